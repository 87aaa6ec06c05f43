"""Token ids of whole texts through a per-process cache of space-free chunks."""

from __future__ import annotations

import json
import os
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _arrow

CACHE_CHARS = 3_000_000
LINE = 64  # pieces that the tokenizer takes at once
#: Letters without marks of their own, then signs other than the apostrophe: two pieces for SPLIT, whatever stands beside them.
LETTERS, SIGNS = r"[A-Za-zÀ-ÖØ-öø-ÿ]*", r"[!-&(-/:-@\[-`{-~]*"
SIMPLE = re.compile(LETTERS + SIGNS)
PARTS = re.compile(f"^(?:({LETTERS})({SIGNS})|(.*))$", re.M)  # letters and signs of a line, or all of it
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"  # behind the last token of a word, in vocabularies that mark it
BREAK = np.zeros(256, bool)  # what separates chunks
BREAK[[9, 10, 13, 32]] = True


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies: in `folder`, or in the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _lowers_and_splits(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, cuts texts by SPLIT, encodes what lies between the cuts by itself and marks its last token."""
    spec = json.loads(tokenizer.to_str())
    model = spec["model"]
    lower = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    cut, bytes_ = ((spec["pre_tokenizer"] or {}).get("pretokenizers", []) + [{}, {}])[:2]
    cuts = cut.get("pattern") == {"Regex": SPLIT} and cut["behavior"] == "Removed" and cut["invert"] and bytes_.get("type") == "ByteLevel" and not (bytes_["add_prefix_space"] or bytes_["use_regex"])
    marks = model.get("type") == "BPE" and model.get("end_of_word_suffix") == END and not model.get("dropout") and spec["truncation"] is None and spec["padding"] is None
    return lower and bool(cuts) and marks and not any(SIMPLE.fullmatch(t["content"]) for t in spec["added_tokens"])


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, one span after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class ChunkEncoder:
    """Encodes texts chunk by chunk, where spaces, tabs and line ends are bounds no token crosses.

    It suits tokenizers that drop white space. Arrow finds the distinct chunks of a call; each is
    encoded once; when the cache holds more than CACHE_CHARS characters, only the chunks that were met
    most often stay, half as many characters at most. Where the tokenizer's rules allow it, a chunk of
    letters and signs after them takes the ids of its lower-cased letters and of its signs, and many
    such pieces are encoded in one line: the mark of a word's last token tells where each ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.simple = _lowers_and_splits(self.tokenizer)
        if self.simple:  # the same model for pieces that are lower-cased and cut already
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[k for t, k in vocabulary.items() if t.endswith(END)]] = True
        self._clear()

    def _shed(self) -> None:
        words, n = list(self.index), len(self.index)
        order = np.argsort(-self.met[:n], kind="stable")
        chars = np.cumsum(np.fromiter(map(len, words), np.int64, n)[order])
        keep = order[(self.met[order] > 1) & (chars <= CACHE_CHARS // 2)]
        keep = keep[keep > 0]
        size = self.size[keep]
        ids = self.ids[_spans(self.start[keep], size)]
        self._clear()
        self.index.update(zip((words[k] for k in keep.tolist()), range(1, len(keep) + 1)))
        self._set(len(keep), self._put(ids) + np.cumsum(size) - size, size)

    def _clear(self) -> None:
        self.index = _Numbers({"": 0})
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.met, self.chars = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _put(self, ids: np.ndarray) -> int:
        """Where these ids lie from now on."""
        at = self.used
        self.used += len(ids)
        while len(self.ids) < self.used:
            self.ids = np.concatenate([self.ids, self.ids * 0])
        self.ids[at : self.used] = ids
        return at

    def _set(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """Where the ids of the n chunks lie that were numbered last."""
        to = len(self.index)
        while len(self.start) < to:
            self.start, self.size, self.met = (np.concatenate([x, x * 0]) for x in (self.start, self.size, self.met))
        self.start[to - n : to], self.size[to - n : to] = start, size
        self.chars += sum(map(len, islice(self.index, to - n, None)))

    def _encode(self, pieces: list[str], cut: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has; `cut`: they are lower-cased, and one word each."""
        if cut and len(pieces) >= LINE:
            lines = [" ".join(pieces[k : k + LINE]) for k in range(0, len(pieces), LINE)]
            found = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(lines, add_special_tokens=False)]
            ids = np.concatenate(found)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(pieces) and ends[-1] == len(ids):  # else the vocabulary lacks letters
                return ids, np.diff(ends, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _add(self, new: list[str]) -> None:
        """Encode the chunks that were numbered last."""
        n = len(self.index) - len(new)
        parts = PARTS.findall("\n".join(new)) if self.simple else [("", "", w) for w in new]
        letters, signs, odd = zip(*parts)
        number = _Numbers({"": 0})
        tails = np.fromiter(map(number.__getitem__, signs), np.int64, len(new))
        odd = np.fromiter(map(number.__getitem__, odd), np.int64, len(new))
        heads = np.fromiter(map(number.__getitem__, map(str.lower, letters)), np.int64, len(new)) + odd
        known = np.fromiter((self.index.get(p, n) for p in number), np.int64, len(number))
        plain, fresh, pieces = np.ones(len(number), bool), known >= n, list(number)
        plain[odd], known[fresh] = False, 0
        start, size = self.start[known], self.size[known]
        for cut in (True, False):
            these = np.flatnonzero(fresh & (plain == cut))
            ids, size[these] = self._encode([pieces[k] for k in these.tolist()], cut)
            start[these] = self._put(ids) + np.cumsum(size[these]) - size[these]
        first, many = start[heads], size[heads]
        two = np.flatnonzero(tails)
        both = np.stack([heads[two], tails[two]], 1).ravel()
        many[two] += size[tails[two]]
        first[two] = self._put(self.ids[_spans(start[both], size[both])]) + np.cumsum(many[two]) - many[two]
        self._set(len(new), first, many)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n + 1 places where texts begin; null counts as empty."""
        if self.chars > CACHE_CHARS:
            self._shed()
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        buf, at = _arrow.utf8(pc.binary_join_element_wise(pc.fill_null(texts, ""), " ", ""))
        apart = BREAK[buf]
        starts = np.flatnonzero(np.append(True, apart))  # a chunk holds the break behind it
        chunks = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.where(apart, np.uint8(32), buf))).dictionary_encode()
        which, n = chunks.indices.to_numpy(), len(self.index)
        words = str(_arrow.utf8(chunks.dictionary)[0], "utf-8").split(" ")[:-1]
        try:
            places = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            if new := list(islice(self.index, n, None)):
                self._add(new)
        except BaseException:  # numbered without ids
            self._clear()
            raise
        self.met[places] += np.bincount(which, minlength=len(words))
        size = self.size[places][which]
        out = self.ids[_spans(self.start[places][which], size)]
        return out, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, at)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
