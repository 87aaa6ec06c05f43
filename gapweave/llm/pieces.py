"""SentencePiece encoding and decoding by Viterbi passes over a trie of distinct marked words.

A word is a run of space marks and the characters behind it up to a line's end; no piece of the
vocabulary crosses from a character to a mark or over a line's end, so words are encoded alone.
Distinct words of a slice are sorted; walking them in this order is a depth-first traversal of
their trie. For each prefix the best score of its segmentations into pieces and the length of the
last piece stand on a stack, so words with a common prefix use its forward scores again.

A segmentation's score is the sum of its pieces' scores in the vocabulary file. A character
without a piece is written in byte pieces, each BYTE_PENALTY below the least score. Of equal
scores the longest last piece wins. The public vocabulary was made by merges, and merging gives
other pieces than the best score for some words; `merges` asks for the library's ids instead.

Cases: null is an empty text; an empty text has no ids; words and texts of any length are encoded
alike; decoding restores every text exactly but for U+2581, which stands for a space; null doc_ids
and repeated rows are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import _arrow, _tokens

MARK = "▁"
CACHE_CHARS, CACHE_PAIRS = 12_000_000, 600_000
BYTE_PENALTY = 10.0
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Model:
    """Pieces, their scores and the forward pass of one vocabulary file."""

    def __init__(self, path: str, merges: bool = False):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [0] * 256
        self.rank: dict[str, int] = {}
        self.id: dict[str, int] = {}
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p] = i
                self.rank[p] = -sp.get_score(i)
        self.merges = merges
        self.score = {p: -r for p, r in self.rank.items()}
        self.byte_score = min(self.score.values(), default=0.0) - BYTE_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces of this vocabulary cross word bounds")
        if any("\n" in p for p in self.id):
            raise ValueError("pieces of this vocabulary cross line ends")
        ends: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: lengths of the pieces that end in two given characters, longest first
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.start, self.size, self.chars = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def merge(self, text: str) -> list[str]:
        """The merge encoding of a short text, by definition: best rank first, leftmost of equals."""
        parts, none = list(text), 1e18
        ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = self.rank.get(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = self.rank.get(parts[k] + parts[k + 1], none)
        return parts

    def merge_long(self, text: str) -> list[str]:
        """The same with a heap, for words of any length."""
        n = len(text)
        part, left, right = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.rank[text[k : k + 2]], k, 2) for k in range(n - 1) if text[k : k + 2] in self.rank]
        heapify(heap)
        while heap:
            _, k, size = heappop(heap)
            r = right[k]
            if part[k] is None or r >= n or len(part[k]) + len(part[r]) != size:
                continue
            part[k] += part[r]
            part[r] = None
            right[k] = right[r]
            if right[k] < n:
                left[right[k]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b < n and (joint := part[a] + part[b]) in self.rank:
                    heappush(heap, (self.rank[joint], a, len(joint)))
        return [p for p in part if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merges leave the pieces a and b side by side; never if they make a piece together."""
        known = self.fits.get((a, b))
        if known is None:
            if a + b in self.rank:
                return False
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def step(self, word: str, states: list[str], at: int) -> str:
        """The last piece of the merge encoding of word[:at], given those of all shorter prefixes."""
        for size in self.ends.get(word[at - 2 : at], ()) if at > 1 else ():
            if size <= at:
                p = word[at - size : at]
                if p in self.rank and (size == at or self.compatible(states[at - size], p)):
                    return p
        return word[at - 1]

    def forward(self, words: list[str]) -> Iterator[list[str]]:
        """Best segmentations of sorted distinct words; forward scores of the prefix shared with the word before are reused."""
        score, ends, single, low = self.score, self.ends, self.score.get, self.byte_score
        best, sizes, before = [0.0], [0], ""
        for w in words:
            same = _shared(before, w)
            del best[same + 1 :], sizes[same + 1 :]
            for at in range(same + 1, len(w) + 1):
                top, length = -1e300, 1
                for size in ends.get(w[at - 2 : at], ()) if at > 1 else ():
                    if size <= at and (s := score.get(w[at - size : at])) is not None and (s := s + best[at - size]) > top:
                        top, length = s, size
                s = single(w[at - 1])
                if (s := best[at - 1] + (low * len(w[at - 1].encode()) if s is None else s)) > top:
                    top, length = s, 1
                best.append(top)
                sizes.append(length)
            before = w
            out, at = [], len(w)
            while at:
                out.append(w[at - sizes[at] : at])
                at -= sizes[at]
            out.reverse()
            yield out

    def merged(self, words: list[str]) -> Iterator[list[str]]:
        """Merge encodings of sorted distinct words: the state of a prefix is the one last piece that merges allow."""
        states, before = [""], ""
        for w in words:
            if len(w) > 4096:  # the same result by a heap, without a state for each of its prefixes
                yield self.merge_long(w)
                continue
            same = _shared(before, w)
            del states[same + 1 :]
            for at in range(same + 1, len(w) + 1):
                states.append(self.step(w, states, at))
            before = w
            out, at = [], len(w)
            while at:
                out.append(states[at])
                at -= len(states[at])
            out.reverse()
            yield out

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.id.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in p.encode()]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n + 1 places where texts begin."""
        if self.chars > CACHE_CHARS:
            self._clear()
        parts = [_split(t) for t in texts]
        flat = [w for p in parts for w in p]
        if new := sorted({w for w in flat if w not in self.index}):
            found = [self.numbers(p) for p in (self.merged(new) if self.merges else self.forward(new))]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])
            self.size = np.concatenate([self.size, sizes])
            self.chars += sum(map(len, new))
            for k, w in enumerate(new, len(self.index)):
                self.index[w] = k
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(total)], np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes one after another, marks as spaces, without the first."""
        if not hasattr(self, "raw"):
            self.raw = [p.replace(MARK, " ").encode() for p in self.piece]
            for b, i in enumerate(self.byte):
                self.raw[i] = bytes([b])
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _shared(a: str, b: str) -> int:
    """The length of the common prefix of two texts."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def _split(text: str | None) -> list[str]:
    """Marked words and line ends of a text with its leading mark; no piece crosses either."""
    if not text:
        return []
    out: list[str] = []
    for k, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")):
        if k:
            out.append("\n")
        if MARK * 2 in line or line.endswith(MARK):
            out += _WORDS.findall(line)
        else:
            first, *rest = line.split(MARK)
            if first:
                out.append(first)
            out += [MARK + w for w in rest]
    return out


_models: dict[tuple[str, bool], Model] = {}


def model(path: str, merges: bool = False) -> Model:
    """The model of this process for a vocabulary file."""
    if (path, merges) not in _models:
        _models[path, merges] = Model(path, merges)
    return _models[path, merges]


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", merges: bool = False) -> DataFrame:
    """doc_id, ids array<int>, n_tokens and ids_crc32 (little-endian unsigned 32-bit ids) of every text; `merges` as in the module's docstring."""
    ship(docs.sparkSession)
    path = path or _tokens.tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, merges)
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                ids, at = m.encode(part.column("text").to_pylist())
                raw, edges = ids.astype("<u4"), at.tolist()
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "ids", "n_tokens", "ids_crc32"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long")


def decode(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the text of the ids of every row."""
    ship(encoded.sparkSession)
    path = path or _tokens.tokenizer_path("piece_bpe_32k.model")
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [m.decode(x.values.to_numpy()) if x.is_valid else None for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string")
