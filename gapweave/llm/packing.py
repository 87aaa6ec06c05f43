"""Harmonic packing of token documents into training sequences, without a shuffle.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k]
and each of its bins takes exactly k pieces. Every task fills the bins of its own partition.
A document gives full sequences of C tokens first. Its remainder is cut down to the upper end
of the next class while packing it whole would waste more than `waste` of a bin, so bins end
nearly full. What is still open when a task ends is laid end to end, cut at C, and the last
rest is cut into powers of two, which need no padding.

Cases: a null or empty text is one token (the end id); null doc_ids and repeated rows are packed
like any row; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import ship
from . import _arrow, _tokens

CAPACITY = 4096
WASTE = 0.01
FINE = 32  # from this class on, pieces are short enough to be packed as they are

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


def cuts(total: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document with `total` tokens."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        piece = rest if k >= FINE or capacity - k * rest <= waste * capacity else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


def padded(tokens: int, capacity: int = CAPACITY) -> int:
    """Stored length of a sequence: the capacity, or its own length at a power of two."""
    return tokens if tokens & (tokens - 1) == 0 else capacity


class _Worker:
    """The bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, base: int, with_ids: bool):
        self.capacity, self.next, self.with_ids = capacity, base, with_ids
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at, tokens = 0, sum(len(p[2]) for p in pieces)
        for doc, start, ids, total in pieces:
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next, at, tokens, padded(tokens, self.capacity)) + ((ids.tolist(),) if self.with_ids else ()))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for n in cuts(len(ids), self.capacity):
            k = self.capacity // n
            # a copy, as the pending piece must not hold its whole batch in memory
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[start : start + n].copy(), len(ids)))
            if len(bin_) == k:
                self.close(self.open.pop(k))
            start += n

    def finish(self) -> None:
        """Cut what is open into full sequences, then into powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            got = []
            while size:
                doc, start, ids, tokens = left.pop()
                got.append((doc, start, ids[:size], tokens))
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:], tokens))
                size -= len(got[-1][2])
            self.close(got)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the documents' token ids, with their sequence and place in it.

    `tokenizer` is the path of a vocabulary file on the executors. With `with_ids` the pieces
    carry their ids. Sequence ids are unique, not dense: the task's number stands in the high bits.
    """
    ship(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    path = tokenizer or _tokens.tokenizer_path("word_bpe_49k.json")
    types = [pa.int64()] * 9 + [pa.list_(pa.int32())] * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.encoder(path)
        worker = _Worker(capacity, TaskContext.get().partitionId() << 40, with_ids)

        def out():
            columns = list(zip(*worker.rows))
            worker.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                ids, at = encoder.encode(part.column("text"))
                edges = at.tolist()
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    worker.add(doc, np.append(ids[edges[k] : edges[k + 1]], np.uint32(end_id)))
                if len(worker.rows) >= (500 if with_ids else 20_000):
                    yield out()
        worker.finish()
        if worker.rows:
            yield out()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)
