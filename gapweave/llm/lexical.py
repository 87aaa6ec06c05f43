"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Terms are maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII, known by
64-bit hashes. A posting's impact is w * ((10^9 tf) div (1000 tf + 20 m)) with w = floor(1000 ln((2N + 2) / (2 df + 1)))
and m = 50 + (50 n N) div L; a document's score for an item is the sum of the impacts of the item's terms.

`build` reads the documents once. A bitmap of fixed size, folded from the items' terms, keeps other terms out of
the shuffle; N, L and the document frequencies count all documents. Postings are dealt to ranges of (term, impact) and
stored in falling order of impact, so a term that most documents hold is spread over many tasks.

`search` goes through three phases for all items together:
1. The heads of all lists (k postings each) give partial sums; the HEADS * k best documents of an item are looked up, and
   the k-th highest of their scores is a lower bound of the result's last score (0 if there are fewer).
2. With m lists, every list sends its postings of bound / m or more: a document in none of these scores less than the bound. Each
   posting travels once, to the partition of its document, whatever the number of items that want it. A sum, with threshold - 1 for
   each list that has not sent the document, bounds a score from above; candidates are documents that can
   still reach the bound, and then the k-th highest of the sums.
3. The candidates' missing postings are looked up by document and the scores are exact.

Cases: null texts, and texts without a term, are no documents (they count in neither N nor L); an item without terms, or without
hits, has no rows; rows with the same item_id (null too) are one item with the terms of all its texts; rows with the
same doc_id and repeated rows are documents of their own; equal scores go by doc_id, null last, then by the
row's place in the table; very long texts are read whole; an empty table of either kind gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ship
from . import _arrow

K = 50
HEADS = 4  # documents looked up for the first bound, as a multiple of k
FILTER_BITS = 1 << 22  # of the bitmap of wanted terms; more terms only let more unwanted ones through, which a join drops
BROADCAST_ROWS = 200_000  # rows of up to 60 bytes


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def term_counts(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """term, row, id, tf and n (all terms of the text) of (id, row, text); with `wanted` (flags by low bits) of such terms only.

    A row with a null term brings for a batch the number of texts with a term (tf) and of all their terms (n).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = every = 0
            for part in _arrow.slices(batch, "text"):
                h, bounds = _arrow.word_hashes(*_arrow.utf8(part.column("text")), apart=_arrow.NO_TERM)
                sizes = np.diff(bounds)
                some, every = some + int((sizes > 0).sum()), every + len(h)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                if wanted is not None:
                    good = wanted[(h & np.uint64(len(wanted) - 1)).astype(np.int64)]
                    doc, h = doc[good], h[good]
                if not len(h):
                    continue
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
                doc, tf = doc[first], np.diff(np.append(first, len(h)))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), part.column("row").take(at), part.column("id").take(at), pa.array(tf), pa.array(sizes[doc])], ["term", "row", "id", "tf", "n"])
            yield pa.RecordBatch.from_pydict({"term": [None], "row": [None], "id": [None], "tf": [some], "n": [every]}, pa.schema([(c, pa.int64()) for c in ("term", "row", "id", "tf", "n")]))

    return texts.select("id", "row", "text").mapInArrow(run, "term long, row long, id long, tf long, n long")


def wanted_flags(terms: DataFrame) -> np.ndarray:
    """True at the low bits of each term; bitmaps of a fixed number of buckets are all that reaches the driver."""
    place = F.col("term").bitwiseAND(FILTER_BITS - 1) + 1  # bitmap positions count from 1
    maps = terms.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS, bool)
    for r in maps:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        out[(r["b"] - 1) * len(bits) : r["b"] * len(bits)] = bits
    return out


def build(docs: DataFrame, items: DataFrame, path: str) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(lists, asked, sent): postings term, impact, row, id; item, term and the item's number of lists; a broadcast of tables of the size of `asked` if it was counted to be small."""
    spark = docs.sparkSession
    asked = term_counts(items).filter("term is not null").select(F.col("id").alias("item"), "term").distinct().checkpoint()
    wanted = asked.select("term").distinct()
    term_counts(docs, wanted_flags(wanted)).write.parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    total = raw.filter("term is null").agg(F.sum("tf").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    df = raw.filter("term is not null").groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weights = df.select("term", weight.alias("w")).filter("w > 0").checkpoint()
    asked = asked.join(weights.select("term"), "term").withColumn("m", F.count("*").over(Window.partitionBy("item"))).checkpoint()
    sent = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda x: x)
    postings = raw.join(sent(weights), "term")
    impact = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 20 * (50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L)))")
    postings = postings.select("term", impact.alias("impact"), "row", "id").filter("impact > 0")
    order = ["term", F.desc("impact"), "row"]
    postings.repartitionByRange(_partitions(spark), *order).sortWithinPartitions(*order).write.parquet(f"{path}/lists")
    return spark.read.parquet(f"{path}/lists"), asked, sent


def _highest(df: DataFrame, by: str, order: list, k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group; what a partition cannot bring among them is dropped before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(out) <= k)


def _looked_up(lists: DataFrame, pairs: DataFrame, asked: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """item, row, id and the whole score of pairs (item, row)."""
    rows = pairs.select("row").distinct().checkpoint()
    few = F.broadcast if rows.count() <= BROADCAST_ROWS else (lambda x: x)
    found = lists.join(few(rows), "row", "left_semi").join(pairs.select("item", "row"), "row").join(sent(asked.select("item", "term")), ["item", "term"])
    return found.groupBy("item", "row").agg(F.min("id").alias("id"), F.sum("impact").alias("score"))


def top(lists: DataFrame, asked: DataFrame, sent: Callable[[DataFrame], DataFrame], path: str, k: int = K) -> DataFrame:
    """item, rank, id and score of the k highest-scoring documents of each item."""
    spark = lists.sparkSession
    heads = _highest(lists, "term", [F.desc("impact"), "row"], k)
    partial = heads.join(sent(asked), "term").groupBy("item", "row").agg(F.sum("impact").alias("s"))
    best = _highest(partial, "item", [F.desc("s"), "row"], HEADS * k).select("item", "row").checkpoint()
    bound = _highest(_looked_up(lists, best, asked, sent), "item", [F.desc("score"), "row"], k).filter(F.col("rank") == k).select("item", F.col("score").alias("bound"))
    asked = asked.join(bound, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    asked = asked.withColumn("least", F.expr("greatest(1, (bound + m - 1) div m)")).checkpoint()

    lowest = asked.groupBy("term").agg(F.min("least").alias("lowest"))
    moved = lists.join(sent(lowest), "term").filter("impact >= lowest").select("row", "id", "term", "impact").repartition(_partitions(spark), "row")
    sums = moved.join(sent(asked), "term").filter("impact >= least").groupBy("row", "item").agg(F.min("id").alias("id"), F.sum("impact").alias("s"), F.count("*").alias("seen"), *(F.first(c).alias(c) for c in ("m", "least", "bound")))
    sums.withColumn("most", F.expr("s + (m - seen) * (least - 1)")).filter("most >= bound").select("item", "row", "s", "most").write.parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums")
    kth = _highest(sums, "item", [F.desc("s"), "row"], k).filter(F.col("rank") == k).select("item", F.col("s").alias("kth"))
    candidates = sums.join(sent(kth), "item", "left").filter("kth is null or most >= kth").select("item", "row").checkpoint()

    scored = _looked_up(lists, candidates, asked, sent)
    return _highest(scored, "item", [F.desc("score"), F.asc_nulls_last("id"), "row"], k)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of each item."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    items = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].cast("string").alias("text"))
    asked = items.select(F.xxhash64("item_id").alias("id"), F.lit(0).cast("long").alias("row"), "text")  # one to one, and null is a key too
    names = items.select(F.xxhash64("item_id").alias("item"), "item_id").distinct()
    with _arrow.scratch(spark, "lexical") as path:
        lists, terms, sent = build(rows, asked, path)
        found = top(lists, terms, sent, path, k).join(names, "item")
        return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score").checkpoint()
