"""Delta-maintained rollups of token counts.

A store is a folder of batches. Each batch holds signed deltas of document and token counts by
source, language and tokenizer version, added up before they are written: inserts count +1 and
+n, deletes -1 and -n, revised counts 0 and new - old. Totals are the sum of all committed
batches, so they are additive and any coarser level is a sum of them. A batch is committed by
the writer's success mark; a batch id that is committed already is left as it is, and one that
broke off is written anew, so each batch counts once however often it is sent.

Cases: null sources, languages and versions are groups of their own; null counts are 0; rows
with an unknown operation are an error; an empty batch commits nothing but its mark; totals of an
empty store are no rows; groups whose documents and tokens are both 0 are not shown; further
columns of the changes are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from . import _arrow, _tokens

KEYS = ("source", "lang", "tokenizer_version")
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, version: str = "word_bpe_49k", folder: str | None = None, keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """`keep` columns, tokenizer_version and n_tokens of every whole text (null: 0)."""
    ship(docs.sparkSession)
    path = _tokens.tokenizer_path(f"{version}.json", folder)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.encoder(path)
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                _, at = encoder.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([version] * part.num_rows), pa.array(np.diff(at))], [*keep, "tokenizer_version", "n_tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokenizer_version string, n_tokens long"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes: op (insert, delete or revise), KEYS, n_tokens, for revise old_n_tokens, and rows if a change stands for several equal ones."""
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0)) if "old_n_tokens" in changes.columns else F.lit(0)
    kind = F.col("op")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - old)
    many = F.col("rows") if "rows" in changes.columns else F.lit(1)
    return changes.groupBy(*KEYS).agg(F.sum((docs * many).cast("long")).alias("n_docs"), F.sum((tokens * many).cast("long")).alias("n_tokens"))


class Store:
    """Committed batches in a folder that every executor and the driver reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, at: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(p)

    def batches(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        return [n.removeprefix("batch=") for n in names if n.startswith("batch=") and self.committed(n.removeprefix("batch="))]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write a batch's deltas; False if the batch id was committed before."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("batch ids consist of letters, digits, hyphens and underscores")
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self, *keys: str) -> DataFrame:
        """n_docs and n_tokens by the given keys (all KEYS by default)."""
        keys = keys or KEYS
        found = self.batches()
        rows = self.spark.read.schema(DELTAS).parquet(*(f"{self.path}/batch={b}" for b in found)) if found else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def replay(docs: DataFrame, version: str = "word_bpe_49k", folder: str | None = None) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice.

    All documents come in; one row of each text stays, the one with the least doc_id, or, where
    no row has one, without; among equal ids the least source and language decide, and of
    repeated rows one stays. The other rows go; the counts of what stays are revised to
    include an end token; the revision is sent again.
    """
    spark = docs.sparkSession
    with _arrow.scratch(spark, "counts") as root:
        fields = docs.select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.coalesce(F.hash("text"), F.lit(0)).alias("h2"))
        count_tokens(fields, version, folder, ("doc_id", "source", "lang", "h", "h2")).write.parquet(f"{root}/ledger")
        ledger = spark.read.parquet(f"{root}/ledger")
        store = Store(spark, f"{root}/store")
        store.commit("load", ledger.withColumn("op", F.lit("insert")))
        # a text's copies are counted by source and language before they meet the one that stays: no task sees them one by one
        text = ["h", "h2"]
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("source").alias("s"), F.col("lang").alias("l"))).alias("first")
        first = ledger.groupBy(*text).agg(least).select(*text, "first.s", "first.l")
        copies = ledger.groupBy(*text, *KEYS, "n_tokens").agg(F.count("*").alias("n"))
        marked = copies.join(first, text).withColumn("stays", F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")))
        gone = marked.withColumn("rows", F.col("n") - F.col("stays").cast("long")).filter("rows > 0")
        store.commit("copies", gone.withColumn("op", F.lit("delete")))
        revised = marked.filter("stays").select(*KEYS, F.lit("revise").alias("op"), F.col("n_tokens").alias("old_n_tokens"), (F.col("n_tokens") + 1).alias("n_tokens"))
        store.commit("end-token", revised)
        store.commit("end-token", revised)
        return store.totals().checkpoint()
