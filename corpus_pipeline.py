"""A corpus pipeline: quality, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again before the next one. All but the last return the columns of documents.

Cases, in every stage: an empty table gives no rows; further columns of the documents are kept, and
columns that a stage needs for itself take names that the documents do not have; null doc_ids and
repeated rows are rows like others (near_duplicates keeps one of repeated rows); very long texts are
read whole. Each stage states what becomes of null and empty texts and of ties.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.llm import _arrow, jaccard, language, packing, quality, secrets

QUALITY_LEAST = 0.5
LANGUAGE_LEAST = 0.4


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is QUALITY_LEAST or more.

    Null and empty texts are scored as empty ones; a score of exactly QUALITY_LEAST stays; equal
    texts have equal scores.
    """
    _arrow.small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, F.lit(True))
    out = _free(docs, "_quality")
    return quality.score(docs, model, tuple(docs.columns), out).filter(F.col(out) >= QUALITY_LEAST).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows, with a pooled probability of LANGUAGE_LEAST or more.

    Null and empty texts, and texts without a letter, go; a probability of exactly LANGUAGE_LEAST stays.
    """
    _arrow.small_batches(spark)
    net = language.train(docs, F.lit(True))
    named, sure = _free(docs, "_language"), _free(docs, "_sure")
    found = language.identify(docs, net, tuple(docs.columns), (named, sure))
    return found.filter((F.col(named) != "und") & (F.col(sure) >= LANGUAGE_LEAST)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect, by the least doc_id (null last) and text hash.

    Null, empty and wordless texts stay, equal ones under the same doc_id once. The decision goes by
    doc_id and text hash together, so a row keeps its place when another text has its doc_id; of
    rows with the same doc_id and text any one stays.
    """
    _arrow.small_batches(spark)
    h, other, theirs = _free(docs, "_h"), _free(docs, "_id"), _free(docs, "_hash")
    away = jaccard.join(docs, by_row=True).filter("not stays").select(F.col("doc_id").alias(other), F.col("text_hash").alias(theirs)).distinct()
    rows = docs.withColumn(h, F.xxhash64("text"))
    kept = rows.join(away, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(h) == F.col(theirs)), "left_anti")
    return kept.dropDuplicates(["doc_id", h]).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in the place of each secret and n_chars to match.

    Null and empty texts stay as they are; of overlapping findings the longest secret is replaced;
    a score of exactly the threshold is a secret.
    """
    _arrow.small_batches(spark)
    forest = secrets.train(secrets.labelled_findings())
    out = _free(docs, "_findings")
    found = secrets.scan(docs, forest, tuple(docs.columns), redact="[SECRET]", out=out)
    changed = F.exists(out, lambda f: f["secret"])
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in training sequences; a null or empty text is its end token alone."""
    _arrow.small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None  # models and a tokenizer; tests hold what the stages keep and make against the models' scores, all pairs and the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, with a written table between each two."""
    root = f"{_arrow.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
