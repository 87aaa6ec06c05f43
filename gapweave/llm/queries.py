"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import circulant, counts, fingerprints, jaccard, language, lexical, media, packing, pieces, pii, quality, secrets, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(k: int):
    return F.crc32(F.col("doc_id").cast("string")) % k


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    net = language.train(docs, F.coalesce(_remainder(3) != 1, F.lit(False)))
    found = language.identify(docs, net)
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.labelled_findings())
    found = secrets.scan(_documents(spark, sf_dir), forest)
    kept = F.filter("findings", lambda f: f["secret"])
    spans = F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["start"].cast("string"), f["end"].cast("string"))), ",")
    top = F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(kept).cast("long").alias("n_secrets"), spans.alias("spans"), top.alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, F.coalesce(_remainder(4) != 2, F.lit(False)))
    found = quality.score(docs, model)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.replay(_documents(spark, sf_dir))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(_documents(spark, sf_dir))
    decoded = pieces.decode(encoded, keep=("doc_id", "n_tokens", "ids_crc32"))
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read(media.store(_documents(spark, sf_dir)))
    return found.drop("stamps", "access_points")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.dedup(_documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_secrets, op3_quality, op4_fingerprints, op5_token_counts, op6_ngram_jaccard, op7_pii, op8_sentencepiece, op9_packing, op10_media, op11_lexical_search, op12_near_dedup, op13_whitening)}


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SQL = f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY 1),
b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score FROM b JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY 1, 2),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""


def _components_sql(width: int, percent: int) -> str:
    """node and root (the least doc_id that links reach) over all pairs of sets that share a shingle."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    shingles = f"CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END"
    return f"""WITH RECURSIVE s AS (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, {words} AS w FROM documents)),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
r AS (SELECT node, min(root) AS root FROM c GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id"""


JACCARD_SQL = f"{_components_sql(5, 80)} FROM s JOIN r ON doc_id = node"
DEDUP_SQL = f"{_components_sql(3, 85)}, doc_id = root AS kept FROM s JOIN r ON doc_id = node"


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_jaccard": JACCARD_SQL, "op11_lexical_search": LEXICAL_SQL, "op12_near_dedup": DEDUP_SQL}
