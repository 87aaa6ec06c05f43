"""The engine's tables as views over the benchmark tables, in Spark and in DuckDB SQL.

Expressions both dialects share are written once. `fact` stands for the results table and
`patches` for 8x8 rasters with a mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import let
from ..operators.raster import value_range

OK = "not (l_linestatus = 'F' and l_quantity < 3)"
FACT = {
    "order_id": "l_orderkey",
    "line_no": "cast(l_linenumber as int)",
    "seed": "cast(l_orderkey % 3 as int)",
    "noise_level": "case l_linenumber % 4 when 0 then 'inf' when 1 then '40' when 2 then '30' else '20' end",
    "method": "o_orderpriority",
    "method_category": "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'spatial' else 'transform' end",
    "patch_id": "l_partkey",
    "satellite": "l_returnflag",
    "split": "case when l_orderkey % 10 < 8 then 'train' when l_orderkey % 10 = 8 then 'val' else 'test' end",
    "gap_fraction": "l_discount",
    "status": f"case when {OK} then 'ok' else 'error' end",
    "elapsed_s": "l_tax",
    "entropy_7": "l_quantity / 10",
    "entropy_15": "l_tax * 50",
    "psnr": f"case when {OK} then l_extendedprice / 2000 end",
    "ssim": f"case when {OK} then 0.6 + l_extendedprice / 400000 end",
    "rmse": f"case when {OK} then power(10, -l_extendedprice / 40000) end",
}
#: DuckDB common table expressions; a query adds its own behind.
FACT_SQL = "fact AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FACT.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
PIXELS_SQL = """raw AS (SELECT vec_id AS patch_id, CAST(unnest(embedding) AS DOUBLE) AS v0, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
rng AS (SELECT patch_id, min(v0) AS lo, CASE WHEN max(v0) - min(v0) < 1e-8 THEN 1 ELSE max(v0) - min(v0) END AS span FROM raw GROUP BY patch_id),
px AS (SELECT patch_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(0 AS INT) AS b, (v0 - lo) / span AS v, CAST((patch_id * 7 + p * 13) % 10 < 3 AS INT) AS gap FROM raw JOIN rng USING (patch_id))"""
BANDS_SQL = PIXELS_SQL.replace("p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, CAST(0 AS INT) AS b", "p // 16 AS INT) AS y, CAST((p // 4) % 4 AS INT) AS x, CAST(p % 4 AS INT) AS b").replace("(patch_id * 7 + p * 13)", "(patch_id * 7 + (p // 4) * 13)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results view; only the columns a query names reach the scans."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.selectExpr(*(f"{e} as {c}" for c, e in FACT.items()))


def patches(spark: SparkSession, sf_dir: str, bands: int = 1) -> DataFrame:
    """patch_id, clean in [0, 1], mask of cells and degraded arrays of 8x8x1 or 4x4x4 rasters."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), "label", F.col("embedding").cast("array<double>").alias("raw"))
    low, span = value_range(F.col("raw"))
    # bound once a row: inside transform() they would be searched for once an element
    clean = let(F.struct(low.alias("lo"), span.alias("span")), lambda s: F.transform("raw", lambda v: (v - s["lo"]) / s["span"]))
    mask = F.transform(F.sequence(F.lit(0), F.lit(64 // bands - 1)), lambda p: ((F.col("patch_id") * 7 + p * 13) % 10 < 3).cast("int"))
    df = raw.select("patch_id", "label", "raw", clean.alias("clean"), mask.alias("mask"))
    degraded = F.transform("clean", lambda v, i: F.when(F.get("mask", F.floor(i / bands).cast("int")) == 1, 0.0).otherwise(v))
    return df.withColumn("degraded", degraded)


def pixel_view(spark: SparkSession, sf_dir: str, bands: int = 1) -> DataFrame:
    """Pixel rows patch_id, y, x, b, v, gap of the patches."""
    width = 8 if bands == 1 else 4
    p = F.col("p")
    rows = patches(spark, sf_dir, bands).select("patch_id", "mask", F.posexplode("clean").alias("p", "v"))
    cell = F.floor(p / bands).cast("int")
    return rows.select("patch_id", F.floor(cell / width).cast("int").alias("y"), (cell % width).cast("int").alias("x"), (p % bands).cast("int").alias("b"), "v", F.get("mask", cell).alias("gap"))
