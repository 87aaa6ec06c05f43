"""Registered queries of the relational layer: filters, joins, summaries, ranks, sets and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import order
from ..operators import select as sel
from ..operators import summary as su
from ..schemas import NOISE_LEVELS
from ..session import scratch
from ..sources.sinks import append
from ..sources.tables import parquet, unified_names, union
from .registry import query, r
from .views import FACT_SQL, fact, patches, table

W = f"WITH {FACT_SQL}"
METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _summary_sql(keys: str, spread: bool = True, source: str = "fact") -> str:
    more = ", round(quantile_cont(psnr, 0.5), 6) AS median, round(stddev_pop(psnr), 6) AS std" if spread else ""
    return f"SELECT {keys}, count(psnr) AS n, round(avg(psnr), 6) AS mean{more} FROM {source} WHERE psnr IS NOT NULL GROUP BY {keys}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"{W} {_summary_sql('method')}")
def summary_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(su.by_method(fact(spark, sf)))


@query(f"{W} {_summary_sql('method, satellite')}")
def summary_by_satellite(spark, sf):
    return _rounded(su.summary(fact(spark, sf), ["method", "satellite"]))


@query(f"{W} {_summary_sql('method, noise_level', False)}")
def summary_by_noise(spark, sf):
    return _rounded(su.summary(fact(spark, sf), ["method", "noise_level"], spread=False))


def _bin_sql(column: str, out: str) -> str:
    q = f"q AS (SELECT quantile_cont({column}, 1.0/3) AS lo, quantile_cont({column}, 2.0/3) AS hi FROM fact WHERE psnr IS NOT NULL AND {column} IS NOT NULL)"
    b = f"b AS (SELECT *, CASE WHEN {column} <= lo THEN 'low' WHEN {column} <= hi THEN 'medium' ELSE 'high' END AS {out} FROM fact, q WHERE {column} IS NOT NULL AND psnr IS NOT NULL)"
    return f"{W}, {q}, {b} {_summary_sql(f'method, {out}', False, 'b')}"


@query(_bin_sql("entropy_7", "entropy_bin"))
def summary_by_entropy_bin(spark, sf):
    return _rounded(su.by_bin(fact(spark, sf), "entropy_7", "entropy_bin"))


@query(_bin_sql("gap_fraction", "gap_bin"))
def summary_by_gap_bin(spark, sf):
    return _rounded(su.by_bin(fact(spark, sf), "gap_fraction", "gap_bin"))


@query(f"{W} SELECT method, noise_level, count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in ("psnr", "ssim", "rmse")) + " FROM fact GROUP BY 1, 2")
def summary_multi_metric(spark, sf):
    return _rounded(su.multi_metric(fact(spark, sf), ["method", "noise_level"], ["psnr", "ssim", "rmse"]))


@query(f"{W}, u AS (SELECT 'classical' AS type, method, noise_level, psnr, ssim FROM fact WHERE method_category = 'spatial' UNION ALL SELECT 'dl', method, noise_level, psnr, NULL FROM fact WHERE method_category <> 'spatial') SELECT type, method, noise_level, count(*) AS n, round(avg(psnr), 6) AS psnr_mean, round(stddev_pop(psnr), 6) AS psnr_std, round(avg(ssim), 6) AS ssim_mean, round(stddev_pop(ssim), 6) AS ssim_std FROM u GROUP BY 1, 2, 3")
def combined_comparison(spark, sf):
    f = fact(spark, sf)
    a = f.filter("method_category = 'spatial'").select(F.lit("classical").alias("type"), "method", "noise_level", "psnr", "ssim")
    b = f.filter("method_category <> 'spatial'").select(F.lit("dl").alias("type"), "method", "noise_level", "psnr")
    return _rounded(su.multi_metric(union(a, b), ["type", "method", "noise_level"], ["psnr", "ssim"]))


@query(f"{W}, m AS (SELECT method_category, method, noise_level, avg(psnr) AS m FROM fact GROUP BY 1, 2, 3) SELECT method_category, method, round(avg(m), 6) AS mean FROM m GROUP BY 1, 2")
def mean_of_means(spark, sf):
    inner = fact(spark, sf).groupBy("method_category", "method", "noise_level").agg(F.avg("psnr").alias("m"))
    return _rounded(inner.groupBy("method_category", "method").agg(F.avg("m").alias("mean")))


@query(f"{W} SELECT method, round(avg(psnr), 6) AS psnr, round(avg(ssim), 6) AS ssim, round(avg(rmse), 6) AS rmse FROM fact GROUP BY 1")
def grouped_means(spark, sf):
    return _rounded(fact(spark, sf).groupBy("method").agg(*(F.avg(m).alias(m) for m in ("psnr", "ssim", "rmse"))))


@query(f"{W} SELECT method, count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_error, round(avg(CASE WHEN status <> 'ok' THEN 1.0 ELSE 0 END), 6) AS error_rate, round(coalesce(avg(elapsed_s) FILTER (status = 'ok'), 0), 6) AS mean_elapsed, round(coalesce(quantile_cont(elapsed_s, 0.95) FILTER (status = 'ok'), 0), 6) AS p95_elapsed, round(coalesce(count(*) FILTER (status = 'ok') / sum(elapsed_s), 0), 6) AS throughput, round(avg(psnr) FILTER (status = 'ok'), 6) AS psnr_mean, round(stddev_samp(psnr) FILTER (status = 'ok'), 6) AS psnr_std FROM fact GROUP BY 1")
def run_summary(spark, sf):
    return _rounded(su.run_summary(fact(spark, sf), ["method"], ["psnr"]))


@query("SELECT event_type, count(*) AS n_rows, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.95), 6) AS p95_value, round(stddev_samp(value), 6) AS std_value FROM events GROUP BY 1")
def eval_run_summary(spark, sf):
    events = table(spark, sf, "events")
    got = events.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"))
    p95 = order.quantiles(events, "value", [0.95], ["event_type"]).select("event_type", F.get("q", F.lit(0)).alias("p95_value"))
    return _rounded(order.same_groups(got, p95, ["event_type"], "left"))


@query(f"{W} SELECT method, count(*) AS failures FROM fact WHERE status = 'error' GROUP BY 1")
def failure_counts(spark, sf):
    return fact(spark, sf).filter("status = 'error'").groupBy("method").agg(F.count("*").alias("failures"))


@query(f"{W}, c AS (SELECT split, count(*) AS n FROM fact GROUP BY 1) SELECT split, n, round(n / (SELECT sum(n) FROM c), 6) AS share, abs(n / (SELECT sum(n) FROM c) - CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END) <= 0.01 AS ok FROM c")
def split_ratio(spark, sf):
    return _rounded(su.shares(fact(spark, sf), "split", {"train": 0.8, "val": 0.1, "test": 0.1}))


@query(f"{W} SELECT satellite, round(quantile_cont(entropy_7, 1.0/3), 6) AS lo, round(quantile_cont(entropy_7, 2.0/3), 6) AS hi FROM fact WHERE split = 'train' GROUP BY 1")
def entropy_cutoffs(spark, sf):
    return _rounded(sel.cutoffs(sel.only(fact(spark, sf), "train"), "entropy_7", by=["satellite"]))


@query(f"{W}, q AS (SELECT satellite, quantile_cont(entropy_7, 1.0/3) AS lo, quantile_cont(entropy_7, 2.0/3) AS hi FROM fact WHERE split = 'train' GROUP BY 1) SELECT f.order_id, f.line_no, f.entropy_7 FROM fact f JOIN q USING (satellite) WHERE entropy_7 <= lo OR entropy_7 > hi")
def bucket_filter(spark, sf):
    f = fact(spark, sf)
    return sel.in_buckets(f, "entropy_7", sel.cutoffs(sel.only(f, "train"), "entropy_7", by=["satellite"]), [" Low", "HIGH"], by=["satellite"]).select("order_id", "line_no", "entropy_7")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) END AS entropy_text FROM events WHERE event_id % 7 <> 0 AND (event_id % 100 <= 20 OR event_id % 100 > 70)")
def bucket_filter_cast(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("event_id") % 100).cast("string")).alias("entropy_text"))
    return sel.in_buckets_text(e, "entropy_text", 20, 70, ["low", "high", "unknown"])


@query(f"{W}, q AS (SELECT quantile_cont(gap_fraction, 1.0/3) AS lo, quantile_cont(gap_fraction, 2.0/3) AS hi FROM fact) SELECT CASE WHEN gap_fraction <= lo THEN 'low' WHEN gap_fraction <= hi THEN 'medium' ELSE 'high' END AS gap_bin, CASE WHEN gap_fraction <= lo THEN 0 WHEN gap_fraction <= hi THEN 1 ELSE 2 END AS bin_ord, count(*) AS n, min(gap_fraction) AS least, max(gap_fraction) AS most FROM fact, q GROUP BY 1, 2")
def tercile_bin(spark, sf):
    return sel.terciles(fact(spark, sf), "gap_fraction", "gap_bin").groupBy("gap_bin", "bin_ord").agg(F.count("*").alias("n"), F.min("gap_fraction").alias("least"), F.max("gap_fraction").alias("most"))


@query(f"{W} SELECT order_id, line_no, patch_id FROM fact WHERE split = 'train' AND satellite = 'R'")
def train_filter(spark, sf):
    return sel.only(fact(spark, sf), "train", "R").select("order_id", "line_no", "patch_id")


@query(f"{W} SELECT method, count(*) AS n FROM fact WHERE method IN ('1-URGENT', '5-LOW') AND satellite IN ('A', 'N') GROUP BY 1")
def in_set_filter(spark, sf):
    f = fact(spark, sf)
    return f.filter(F.col("method").isin("1-URGENT", "5-LOW") & F.col("satellite").isin("A", "N")).groupBy("method").agg(F.count("*").alias("n"))


@query(f"{W} SELECT order_id, line_no, psnr, ssim FROM fact WHERE psnr IS NOT NULL AND ssim IS NOT NULL AND entropy_7 IS NOT NULL")
def drop_incomplete(spark, sf):
    return fact(spark, sf).na.drop(subset=["psnr", "ssim", "entropy_7"]).select("order_id", "line_no", "psnr", "ssim")


_MANIFEST = "SELECT p_partkey AS patch_id, p_brand AS satellite, " + ", ".join(f"CASE WHEN p_size % 5 <> {i} THEN concat('d/', p_partkey, '_{n}.npy') END AS degraded_{n}_path" for i, n in enumerate(NOISE_LEVELS)) + " FROM part"


def _manifest(spark, sf) -> DataFrame:
    paths = (F.when(F.col("p_size") % 5 != i, F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(f"_{n}.npy"))).alias(f"degraded_{n}_path") for i, n in enumerate(NOISE_LEVELS))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), F.col("p_brand").alias("satellite"), *paths)


@query(f"WITH m AS ({_MANIFEST}) " + " UNION ALL ".join(f"SELECT patch_id, satellite, '{n}' AS noise_level, degraded_{n}_path AS degraded_path FROM m WHERE degraded_{n}_path IS NOT NULL" for n in NOISE_LEVELS))
def noise_unpivot(spark, sf):
    return sel.noise_rows(_manifest(spark, sf))


@query("WITH n AS (SELECT unnest(['inf', '40']) AS noise_level), m AS (SELECT unnest(['idw', 'rbf', 'dct']) AS method) SELECT p_partkey AS patch_id, noise_level, method FROM part, n, m")
def work_list_cross(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"))
    return sel.work_list(p, spark.createDataFrame([("idw",), ("rbf",), ("dct",)], "method string"), spark.createDataFrame([("inf",), ("40",)], "noise_level string")).select("patch_id", "noise_level", "method")


@query(f"{W} SELECT seed, noise_level, method, count(*) AS tasks FROM fact GROUP BY 1, 2, 3")
def work_size(spark, sf):
    return fact(spark, sf).groupBy("seed", "noise_level", "method").agg(F.count("*").alias("tasks"))


_TASKS = "t AS (SELECT DISTINCT seed, noise_level, method, patch_id FROM fact), d AS (SELECT DISTINCT seed, noise_level, method, patch_id FROM fact WHERE satellite = 'A')"


@query(f"{W}, {_TASKS} SELECT t.* FROM t ANTI JOIN d USING (seed, noise_level, method, patch_id)")
def resume_anti_join(spark, sf):
    f = fact(spark, sf)
    tasks = f.select("seed", "noise_level", "method", "patch_id").distinct()
    return sel.remaining(tasks, f.filter("satellite = 'A'"))


@query(f"{W} SELECT order_id, line_no, patch_id FROM fact WHERE patch_id IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def selected_semi_join(spark, sf):
    chosen = table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("patch_id"))
    return fact(spark, sf).join(chosen, "patch_id", "left_semi").select("order_id", "line_no", "patch_id")


@query("SELECT p_partkey AS patch_id, coalesce(CASE WHEN p_size > 25 THEN p_size END, 42) AS seed FROM part")
def seed_lookup_join(spark, sf):
    p = table(spark, sf, "part")
    seeds = p.filter("p_size > 25").select("p_partkey", F.col("p_size").alias("seed"))
    return p.select("p_partkey").join(seeds, "p_partkey", "left").select(F.col("p_partkey").alias("patch_id"), F.coalesce("seed", F.lit(42)).alias("seed"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(d.source, 'none') AS source FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def point_lookup_join(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return table(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("source", F.lit("none")).alias("source"))


_DIM = [("1-URGENT", "spatial", "Nearest"), ("2-HIGH", "kernel", "IDW"), ("3-MEDIUM", "transform", "DCT")]


@query(f"{W}, dim AS (SELECT * FROM (VALUES {', '.join(map(str, _DIM))}) t(method, category, display)) SELECT method, coalesce(category, 'unknown') AS category, coalesce(display, method) AS display, count(*) AS n FROM fact LEFT JOIN dim USING (method) GROUP BY 1, 2, 3")
def method_dim_join(spark, sf):
    dim = spark.createDataFrame(_DIM, "method string, category string, display string")
    counts = fact(spark, sf).groupBy("method").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(dim), "method", "left").select("method", F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("display", "method").alias("display"), "n")


@query("SELECT p.p_partkey AS patch_id, p.p_brand AS satellite, s.n AS mean_entropy_7 FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) s ON p.p_partkey = s.l_partkey")
def extra_cols_left_join(spark, sf):
    extra = table(spark, sf, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("patch_id")).agg(F.count("*").alias("mean_entropy_7"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), F.col("p_brand").alias("satellite")).join(extra, "patch_id", "left")


@query(f"{W} SELECT satellite, patch_id, arg_min(seed, (seed + 1) % 3) AS seed FROM fact GROUP BY 1, 2")
def first_seed_union(spark, sf):
    return sel.first_seed(fact(spark, sf).select("satellite", "patch_id", "seed", ((F.col("seed") + 1) % 3).alias("seed_pos")))


@query("SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return union(a, table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key")))


@query("SELECT l_partkey AS patch_id FROM lineitem WHERE l_quantity > 40 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def distinct_ids(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("patch_id"))
    return a.union(table(spark, sf, "part").filter("p_size < 5").select("p_partkey")).distinct()


@query("SELECT p_partkey AS patch_id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def missing_ids(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id")).subtract(table(spark, sf, "lineitem").filter("l_quantity > 40").select("l_partkey"))


@query(f"{W}, m AS (SELECT satellite, method, avg(psnr) AS mean FROM fact GROUP BY 1, 2) SELECT satellite, method, round(mean, 6) AS mean, row_number() OVER (PARTITION BY satellite ORDER BY mean DESC, method) AS rank FROM m")
def rank_in_group(spark, sf):
    means = fact(spark, sf).groupBy("satellite", "method").agg(F.avg("psnr").alias("mean"))
    return su.rank_in(means, ["satellite"], F.desc("mean"), "method").select("satellite", "method", r("mean"), F.col("rank").cast("long").alias("rank"))


@query(f"{W}, m AS (SELECT method, avg(psnr) AS psnr, avg(rmse) AS rmse FROM fact GROUP BY 1) SELECT method, rank() OVER (ORDER BY psnr DESC) AS psnr_rank, rank() OVER (ORDER BY rmse) AS rmse_rank FROM m")
def min_rank_metrics(spark, sf):
    m = fact(spark, sf).groupBy("method").agg(F.avg("psnr").alias("psnr"), F.avg("rmse").alias("rmse"))  # a row for each method
    return m.select("method", F.rank().over(Window.orderBy(F.desc("psnr"))).cast("long").alias("psnr_rank"), F.rank().over(Window.orderBy("rmse")).cast("long").alias("rmse_rank"))


@query(f"{W}, m AS (SELECT method, avg(psnr) AS psnr, avg(ssim) AS ssim, avg(rmse) AS rmse FROM fact GROUP BY 1), u AS (SELECT * FROM m UNPIVOT (value FOR metric IN (psnr, ssim, rmse))) SELECT metric, method, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'rmse' THEN value ELSE -value END, method) AS place FROM u WHERE isfinite(value)")
def column_rank(spark, sf):
    m = fact(spark, sf).groupBy("method").agg(*(F.avg(x).alias(x) for x in ("psnr", "ssim", "rmse")))
    u = m.unpivot(["method"], ["psnr", "ssim", "rmse"], "metric", "value").filter("value is not null and not isnan(value) and abs(value) < double('inf')")
    key = F.when(F.col("metric") == "rmse", F.col("value")).otherwise(-F.col("value"))
    return su.rank_in(u, ["metric"], key, "method", out="place").select("metric", "method", F.col("place").cast("long").alias("place"))


@query(f"{W}, s AS (SELECT noise_level, patch_id, max(entropy_7) AS score FROM fact GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY noise_level ORDER BY score DESC, patch_id) AS hi, row_number() OVER (PARTITION BY noise_level ORDER BY score, patch_id) AS lo FROM s) SELECT noise_level, patch_id, score, 'high' AS side FROM k WHERE hi <= 5 UNION ALL SELECT noise_level, patch_id, score, 'low' FROM k WHERE lo <= 5")
def top_bottom_k(spark, sf):
    s = fact(spark, sf).groupBy("noise_level", "patch_id").agg(F.max("entropy_7").alias("score"))
    return su.extremes(s, "noise_level", "score", 5)


@query(f"{W}, m AS (SELECT method, avg(psnr) AS mean FROM fact GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mean DESC, method) AS rank, count(*) OVER () AS k FROM m) SELECT method, round(mean, 6) AS mean, rank, CASE WHEN rank = 1 THEN 'best' ELSE 'middle' END AS role FROM k WHERE rank = 1 OR rank = k // 2 + 1")
def best_and_mid_method(spark, sf):
    return su.best_and_middle(fact(spark, sf).groupBy("method").agg(F.avg("psnr").alias("mean"))).select("method", r("mean"), F.col("rank").cast("long").alias("rank"), "role")


@query(f"{W} SELECT method, round(avg(psnr), 6) AS mean FROM fact GROUP BY 1 ORDER BY avg(psnr) DESC, method LIMIT 4")
def top4_methods(spark, sf):
    return _rounded(fact(spark, sf).groupBy("method").agg(F.avg("psnr").alias("mean")).orderBy(F.desc("mean"), "method").limit(4))


@query("WITH t AS (SELECT unnest([0.1, 0.5, 0.9]) AS percentile, unnest(quantile_cont(p_retailprice, [0.1, 0.5, 0.9])) AS target FROM part) SELECT CAST(percentile AS DOUBLE) AS percentile, patch_id, price FROM (SELECT percentile, p_partkey AS patch_id, p_retailprice AS price, row_number() OVER (PARTITION BY percentile ORDER BY abs(p_retailprice - target), p_partkey) AS k FROM part, t) WHERE k = 1")
def percentile_representatives(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), F.col("p_retailprice").alias("price"))
    return su.representatives(p, "price").select("percentile", "patch_id", "price")


_EPOCHS = "e AS (SELECT user_id AS model, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS val_loss FROM events)"


def _epochs(spark, sf) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("model"), F.row_number().over(w).cast("long").alias("epoch"), F.col("value").alias("val_loss"))


@query(f"WITH {_EPOCHS} SELECT model, max(epoch) AS epoch, arg_max(val_loss, epoch) AS val_loss FROM e GROUP BY 1")
def last_epoch_row(spark, sf):
    return _epochs(spark, sf).groupBy("model").agg(F.max("epoch").alias("epoch"), F.max_by("val_loss", "epoch").alias("val_loss"))


@query(f"WITH {_EPOCHS} SELECT model, epoch AS best_epoch, val_loss, n_epochs FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY val_loss, epoch) AS k, count(*) OVER (PARTITION BY model) AS n_epochs FROM e) WHERE k = 1")
def best_epoch(spark, sf):
    got = _epochs(spark, sf).groupBy("model").agg(F.min(F.struct("val_loss", "epoch")).alias("b"), F.count("*").alias("n_epochs"))
    return got.select("model", F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("val_loss"), "n_epochs")


@query(f"WITH {_EPOCHS} SELECT model, (model * 1000 + 7)::BIGINT AS n_params, round(sum(val_loss / 10), 6) AS time_s, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS val_loss, count(*) AS n_epochs FROM e GROUP BY 1")
def model_cards(spark, sf):
    e = _epochs(spark, sf).withColumn("n_params", F.col("model") * 1000 + 7).withColumn("seconds", F.col("val_loss") / 10)
    return su.model_cards(e).withColumn("time_s", r(F.col("time_s")))


_WALL = "w AS (SELECT DISTINCT seed, noise_level, (seed + 2) * 10.0::DOUBLE AS wall_time_s FROM fact)"


@query(f"{W}, {_WALL} SELECT seed, noise_level, any_value(wall_time_s) AS wall_time_s, count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_error, round(avg(CASE WHEN status <> 'ok' THEN 1.0 ELSE 0 END), 6) AS error_rate, round(avg(elapsed_s) FILTER (status = 'ok'), 6) AS mean_elapsed, round(quantile_cont(elapsed_s, 0.95) FILTER (status = 'ok'), 6) AS p95_elapsed, round(count(*) FILTER (status = 'ok') / any_value(wall_time_s), 6) AS throughput, round(avg(psnr) FILTER (status = 'ok'), 6) AS psnr_mean, round(stddev_samp(psnr) FILTER (status = 'ok'), 6) AS psnr_std FROM fact JOIN w USING (seed, noise_level) GROUP BY 1, 2")
def grid_summary(spark, sf):
    """Summaries of grid runs, appended run by run to one table and read back."""
    f = fact(spark, sf)
    wall = f.select("seed", "noise_level", ((F.col("seed") + 2) * 10.0).alias("wall_time_s")).distinct()
    with scratch(spark, "grid") as path:
        for seed in (0, 1, 2):
            append(su.grid_summary(f.filter(F.col("seed") == seed), ["seed", "noise_level"], ["psnr"], wall), path)
        return _rounded(parquet(spark, path)).checkpoint()


@query(f"{W} SELECT DISTINCT satellite, patch_id FROM fact WHERE seed = 0 EXCEPT SELECT satellite, patch_id FROM fact WHERE split = 'train'")
def selection_subset(spark, sf):
    """Selected patches that are no training patches."""
    f = fact(spark, sf)
    return sel.outside(f.filter("seed = 0"), sel.only(f, "train"))


@query(f"WITH {_EPOCHS}, b AS (SELECT *, min(val_loss) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), i AS (SELECT *, CASE WHEN before IS NULL OR val_loss < before - 1e-4 THEN epoch END AS better FROM b), s AS (SELECT *, epoch - max(better) OVER (PARTITION BY model ORDER BY epoch) AS waited FROM i) SELECT model, min(epoch) AS stop_epoch FROM s WHERE waited >= 5 GROUP BY 1")
def early_stop(spark, sf):
    w = Window.partitionBy("model").orderBy("epoch")
    e = _epochs(spark, sf).withColumn("before", F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("better", F.when(F.col("before").isNull() | (F.col("val_loss") < F.col("before") - 1e-4), F.col("epoch")))
    e = e.withColumn("waited", F.col("epoch") - F.max("better").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.filter("waited >= 5").groupBy("model").agg(F.min("epoch").alias("stop_epoch"))


@query(f"{W} SELECT noise_level, method, order_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY noise_level, method ORDER BY order_id, line_no) AS k FROM fact WHERE seed = 0) WHERE k <= 3")
def first_n_per_group(spark, sf):
    f = fact(spark, sf).filter("seed = 0").select("noise_level", "method", "order_id", "line_no")
    return su.first_n(f, ["noise_level", "method"], ["order_id", "line_no"], 3)


@query(f"{W}, m AS (SELECT method, satellite, avg(psnr) AS mean FROM fact GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY satellite ORDER BY mean DESC, method) AS rank, printf('%.2f', mean) AS t FROM m), c AS (SELECT method, satellite, CASE rank WHEN 1 THEN '\\textbf{{' || t || '}}' WHEN 2 THEN '\\underline{{' || t || '}}' ELSE t END AS cell FROM k) SELECT method, " + ", ".join(f"coalesce(max(cell) FILTER (satellite = '{s}'), '--') AS {s}" for s in "ANRX") + " FROM c GROUP BY 1")
def pivot_table_cells(spark, sf):
    means = fact(spark, sf).groupBy("method", "satellite").agg(F.avg("psnr").alias("mean"))
    return su.ranked_cells(means, "satellite", list("ANRX"))


@query(f"{W}, m AS (SELECT DISTINCT method_category, method FROM fact) SELECT method_category, method, CASE WHEN lag(method_category) OVER (ORDER BY method_category, method) = method_category THEN '' ELSE method_category END AS shown FROM m")
def suppress_repeats(spark, sf):
    return su.suppress_repeats(fact(spark, sf).select("method_category", "method").distinct(), "method_category", ["method_category", "method"])


@query("SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT event_id, (event_id % 1000) / 10000.0 AS p FROM events)")
def p_stars(spark, sf):
    return table(spark, sf, "events").select("event_id", S.stars((F.col("event_id") % 1000) / F.lit(10000.0)).alias("stars"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(concat('-', p_type, ' / ', p_name, '!'), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'run') AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.slugify(F.concat(F.lit("-"), "p_type", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


@query("SELECT p_partkey AS patch_id, concat('train/', p_brand, '/', lpad(CAST(p_partkey AS VARCHAR), 7, '0'), '_clean.npy') AS path FROM part")
def path_format(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), S.array_path(F.col("p_partkey"), "clean", F.lit("train"), F.col("p_brand")).alias("path"))


@query("SELECT p_partkey AS patch_id, CAST(concat('0x', substr(sha256(concat('42_', p_brand, '_', p_partkey)), 1, 8)) AS BIGINT) AS seed FROM part")
def stable_hash_seed(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), S.stable_seed(F.concat_ws("_", F.lit("42"), "p_brand", F.col("p_partkey").cast("string"))).alias("seed"))


@query("SELECT o_orderkey, upper(replace(replace(o_orderpriority, '-', '_'), '_', '\\_')) AS label, coalesce(CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END, o_orderstatus) AS display, lower(trim(concat(' ', o_orderpriority, ' '))) AS plain, string_split(o_orderpriority, '-')[-1] AS suffix FROM orders")
def label_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.latex_escape(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))).alias("label"), S.lookup(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("display"), F.lower(F.trim(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))).alias("plain"), F.element_at(F.split("o_orderpriority", "-"), -1).alias("suffix"))


@query("SELECT event_id, round(CASE WHEN m < 1e-12 THEN NULL ELSE 10 * log10(1 / m) END, 6) AS psnr, round(CASE WHEN m > 0 THEN 2 * m / (1 + m) ELSE 0 END, 6) AS f1, round(degrees(acos(greatest(-1, least(1, m)))), 6) AS angle FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS m FROM events)")
def metric_scalars(spark, sf):
    m = (F.col("event_id") % 100) / F.lit(100.0)
    p = S.psnr_of_mse(m)
    return table(spark, sf, "events").select("event_id", F.round(F.when(p < float("inf"), p), 6).alias("psnr"), F.round(S.f1_of_accuracy(m), 6).alias("f1"), F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m)))), 6).alias("angle"))


@query("WITH s AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(concat(p_brand, '|', p_partkey)), p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand AS satellite, p_partkey AS patch_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM s")
def hash_split(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("satellite"), F.col("p_partkey").alias("patch_id"))
    return sel.hash_split(p, "patch_id", "satellite").select("satellite", "patch_id", "split")


@query(f"{W}, m AS (SELECT method, avg(psnr) AS psnr, avg(rmse) AS rmse FROM fact GROUP BY 1), b AS (SELECT min(psnr) AS pl, max(psnr) AS ph, min(rmse) AS rl, max(rmse) AS rh FROM m) SELECT method, round(CASE WHEN ph - pl < 1e-12 THEN 0.5 ELSE (psnr - pl) / (ph - pl) END, 6) AS psnr, round(CASE WHEN rh - rl < 1e-12 THEN 0.5 ELSE (rh - rmse) / (rh - rl) END, 6) AS rmse FROM m, b")
def column_minmax_norm(spark, sf):
    m = fact(spark, sf).groupBy("method").agg(F.avg("psnr").alias("psnr"), F.avg("rmse").alias("rmse"))
    return _rounded(su.minmax_columns(m, {"psnr": True, "rmse": False}))


@query(f"{W} SELECT method, count(*) AS n, round(regr_slope(psnr, entropy_7), 6) AS slope, round(regr_intercept(psnr, entropy_7), 6) AS intercept, round(regr_r2(psnr, entropy_7), 6) AS r2, round(1 - (1 - regr_r2(psnr, entropy_7)) * (count(*) - 1) / (count(*) - 2), 6) AS r2_adj FROM fact WHERE psnr IS NOT NULL AND entropy_7 IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def linear_fit(spark, sf):
    return _rounded(su.linear_fit(fact(spark, sf), ["method"], "entropy_7", "psnr"))


@query(f"{W}, q AS (SELECT method, count(*) AS n, avg(psnr) AS mean, quantile_cont(psnr, 0.25) AS q1, quantile_cont(psnr, 0.5) AS q2, quantile_cont(psnr, 0.75) AS q3 FROM fact WHERE psnr IS NOT NULL GROUP BY 1) SELECT method, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(psnr) FILTER (psnr >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo, round(max(psnr) FILTER (psnr <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi FROM q JOIN fact USING (method) WHERE psnr IS NOT NULL GROUP BY ALL")
def box_stats(spark, sf):
    return _rounded(su.boxes(fact(spark, sf), ["method"], "psnr"))


@query(f"{W} SELECT order_id, line_no, round(CASE WHEN psnr IS NULL THEN (entropy_7 + entropy_15) / 2 ELSE (entropy_7 + entropy_15 + psnr) / 3 END, 6) AS score FROM fact")
def row_mean_score(spark, sf):
    return fact(spark, sf).select("order_id", "line_no", F.round(S.row_mean("entropy_7", "entropy_15", "psnr"), 6).alias("score"))


@query(f"{W} SELECT * FROM (SELECT 'psnr' AS metric, count(psnr) AS n FROM fact UNION ALL SELECT 'ssim', count(ssim) FROM fact UNION ALL SELECT 'rmse', count(rmse) FROM fact) WHERE n > 0")
def metric_available(spark, sf):
    return sel.available(fact(spark, sf), ["psnr", "ssim", "rmse", "sam"])


@query("SELECT vec_id AS patch_id FROM embeddings WHERE len(embedding) = 64 AND vec_id % 7 <> 0")
def validate_rows(spark, sf):
    df = patches(spark, sf).withColumn("clean", F.when(F.col("patch_id") % 7 == 0, F.transform("clean", lambda v: F.lit(float("nan")))).otherwise(F.col("clean")))
    return sel.valid_rows(df, 64)[0].select("patch_id")


@query("SELECT power, radius, kernel FROM (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS power), (SELECT unnest([0, 5]) AS radius), (SELECT unnest(['linear', 'cubic']) AS kernel)")
def grid_expand(spark, sf):
    return sel.grid(spark, {"power": [1.0, 2.0, 3.0], "radius": [0, 5], "kernel": ["linear", "cubic"]}).select("power", "radius", "kernel")


@query("SELECT event_type, round(avg(value) FILTER (isfinite(value) AND event_id % 10 <> 0), 6) AS mean FROM events GROUP BY 1")
def finite_mean(spark, sf):
    v = F.when(F.col("event_id") % 10 == 0, float("inf")).otherwise(F.col("value"))
    e = table(spark, sf, "events").select("event_type", v.alias("v"))
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    return _rounded(e.groupBy("event_type").agg(F.avg(F.when(finite, F.col("v"))).alias("mean")))


@query("SELECT vec_id AS method, label AS method_category, CAST(label % 3 AS DOUBLE) AS entropy_7, 'dl' AS type FROM embeddings")
def unified_columns(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("model"), F.col("label").alias("architecture"), (F.col("label") % 3).cast("double").alias("mean_entropy_7"))
    return unified_names(e).withColumn("type", F.lit("dl"))


@query(f"{W} SELECT 'psnr' AS metric, count(*) FILTER (psnr > 20) AS n_significant FROM fact")
def significant_count(spark, sf):
    return fact(spark, sf).agg(F.lit("psnr").alias("metric"), F.count_if(F.col("psnr") > 20).alias("n_significant"))


@query()
def bootstrap_ci(spark, sf):
    return su.bootstrap_ci(fact(spark, sf), ["method"], "psnr", ["order_id", "line_no"])


def _draw_sql(rows: str, seed: int, most: int) -> str:
    """satellite, patch_id and place of a draw by hash order."""
    return f"SELECT satellite, patch_id, place FROM (SELECT satellite, patch_id, row_number() OVER (PARTITION BY satellite ORDER BY sha256(concat({seed}, '|', patch_id)), patch_id) AS place FROM (SELECT DISTINCT satellite, patch_id FROM {rows})) WHERE place <= {most}"


@query()
def method_intervals(spark, sf):
    """The summary of each method with the interval of its mean."""
    return su.with_interval(fact(spark, sf), ["method"], "psnr", ["order_id", "line_no"])


@query()
def scenario_intervals(spark, sf):
    """Models by scenario, satellite and noise level: mean, spread and interval of every metric from one set of resamples."""
    f = fact(spark, sf).filter("method_category <> 'spatial'").withColumn("entropy_scenario", F.when(F.col("seed") == 0, "low").otherwise("all"))
    return su.with_intervals(f, ["method", "entropy_scenario", "satellite", "noise_level"], ["psnr", "ssim", "rmse"], ["order_id", "line_no"])


@query()
def combined_intervals(spark, sf):
    """Both kinds of method on their shared metrics, with intervals."""
    f = fact(spark, sf).select("method", "noise_level", "psnr", "ssim", "order_id", "line_no", F.when(F.col("method_category") == "spatial", "classical").otherwise("dl").alias("type"))
    return su.with_intervals(f, ["type", "method", "noise_level"], ["psnr", "ssim"], ["order_id", "line_no"])


@query(f"{W} SELECT satellite, patch_id, place - 1 AS draw FROM ({_draw_sql('fact', 42, 30)})")
def sample_ids(spark, sf):
    return sel.sample_ids(fact(spark, sf), "satellite", 30)


_SEEDS = (42, 43)
_DRAWS = " UNION ALL ".join(f"SELECT satellite, patch_id, {seed} AS seed, {k} AS pos FROM ({_draw_sql('train', drawn, 20)})" for k, (seed, drawn) in enumerate(zip(_SEEDS, sel.spawned(_SEEDS))))


@query(f"{W}, train AS (SELECT * FROM fact WHERE split = 'train') SELECT satellite, patch_id, arg_min(seed, pos)::INT AS seed FROM ({_DRAWS}) GROUP BY 1, 2")
def patch_plan(spark, sf):
    return sel.patch_plan(sel.only(fact(spark, sf), "train"), [42, 43], 20)


@query("SELECT p_partkey AS patch_id, CASE WHEN p_size % 4 = 0 THEN concat('d/', p_partkey, '_inf.npy') ELSE concat('d/', p_partkey, '_20.npy') END AS path FROM part")
def noise_column(spark, sf):
    """The path column that a row's noise level names."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), F.when(F.col("p_size") % 4 == 0, "inf").otherwise("20").alias("noise_level"))
    p = p.withColumns({f"degraded_{n}_path": F.concat(F.lit("d/"), F.col("patch_id").cast("string"), F.lit(f"_{n}.npy")) for n in NOISE_LEVELS})
    return p.select("patch_id", F.coalesce(*(F.when(F.col("noise_level") == n, F.col(f"degraded_{n}_path")) for n in NOISE_LEVELS)).alias("path"))


@query("WITH k AS (SELECT * FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS satellite), (SELECT unnest([7, 15]) AS window_px)), m AS (SELECT l_returnflag AS satellite, 7 AS window_px, avg(l_quantity) AS mean FROM lineitem GROUP BY 1) SELECT k.satellite, k.window_px, coalesce(printf('%.2f', m.mean), '--') AS cell FROM k LEFT JOIN m ON k.satellite = m.satellite AND k.window_px = m.window_px")
def grid_lookup(spark, sf):
    """Report cells looked up by key on the grid of all keys, `--` where there is none."""
    cells = sel.grid(spark, {"satellite": ["A", "N", "R", "X"], "window_px": [7, 15]}).drop("params")
    means = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("satellite")).agg(F.avg("l_quantity").alias("mean")).withColumn("window_px", F.lit(7))
    return cells.join(means, ["satellite", "window_px"], "left").select("satellite", "window_px", F.when(F.col("mean").isNull(), "--").otherwise(F.format_string("%.2f", "mean")).alias("cell"))


@query("SELECT o_orderkey, CASE WHEN p < 1e-10 THEN '<1e-10' ELSE printf('%.2e', p) END AS p_text, round(2 * (o_orderkey % 97) / 97.0::DOUBLE - 1, 6) AS cliff, least(1.0::DOUBLE, p * 10) AS bonferroni FROM (SELECT o_orderkey, (o_orderkey % 97) / 97.0::DOUBLE / power(10, o_orderkey % 13) AS p FROM orders)")
def report_scalars(spark, sf):
    k = F.col("o_orderkey") % 97 / F.lit(97.0)
    o = table(spark, sf, "orders").select("o_orderkey", (k / F.pow(F.lit(10.0), F.col("o_orderkey") % 13)).alias("p"), k.alias("k"))
    return o.select("o_orderkey", S.p_text(F.col("p")).alias("p_text"), F.round(2 * F.col("k") - 1, 6).alias("cliff"), F.least(F.lit(1.0), F.col("p") * 10).alias("bonferroni"))


@query(f"{W} SELECT order_id, line_no, CASE noise_level WHEN 'inf' THEN 'gap_only' WHEN '40' THEN 'snr40dB' WHEN '30' THEN 'snr30dB' ELSE 'snr20dB' END AS noise, (psnr - entropy_7) / 2 AS half_width, concat_ws(' ', '--batch-size ' || line_no, '--noise-level ' || noise_level, CASE WHEN seed > 0 THEN '--seed ' || seed END) AS arguments FROM fact")
def report_texts(spark, sf):
    """Noise labels, half the width between two bounds and arguments of a command."""
    text = lambda c: F.col(c).cast("string")
    options = F.create_map(F.lit("seed"), F.when(F.col("seed") > 0, text("seed")), F.lit("noise_level"), text("noise_level"), F.lit("batch_size"), text("line_no"))
    return fact(spark, sf).select("order_id", "line_no", S.lookup(F.col("noise_level"), S.NOISE_LABELS).alias("noise"), su.half_width(F.col("entropy_7"), F.col("psnr")).alias("half_width"), S.arguments(options).alias("arguments"))
