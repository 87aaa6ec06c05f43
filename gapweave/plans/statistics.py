"""Registered queries of the statistics layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order
from ..operators import stats as st
from ..session import shared_dir
from ..streaming.checkpoints import incremental
from .registry import query, r
from .views import FACT_SQL, fact, table

W = f"WITH {FACT_SQL}"


@query(f"{W} SELECT order_id, line_no, rank() OVER (PARTITION BY method ORDER BY entropy_7) + (count(*) OVER (PARTITION BY method, entropy_7) - 1) / 2.0::DOUBLE AS rank FROM fact")
def avg_rank(spark, sf):
    return order.average_ranks(fact(spark, sf).select("method", "order_id", "line_no", "entropy_7"), "entropy_7", ["method"]).select("order_id", "line_no", "rank")


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem")
def global_rank(spark, sf):
    return order.average_ranks(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey", "l_linenumber", "rank")


@query(f"{W} SELECT method, count(*) AS n, round(corr(entropy_7, psnr), 6) AS r FROM fact WHERE psnr IS NOT NULL GROUP BY 1")
def pearson(spark, sf):
    f = fact(spark, sf).filter("psnr is not null")
    return f.groupBy("method").agg(F.count("*").alias("n"), F.round(F.corr("entropy_7", "psnr"), 6).alias("r"))


_RANKED = "SELECT method, x_name, y_name, x, y, rank() OVER (PARTITION BY method, x_name, y_name ORDER BY x) + (count(*) OVER (PARTITION BY method, x_name, y_name, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY method, x_name, y_name ORDER BY y) + (count(*) OVER (PARTITION BY method, x_name, y_name, y) - 1) / 2.0::DOUBLE AS ry FROM long"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT method, '{x}' AS x_name, '{y}' AS y_name, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM fact WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x in ("entropy_7", "entropy_15") for y in ("psnr", "ssim")) + ")"


@query(f"{W}, {_LONG}, k AS ({_RANKED}) SELECT method, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k WHERE x_name = 'entropy_7' AND y_name = 'psnr' GROUP BY 1")
def spearman(spark, sf):
    return st.correlations(fact(spark, sf), ["entropy_7"], ["psnr"]).select("method", "n", r("rho"))


@query(f"{W}, {_LONG}, k AS ({_RANKED}) SELECT method, x_name, y_name, count(*) AS n, round(corr(x, y), 6) AS r, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1, 2, 3")
def corr_matrix(spark, sf):
    return st.correlations(fact(spark, sf), ["entropy_7", "entropy_15"], ["psnr", "ssim"]).select("method", "x_name", "y_name", "n", r("r"), r("rho"))


@query(f"{W}, {_LONG}, k AS ({_RANKED}) SELECT method, round(max(c) FILTER (x_name = 'entropy_15'), 6) AS entropy_15, round(max(c) FILTER (x_name = 'entropy_7'), 6) AS entropy_7 FROM (SELECT method, x_name, corr(rx, ry) AS c FROM k WHERE y_name = 'psnr' GROUP BY 1, 2) GROUP BY 1")
def pivot_corr(spark, sf):
    c = st.correlations(fact(spark, sf), ["entropy_7", "entropy_15"], ["psnr"])
    wide = c.groupBy("method").pivot("x_name", ["entropy_15", "entropy_7"]).agg(F.avg("rho"))
    return wide.select("method", r("entropy_15"), r("entropy_7")).filter("entropy_15 is not null or entropy_7 is not null")


@query("WITH t AS (SELECT p_partkey AS test, ((p_partkey * 7919) % 10007 + 0.5) / 20014.0 AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM t) SELECT test, round(least(1, min(p * m / i) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k")
def fdr_bh(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("test"), (((F.col("p_partkey") * 7919) % 10007 + F.lit(0.5)) / F.lit(20014.0)).cast("double").alias("p"))
    return st.fdr(t, "p").select("test", r("q"))


@query(f"{W}, k AS (SELECT method, psnr, rank() OVER (ORDER BY psnr) + (count(*) OVER (PARTITION BY psnr) - 1) / 2.0::DOUBLE AS rk FROM fact WHERE psnr IS NOT NULL), g AS (SELECT method, count(*) AS c, sum(rk) AS s FROM k GROUP BY 1), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM k GROUP BY psnr)), a AS (SELECT count(*) AS k, sum(c)::DOUBLE AS n, sum(s * s / c) AS u FROM g), h AS (SELECT k, n, (12 / (n * (n + 1)) * u - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM a, t) SELECT k, CAST(n AS BIGINT) AS n, round(h, 4) AS h, round(h / (n - 1), 8) AS epsilon_sq FROM h")
def kruskal_h(spark, sf):
    return st.kruskal(fact(spark, sf), "method", "psnr").select("k", "n", F.round("h", 4).alias("h"), F.round("epsilon_sq", 8).alias("epsilon_sq"))


@query(f"{W}, f AS (SELECT method AS g, psnr AS v FROM fact WHERE psnr IS NOT NULL), p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM f) a JOIN (SELECT DISTINCT g FROM f) b ON a.g < b.g), k AS (SELECT a, b, g, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS rk FROM p JOIN f ON g = a OR g = b), s AS (SELECT a, b, count(*) FILTER (g = a) AS n_a, count(*) FILTER (g = b) AS n_b, sum(rk) FILTER (g = a) AS ra FROM k GROUP BY 1, 2) SELECT a, b, n_a, n_b, round(ra - n_a * (n_a + 1) / 2.0::DOUBLE, 4) AS u, round(2 * (ra - n_a * (n_a + 1) / 2.0::DOUBLE) / (n_a::DOUBLE * n_b) - 1, 6) AS delta FROM s")
def mannwhitney_u(spark, sf):
    return st.mann_whitney(fact(spark, sf), "method", "psnr").select("a", "b", "n_a", "n_b", F.round("u", 4).alias("u"), r("delta"))


@query(f"{W} SELECT order_id, line_no, " + ", ".join(f"CAST(noise_level = '{v}' AS DOUBLE) AS noise_level_{v}" for v in ("30", "40", "inf")) + " FROM fact")
def one_hot_drop_first(spark, sf):
    df, names = st.dummies(fact(spark, sf), ["noise_level"])
    return df.select("order_id", "line_no", *names)


@query(f"{W} SELECT unnest(['entropy_7', 'entropy_15']) AS name, round(1 / (1 - corr(entropy_7, entropy_15) ** 2), 6) AS vif FROM fact")
def vif_two(spark, sf):
    return st.vif(fact(spark, sf), ["entropy_7", "entropy_15"]).select("name", r("vif"))


def _inside(density: str, end: str) -> str:
    """SQL for the integral of a density of t from 0 to end, by Simpson's rule in 2,000 steps."""
    return f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('(t)', f'({end} * i / 2000.0::DOUBLE)')})) * {end} / 6000"


_KRUSKAL = f"k AS (SELECT method, psnr, rank() OVER (ORDER BY psnr) + (count(*) OVER (PARTITION BY psnr) - 1) / 2.0::DOUBLE AS rk FROM fact WHERE psnr IS NOT NULL), g AS (SELECT method, count(*) AS c, sum(rk) AS s FROM k GROUP BY 1), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM k GROUP BY psnr)), a AS (SELECT count(*) AS k, sum(c)::DOUBLE AS n, sum(s * s / c) AS u FROM g), h AS (SELECT k, n, (12 / (n * (n + 1)) * u - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM a, t)"


# five methods make four degrees of freedom, for which the chi-squared tail has a closed form
@query(f"{W}, {_KRUSKAL} SELECT k, CAST(n AS BIGINT) AS n, round(h, 4) AS h, CASE WHEN k = 5 THEN round(exp(-h / 2) * (1 + h / 2), 6) END AS p FROM h")
def kruskal_p(spark, sf):
    return st.kruskal_test(fact(spark, sf), "method", "psnr").select("k", "n", F.round("h", 4).alias("h"), r("p"))


_PAIRS = "f AS (SELECT method AS g, psnr AS v FROM fact WHERE psnr IS NOT NULL), p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM f) a JOIN (SELECT DISTINCT g FROM f) b ON a.g < b.g), k AS (SELECT a, b, g, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY a, b, v)::DOUBLE AS t FROM p JOIN f ON g = a OR g = b), s AS (SELECT a, b, (count(*) FILTER (g = a))::DOUBLE AS na, (count(*) FILTER (g = b))::DOUBLE AS nb, sum(rk) FILTER (g = a) AS ra, sum(t * t - 1) AS ties FROM k GROUP BY 1, 2), z AS (SELECT a, b, greatest(abs(ra - na * (na + 1) / 2 - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS z FROM s)"


@query(f"{W}, {_PAIRS}, q AS (SELECT a, b, z, greatest(0, 1 - 2 * {_inside('exp(-(t) * (t) / 2)', 'z')} / sqrt(2 * pi())) AS p FROM z) SELECT a, b, round(z, 4) AS z, round(p, 6) AS p, round(least(1, p * count(*) OVER ()), 6) AS p_corrected, p * count(*) OVER () <= 0.05 AS significant FROM q")
def pairwise_p(spark, sf):
    return st.pairwise_test(fact(spark, sf), "method", "psnr").select("a", "b", F.round("z", 4).alias("z"), r("p"), r("p_corrected"), "significant")


@query(f"{W}, {_LONG}, k AS ({_RANKED}), c AS (SELECT method, x_name, y_name, count(*)::DOUBLE AS n, corr(rx, ry) AS rho FROM k GROUP BY 1, 2, 3), t AS (SELECT *, n - 2 AS v, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS z FROM c), p AS (SELECT *, greatest(0, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * {_inside('pow(1 + (t) * (t) / v, -(v + 1) / 2)', 'z')}) AS p FROM t), o AS (SELECT *, row_number() OVER (ORDER BY p, method, x_name, y_name) AS i, count(*) OVER () AS m FROM p), q AS (SELECT *, least(1, min(p * m / i) OVER (ORDER BY p DESC, method DESC, x_name DESC, y_name DESC ROWS UNBOUNDED PRECEDING)) AS q FROM o) SELECT method, x_name, y_name, round(rho, 6) AS rho, round(p, 6) AS p, round(q, 6) AS q, q <= 0.05 AS significant FROM q")
def correlation_p(spark, sf):
    c = st.correlations(fact(spark, sf), ["entropy_7", "entropy_15"], ["psnr", "ssim"])
    q = st.fdr(st.with_p(c, "rho", "p"), "p")
    return q.select("method", "x_name", "y_name", r("rho"), r("p"), r("q"), "significant")


@query()
def robust_regression(spark, sf):
    coefficients, _ = st.robust_regression(fact(spark, sf), "psnr", ["entropy_7", "entropy_15"])
    return spark.createDataFrame(coefficients)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def checkpoint_stream(spark, sf):
    """Events read by a stream that is started twice; the second start adds nothing."""
    import uuid

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    for _ in range(2):
        incremental(spark, f"{sf}/events.parquet*", schema, f"{root}/out", f"{root}/state", lambda df: df.select("event_id", "event_type", "value"))
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
