"""Order statistics without a task that sees a whole group: running counts, average ranks and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGES = 64  # value ranges of a group, each a task's work
ACCURACY = 10_000  # of a sketch: its ranks are within 1 / ACCURACY of the rows


def same_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null is a key like others; without keys both sides are one row (or `b` is)."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row
    b = b.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return a.join(b, on, how).drop(*(f"_same_{k}" for k in keys))


def _ranged(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """rows with _s, the value range of their group: a sketch cuts each group into RANGES of about equal weight."""
    edges = rows.groupBy(*by).agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 20 * RANGES).alias("_e"))
    return same_groups(rows, edges, by).withColumn("_s", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")


def running(rows: DataFrame, by: Sequence[str], value: str, measures: Sequence[str], ranges: Column | None = None) -> DataFrame:
    """For each row the sums of measures over the rows of its group up to its value: upto_<measure>.

    A group holds each value once. Two levels: sums run within (group, value range), and each range starts from the sums
    of those before it, of which a group has RANGES. `ranges` gives numbers of ranges that grow with the value, if known.
    """
    placed = _ranged(rows, by, value) if ranges is None else rows.withColumn("_s", ranges)
    totals = placed.groupBy(*by, "_s").agg(*(F.sum(m).alias(f"_t_{m}") for m in measures))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    starts = totals.select(*by, "_s", *(F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_b_{m}") for m in measures))
    within = Window.partitionBy(*by, "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.withColumns({f"_u_{m}": F.sum(m).over(within) for m in measures})
    out = same_groups(sums, starts, [*by, "_s"])
    return out.withColumns({f"upto_{m}": F.col(f"_u_{m}") + F.col(f"_b_{m}") for m in measures}).drop("_s", *(f"_{x}_{m}" for x in "ub" for m in measures))


def least_from(rows: DataFrame, by: Sequence[str], value: str, measure: str, out: str) -> DataFrame:
    """For each row the least measure over the rows of its group from its value on, by the same two levels."""
    placed = _ranged(rows, by, value)
    totals = placed.groupBy(*by, "_s").agg(F.min(measure).alias("_t"))
    behind = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    ends = totals.select(*by, "_s", F.min("_t").over(behind).alias("_b"))
    within = Window.partitionBy(*by, "_s").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    got = same_groups(placed.withColumn("_u", F.min(measure).over(within)), ends, [*by, "_s"])
    return got.withColumn(out, F.least("_u", "_b")).drop("_s", "_u", "_b")


def hash_places(rows: DataFrame, by: Sequence[str], text: Column, key: str) -> DataFrame:
    """rows with place (from 1) in the order of the SHA-256 of a text, then of the key, within their group.

    The hash is even, so its first byte makes the ranges: places are counted, no group is sorted whole.
    """
    h = F.sha2(text, 256)
    rows = rows.withColumn("_h", F.struct(h.alias("h"), F.col(key).alias("k"))).withColumn("_one", F.lit(1).cast("long"))
    return running(rows, by, "_h", ["_one"], F.conv(F.substring(F.col("_h.h"), 1, 2), 16, 10).cast("int")).withColumnRenamed("upto__one", "place").drop("_h", "_one")


def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), among: dict[str, Column] | None = None) -> DataFrame:
    """by, value and the average rank of each distinct value, ties sharing theirs.

    `among` names several ranks, each among the rows of its condition; one count of the values serves them all.
    """
    among = among or {"rank": F.lit(True)}
    counts = df.groupBy(*by, value).agg(*(F.count_if(c).alias(f"_c_{n}") for n, c in among.items()))
    got = running(counts, by, value, [f"_c_{n}" for n in among])
    rank = {n: F.when(F.col(f"_c_{n}") > 0, (F.col(f"upto__c_{n}") - (F.col(f"_c_{n}") - 1) / 2).cast("double")) for n in among}
    return got.select(*by, value, *(c.alias(n) for n, c in rank.items()))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average ranks with ties; null values and groups of a null key are dropped."""
    return df.join(rank_table(df.na.drop(subset=[value, *by]), value, by).withColumnRenamed("rank", out), [*by, value])


def quantiles(df: DataFrame, column: str, points: Sequence[float], by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """by and the exact, linearly interpolated quantiles of a column as an array, by distributed selection.

    Two passes. A sketch brackets each rank between two values that leave 4 / ACCURACY of the rows between
    them. The second pass counts the rows below the bracket and the distinct values inside it; no buffer holds a group's
    values. The rank lies inside, or is the greatest value below or the least above; anything else is an error.
    Null and NaN are missing; a group without values has no row.
    """
    v = F.col("_v")
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    slack = 2 / ACCURACY
    ends = [min(1.0, max(0.0, p + s)) for p in points for s in (-slack, slack)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_b"))
    bounds = lambda i: (F.get("_b", F.lit(2 * i)), F.get("_b", F.lit(2 * i + 1)))
    side = lambda i: F.when(v < bounds(i)[0], -1).when(v > bounds(i)[1], 1).otherwise(0)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), side(i).alias("side")) for i in range(len(points)))))
    placed = same_groups(rows, sketch, by).select(*by, "_n", "_v", each.alias("_p")).select(*by, "_n", "_v", "_p.*")
    inside = F.when(F.col("side") == 0, v).alias("_w")
    kept = placed.groupBy(*by, "_n", "i", "side", inside).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_n", "i").orderBy("side", "_w").rowsBetween(Window.unboundedPreceding, 0))
    at = F.get(F.array(*map(F.lit, points)), F.col("i")) * (F.col("_n") - 1)
    kept = kept.withColumn("_u", upto).withColumn("_at", at)

    def placed_at(rank: Column) -> Column:
        """The value of a 0-based rank if this row holds it."""
        here = (rank >= F.col("_u") - F.col("_c")) & (rank < F.col("_u"))
        lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
        value = F.when(F.col("side") == 0, F.col("_w")).when((F.col("side") < 0) & (rank == F.col("_u") - 1), F.col("_most")).when((F.col("side") > 0) & (rank == F.col("_u") - F.col("_c")), F.col("_least")).otherwise(lost)
        return F.max(F.when(here, value))

    low, high = F.floor("_at"), F.ceil("_at")
    found = kept.groupBy(*by, "i").agg(placed_at(low).alias("_x"), placed_at(high).alias("_y"), F.first("_at").alias("_at"))
    share = F.col("_at") - F.floor("_at")
    value = F.when(share == 0, F.col("_x")).otherwise(F.col("_x") + (F.col("_y") - F.col("_x")) * share)
    every = F.array_sort(F.collect_list(F.struct("i", value.alias("q"))))  # as many as points
    return found.groupBy(*by).agg(F.transform(every, lambda s: s["q"]).alias(out)).filter(F.size(out) > 0)
