"""Grouped summaries, bootstrap intervals, rankings and pivots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import order as od
from .bootstrap import RESAMPLES, WHOLE, bootstrap_chunk, bootstrap_mean, bootstrap_paths, intervals  # noqa: F401
from .select import terciles


def summary(df: DataFrame, keys: Sequence[str], metric: str = "psnr", spread: bool = True) -> DataFrame:
    """keys, n (non-null), mean and, with spread, median and population std of a metric.

    Groups of a null key and null values are dropped.
    """
    df = df.filter(F.col(metric).isNotNull())
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    got = df.groupBy(*keys).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), *([F.stddev_pop(metric).alias("std")] if spread else []))
    if not spread:
        return got
    median = od.quantiles(df, metric, [0.5], keys).select(*keys, F.get("q", F.lit(0)).alias("median"))
    return od.same_groups(got, median, keys, "left").select(*keys, "n", "mean", "median", "std")


def by_method(df: DataFrame, metric: str = "psnr") -> DataFrame:
    return summary(df, ["method"], metric).orderBy(F.desc("mean"), "method")


def by_bin(df: DataFrame, column: str, out: str, metric: str = "psnr") -> DataFrame:
    """By method and tercile of a column; terciles are those of all rows with a value and a metric."""
    return summary(terciles(df.filter(F.col(metric).isNotNull()), column, out), ["method", out], metric, False)


def with_interval(df: DataFrame, keys: Sequence[str], metric: str = "psnr", order: Sequence[str] = (), spread: bool = True) -> DataFrame:
    """summary() and the bootstrap interval of each group's mean (ci95_lo, ci95_hi)."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return summary(df, keys, metric, spread).join(bootstrap_ci(df, keys, metric, order), list(keys), "left")


def half_width(lo: Column, hi: Column) -> Column:
    """Half the width of an interval; null if a bound is missing."""
    return (hi - lo) / 2


def multi_metric(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """n (all rows) and mean and population std of several metrics in one pass."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_pop))))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], metric: str = "psnr", order: Sequence[str] = (), most: int = WHOLE) -> DataFrame:
    """keys, ci95_lo and ci95_hi of one metric's mean; groups of a null key or of null values have no row."""
    got = intervals(df.na.drop(subset=list(keys)).filter(F.col(metric).isNotNull()), keys, [metric], order, most)
    return got.withColumnsRenamed({f"{metric}_ci95_{e}": f"ci95_{e}" for e in ("lo", "hi")})


def with_intervals(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], order: Sequence[str] = (), most: int = WHOLE) -> DataFrame:
    """n (all rows), mean, population std and the interval of the mean of several metrics, from one count of the rows and one set of resamples."""
    return intervals(df, keys, metrics, order, most, spread=True)


def run_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], wall_time_s: float | None = None) -> DataFrame:
    """Rows, failures and, of the `ok` rows, mean and p95 of elapsed times, throughput and sample statistics of metrics.

    Throughput is `ok` rows by wall time, which is that of one worker (the sum of all elapsed times)
    unless given. Without `ok` rows times and throughput are 0. A null status is no `ok`.
    """
    ok = F.col("status").eqNullSafe("ok")
    elapsed, wall = F.when(ok, F.col("elapsed_s")), F.sum("elapsed_s") if wall_time_s is None else F.lit(float(wall_time_s))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    got = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), (F.count_if(~ok) / F.count("*")).alias("error_rate"),
        zero(F.avg(elapsed)).alias("mean_elapsed"), zero(F.when(wall > 0, F.count_if(ok) / wall)).alias("throughput"),
        *(f(F.when(ok, F.col(m))).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))),
    )
    p95 = od.quantiles(df.filter(ok), "elapsed_s", [0.95], keys).select(*keys, F.get("q", F.lit(0)).alias("p95_elapsed"))
    return od.same_groups(got, p95, keys, "left").withColumn("p95_elapsed", zero(F.col("p95_elapsed")))


def grid_summary(runs: DataFrame, parameters: Sequence[str], metrics: Sequence[str], wall: DataFrame) -> DataFrame:
    """One row for each run of a parameter grid: its parameters, wall_time_s and the figures of run_summary by that wall time.

    runs: the parameters, status, elapsed_s and metrics; wall: the parameters and wall_time_s. A run without results has no row.
    """
    got = run_summary(runs, parameters, metrics).drop("throughput")
    timed = od.same_groups(got, wall.select(*parameters, "wall_time_s"), parameters, "left")
    return timed.withColumn("throughput", F.when(F.col("wall_time_s") > 0, F.col("n_ok") / F.col("wall_time_s")).otherwise(0.0))


def model_cards(epochs: DataFrame) -> DataFrame:
    """model, n_params, training time, best epoch (the first with the least val_loss), that loss and the number of epochs.

    epochs: model, n_params (the same in all rows), epoch, val_loss and seconds of each epoch; NaN losses are no best ones.
    """
    loss = F.when(~F.isnan("val_loss"), F.col("val_loss"))
    best = F.min(F.when(loss.isNotNull(), F.struct(loss.alias("val_loss"), "epoch"))).alias("b")
    got = epochs.groupBy("model").agg(F.max("n_params").alias("n_params"), F.sum("seconds").alias("time_s"), best, F.count("*").alias("n_epochs"))
    return got.select("model", "n_params", "time_s", F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("val_loss"), "n_epochs")


def shares(df: DataFrame, key: str, expected: dict[str, float], within: float = 0.01) -> DataFrame:
    """Share of each value and whether it lies within the tolerance of what is expected."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # a row for each value
    want = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    return counts.withColumn("share", share).withColumn("ok", F.abs(F.col("share") - F.try_element_at(want, F.col(key))) <= within)


def rank_in(df: DataFrame, by: Sequence[str], value: Column, *ties: str, out: str = "rank") -> DataFrame:
    """Places 1, 2, ... in each group, ties broken by the given columns."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(value, *ties)))


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def extremes(df: DataFrame, by: str, score: str, k: int, key: str = "patch_id") -> DataFrame:
    """The k highest and k lowest rows of each group, ties in the order of the key."""
    high = first_n(df, [by], [F.desc(score), key], k).withColumn("side", F.lit("high"))
    low = first_n(df, [by], [F.asc(score), key], k).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def representatives(df: DataFrame, column: str, points: Sequence[float] = (0.1, 0.5, 0.9), key: str = "patch_id") -> DataFrame:
    """The row nearest to each percentile of a column, the least key among equals."""
    df = df.filter(F.col(column).isNotNull())
    q = od.quantiles(df, column, points)
    targets = q.select(F.posexplode("q").alias("i", "target")).select("target", F.get(F.array(*map(F.lit, points)), F.col("i")).alias("percentile"))
    near = df.crossJoin(F.broadcast(targets)).groupBy("percentile").agg(F.min(F.struct(F.abs(F.col(column) - F.col("target")).alias("d"), F.col(key).alias(key), F.col(column).alias(column))).alias("best"))
    return near.select("percentile", f"best.{key}", f"best.{column}")


def best_and_middle(means: DataFrame, value: str = "mean", key: str = "method") -> DataFrame:
    """The best row and that of the median rank of a small summary."""
    w = Window.partitionBy().orderBy(F.desc(value), key)
    placed = means.withColumn("rank", F.row_number().over(w)).withColumn("k", F.count("*").over(Window.partitionBy()))
    return placed.filter((F.col("rank") == 1) | (F.col("rank") == F.floor(F.col("k") / 2) + 1)).withColumn("role", F.when(F.col("rank") == 1, "best").otherwise("middle")).drop("k")


def minmax_columns(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Columns scaled to [0, 1] over all rows, turned where less is better; 0.5 when the range is under 1e-12."""
    bounds = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(bounds))  # one row
    for c, more_is_better in columns.items():
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        v = (F.col(c) - lo) / (hi - lo) if more_is_better else (hi - F.col(c)) / (hi - lo)
        out = out.withColumn(c, F.when(hi - lo < 1e-12, 0.5).otherwise(v))
    return out.select(*df.columns)


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r2 and adjusted r2 of groups with three pairs or more."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = df.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")).filter("n >= 3")
    return fit.withColumn("r2_adj", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2))


def boxes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, mean and the whiskers: the last values within 1.5 quartile ranges."""
    df = df.filter(F.col(value).isNotNull())
    q = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    q = od.same_groups(q, od.quantiles(df, value, [0.25, 0.5, 0.75], keys), keys).select(*keys, "n", "mean", *(F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)))
    v, span = F.col(value), F.col("q3") - F.col("q1")
    inside = df.join(q, list(keys)).groupBy(*keys).agg(F.min(F.when(v >= F.col("q1") - 1.5 * span, v)).alias("whisker_lo"), F.max(F.when(v <= F.col("q3") + 1.5 * span, v)).alias("whisker_hi"))
    return q.join(inside, list(keys))


def ranked_cells(means: DataFrame, group: str, values: Iterable[str], value: str = "mean", key: str = "method") -> DataFrame:
    """Table cells by key and group: the best of a group bold, the second underlined, `--` when missing."""
    placed = rank_in(means, [group], F.desc(value), key)
    text = F.format_string("%.2f", value)
    cell = F.when(F.col("rank") == 1, F.concat(F.lit("\\textbf{"), text, F.lit("}"))).when(F.col("rank") == 2, F.concat(F.lit("\\underline{"), text, F.lit("}"))).otherwise(text)
    values = list(values)
    wide = placed.withColumn("cell", cell).groupBy(key).pivot(group, values).agg(F.first("cell"))
    return wide.fillna("--", subset=values)


def suppress_repeats(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """The label only where it changes; the table is a report of bounded size."""
    before = F.lag(label).over(Window.partitionBy().orderBy(*order))
    return df.withColumn("shown", F.when(before.isNull() | (before != F.col(label)), F.col(label)).otherwise(""))


def latex_table(df: DataFrame, caption: str, label: str, most: int = 1000) -> str:
    """LaTeX text of a report; more than `most` rows are an error rather than a collected table."""
    rows: Iterator = df.limit(most + 1).toLocalIterator()
    body = [" & ".join("--" if v is None else str(v) for v in r) + " \\\\" for r in rows]
    if len(body) > most:
        raise ValueError(f"a table of more than {most} rows is not a report")
    head = " & ".join(c.replace("_", "\\_") for c in df.columns) + " \\\\"
    return "\n".join(["\\begin{table}", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}", "\\toprule", head, "\\midrule", *body, "\\bottomrule", "\\end{tabular}", "\\end{table}"])
