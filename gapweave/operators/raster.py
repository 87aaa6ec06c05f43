"""Rasters as rows of pixels: normalisation, entropy, relational fills and quality metrics.

A raster is a row with an array in row-major order (y, x, band); `pixels` makes it rows. All
joins below carry patch_id as an equality, so they are shuffled hash or merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import f1_of_accuracy, let, psnr_of_mse

THRESHOLDS = {"002": 0.02, "005": 0.05, "01": 0.10}


def pixels(df: DataFrame, width: int, bands: int = 1, array: str = "values", key: str = "patch_id", value: str = "v") -> DataFrame:
    """key, y, x, b and the value of each element."""
    p = F.col("p")
    rows = df.select(key, F.posexplode(array).alias("p", value))
    return rows.select(key, F.floor(p / (width * bands)).cast("int").alias("y"), (F.floor(p / bands) % width).cast("int").alias("x"), (p % bands).cast("int").alias("b"), F.col(value).cast("double").alias(value))


def assemble(px: DataFrame, width: int, bands: int = 1, value: str = "v", out: str = "values") -> DataFrame:
    """Arrays again from pixel rows."""
    place = (F.col("y") * width + F.col("x")) * bands + F.col("b")
    return px.groupBy("patch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(value).alias("v")))), lambda s: s["v"]).alias(out))


def value_range(array: Column) -> tuple[Column, Column]:
    """Least value and span; a span under 1e-8 counts as 1."""
    low, high = F.array_min(array), F.array_max(array)
    return low, F.when(high - low < 1e-8, 1.0).otherwise(high - low)


def normalised(array: Column, clean: Column) -> Column:
    """An array in the range of the clean one, clipped to [0, 1]."""
    low, span = value_range(clean)
    return let(F.struct(low.alias("lo"), span.alias("span")), lambda s: F.transform(array, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - s["lo"]) / s["span"]))))


def without_nan(array: Column) -> Column:
    return F.transform(array, lambda v: F.nanvl(v, F.lit(0.0)))


def thresholded(mask: Column) -> Column:
    return F.transform(mask, lambda v: (v > 0.5).cast("int"))


def inverted(mask: Column) -> Column:
    """1 for 0 and 0 for 1: a mask of valid cells as one of gaps."""
    return F.transform(mask, lambda v: 1 - v)


def first_channel(mask: Column, bands: int) -> Column:
    return F.filter(mask, lambda v, i: i % bands == 0)


def gap_fraction(mask: Column) -> Column:
    return F.round(F.aggregate(mask, F.lit(0.0), lambda s, v: s + v) / F.size(mask), 6)


def channels_last(array: Column, cells: int, bands: int) -> Column:
    """Band-major (c, y, x) to pixel-major (y, x, c)."""
    return F.transform(F.sequence(F.lit(0), F.lit(cells * bands - 1)), lambda i: F.get(array, (i % bands) * cells + F.floor(i / bands).cast("int")))


def model_input(array: Column, mask: Column) -> Column:
    """Gaps set to zero, then the mask as one more channel behind."""
    return F.concat(F.zip_with(array, mask, lambda v, m: F.when(m > 0.5, 0.0).otherwise(v)), F.transform(mask, lambda m: m.cast("double")))


def blended(reconstruction: Column, degraded: Column, mask: Column) -> Column:
    """The reconstruction in the gaps, the input elsewhere."""
    return F.transform(F.arrays_zip(reconstruction.alias("r"), degraded.alias("d"), mask.alias("m")), lambda s: F.when(s["m"] > 0.5, s["r"]).otherwise(s["d"]))


def error_map(px: DataFrame, clean: str = "clean", other: str = "rec") -> DataFrame:
    """Squared error of each pixel, the mean over its bands."""
    return px.groupBy("patch_id", "y", "x").agg(F.avg((F.col(clean) - F.col(other)) ** 2).alias("err"))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def grey_levels(values: Column, bands: int = 1) -> Column:
    """The mean of each cell's bands stretched to 0..255 by truncation; a span under 1e-10 is all 0."""
    cells = F.transform(F.sequence(F.lit(0), F.size(values) - bands, F.lit(bands)), lambda p: F.aggregate(F.slice(values, p + 1, bands), F.lit(0.0), lambda s, v: s + v) / bands)
    return let(cells, lambda c: let(F.struct(F.array_min(c).alias("lo"), F.array_max(c).alias("hi")), lambda r: F.transform(c, lambda v: F.when(r["hi"] - r["lo"] < 1e-10, 0).otherwise(F.floor((v - r["lo"]) * 255 / (r["hi"] - r["lo"]))).cast("int"))))


def entropy_map(values: Column, window: int, height: int, width: int, bands: int = 1) -> Column:
    """Base-2 entropy of grey levels in the odd window around each cell, clipped to the raster, as an array.

    One histogram slides along each row: a step takes the column that leaves the window out of it and puts the
    entering one in, and mends the sum of c log2 c by the counts that change. Nothing leaves the row of the raster.
    """
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd and positive")
    r = window // 2
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)

    def moved(state: Column, move: Column) -> Column:
        at, d = move["level"], move["d"]
        c = F.get(state["n"], at)
        counts = F.concat(F.slice(state["n"], 1, at), F.array(c + d), F.slice(state["n"], at + 2, F.size(state["n"]) - at - 1))
        return F.struct(counts.alias("n"), (state["s"] + term(c + d) - term(c)).alias("s"))

    def along_row(g: Column, y: Column, kinds: Column) -> Column:
        above, below = F.greatest(y - r, F.lit(0)), F.least(y + r, F.lit(height - 1))
        column = lambda x, d: F.transform(F.sequence(above, below), lambda k: F.struct(F.get(g, k * width + x).alias("level"), F.lit(d).alias("d")))
        none = F.slice(column(F.lit(0), 0), 1, 0)
        first = F.flatten(F.transform(_upto(min(r + 1, width)), lambda x: column(x, 1)))
        empty = F.struct(F.array_repeat(F.lit(0), kinds).alias("n"), F.lit(0.0).alias("s"))

        def step(state: Column, x: Column) -> Column:
            enters = F.when((x > 0) & (x + r < width), column(x + r, 1)).otherwise(none)
            leaves = F.when(x > r, column(x - r - 1, -1)).otherwise(none)
            n = ((below - above + 1) * (F.least(x + r, F.lit(width - 1)) - F.greatest(x - r, F.lit(0)) + 1)).cast("double")
            now = F.aggregate(F.concat(enters, leaves), F.struct(state["n"].alias("n"), state["s"].alias("s")), moved)
            return let(now, lambda h: F.struct(h["n"].alias("n"), h["s"].alias("s"), F.array_append(state["out"], F.log2(n) - h["s"] / n).alias("out")))

        start = F.aggregate(first, empty, moved)
        with_out = let(start, lambda h: F.struct(h["n"].alias("n"), h["s"].alias("s"), F.array().cast("array<double>").alias("out")))
        return F.aggregate(_upto(width), with_out, step, lambda state: state["out"])

    # levels are numbered among those that occur, so a histogram is no longer than they are
    numbered = lambda g: let(F.array_sort(F.array_distinct(g)), lambda k: F.struct(F.transform(g, lambda v: (F.array_position(k, v) - 1).cast("int")).alias("g"), F.size(k).alias("kinds")))
    rows = lambda l: F.flatten(F.transform(_upto(height), lambda y: along_row(l["g"], y, l["kinds"])))  # noqa: E731, E741
    return let(grey_levels(values, bands), lambda g: let(numbered(g), rows))


def nearest_cells(mask: Column, height: int, width: int, radius: float | None = None) -> Column:
    """For each cell the index of the nearest known one (mask 0), ties by row, then column; itself if known, null if none is.

    Two separable passes: two scans of each row find the nearest known column, then a cell takes the best of its own
    column's rows. A raster costs cells * (width + height), and nothing leaves its row.
    """

    def scanned(row: Column, backward: bool) -> Column:
        last = lambda s, x: F.when(F.get(row, x) == 0, x).otherwise(s["last"])
        start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))
        places = F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)) if backward else _upto(width)
        out = F.aggregate(places, start, lambda s, x: F.struct(last(s, x).alias("last"), F.array_append(s["out"], last(s, x)).alias("out")), lambda s: s["out"])
        return F.reverse(out) if backward else out

    def closest(left: Column, right: Column, x: Column) -> Column:
        return F.when(left < 0, right).when((right < 0) | (x - left <= right - x), left).otherwise(right)

    in_row = lambda row: let(scanned(row, True), lambda right: F.transform(scanned(row, False), lambda left, x: closest(left, F.get(right, x), x)))
    near = F.transform(_upto(height), lambda y: let(F.slice(mask, y * width + 1, width), in_row))

    def best(n: Column, i: Column) -> Column:
        y, x = F.floor(i / width).cast("int"), i % width
        at = lambda k, kx: F.when(kx >= 0, F.struct(((y - k) * (y - k) + (x - kx) * (x - kx)).alias("d2"), (k * width + kx).alias("at")))
        found = F.array_min(F.transform(_upto(height), lambda k: let(F.get(F.get(n, k), x), lambda kx: at(k, kx))))
        return found["at"] if radius is None else let(found, lambda f: F.when(f["d2"] <= radius * radius, f["at"]))

    return let(near, lambda n: F.transform(mask, lambda m, i: F.when(m == 0, i).otherwise(best(n, i))))


def nearest_fill(values: Column, mask: Column, height: int, width: int, bands: int = 1, radius: float | None = None) -> Column:
    """An array with its gaps taken from the nearest known cell, as they are where there is none (within the radius)."""
    at = lambda cells, i: F.get(values, F.get(cells, F.floor(i / bands).cast("int")) * bands + i % bands)
    return let(nearest_cells(mask, height, width, radius), lambda cells: F.transform(values, lambda v, i: F.coalesce(at(cells, i), v)))


def _gaps_and_known(px: DataFrame) -> DataFrame:
    gap = px.filter("gap = 1").select("patch_id", "y", "x", "b")
    known = px.filter("gap = 0").select("patch_id", F.col("y").alias("ky"), F.col("x").alias("kx"), "b", F.col("v").alias("kv"))
    dy, dx = F.col("y") - F.col("ky"), F.col("x") - F.col("kx")
    return gap.join(known, ["patch_id", "b"]).withColumn("d2", (dy * dy + dx * dx).cast("double"))


def fill_idw(px: DataFrame, power: float = 2.0, radius: float | None = None) -> DataFrame:
    """Gaps filled with means of known pixels weighted by 1 / distance ** power; a radius is that of a square window."""
    near = _gaps_and_known(px)
    if radius is not None:
        near = near.filter((F.abs(F.col("y") - F.col("ky")) <= radius) & (F.abs(F.col("x") - F.col("kx")) <= radius))
    weight = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-10)), F.lit(power))
    best = near.groupBy("patch_id", "y", "x", "b").agg((F.sum(weight * F.col("kv")) / F.sum(weight)).alias("fill"))
    filled = px.join(best, ["patch_id", "y", "x", "b"], "left")
    return filled.withColumn("rec", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("fill", "v")))).drop("fill")


def pixel_metrics(px: DataFrame) -> DataFrame:
    """psnr, rmse and accuracies of the gap pixels of each raster; px has clean, rec and gap.

    Without gaps: psnr infinite, rmse 0, accuracies 1.
    """
    gap = F.col("gap") == 1
    e = F.col("clean") - F.col("rec")
    got = px.groupBy("patch_id").agg(F.count_if(gap).alias("n_gap"), F.avg(F.when(gap, e * e)).alias("mse"), *(F.avg(F.when(gap, (F.abs(e) <= t).cast("double"))).alias(f"a{k}") for k, t in THRESHOLDS.items()))
    out = {"psnr": psnr_of_mse(F.col("mse")), "rmse": F.coalesce(F.sqrt("mse"), F.lit(0.0))}
    for k in THRESHOLDS:
        accuracy = F.coalesce(f"a{k}", F.lit(1.0))
        out |= {f"pixel_acc_{k}": accuracy, f"f1_{k}": f1_of_accuracy(accuracy)}
    return got.withColumns(out).select("patch_id", "n_gap", *out)


def spectral_angle(px: DataFrame) -> DataFrame:
    """Mean angle in degrees between clean and filled spectra of gap pixels; 0 without any."""
    a, b = F.col("clean"), F.col("rec")
    dots = px.filter("gap = 1").groupBy("patch_id", "y", "x").agg(F.sum(a * b).alias("ab"), F.sqrt(F.sum(a * a)).alias("na"), F.sqrt(F.sum(b * b)).alias("nb"))
    size = F.col("na") * F.col("nb")
    angle = F.when(size > 1e-10, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / size)))))
    got = dots.groupBy("patch_id").agg(F.avg(angle).alias("sam"))
    return px.select("patch_id").distinct().join(got, "patch_id", "left").withColumn("sam", F.coalesce("sam", F.lit(0.0)))


def band_errors(px: DataFrame) -> DataFrame:
    """rmse and mean clean value of the gap pixels by raster and band."""
    e = F.col("clean") - F.col("rec")
    return px.filter("gap = 1").groupBy("patch_id", "b").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("clean").alias("mean_clean"))


def ergas(px: DataFrame) -> DataFrame:
    """100 times the root mean of squared relative band errors; bands with a mean within 1e-10 are left out."""
    ratio = F.col("rmse") / F.col("mean_clean")
    got = band_errors(px).groupBy("patch_id").agg((100 * F.sqrt(F.avg(F.when(F.abs("mean_clean") > 1e-10, ratio * ratio)))).alias("ergas"))
    return px.select("patch_id").distinct().join(got, "patch_id", "left").withColumn("ergas", F.coalesce("ergas", F.lit(0.0)))


def rmse_per_band(px: DataFrame, bands: int) -> DataFrame:
    """One column a band."""
    wide = band_errors(px).groupBy("patch_id").pivot("b", list(range(bands))).agg(F.first("rmse"))
    return wide.withColumnsRenamed({str(b): f"rmse_b{b}" for b in range(bands)})


def gap_loss(px: DataFrame, power: int = 2) -> DataFrame:
    """Sum of squared (or absolute) errors over gaps, divided by their number, or by 1."""
    e = F.when(F.col("gap") == 1, F.abs(F.col("clean") - F.col("rec")) ** power).otherwise(0.0)
    return px.groupBy("patch_id").agg((F.sum(e) / F.greatest(F.count_if(F.col("gap") == 1), F.lit(1))).alias("loss"))
