"""Registered queries of the raster layer: arrays, entropy, fills and quality metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import display_range
from ..operators import fills, models
from ..operators import raster as ra
from ..operators import stats as st
from .evaluate import entropies, evaluate, resume
from ..session import scratch, ship
from ..sources import lookup, npy, sinks
from .registry import query, r
from .views import BANDS_SQL, PIXELS_SQL, patches, pixel_view

P = f"WITH {PIXELS_SQL}"
B = f"WITH {BANDS_SQL}"
#: The fill that metric queries judge: inverse distance, as SQL.
IDW_SQL = "dist AS (SELECT g.patch_id, g.y, g.x, g.b, sum(k.v / ((g.y-k.y)*(g.y-k.y)+(g.x-k.x)*(g.x-k.x))) / sum(1.0 / ((g.y-k.y)*(g.y-k.y)+(g.x-k.x)*(g.x-k.x))) AS fill FROM px g JOIN px k ON g.patch_id = k.patch_id AND g.b = k.b AND g.gap = 1 AND k.gap = 0 GROUP BY 1, 2, 3, 4), rec AS (SELECT px.*, px.v AS clean, CASE WHEN gap = 1 THEN greatest(0, least(1, fill)) ELSE v END AS rec FROM px LEFT JOIN dist USING (patch_id, y, x, b))"


def _filled(spark, sf, bands: int = 1) -> DataFrame:
    px = pixel_view(spark, sf, bands)
    return ra.fill_idw(px).withColumn("clean", F.col("v"))


@query(f"{P} SELECT patch_id, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean FROM px GROUP BY 1")
def raster_normalize(spark, sf):
    px = ra.pixels(patches(spark, sf).select("patch_id", ra.normalised(F.col("raw"), F.col("raw")).alias("values")), 8)
    return px.groupBy("patch_id").agg(F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT vec_id AS patch_id, round(list_sum(list_transform(embedding, lambda v: CASE WHEN v < 0 THEN 0 ELSE v::DOUBLE END)), 5) AS total FROM embeddings")
def raster_without_nan(spark, sf):
    nan = F.transform("raw", lambda v: F.when(v < 0, float("nan")).otherwise(v))
    return patches(spark, sf).select("patch_id", F.round(F.aggregate(ra.without_nan(nan), F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query(f"{P} SELECT patch_id, count(*) FILTER (v > 0.5) AS ones FROM px GROUP BY 1")
def raster_mask(spark, sf):
    ones = F.size(F.filter(ra.thresholded(F.col("clean")), lambda m: m == 1)).cast("long")
    return patches(spark, sf).select("patch_id", ones.alias("ones"))


@query(f"{P} SELECT patch_id, round(avg(gap), 6) AS gap_fraction FROM px GROUP BY 1")
def raster_gap_fraction(spark, sf):
    return patches(spark, sf).select("patch_id", ra.gap_fraction(F.col("mask")).alias("gap_fraction"))


@query("SELECT vec_id AS patch_id, CAST(i AS INT) AS place, embedding[(i % 4) * 16 + i // 4 + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)")
def raster_transpose(spark, sf):
    out = ra.channels_last(F.col("raw"), 16, 4)
    return patches(spark, sf).select("patch_id", F.posexplode(out).alias("place", "v"))


@query(f"{P} SELECT patch_id, round(sum(CASE WHEN gap = 1 THEN 1 - v ELSE v END), 6) AS total FROM px GROUP BY 1")
def raster_blend(spark, sf):
    df = patches(spark, sf).withColumn("other", F.transform("clean", lambda v: 1 - v))
    total = F.aggregate(ra.blended(F.col("other"), F.col("clean"), F.col("mask")), F.lit(0.0), lambda s, v: s + v)
    return df.select("patch_id", F.round(total, 6).alias("total"))


@query(f"{P} SELECT patch_id, CAST(128 AS INT) AS cells, round(sum(CASE WHEN gap = 1 THEN 0 ELSE v END) + sum(gap), 6) AS total FROM px GROUP BY 1")
def raster_model_input(spark, sf):
    out = ra.model_input(F.col("clean"), F.col("mask"))
    return patches(spark, sf).select("patch_id", F.size(out).alias("cells"), F.round(F.aggregate(out, F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("SELECT vec_id AS patch_id, round(list_sum(list_transform(embedding[1:48], lambda v: (v::DOUBLE - list_min(embedding[1:48])) / (list_max(embedding[1:48])::DOUBLE - list_min(embedding[1:48])))), 5) AS total FROM embeddings")
def display_minmax(spark, sf):
    shown = display_range(F.slice("raw", 1, 48))
    return patches(spark, sf).select("patch_id", F.round(F.aggregate(shown, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query(f"{B}, {IDW_SQL} SELECT patch_id, y, x, round(avg((clean - rec) * (clean - rec)), 6) AS err FROM rec GROUP BY 1, 2, 3")
def raster_error_map(spark, sf):
    return ra.error_map(_filled(spark, sf, 4)).withColumn("err", r(F.col("err")))


_ENTROPY_SQL = f"{P}, g AS (SELECT patch_id, y, x, CASE WHEN max(v) OVER w - min(v) OVER w < 1e-10 THEN 0 ELSE CAST(floor((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w)) AS INT) END AS g FROM px WINDOW w AS (PARTITION BY patch_id)), c AS (SELECT a.patch_id, a.y, a.x, b.g, count(*) AS c FROM g a JOIN g b ON a.patch_id = b.patch_id AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY 1, 2, 3, 4), e AS (SELECT patch_id, y, x, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY 1, 2, 3) SELECT patch_id, round(avg(e), 5) AS mean_entropy FROM e GROUP BY 1"


@query(_ENTROPY_SQL)
def raster_entropy(spark, sf):
    mean = F.aggregate(ra.entropy_map(F.col("clean"), 7, 8, 8), F.lit(0.0), lambda s, v: s + v) / 64
    return patches(spark, sf).repartition(_tasks(spark)).select("patch_id", F.round(mean, 5).alias("mean_entropy"))


@query(_ENTROPY_SQL.replace("mean_entropy", "mean_entropy_7"))
def entropy_maps(spark, sf):
    """Maps written as array files in two runs, the second of which resumes; the means of what is stored."""
    p = patches(spark, sf).select("patch_id", "clean").repartition(_tasks(spark))
    with scratch(spark, "entropy") as path:
        sinks.entropy_maps(p.filter("patch_id % 2 = 0"), path, (8, 8, 1), [7])
        return sinks.entropy_maps(p, path, (8, 8, 1), [7]).select("patch_id", F.round("mean_entropy_7", 5).alias("mean_entropy_7")).checkpoint()


@query(f"WITH {PIXELS_SQL}, s AS (SELECT patch_id, CASE patch_id % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'image' END AS source, CASE patch_id % 3 WHEN 0 THEN v::FLOAT::DOUBLE WHEN 1 THEN (floor(v * 255.0::DOUBLE + 0.5) / 255)::FLOAT::DOUBLE END AS v FROM px WHERE y < 6) SELECT patch_id, source, round(sum(v), 4) AS total FROM s GROUP BY 1, 2")
def reconstruction_lookup(spark, sf):
    """Reconstructions stored as arrays, as images or not at all, looked up in this order."""
    p = patches(spark, sf).select("patch_id", F.lit("idw").alias("method"), F.lit("inf").alias("noise_level"), F.slice("clean", 1, 48).alias("values")).repartition(_tasks(spark))
    files = p.select("patch_id", F.lit(None).cast("string").alias("variant"), F.array(*map(F.lit, (4, 4, 3))).alias("shape"), "values", "method", "noise_level")
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    with scratch(spark, "lookup") as path:
        npy.write(files.filter("patch_id % 3 = 0").withColumn("folder", F.concat_ws("/", "noise_level", "method")), f"{path}/reconstruction_arrays")
        npy.write(files.filter("patch_id % 3 < 2").withColumn("folder", F.col("method")), f"{path}/reconstruction_images", suffix=".png", dtype="float64")
        got = lookup.reconstructions(p.select("noise_level", "method", "patch_id"), path)
        return got.select("patch_id", "source", F.round(total, 4).alias("total")).checkpoint()


@query("SELECT patch_id, variant, cells, round(total, 4) AS total FROM (SELECT vec_id AS patch_id, 'clean' AS variant, [4, 4, 4] AS cells, list_sum(list_transform(range(64), lambda p: embedding[(p % 4) * 16 + p // 4 + 1]::DOUBLE * (p + 1))) AS total FROM embeddings UNION ALL SELECT vec_id, 'mask', [4, 4], list_sum(list_transform(range(16), lambda p: CASE WHEN (vec_id * 7 + p * 13) % 10 < 3 THEN 0 ELSE p + 1 END))::DOUBLE FROM embeddings)")
def stored_arrays(spark, sf):
    """Band-major patches and masks of valid cells, written as array files and read back; totals are weighted by place."""
    p = patches(spark, sf, 4).select("patch_id", "raw", "mask", F.col("label").cast("string").alias("satellite"))
    weighted = F.aggregate(F.transform("values", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    with scratch(spark, "arrays") as path:
        sinks.patch_arrays(p.withColumnRenamed("raw", "clean").repartition(_tasks(spark)), path, (4, 4, 4))
        return npy.arrays(spark, path).select("patch_id", "variant", F.col("shape").alias("cells"), F.round(weighted, 4).alias("total")).checkpoint()


@query(f"{P}, g AS (SELECT patch_id, CASE WHEN max(v) OVER w - min(v) OVER w < 1e-10 THEN 0 ELSE CAST(floor((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w)) AS INT) END AS g FROM px WINDOW w AS (PARTITION BY patch_id)), c AS (SELECT patch_id, g, count(*) AS c FROM g GROUP BY 1, 2), e AS (SELECT patch_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY 1) SELECT patch_id, CASE patch_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN patch_id / 2.0::DOUBLE ELSE round(e, 5) END AS entropy_15 FROM e")
def entropy_fallback(spark, sf):
    """The manifest's value, else the stored one, else that of the pixels; a window of 15 covers a whole patch of 8x8."""
    p, k = patches(spark, sf).select("patch_id", "clean"), F.col("patch_id") % 3
    stored = p.filter(k < 2).select("patch_id", (F.col("patch_id") / 2).alias("entropy_15"))
    got = entropies(p.withColumn("mean_entropy_15", F.when(k == 0, 1.5)), (8, 8, 1), stored, [15])
    return got.select("patch_id", F.round("entropy_15", 5).alias("entropy_15"))


@query(f"{P}, k AS (SELECT g.patch_id, g.y, g.x, k.v AS fill, row_number() OVER (PARTITION BY g.patch_id, g.y, g.x ORDER BY (g.y-k.y)*(g.y-k.y)+(g.x-k.x)*(g.x-k.x), k.y, k.x) AS n FROM px g JOIN px k ON g.patch_id = k.patch_id AND g.gap = 1 AND k.gap = 0) SELECT patch_id, y, x, round(fill, 6) AS fill FROM k WHERE n = 1")
def fill_nearest(spark, sf):
    p, mask = F.col("p"), F.col("mask")
    filled = patches(spark, sf).repartition(_tasks(spark)).select("patch_id", "mask", F.posexplode(ra.nearest_fill(F.col("clean"), mask, 8, 8)).alias("p", "v"))
    return filled.filter(F.get(mask, p) == 1).select("patch_id", F.floor(p / 8).cast("int").alias("y"), (p % 8).cast("int").alias("x"), F.round("v", 6).alias("fill"))


@query(f"{P}, {IDW_SQL} SELECT patch_id, y, x, round(rec, 5) AS fill FROM rec WHERE gap = 1")
def fill_idw(spark, sf):
    return ra.fill_idw(pixel_view(spark, sf)).filter("gap = 1").select("patch_id", "y", "x", F.round("rec", 5).alias("fill"))


@query(f"{P}, {IDW_SQL} SELECT patch_id, count(*) AS n_gap, round(10 * log10(1 / avg((clean - rec) * (clean - rec))), 5) AS psnr FROM rec WHERE gap = 1 GROUP BY 1")
def metric_psnr(spark, sf):
    return ra.pixel_metrics(_filled(spark, sf)).select("patch_id", "n_gap", F.round("psnr", 5).alias("psnr"))


@query(f"{P}, {IDW_SQL} SELECT patch_id, round(sqrt(avg((clean - rec) * (clean - rec))), 6) AS rmse FROM rec WHERE gap = 1 GROUP BY 1")
def metric_rmse(spark, sf):
    return ra.pixel_metrics(_filled(spark, sf)).select("patch_id", F.round("rmse", 6).alias("rmse"))


@query(f"{P}, {IDW_SQL}, a AS (SELECT patch_id, avg(CASE WHEN abs(clean - rec) <= 0.02 THEN 1.0 ELSE 0 END) AS a2, avg(CASE WHEN abs(clean - rec) <= 0.05 THEN 1.0 ELSE 0 END) AS a5, avg(CASE WHEN abs(clean - rec) <= 0.1 THEN 1.0 ELSE 0 END) AS a10 FROM rec WHERE gap = 1 GROUP BY 1) SELECT patch_id, round(a2, 6) AS pixel_acc_002, round(a5, 6) AS pixel_acc_005, round(a10, 6) AS pixel_acc_01, round(2 * a10 / (1 + a10), 6) AS f1_01 FROM a")
def metric_pixel_acc_f1(spark, sf):
    return ra.pixel_metrics(_filled(spark, sf)).select("patch_id", *(r(c) for c in ("pixel_acc_002", "pixel_acc_005", "pixel_acc_01", "f1_01")))


@query(f"{B}, {IDW_SQL}, s AS (SELECT patch_id, y, x, sum(clean * rec) / (sqrt(sum(clean * clean)) * sqrt(sum(rec * rec))) AS c FROM rec WHERE gap = 1 GROUP BY 1, 2, 3 HAVING sqrt(sum(clean * clean)) * sqrt(sum(rec * rec)) > 1e-10) SELECT patch_id, round(avg(degrees(acos(greatest(-1, least(1, c))))), 4) AS sam FROM s GROUP BY 1")
def metric_sam(spark, sf):
    return ra.spectral_angle(_filled(spark, sf, 4)).select("patch_id", F.round("sam", 4).alias("sam"))


@query(f"{B}, {IDW_SQL}, s AS (SELECT patch_id, b, sqrt(avg((clean - rec) * (clean - rec))) / avg(clean) AS q FROM rec WHERE gap = 1 GROUP BY 1, 2) SELECT patch_id, round(100 * sqrt(avg(q * q)), 4) AS ergas FROM s GROUP BY 1")
def metric_ergas(spark, sf):
    return ra.ergas(_filled(spark, sf, 4)).select("patch_id", F.round("ergas", 4).alias("ergas"))


@query(f"{B}, {IDW_SQL}, s AS (SELECT patch_id, b, round(sqrt(avg((clean - rec) * (clean - rec))), 6) AS q FROM rec WHERE gap = 1 GROUP BY 1, 2) SELECT patch_id, " + ", ".join(f"max(q) FILTER (b = {b}) AS rmse_b{b}" for b in range(4)) + " FROM s GROUP BY 1")
def metric_rmse_per_band(spark, sf):
    return ra.rmse_per_band(_filled(spark, sf, 4), 4).select("patch_id", *(r(f"rmse_b{b}") for b in range(4)))


@query(f"{P}, {IDW_SQL} SELECT patch_id, round(sum(CASE WHEN gap = 1 THEN (clean - rec) * (clean - rec) ELSE 0 END) / greatest(count(*) FILTER (gap = 1), 1), 6) AS loss FROM rec GROUP BY 1")
def gap_loss(spark, sf):
    return ra.gap_loss(_filled(spark, sf)).withColumn("loss", r(F.col("loss")))


_LAG = "z AS (SELECT patch_id, y, x, v - avg(v) OVER (PARTITION BY patch_id) AS z FROM px), l AS (SELECT a.patch_id, a.y, a.x, any_value(a.z) AS z, avg(b.z) AS lag FROM z a JOIN z b ON a.patch_id = b.patch_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3)"


@query(f"{P}, {_LAG} SELECT patch_id, count(*) AS n, round(sum(z * lag) / sum(z * z), 5) AS moran_i, round(-1.0 / (count(*) - 1), 6) AS expected_i FROM l GROUP BY 1")
def moran_i(spark, sf):
    return st.moran(pixel_view(spark, sf)).select("patch_id", "n", F.round("moran_i", 5).alias("moran_i"), r("expected_i"))


@query(f"{P}, {_LAG} SELECT patch_id, y, x, CASE WHEN z > 0 THEN CASE WHEN lag > 0 THEN 1 ELSE 4 END ELSE CASE WHEN lag > 0 THEN 2 ELSE 3 END END AS quadrant FROM l")
def lisa_quadrant(spark, sf):
    return st.quadrants(pixel_view(spark, sf))


_DEALS = "deals AS (SELECT k, cell, row_number() OVER (PARTITION BY k ORDER BY md5(concat('42|', k, '|', cell))) AS place FROM (SELECT unnest(range(1, 100)) AS k), (SELECT unnest(range(64)) AS cell))"


@query(f"{P}, {_LAG}, {_DEALS}, d AS (SELECT patch_id, k, place, cell, z AS dealt FROM l JOIN deals ON y * 8 + x = cell WHERE place <= 9), h AS (SELECT l.patch_id, y, x, l.z, lag, k, dealt, row_number() OVER (PARTITION BY l.patch_id, y, x, k ORDER BY place) AS r FROM l JOIN d ON l.patch_id = d.patch_id AND d.cell <> y * 8 + x), m AS (SELECT patch_id, y, x, k, any_value(z) AS z, any_value(lag) AS lag, avg(dealt) AS mean FROM h WHERE r <= (1 + (y > 0)::INT + (y < 7)::INT) * (1 + (x > 0)::INT + (x < 7)::INT) - 1 GROUP BY 1, 2, 3, 4), c AS (SELECT patch_id, y, x, any_value(z) AS z, any_value(lag) AS lag, count(*) FILTER (round(z * mean, 9) >= round(z * lag, 9)) AS larger FROM m GROUP BY 1, 2, 3) SELECT patch_id, y, x, CASE WHEN z > 0 THEN CASE WHEN lag > 0 THEN 1 ELSE 4 END ELSE CASE WHEN lag > 0 THEN 2 ELSE 3 END END AS quadrant, round((least(larger, 99 - larger) + 1) / 100.0::DOUBLE, 6) AS p FROM c")
def local_moran_p(spark, sf):
    """Pseudo-p of each cell from 99 permutations."""
    rasters = patches(spark, sf).select("patch_id", F.col("clean").alias("values"), F.array_repeat(F.lit(1), 64).alias("inside"))
    return st.local_p_arrays(rasters.repartition(_tasks(spark)), 8, 64, 99).withColumn("p", r(F.col("p")))


@query(f"{P}, {_LAG}, {_DEALS}, near AS (SELECT a.c AS cell, b.c AS other FROM range(64) a(c), range(64) b(c) WHERE a.c <> b.c AND abs(a.c // 8 - b.c // 8) <= 1 AND abs(a.c % 8 - b.c % 8) <= 1), dealt AS (SELECT patch_id, k, place - 1 AS slot, z FROM deals JOIN z ON cell = y * 8 + x), lags AS (SELECT patch_id, k, near.cell, avg(z) AS lag FROM near JOIN dealt ON other = slot GROUP BY 1, 2, 3), s AS (SELECT patch_id, k, sum(z * lag) AS s FROM dealt JOIN lags USING (patch_id, k) WHERE slot = cell GROUP BY 1, 2), o AS (SELECT patch_id, sum(z * lag) AS a, sum(z * z) AS b FROM l GROUP BY 1) SELECT patch_id, round(any_value(a / b), 5) AS moran_i, round((least(count(*) FILTER (round(s, 9) >= round(a, 9)), count(*) FILTER (round(s, 9) < round(a, 9))) + 1) / 100.0::DOUBLE, 6) AS p FROM s JOIN o USING (patch_id) GROUP BY 1")
def global_moran_p(spark, sf):
    """Moran's I with its pseudo-p from 99 permutations."""
    return st.global_p(pixel_view(spark, sf).repartition(_tasks(spark), "patch_id"), 8, 8, 99).select("patch_id", F.round("moran_i", 5).alias("moran_i"), r("p"))


#: Patches at four noise levels; what a level adds follows from patch and place.
_AMPLITUDE = {"inf": 0.0, "40": 0.01, "30": 0.03, "20": 0.1}
_SCENARIOS = {"low": ["low"], "upper": ["medium", "high"], "all": None}
_NOISY = f"lv AS (SELECT unnest({list(_AMPLITUDE)}) AS noise_level, unnest({list(_AMPLITUDE.values())})::DOUBLE AS amp), pt AS (SELECT vec_id AS patch_id, CAST(label % 3 AS VARCHAR) AS satellite, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, list_max(embedding)::DOUBLE AS entropy_7 FROM embeddings), d AS (SELECT patch_id, noise_level, y, x, v AS clean, gap, v + amp * ((patch_id * 31 + (y * 8 + x) * 17) % 101 - 50) / 50 AS d FROM px, lv)"


@query(f"""{P}, {_NOISY}, wh AS (SELECT patch_id, noise_level, avg(d) AS whole FROM d WHERE gap = 0 GROUP BY 1, 2),
g AS (SELECT a.patch_id, a.noise_level, a.y, a.x, any_value(a.clean) AS clean, avg(b.d) AS near FROM d a LEFT JOIN d b ON a.patch_id = b.patch_id AND a.noise_level = b.noise_level AND b.gap = 0 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.gap = 1 GROUP BY 1, 2, 3, 4),
f AS (SELECT patch_id, noise_level, clean, coalesce(near, whole, 0) AS near, coalesce(whole, 0) AS whole FROM g LEFT JOIN wh USING (patch_id, noise_level)),
q AS (SELECT satellite, quantile_cont(entropy_7, 1.0/3) AS lo, quantile_cont(entropy_7, 2.0/3) AS hi FROM pt WHERE split = 'train' GROUP BY 1),
sc AS (SELECT pt.*, s.entropy_scenario FROM pt LEFT JOIN q USING (satellite) JOIN (SELECT unnest(['low', 'upper', 'all']) AS entropy_scenario) s ON entropy_scenario = 'all' OR (entropy_scenario = 'low' AND entropy_7 <= lo) OR (entropy_scenario = 'upper' AND entropy_7 > lo)),
m AS (SELECT entropy_scenario, avg(clean) AS my, avg(near) AS mn, avg(whole) AS mw, var_pop(near) AS vn, var_pop(whole) AS vw, covar_pop(near, whole) AS nw, covar_pop(near, clean) AS ny, covar_pop(whole, clean) AS wy FROM sc JOIN f USING (patch_id) WHERE split = 'train' AND noise_level = 'inf' GROUP BY 1),
k AS (SELECT *, (vw * ny - nw * wy) / (vn * vw - nw * nw) AS kn, (vn * wy - nw * ny) / (vn * vw - nw * nw) AS kw FROM m),
e AS (SELECT entropy_scenario, noise_level, satellite, patch_id, entropy_7, clean - greatest(0, least(1, my + kn * (near - mn) + kw * (whole - mw))) AS e FROM sc JOIN f USING (patch_id) JOIN k USING (entropy_scenario) WHERE split = 'test')
SELECT entropy_scenario, noise_level, satellite, patch_id, round(entropy_7, 6) AS entropy_7, round(count(*) / 64.0::DOUBLE, 6) AS gap_fraction, round(sqrt(avg(e * e)), 5) AS rmse, round(10 * log10(1 / avg(e * e)), 4) AS psnr FROM e GROUP BY ALL""")
def scenario_models(spark, sf):
    """Linear models by scenario of entropy, evaluated on the test patches at every noise level."""
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("noise_level"), F.lit(a).alias("amp")) for k, a in _AMPLITUDE.items()))).alias("l")
    p = patches(spark, sf).repartition(_tasks(spark)).select("patch_id", (F.col("label") % 3).cast("string").alias("satellite"), F.array_max("raw").alias("entropy_7"), "clean", "mask", levels).select("*", "l.*")
    noisy = F.transform("clean", lambda v, i: v + F.col("amp") * ((F.col("patch_id") * 31 + i * 17) % 101 - 50) / 50)
    split = F.when(F.col("patch_id") % 10 < 7, "train").when(F.col("patch_id") % 10 == 7, "val").otherwise("test")
    got = models.run_scenarios(p.withColumn("degraded", noisy).withColumn("split", split), _SCENARIOS, (8, 8, 1))
    return got.select("entropy_scenario", "noise_level", "satellite", "patch_id", r("entropy_7"), r("gap_fraction"), F.round("rmse", 5).alias("rmse"), F.round("psnr", 4).alias("psnr"))


def _rows(spark, sf, bands: int = 1) -> DataFrame:
    return patches(spark, sf, bands).select(F.lit(0).alias("seed"), F.lit("inf").alias("noise_level"), "patch_id", F.col("label").cast("string").alias("satellite"), ra.gap_fraction(F.col("mask")).alias("gap_fraction"), "clean", "degraded", "mask")


def _tasks(spark) -> int:
    """As many as shuffles have, or cores: a new session counts two cores until its executors have registered."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _fill(name: str):
    def run(spark, sf):
        return evaluate(_rows(spark, sf), [name], (8, 8, 1), tasks=_tasks(spark)).select("patch_id", "status", "psnr", "ssim", "rmse")

    return run


for _name in fills.METHODS:
    if _name not in ("nearest", "idw"):
        query(name=f"fill_{_name}")(_fill(_name))


@query()
def metric_ssim(spark, sf):
    return evaluate(_rows(spark, sf, 4), ["idw"], (4, 4, 4), tasks=_tasks(spark)).select("patch_id", "ssim", "sam", "ergas")


@query()
def evaluate_pipeline(spark, sf):
    """All cheap methods on all patches, with a resume over what one method has done."""
    rows = _rows(spark, sf)
    done = evaluate(rows, ["nearest"], (8, 8, 1), tasks=_tasks(spark))
    left = resume(rows, done.select("seed", "noise_level", "method", "patch_id", "status"), ["nearest", "idw", "dct", "lanczos"], (8, 8, 1), tasks=_tasks(spark))
    return left.groupBy("method").agg(F.count("*").alias("n"), F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"))


@query()
def moran_permutation(spark, sf):
    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 16):
                part = pdf.iloc[k : k + 16]
                got = st.moran_permutations(np.array(part["clean"].tolist()).reshape(-1, 8, 8))
                yield pd.DataFrame({"patch_id": part["patch_id"], "moran_i": got["i"], "p": got["p"], "significant_cells": (got["local_p"] <= 0.05).sum((1, 2))})

    ship(spark)
    return patches(spark, sf).select("patch_id", "clean").repartition(_tasks(spark)).mapInPandas(run, "patch_id long, moran_i double, p double, significant_cells long")
