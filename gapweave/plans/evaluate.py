"""The evaluation plan: patches, noise levels and methods in, one row of metrics for each out."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import fills
from ..operators.select import remaining
from ..schemas import ENTROPY_COLUMNS, METRICS, RESULTS
from ..session import ship

ENTROPY_WINDOWS = (7, 15, 31)
FIELDS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULTS)


def local_entropy(grey: np.ndarray, window: int) -> np.ndarray:
    """Entropy of the window around each pixel, one summed-area table for each grey level that occurs."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd and positive")
    v = grey.astype(float)
    span = v.max() - v.min()
    g = np.zeros(v.shape, np.int64) if span < 1e-10 else ((v - v.min()) * 255 / span).astype(np.int64)
    r, (h, w) = window // 2, v.shape
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r, h - 1) + 1
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r, w - 1) + 1
    n = (y1 - y0)[:, None] * (x1 - x0)[None]
    total = np.zeros((h, w))
    for level in np.unique(g):
        s = np.pad((g == level).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        c = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
        total += c * np.log2(np.maximum(c, 1))
    return np.maximum(np.log2(n) - total / n, 0.0)


PIXELS = 256  # of rasters whose windows are counted by comparing all pairs of pixels
PAIRS = 1 << 20  # pairs of pixels that are compared at once
CHUNK = 1 << 15  # pixels of rasters handled together


def mean_entropies(grey: np.ndarray, windows: Sequence[int]) -> np.ndarray:
    """(n, windows): means of local_entropy of rasters (n, h, w)."""
    n, h, w = grey.shape
    if h * w > PIXELS or any(k < 1 or k % 2 == 0 for k in windows):
        return np.array([[local_entropy(g, k).mean() for k in windows] for g in grey]).reshape(n, len(windows))
    if n > (step := max(1, PAIRS // (h * w) ** 2)):
        return np.concatenate([mean_entropies(grey[k : k + step], windows) for k in range(0, n, step)])
    v = grey.reshape(n, -1).astype(float)
    low, span = v.min(1, keepdims=True), np.ptp(v, axis=1)[:, None]
    g = np.where(span < 1e-10, 0, (v - low) * 255 / np.where(span < 1e-10, 1, span)).astype(np.int64)
    same = (g[:, :, None] == g[:, None, :]).astype(np.float32)
    y, x = np.divmod(np.arange(h * w), w)
    log2 = np.log2(np.maximum(np.arange(h * w + 1), 1))
    out, done = np.empty((n, len(windows))), {}
    for at, k in enumerate(windows):
        reach = min(k // 2, max(h, w) - 1)
        if reach not in done:
            inside = (np.abs(y[:, None] - y) <= reach) & (np.abs(x[:, None] - x) <= reach)
            size = inside.sum(1)
            # every pixel of a window adds the logarithm of how many there share its level
            near = inside.astype(np.float32) @ same if not inside.all() else same.sum(1, keepdims=True)
            logs = log2[near.astype(np.int32)]
            total = np.einsum("ij,kij->ki", inside.astype(float), logs) if not inside.all() else logs.sum(2)
            done[reach] = np.maximum(np.log2(size[: total.shape[1]]) - total / size[: total.shape[1]], 0.0).mean(1)
        out[:, at] = done[reach]
    return out


def entropies(patches: DataFrame, shape: tuple[int, int, int], stored: DataFrame | None = None, windows: Sequence[int] = ENTROPY_WINDOWS) -> DataFrame:
    """patch_id and entropy_N for each window: the manifest's mean_entropy_N, else that of `stored`, else computed from `clean`.

    patches: patch_id, clean and what the manifest has of the mean_entropy_N columns; `stored` has one row a
    patch_id and some of the entropy_N columns. NaN counts as missing. Pixels of patches that lack nothing are not
    sent to Python; a patch without usable pixels keeps nulls.
    """
    names = [f"entropy_{n}" for n in windows]
    number = lambda c: F.when(~F.isnan(c), c.cast("double"))
    known = {n: [number(F.col(f"mean_{n}"))] if f"mean_{n}" in patches.columns else [] for n in names}
    rows = patches.select("patch_id", "clean", *(f"mean_{n}" for n in names if known[n]))
    if stored is not None:
        have = [n for n in names if n in stored.columns]
        rows = rows.join(stored.select("patch_id", *(F.col(n).alias(f"stored_{n}") for n in have)), "patch_id", "left")
        for n in have:
            known[n].append(number(F.col(f"stored_{n}")))
    rows = rows.select("patch_id", "clean", *(F.coalesce(*known[n], F.lit(None).cast("double")).alias(n) for n in names))
    lacking = F.exists(F.array(*names), lambda x: x.isNull())
    h, w, c = shape
    ship(patches.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, pixels in pdf["clean"].items():
                try:
                    grey = None if pixels is None else np.asarray(pixels, float).reshape(h, w, c).mean(2)
                except (TypeError, ValueError):  # not this many numbers
                    grey = None
                if grey is not None and np.isfinite(grey).all():
                    for n, name in zip(windows, names):
                        if pd.isna(pdf.at[i, name]):
                            pdf.at[i, name] = local_entropy(grey, n).mean()
            yield pdf[["patch_id", *names]]

    kind = dict(patches.dtypes)["patch_id"]
    out = rows.withColumn("clean", F.when(lacking, F.col("clean"))).mapInPandas(run, f"patch_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return out.withColumns({n: number(F.col(n)) for n in names})


def evaluate(patches: DataFrame, methods: Sequence[str], shape: tuple[int, int, int], params: dict[str, dict] | None = None, keep_arrays: bool = False, tasks: int | None = None, windows: Sequence[int] = ENTROPY_WINDOWS) -> DataFrame:
    """Results rows for every patch row and method.

    patches: seed, noise_level, patch_id, satellite, gap_fraction, clean, degraded and mask
    arrays. A patch crosses into Python once and all methods run on it there; an error makes a row with
    status `error` and NULL metrics. With keep_arrays the reconstruction comes along. A column
    `wanted` (array of method names) narrows a row's methods. A table of few bytes is one task by itself;
    `tasks` deals its patches out, as the work is in the methods. `windows` are those of the entropies.
    Methods run on stacks of patches, so elapsed_s is a patch's share of its stack's time; a stack that fails
    is run again patch by patch.
    """
    ship(patches.sparkSession)
    params = params or {}
    chosen = [fills.method(m) for m in methods]
    h, w, c = shape
    columns = [f.name for f in RESULTS] + ["reconstruction"] * keep_arrays
    texts = [f.name for f in RESULTS if f.dataType.simpleString() == "string"]
    keys = ["seed", "noise_level", "patch_id", "satellite", "gap_fraction"]

    def arrays(p) -> tuple:
        """clean, degraded, mask and entropies of one patch, or the error that its arrays raise."""
        try:
            clean, degraded = (np.asarray(x, np.float32).reshape(h, w, c)[..., 0 if c == 1 else slice(None)] for x in (p.clean, p.degraded))
            mask = np.asarray(p.mask).reshape(h, w) != 0
            grey = clean if c == 1 else clean.mean(2)
            return clean, degraded, mask, grey if np.isfinite(grey).all() else [float(local_entropy(grey, n).mean()) for n in windows]
        except Exception as e:  # unusable arrays: every method's row says so
            return (e,)

    def judged(m: fills.Method, clean: np.ndarray, degraded: np.ndarray, mask: np.ndarray) -> tuple[dict, np.ndarray]:
        filled = m.apply_many(degraded, mask, **params.get(m.name, {}))
        return fills.metrics_many(clean, filled, mask), filled

    def rows_of(m: fills.Method, some: pd.DataFrame, stacks: list, values: np.ndarray) -> pd.DataFrame:
        """The rows of one method for patches with usable arrays."""
        out = some[keys].assign(method=m.name, method_category=m.category, status="ok")
        began = time.perf_counter()
        try:
            got, filled = judged(m, *stacks)
            wrong = [None] * len(some)
        except Exception as e:
            if len(some) > 1:
                return pd.concat([rows_of(m, some.iloc[k : k + 1], [x[k : k + 1] for x in stacks], values[k : k + 1]) for k in range(len(some))])
            got, filled, wrong = {}, None, [f"{type(e).__name__}: {e}"]  # a patch's failure is a row, the job goes on
        found = got | ({f"entropy_{n}": values[:, k] for k, n in enumerate(windows)} if got else {})
        out = out.assign(**found, error_msg=wrong, elapsed_s=(time.perf_counter() - began) / len(some))
        if not got:
            out["status"] = "error"
        if keep_arrays:
            out["reconstruction"] = [None] * len(some) if filled is None else list(filled.reshape(len(some), -1))
        return out

    def handled(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        read = [arrays(p) for p in pdf.itertuples(index=False)]
        wanted = [None if x is None else set(x) for x in pdf["wanted"]]
        good = [k for k, x in enumerate(read) if len(x) > 1]
        values = np.empty((len(pdf), len(windows)))
        finite = [k for k in good if isinstance(read[k][3], np.ndarray)]
        if finite:
            values[finite] = mean_entropies(np.stack([read[k][3] for k in finite]), windows)
        for k in set(good) - set(finite):
            values[k] = read[k][3]
        for m in chosen:
            at = [k for k in good if wanted[k] is None or m.name in wanted[k]]
            if at:
                yield rows_of(m, pdf.iloc[at], [np.stack([read[k][i] for k in at]) for i in range(3)], values[at])
            bad = [k for k, x in enumerate(read) if len(x) == 1 and (wanted[k] is None or m.name in wanted[k])]
            if bad:
                errors = [f"{type(read[k][0]).__name__}: {read[k][0]}" for k in bad]
                yield pdf[keys].iloc[bad].assign(method=m.name, method_category=m.category, status="error", error_msg=errors, elapsed_s=0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CHUNK // (h * w))
        for pdf in batches:
            for k in range(0, len(pdf), step):
                for out in handled(pdf.iloc[k : k + step]):
                    # text as objects: Spark takes no chunked string columns
                    out = out.reindex(columns=columns)
                    yield out.astype(dict.fromkeys(texts, object)).where(out.notna(), None).astype({f: float for f in columns if f not in texts and f in (*METRICS, *ENTROPY_COLUMNS)})

    if tasks:
        patches = patches.repartition(tasks)
    if "wanted" not in patches.columns:
        patches = patches.withColumn("wanted", F.lit(None).cast("array<string>"))
    out = patches.select("seed", "noise_level", "patch_id", "satellite", "gap_fraction", "clean", "degraded", "mask", "wanted").mapInPandas(run, FIELDS + (", reconstruction array<float>" if keep_arrays else ""))
    return out.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in (*METRICS, *ENTROPY_COLUMNS)})


def resume(patches: DataFrame, done: DataFrame | None, methods: Sequence[str], shape: tuple[int, int, int], retry_errors: bool = False, tasks: int | None = None) -> DataFrame:
    """evaluate() of the patch and method pairs without a row in `done`.

    Arrays take no part in the anti join: only the keys of what is left are joined back to them,
    with the methods that a patch still wants; no other method runs on it.
    """
    if done is None:
        return evaluate(patches, methods, shape, tasks=tasks)
    names = [fills.method(m).name for m in methods]
    keys = patches.select("seed", "noise_level", "patch_id").withColumn("method", F.explode(F.array(*map(F.lit, names))))
    left = remaining(keys, done, retry_errors=retry_errors)
    wanted = left.groupBy("seed", "noise_level", "patch_id").agg(F.collect_set("method").alias("wanted"))
    return evaluate(patches.join(wanted, ["seed", "noise_level", "patch_id"]), methods, shape, tasks=tasks)
