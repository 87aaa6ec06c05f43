"""Schemas of the tables and the boundary where NaN becomes NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

NOISE_LEVELS = ("inf", "40", "30", "20")
ENTROPY_COLUMNS = ("entropy_7", "entropy_15", "entropy_31")
METRICS = ("psnr", "ssim", "rmse", "pixel_acc_002", "f1_002", "pixel_acc_005", "f1_005", "pixel_acc_01", "f1_01", "sam", "ergas", "rmse_b0", "rmse_b1", "rmse_b2", "rmse_b3")


def _struct(strings: str = "", ints: str = "", longs: str = "", doubles: str = "", order: str = "") -> T.StructType:
    kinds = {c: t for names, t in ((strings, T.StringType()), (ints, T.IntegerType()), (longs, T.LongType()), (doubles, T.DoubleType())) for c in names.split()}
    return T.StructType([T.StructField(c, kinds[c]) for c in (order.split() or kinds)])


RESULTS = _struct(
    strings="noise_level method method_category satellite status error_msg",
    ints="seed",
    longs="patch_id",
    doubles=f"gap_fraction elapsed_s {' '.join(ENTROPY_COLUMNS)} {' '.join(METRICS)}",
    order=f"seed noise_level method method_category patch_id satellite gap_fraction status error_msg elapsed_s {' '.join(ENTROPY_COLUMNS)} {' '.join(METRICS)}",
)
MANIFEST = _struct(strings="satellite split bands acquisition_date clean_path mask_path degraded_inf_path degraded_40_path degraded_30_path degraded_20_path", longs="patch_id", doubles="gap_fraction mean_entropy_7 mean_entropy_15 mean_entropy_31")
HISTORY = T.StructType([T.StructField("model_name", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("epochs", T.ArrayType(T.MapType(T.StringType(), T.DoubleType())))])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as NULL; infinities stay."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
