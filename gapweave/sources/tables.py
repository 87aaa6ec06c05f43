"""Sources: Parquet and CSV scans, ragged-file repair, array files, nested JSON, model folders, configuration."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..errors import ConfigError, SchemaError
from ..operators.select import bucket_names
from ..schemas import HISTORY, NOISE_LEVELS, RESULTS, nan_to_null

CSV = {"header": "true", "escape": '"', "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan"}


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to columns; extra columns of later files are merged."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV scan with a declared schema; inf and nan are numbers, NaN becomes NULL."""
    df = nan_to_null(spark.read.options(**CSV).schema(schema).csv(path))
    return df.select(*columns) if columns else df


#: A comma outside double quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def fields(line: Column) -> Column:
    """The fields of a CSV line, quotes taken off and doubled ones halved."""
    bare = lambda v: F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))
    return F.transform(F.split(line, _COMMA, -1), lambda v: F.when((F.length(v) > 1) & v.startswith('"') & v.endswith('"'), bare(v)).otherwise(v))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file from its first line, with CSV's quoting; none of an empty file."""
    first = spark.read.text(path).limit(1).select(fields(F.col("value")).alias("c")).collect()
    return list(first[0]["c"]) if first else []


def csv_by_name(spark: SparkSession, path: str, schema: T.StructType, names: Sequence[str], prefix: str = "mean_entropy_") -> DataFrame:
    """Columns that are named or begin with a prefix."""
    return csv(spark, path, schema, [c.name for c in schema if c.name in names or c.name.startswith(prefix)])


def csv_lenient(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): lines that do not fit the schema are set aside, not fatal.

    Each file's first line is its header, and no other line is taken for one. With `multi_line` quoted fields may hold line ends; a file
    is one task then.
    """
    full = T.StructType([*schema, T.StructField("_bad", T.StringType())])
    options = CSV | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": str(multi_line).lower(), "columnPruning": "false", "enforceSchema": "true"}
    names = [f.name for f in schema]
    # Spark refuses a scan of the corrupt column alone; a test that it cannot fold away, and that always holds, keeps the others in it
    read = F.xxhash64(*names) % 2 + F.rand(0) < 2
    rows = spark.read.options(**options).schema(full).csv(path).filter(read)
    return nan_to_null(rows.filter("_bad is null").select(*names)), rows.filter("_bad is not null").select(F.col("_bad").alias("line"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """The results table from Parquet, or from CSV with noise levels kept as text."""
    if path.rstrip("/").endswith(".csv"):
        present = header(spark, path)
        kinds = {f.name: f for f in RESULTS}
        return csv(spark, path, T.StructType([kinds.get(c, T.StructField(c, T.StringType())) for c in present]))
    return nan_to_null(spark.read.parquet(path))


def csv_ragged(spark: SparkSession, path: str, windows: Sequence[int] = (7, 15, 31)) -> DataFrame:
    """A results CSV in which later rows have more entropy fields than the header names.

    Missing entropy columns, in the order of their names, stand behind the last one named. Rows
    of any width but these two are dropped; it is an error if no row fits either.
    """
    names = header(spark, path)
    have = [c for c in names if c.startswith("entropy_")]
    missing = sorted(c for c in (f"entropy_{w}" for w in windows) if c not in have)
    at = max((names.index(c) + 1 for c in have), default=len(names))
    wide = [*names[:at], *missing, *names[at:]]
    kinds = {f.name: f.dataType.simpleString() for f in RESULTS}
    cells = spark.read.text(path).select(fields(F.col("value")).alias("c")).filter(F.col("c") != F.array(*map(F.lit, names)))

    def part(columns: list[str]) -> DataFrame:
        value = lambda i: F.nullif(F.get("c", F.lit(i)), F.lit(""))
        number = lambda i: F.when(F.lower(value(i)) == "inf", F.lit(float("inf"))).otherwise(value(i).try_cast("double"))
        return cells.filter(F.size("c") == len(columns)).select(*((number(i) if kinds.get(c) == "double" else value(i).try_cast(kinds.get(c, "string"))).alias(c) for i, c in enumerate(columns)))

    out = part(names).unionByName(part(wide), allowMissingColumns=True) if missing else part(names)
    if cells.limit(1).count() and not out.limit(1).count():
        raise SchemaError("no row has as many fields as the header or the repaired header")
    return out


def arrays(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """NPY files as rows: patch_id and variant from the name, shape, values in row-major order.

    A file that is no array gives a row with NULL values and the error.
    """
    schema = "path string, patch_id long, variant string, shape array<int>, values array<float>, error string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    a = np.load(io.BytesIO(raw), allow_pickle=False)
                    rows.append((list(a.shape), a.astype(np.float32).ravel(), None))
                except Exception as e:  # the file's own fault: reported in its row
                    rows.append((None, None, str(e)))
            yield pd.DataFrame({"path": pdf["path"], "shape": [r[0] for r in rows], "values": [r[1] for r in rows], "error": [r[2] for r in rows]})

    got = files.mapInPandas(load, "path string, shape array<int>, values array<float>, error string")
    stem = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    return got.withColumn("patch_id", F.nullif(F.regexp_extract(stem, r"^(\d+)", 1), F.lit("")).try_cast("long")).withColumn("variant", F.regexp_extract(stem, r"^\d+_(.*)$", 1)).select(*(c.split()[0] for c in schema.split(", ")))


def stems(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """patch_id of files whose names are, or begin with, numbers; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"/(\d+)[^/]*$", 1).try_cast("long").alias("patch_id")).filter("patch_id is not null").distinct()


def histories(spark: SparkSession, path: str) -> DataFrame:
    """Training histories, one row an epoch: model_name, metadata, epoch and its metrics."""
    df = spark.read.schema(HISTORY).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return df.select("model_name", "metadata", F.explode("epochs").alias("m")).select("model_name", "metadata", F.col("m")["epoch"].cast("int").alias("epoch"), F.col("m")["train_loss"].alias("train_loss"), F.col("m")["val_loss"].alias("val_loss"), F.map_filter("m", lambda k, _: k.startswith("val_") & (k != "val_loss")).alias("val_metrics"))


def selections(spark: SparkSession, path: str, expected: dict | None = None) -> DataFrame:
    """Patch selections of either layout as satellite, seed, patch_id, seed_pos; metadata must match if given."""
    inner = "map<string, map<string, array<bigint>>>"
    raw = spark.read.text(path, wholetext=True)
    both = raw.select(F.from_json("value", f"struct<metadata: map<string, string>, selections: {inner}>").alias("a"), F.from_json("value", inner).alias("b"), F.get_json_object("value", "$.selections").isNotNull().alias("wrapped"))
    if expected:
        agrees = F.lit(True)
        for k, v in expected.items():
            agrees = agrees & F.coalesce(F.try_element_at("a.metadata", F.lit(k)) == str(v), F.lit(False))
        if not both.filter(~agrees).isEmpty():  # every file's, not only the first one's
            raise ConfigError("the stored selections were made for another configuration")
    maps = both.select(F.when(F.col("wrapped"), F.col("a.selections")).otherwise(F.col("b")).alias("m"))
    rows = maps.select(F.explode("m").alias("satellite", "s")).select("satellite", F.explode("s").alias("seed", "ids")).select("satellite", F.col("seed").cast("int").alias("seed"), F.explode("ids").alias("patch_id"))
    return rows.withColumn("seed_pos", F.dense_rank().over(Window.partitionBy("satellite").orderBy("seed")))


def scenario_of(path: Column, root: str) -> Column:
    """The scenario folder above the model's folder, or `default`."""
    rest = F.split(F.regexp_replace(path, f"^.*{root.strip('/').split('/')[-1]}/", ""), "/")
    return F.when(F.size(rest) >= 3, F.get(rest, F.lit(0))).otherwise("default")


def model_results(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Evaluation CSVs of all model folders, with names of the results table and the scenario."""
    df = spark.read.options(**CSV, recursiveFileLookup="true", pathGlobFilter="*.csv").schema(schema).csv(root)
    df = df.withColumn("entropy_scenario", scenario_of(F.col("_metadata.file_path"), root))
    return unified_names(nan_to_null(df)).withColumn("type", F.lit("dl"))


def unified_names(df: DataFrame) -> DataFrame:
    """model, architecture and mean_entropy_* under the names of the results table."""
    names = {"model": "method", "architecture": "method_category"} | {c: c.removeprefix("mean_") for c in df.columns if c.startswith("mean_entropy_")}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def union(*frames: DataFrame) -> DataFrame:
    """All rows by column name; what a frame lacks is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialised(spark: SparkSession, path: str, compute) -> DataFrame:
    """A stored summary if it is there, else the result of compute()."""
    return spark.read.parquet(path) if exists(spark, path) else compute()


@dataclass(frozen=True)
class Experiment:
    """A validated experiment configuration."""

    name: str
    seeds: tuple[int, ...]
    noise_levels: tuple[str, ...]
    satellites: tuple[str, ...]
    entropy_windows: tuple[int, ...]
    max_patches: int | None
    methods: tuple[tuple[str, str, dict], ...]
    metrics: tuple[str, ...] = ("psnr", "ssim", "rmse")
    scenarios: dict[str, dict] = field(default_factory=dict)
    output_dir: str = "results"
    workers: int | None = None


def experiment(raw: dict | str) -> Experiment:
    """A configuration from a mapping or YAML/JSON text; wrong or missing entries raise ConfigError."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError:
            import yaml

            raw = yaml.safe_load(raw)
    if not isinstance(raw, dict) or "experiment" not in raw or "methods" not in raw:
        raise ConfigError("a configuration needs the sections experiment and methods")
    e = raw["experiment"]
    if absent := [k for k in ("name", "seeds", "noise_levels", "satellites") if not e.get(k)]:
        raise ConfigError(f"experiment lacks {', '.join(absent)}")
    noises = tuple(str(n).removesuffix(".0") for n in e["noise_levels"])
    if bad := [n for n in noises if n not in NOISE_LEVELS]:
        raise ConfigError(f"unknown noise levels: {', '.join(bad)}")
    windows = tuple(int(w) for w in e.get("entropy_windows", (7, 15, 31)))
    if any(w < 1 or w % 2 == 0 for w in windows):
        raise ConfigError("entropy windows must be odd and positive")
    most = e.get("max_patches")
    if most is not None and int(most) < 1:
        raise ConfigError("max_patches must be positive")
    methods = tuple((m["name"], category, dict(m.get("params") or {})) for category, ms in raw["methods"].items() for m in ms)
    if not methods:
        raise ConfigError("no methods")
    scenarios = dict((raw.get("entropy_filter") or {}).get("scenarios") or {})
    for s in scenarios.values():
        for k in ("train_buckets", "eval_buckets"):
            bucket_names(s.get(k, ()))
    return Experiment(e["name"], tuple(int(s) for s in e["seeds"]), noises, tuple(e["satellites"]), windows, most and int(most), methods, tuple(raw.get("metrics", ("psnr", "ssim", "rmse"))), scenarios, e.get("output_dir", "results"), e.get("workers"))
