"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: method aliases and labels of noise levels
ALIASES = {"l1_dct": "cs_dct", "l1_wavelet": "cs_wavelet", "exemplar_based": "exemplar"}
NOISE_LABELS = {"inf": "gap_only", "40": "snr40dB", "30": "snr30dB", "20": "snr20dB"}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, table: dict[str, str], fallback: Column | None = None) -> Column:
    """The value of a literal map, else the fallback (the key itself)."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), key if fallback is None else fallback)


def slugify(text: Column, default: str = "run") -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit(default))


def six_digits(x: Column) -> Column:
    """A number with six significant digits at most and no trailing zeros; null is `none`.

    Exponents under -4 and from 6 on are written as such, with two digits at least. A tie in the
    seventh digit is rounded away from zero.
    """
    said = F.format_string("%.5e", F.abs(x))
    digits, power = F.replace(F.substring(said, 1, 7), F.lit("."), F.lit("")), F.substring(said, 9, 9).cast("int")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    sign, one = F.when(x < 0, "-").otherwise(""), F.lit(1)
    above = F.concat(F.substr(digits, one, power + 1), F.lit("."), F.substr(digits, power + 2))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(bare(F.substring(said, 1, 7)), F.substring(said, 8, 10))
    text = F.when((power >= 0) & (power < 6), bare(above)).when((power < 0) & (power >= -4), bare(below)).otherwise(scientific)
    return F.when(x.isNull(), "none").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, "0").otherwise(F.concat(sign, text))


def array_path(patch_id: Column, variant: str, *folders: Column) -> Column:
    return F.concat_ws("/", *folders, F.concat(F.lpad(patch_id.cast("string"), 7, "0"), F.lit(f"_{variant}.npy")))


def stable_seed(salt: Column) -> Column:
    """The first eight hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(salt, 256), 1, 8), 16, 10).cast("long")


def stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def p_text(p: Column) -> Column:
    return F.when(p < 1e-10, "<1e-10").otherwise(F.format_string("%.2e", p))


def latex_escape(text: Column) -> Column:
    return F.replace(F.upper(text), F.lit("_"), F.lit("\\_"))


def f1_of_accuracy(a: Column) -> Column:
    return F.when(a > 0, 2 * a / (1 + a)).otherwise(0.0)


def psnr_of_mse(mse: Column) -> Column:
    return F.when(mse.isNull() | (mse < 1e-12), F.lit(float("inf"))).otherwise(10 * F.log10(1 / mse))


def adjusted_r2(r2: Column, n: Column, predictors: int = 1) -> Column:
    return 1 - (1 - r2) * (n - 1) / (n - predictors - 1)


def row_mean(*columns: str) -> Column:
    """The mean of a row's non-null values."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(count > 0, total / count)


def arguments(options: Column) -> Column:
    """`--name value` pairs of a map of texts by key, underscores as hyphens; null values are left out."""
    entries = F.array_sort(F.filter(F.map_entries(options), lambda e: e["value"].isNotNull()))
    return F.concat_ws(" ", F.transform(entries, lambda e: F.concat(F.lit("--"), F.replace(e["key"], F.lit("_"), F.lit("-")), F.lit(" "), e["value"])))


def preferred(columns: list[str], first: tuple[str, ...] = ("entropy_7", "entropy_15"), prefix: str = "entropy_") -> str | None:
    """The first of the wanted columns that a table has, else its first one with the prefix by name."""
    return next((c for c in (*first, *sorted(c for c in columns if c.startswith(prefix))) if c in columns), None)


def display_range(values: Column) -> Column:
    """Joint min-max stretch to [0, 1]; NaN counts as 0, a constant (under 1e-8) is all zeros."""
    clean = F.filter(values, lambda v: ~F.isnan(v))
    low, span = F.array_min(clean), F.array_max(clean) - F.array_min(clean)
    return F.transform(values, lambda v: F.when(F.isnan(v) | (span < 1e-8), 0.0).otherwise((v - low) / span))
