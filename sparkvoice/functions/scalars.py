"""Scalar functions of the comparison layer. A missing value is null, never NaN."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_GAP = 1e-6
SEMITONE_BASE_HZ = 27.5
#: Hz by sex.
PITCH_RANGES = {"m": (60.0, 400.0), "f": (90.0, 600.0), "default": (60.0, 600.0)}
FORMANT_CEILINGS = {"m": 5000.0, "f": 5500.0, "default": 5500.0}


def missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating column becomes null."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def recovery_rate(source: Column, converted: Column, target: Column, min_gap: float = MIN_GAP) -> Column:
    """How much of the way from source to target the converted value has gone; null where the way is shorter than min_gap."""
    gap = target - source
    return F.when(F.abs(gap) >= min_gap, F.try_divide(converted - source, gap))


def hz_to_semitones(f: Column) -> Column:
    return F.when(f > 0, 12 * F.log2(f / SEMITONE_BASE_HZ))


def semitones_to_hz(s: Column) -> Column:
    return SEMITONE_BASE_HZ * F.pow(F.lit(2.0), s / 12)


def log_ratio(num: Column, den: Column) -> Column:
    """Power ratio in dB; null unless both are positive."""
    return F.when((num > 0) & (den > 0), 10 * F.log10(F.try_divide(num, den)))


def sex_key(sex: Column) -> Column:
    return F.substring(F.lower(F.trim(sex)), 1, 1)


def by_sex(sex: Column, values: Mapping) -> Column:
    """The value for m or f, else the default."""
    key = sex_key(sex)
    out = F.lit(values["default"])
    for k in ("m", "f"):
        out = F.when(key == k, F.lit(values[k])).otherwise(out)
    return out


def range_source(sex: Column) -> Column:
    return F.when(sex_key(sex).isin("m", "f"), "sex").otherwise("default")


def formant_references(ceiling: Column, count: int = 5) -> Column:
    """Expected formants of a uniform tube under a ceiling."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (2 * k + 1) * ceiling / 10)


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), ""))
