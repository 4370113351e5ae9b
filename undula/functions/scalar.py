"""Scalar expressions: levels, axes, windows, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def level_db(magnitude: Column, reference: Column | float) -> Column:
    """20 log10 of a magnitude over a reference, both kept above 1e-12."""
    reference = F.lit(float(reference)) if isinstance(reference, int | float) else reference
    return 20 * F.log10(F.greatest(magnitude, F.lit(EPS)) / F.greatest(reference, F.lit(EPS)))


def power_db(power: Column, floor: float = 1e-30) -> Column:
    return 10 * F.log10(power + F.lit(floor))


def mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz(m: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)


def axis_hz(scale: str, low: float, high: float, rows: int, row: Column) -> Column:
    """Frequency of a row of a linear, logarithmic or mel axis."""
    part = row / F.lit(float(max(rows - 1, 1)))
    if scale == "log":
        low = max(low, 20.0)
        return F.lit(low) * F.pow(F.lit(high / low), part)
    if scale == "mel":
        a, b = 2595.0 * math.log10(1 + low / 700.0), 2595.0 * math.log10(1 + high / 700.0)
        return mel_to_hz(F.lit(a) + part * F.lit(b - a))
    return F.lit(float(low)) + part * F.lit(float(high - low))


def window_value(name: str, n: int, i: Column) -> Column:
    """Coefficient i of a symmetric window of n points."""
    if name == "rect" or n < 2:
        return F.lit(1.0)
    x = 2 * math.pi * i / F.lit(float(n - 1))
    if name == "hann":
        return 0.5 - 0.5 * F.cos(x)
    if name == "hamming":
        return 0.54 - 0.46 * F.cos(x)
    if name == "blackman":
        return 0.42 - 0.5 * F.cos(x) + 0.08 * F.cos(2 * x)
    return 1.0 - F.abs(2.0 * i / F.lit(float(n - 1)) - 1.0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters turned into one dash, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def safe_name(name: Column, default: str = "file") -> Column:
    """A file name without folders, control and reserved characters or leading dots."""
    kept = F.ltrim(F.trim(F.regexp_replace(base_name(name), r'[\x00-\x1f<>:"|?*]', "_")), F.lit(". "))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def clean_message(text: Column, limit: int = 200) -> Column:
    """Absolute paths removed, cut to ``limit`` characters."""
    return F.substring(F.regexp_replace(text, r"(/[^\s/:]+)+/", ""), 1, limit)


def minutes(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(whole, F.lit(60)).cast("string"), 2, "0"))
