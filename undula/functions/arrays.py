"""Expressions over arrays; each stays in the JVM and needs no shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def median(a: Column) -> Column:
    """The mean of the two middle values; null for an empty array."""
    n = F.size(a)
    return let(F.array_sort(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def between(a: Column, start: Column, end: Column) -> Column:
    """Items start to end - 1, counted from 0."""
    return F.slice(a, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def moving_mean(a: Column, bins: int) -> Column:
    """Sum of ``bins`` neighbours over ``bins``, missing ones counted as zero; even windows lean to the left."""
    if bins < 2:
        return a
    left, right, n = bins // 2, (bins - 1) // 2, F.size(a)
    return F.transform(a, lambda _, i: total(between(a, F.greatest(i - left, F.lit(0)), F.least(i + right + 1, n))) / F.lit(float(bins)))


def first_max(a: Column) -> Column:
    """Place of the first largest item, from 0."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def dft_magnitudes(x: Column, n: int) -> Column:
    """Magnitudes of bins 0 to n // 2 of a short frame, by the definition; long frames take ``functions.dsp``."""

    def at(k: Column) -> Column:
        angle = lambda i: F.lit(2 * math.pi / n) * F.pmod(k * i, F.lit(n))
        re = total(F.transform(x, lambda v, i: v * F.cos(angle(i))))
        im = total(F.transform(x, lambda v, i: v * F.sin(angle(i))))
        return F.sqrt(re * re + im * im)

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), at)
