"""Colours: notation, OKLab over black and white, palette distances. All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to linear light, and the published OKLab matrices. Fixed values.
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def canonical_color(color: Column) -> Column:
    """#rrggbbaa in lower case from 3, 4, 6 or 8 digits; null for anything else."""
    c = F.lower(F.trim(color))
    long = F.when(c.rlike(r"^#(?:[0-9a-f]{3}|[0-9a-f]{4})\z"), F.regexp_replace(c, "([0-9a-f])", "$1$1")).when(c.rlike(r"^#(?:[0-9a-f]{6}|[0-9a-f]{8})\z"), c)
    return F.when(F.length(long) == 7, F.concat(long, F.lit("ff"))).otherwise(long)


def _channel(color: Column, i: int) -> Column:
    return F.conv(F.substring(color, 2 * i, 2), 16, 10).cast("double") / 255.0


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def oklab6(color: Column) -> Column:
    """OKLab times 100 of a canonical colour laid over black, then over white."""
    rgb, alpha = [_channel(color, i) for i in (1, 2, 3)], _channel(color, 4)
    out = []
    for ground in (0.0, 1.0):
        light = [_linear(c * alpha + (1.0 - alpha) * ground) for c in rgb]
        cone = [F.cbrt(sum((w * x for w, x in zip(row[1:], light[1:], strict=True)), row[0] * light[0])) for row in LMS]
        out += [sum((w * x for w, x in zip(row[1:], cone[1:], strict=True)), row[0] * cone[0]) * 100.0 for row in LAB]
    return F.array(*out)


def _squares(a: Column, b: Column, at: int) -> Column:
    d = [a[i] - b[i] for i in range(at, at + 3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def worst_distance(a: Column, b: Column) -> Column:
    """The greater of the distances over black and over white."""
    return F.sqrt(F.greatest(_squares(a, b, 0), _squares(a, b, 3)))


def centroid(vectors: Column) -> Column:
    n = F.size(vectors)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.aggregate(F.transform(vectors, lambda v: F.get(v, i)), F.lit(0.0), lambda a, x: a + x) / n)


def distances(a: Column, b: Column) -> Column:
    """Worst distance of each pair of colours at the same place."""
    return F.zip_with(a, b, worst_distance)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def close(values: Column) -> Column:
    return (mean(values) <= 1.0) & (F.array_max(values) <= 2.0)
