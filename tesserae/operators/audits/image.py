"""Images as planes of luminance: perceptual hashes, statistics, and structure under turns and shifts. NumPy in Arrow functions.

Decoding is the caller's: a plane is a square array of values from 0 to 1 as float32
bytes, and colours are three such values for each of its points.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import arrow

CONFIRMED, FLAT = 0.985, 1e-7
FEATURES = "hashes array<bigint>, quantiles array<double>, spectrum array<double>, edge double, tints array<double>"
LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: How far pictures may be apart in any quantile of colour or of contrast to be compared at all. Fixed values.
COLOUR, CONTRAST = 0.075, 0.04


def reduced(plane: np.ndarray, n: int) -> np.ndarray:
    """Means of equal blocks."""
    k = len(plane) // n
    return plane[: k * n, : k * n].reshape(n, k, n, k).mean(axis=(1, 3))


def turned(plane: np.ndarray) -> list[np.ndarray]:
    """The eight turns and mirrors."""
    return [np.rot90(p, r) for p in (plane, np.fliplr(plane)) for r in range(4)]


def perceptual_hash(plane: np.ndarray) -> int:
    """Signs of the 63 lowest cosine coefficients about their median."""
    x = reduced(plane, 32)
    base = np.cos(np.pi * (2 * np.arange(32) + 1) * np.arange(8)[:, None] / 64)
    c = (base @ x @ base.T).ravel()[1:]
    return int(((c > np.median(c)).astype(np.uint64) << np.arange(63, dtype=np.uint64)).sum())


def features(plane: np.ndarray, colours: np.ndarray | None = None) -> tuple:
    small = reduced(plane, 64)
    q = np.quantile(small, LEVELS)
    tints = None if colours is None else np.quantile(np.stack([reduced(colours[..., i], 64) for i in range(3)]).reshape(3, -1), LEVELS, axis=1).ravel().tolist()
    power = np.abs(np.fft.fftshift(np.fft.fft2(small - small.mean()))) ** 2
    radius = np.hypot(*(np.indices(power.shape) - 32))
    rings = np.array([power[(radius >= a) & (radius < b)].sum() for a, b in zip((1, 2, 4, 8, 12, 18, 26), (2, 4, 8, 12, 18, 26, 46), strict=True)])
    edge = np.abs(np.diff(small, axis=0)).mean() + np.abs(np.diff(small, axis=1)).mean()
    return [perceptual_hash(p) for p in turned(small)], list(q - q[2]), list(rings / max(rings.sum(), 1e-12)), float(edge), tints


def structure(a: np.ndarray, b: np.ndarray) -> float | None:
    """The greatest absolute correlation over turns, mirrors and periodic shifts; None for a plane without contrast."""
    x, y = a - a.mean(), b - b.mean()
    if x.std() <= FLAT or y.std() <= FLAT:
        return None
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    other = np.conj(np.fft.rfft2(y))
    return min(1.0, max(float(np.abs(np.fft.irfft2(np.fft.rfft2(t) * other, s=y.shape)).max()) for t in turned(x)))


def _plane(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, "<f4").astype(float)
    return x.reshape(int(len(x) ** 0.5), -1)


@arrow(FEATURES)
def plane_features(planes: pd.Series, colours: pd.Series) -> pd.DataFrame:
    rows = []
    for plane, rgb in zip(planes, colours, strict=True):
        x = _plane(plane)
        rows.append(features(x, None if rgb is None else np.frombuffer(rgb, "<f4").astype(float).reshape(*x.shape, 3)))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])


@arrow("double")
def plane_structure(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([structure(_plane(a), _plane(b)) for a, b in zip(left, right, strict=True)], dtype=float)


def hamming(a: Column, b: Column) -> Column:
    """Least distance of any of a's hashes to any of b's."""
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.bit_count(x.bitwiseXOR(y))))))


def neighbours(rows: DataFrame, field: str, places: tuple[int, ...], width: float) -> DataFrame:
    """a_id < b_id of rows that may be within the width of each other in each of these places: they are in the same or neighbouring cells."""
    cells = [F.floor(F.get(field, F.lit(i)) / width).alias(f"c{i}") for i in places]
    base = rows.where(F.col(field).isNotNull()).select("id", *cells)
    steps = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in zip(places, ds, strict=True))) for ds in product((-1, 0, 1), repeat=len(places)))))
    right = base.withColumn("d", steps).select(F.col("id").alias("b_id"), *((F.col(f"c{i}") + F.col(f"d.d{i}")).alias(f"c{i}") for i in places))
    return base.withColumnRenamed("id", "a_id").join(right, [f"c{i}" for i in places]).where("a_id < b_id").select("a_id", "b_id")


def audit(images: DataFrame) -> DataFrame:
    """a_id < b_id, reason, correlation, relation of images (id, sha256, plane and, where there are any, rgb).

    Equal pictures are paired with the least of them, and only these meet others.
    Every rule asks for like contrast or like colours, so pairs meet in cells of three
    quantiles of the one or the other; features ride along, planes are fetched last.
    """
    firsts = images.groupBy("sha256").agg(F.min("id").alias("a_id"))
    exact = images.select("sha256", F.col("id").alias("b_id")).join(firsts, "sha256").where("a_id <> b_id")
    exact = exact.select("a_id", "b_id", F.lit("exact").alias("reason"), F.lit(None).cast("double").alias("correlation"), F.lit("exact").alias("relation"))
    held = images.join(firsts.select(F.col("a_id").alias("id")), "id", "left_semi")
    colours = F.col("rgb") if "rgb" in images.columns else F.lit(None).cast("binary")
    rows = held.select("id", F.explode(F.array(plane_features("plane", colours))).alias("f")).select("id", "f.*")
    met = neighbours(rows, "quantiles", (0, 3, 4), CONTRAST).union(neighbours(rows, "tints", (6, 7, 8), COLOUR)).distinct()
    side = lambda p: rows.select(*(F.col(c).alias(f"{p}_{c}") for c in rows.columns))
    both = met.join(side("a"), "a_id").join(side("b"), "b_id")
    most = lambda f: F.array_max(F.zip_with(f"a_{f}", f"b_{f}", lambda x, y: F.abs(x - y)))
    spread = lambda p: F.array_max(f"{p}_quantiles") - F.array_min(f"{p}_quantiles")
    edge = F.abs(F.col("a_edge") - F.col("b_edge"))
    rings = F.aggregate(F.zip_with("a_spectrum", "b_spectrum", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    near = lambda contrast, colour: (F.col("contrast") <= contrast) | F.coalesce(F.col("colour") <= colour, F.lit(False))
    reason = (
        F.when(hamming(F.col("a_hashes"), F.col("b_hashes")) <= 8, "perceptual-geometry")
        .when((spread("a") <= 0.08) & (spread("b") <= 0.08) & (F.col("contrast") <= 0.025) & (edge <= 0.018), "low-contrast-surface-family")
        .when(near(0.035, 0.045) & (rings <= 0.18) & (edge <= 0.018) & (F.greatest("a_edge", "b_edge") <= 0.23), "texture-statistics")
    )
    coarse = both.withColumns({"contrast": most("quantiles"), "colour": most("tints")}).where(near(CONTRAST, COLOUR)).withColumn("reason", reason).where("reason is not null").select("a_id", "b_id", "reason")
    planes = lambda p: held.select(F.col("id").alias(f"{p}_id"), F.col("plane").alias(f"{p}_plane"))
    scored = coarse.join(planes("a"), "a_id").join(planes("b"), "b_id").select("a_id", "b_id", "reason", F.explode(F.array(plane_structure("a_plane", "b_plane"))).alias("correlation"))
    c = F.col("correlation")
    relation = F.when(c >= CONFIRMED, "near").when((c >= 0.9) | c.isNull() | F.isnan(c), "candidate").otherwise("statistical")
    return exact.unionByName(scored.select("a_id", "b_id", "reason", "correlation", relation.alias("relation")))
