"""Importance resampling: a corpus drawn towards a target by hashed runs of words.

A document's features are all runs of 1 to ``n`` consecutive words, joined by one
space; a feature's bucket is the CRC-32 of its bytes modulo the number of buckets. One
scan of a document gives all of them: a ring keeps the running CRC states of the last n
starts, and each word extends every one of them by a space and itself. No run is put
together as text.

A bucket's gain is the logarithm of how much commoner it is in the target than in the
corpus, both smoothed by one, in thousandths. A document's weight is the floored mean of
its features' gains; with a Gumbel draw that its doc_id alone decides, the highest
scores are a sample without replacement in proportion to the weights.

The buckets of a document travel as one array of two or four bytes each, written once
and read for the counts and for the weights. Counts are added up in each task first, so
what comes to the driver is one number a bucket, whatever the corpus. Ranks are given
within ranges of the order that hold about as many rows each, however many scores tie.

Defined results: words are runs of a-z (A-Z are lowered), digits and all beyond ASCII;
a null or empty text has no features, weight 0, and is never drawn; texts of any length
are read whole; repeated rows are documents of their own; a null doc_id draws as an
empty name and stands after others of its score; an empty table gives no rows, an empty
target leaves all counts of it at 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import documents, forget, parts, settle

#: Longest runs of words, buckets, the seed of the draw, the share drawn (percent) and the words a drawn document has.
LONGEST, BUCKETS, SEED, SHARE, WORDS = 2, 10_000, 7, 25, 20

_ORDINARY = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_ORDINARY).split()


def ring(said: list[bytes], n: int = LONGEST) -> list[int]:
    """The CRC-32 of every run of 1 to n words."""
    out: list[int] = []
    states: list[int] = []
    for word in said:
        further = b" " + word
        if len(states) == n:
            del states[0]
        states = [crc32(further, state) for state in states]
        states.append(crc32(word))
        out += states
    return out


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def features(docs: DataFrame, n: int = LONGEST, size: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and buckets (packed) of every document."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                said = [words(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                found = [np.array(ring(w, n), np.uint32) % np.uint32(size) for w in said]
                columns = [batch.column("doc_id"), pa.array([len(w) for w in said], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype(kind).tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def totals(found: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket. ``size`` numbers come to the driver."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for row in found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: floor(1000 ln((t + 1)(S + size) / ((s + 1)(T + size))))."""
    size, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weights(found: DataFrame, gain: np.ndarray, size: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a document's features (none: 0)."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(x, kind)].sum()) for x in batch.column("buckets").to_pylist()]
            mean = [s // max(n, 1) for s, n in zip(sums, batch.column("n_features").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(mean, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED) -> Column:
    """A document's draw in thousandths, from its doc_id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place in the whole order, from 1. Ranges of the order are ranked side by side, and each starts where those before it end."""
    spark = df.sparkSession
    ranges = settle(df.repartitionByRange(parts(spark), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_place", place).join(starts, "_range").select(*df.columns, (F.col("_start") + F.col("_place")).cast("long").alias(name))


def draw(docs: DataFrame, target: DataFrame, n: int = LONGEST, size: int = BUCKETS, seed: int = SEED, share: int = SHARE, least: int = WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; a rank only for those drawn.

    Of the N documents of ``least`` words or more, the floor(share * N / 100) highest
    scores are drawn, ties to the smaller doc_id. ``target`` has its texts in ``text``.
    """
    found = settle(features(docs, n, size), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, size)
    gain = gains(totals(found, size), totals(wanted, size))
    scored = settle(weights(found, gain, size).withColumn("score", F.col("weight") + gumbel(seed)), "scores")
    forget(found)
    able = scored.where(F.col("n_words") >= least).select("doc_id", "n_features", "weight", "score")
    most = share * able.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = ranked(able, order, "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(F.col("n_words") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.unionByName(rest)
