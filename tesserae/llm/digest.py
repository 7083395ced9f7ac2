"""Improbable-feature digests of byte strings.

Every window of 32 bytes has an entropy; over the corpus, entropies that few
windows have are rare. A window is selected if it is the rarest (leftmost of
equals) in enough of the runs of 32 neighbouring windows that it is part of. The
selected windows, in order, go into a chain of Bloom filters, 160 to a filter.
Two digests are compared filter by filter: the bits in common over what chance
gives, normalised by the most there could be, with the best partner of each
filter of the shorter chain.

The rarities are counted over all windows of the corpus; digests made with the
same table of rarities can be compared.

Defined results: a text of fewer than 32 bytes is one feature; an empty or null
text has an empty digest, which is like an empty digest (1) and like no other
(0); repeated rows give repeated results and rows of one doc_id stand in the
order of their texts; a null doc_id comes first; a single document's next
document is itself; texts of any length are worked on in whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bucket, cuts, documents, parts

WINDOW = 32
#: Neighbouring windows among which the rarest is popular, and in how many such runs it must be.
RUN, POPULAR = 32, 8
#: Entropy levels.
LEVELS = 320
#: Windows below this entropy (bits) repeat a few bytes and say little.
DULL = 2.0
BITS, FILTER, PROBES = 2048, 160, 5
#: Bytes of texts worked on at once.
BLOCK = 1 << 20

_C = np.arange(WINDOW + 1, dtype=float)
_CLOG = _C * np.log2(np.maximum(_C, 1))
#: What the c-th equal byte adds to the sum of c * log2(c), in fixed point so that sums are exact.
_STEP = np.zeros(WINDOW + 1, np.int64)
_STEP[1:] = np.round((_CLOG[1:] - _CLOG[:-1]) * (1 << 20)).astype(np.int64)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of each window of the bytes."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    come, go = np.cumsum(_STEP[before + 1]), np.cumsum(_STEP[after + 1])
    total = come[WINDOW - 1 :].copy()
    total[1:] -= go[: n - WINDOW]
    top = WINDOW * 5 << 20  # log2(WINDOW) is 5
    return ((top - total) * (LEVELS - 1) // top).astype(np.int32)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length


def histogram(texts: list[bytes]) -> np.ndarray:
    """Windows of the texts by entropy level."""
    data, start, length = _joined(texts)
    found = levels(data)
    inside = np.zeros(len(found) + 1, np.int64)
    long = length >= WINDOW
    np.add.at(inside, start[long], 1)
    np.add.at(inside, (start + length - WINDOW + 1)[long], -1)
    return np.bincount(found[np.cumsum(inside[:-1]) > 0], minlength=LEVELS)


def rarities(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; dull levels last."""
    order = np.lexsort((np.arange(LEVELS), counts))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    rank[: int(DULL / 5 * (LEVELS - 1))] = LEVELS
    return rank


def selected(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The 64-bit hashes of each text's features, in order."""
    data, start, length = _joined(texts)
    windows = np.maximum(length - WINDOW + 1, 0)
    lv = levels(data)
    n = len(lv)
    taken: list[np.ndarray] = []
    long = windows >= RUN
    if n and long.any():
        key = rank[lv] * n + np.arange(n)
        least, width = key, 1
        while width < RUN:  # least key of ever longer runs
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        edge = np.zeros(len(least) + 1, np.int64)  # runs that lie within one text
        np.add.at(edge, start[long], 1)
        np.add.at(edge, (start + windows - RUN + 1)[long], -1)
        votes = np.bincount(least[np.cumsum(edge[:-1]) > 0] % n, minlength=n)
        taken.append(np.flatnonzero((votes >= POPULAR) & (rank[lv] < LEVELS)))
    # where no run votes, or for dull windows only, the rarest window stands for the text
    held = np.zeros(len(texts), bool)
    if taken:
        held[np.searchsorted(start, taken[0], "right") - 1] = True
    few = np.flatnonzero((windows > 0) & ~held)
    if len(few):
        taken.append(np.array([start[i] + int(np.argmin(rank[lv[start[i] : start[i] + windows[i]]])) for i in few], np.int64))
    place = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    hashes = _mixed(data[place[:, None] + np.arange(WINDOW)]) if len(place) else np.zeros(0, np.uint64)
    own = np.searchsorted(start, place, "right") - 1  # of equal starts (empty texts) the last one has the bytes
    at = np.searchsorted(own, np.arange(len(texts) + 1))
    out = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for i in np.flatnonzero((length > 0) & (length < WINDOW)):
        short = np.zeros((1, WINDOW), np.uint8)
        short[0, : length[i]] = data[start[i] : start[i] + length[i]]
        out[i] = _mixed(short) + np.uint64(length[i])
    return out


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    words = np.ascontiguousarray(rows).view("<u8")
    x = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        x = (x ^ words[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def chain(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters (rows of bytes) and how many features each holds."""
    n = -(-len(hashes) // FILTER)
    bits = np.zeros((n, BITS), np.uint8)
    row = np.arange(len(hashes)) // FILTER
    for k in range(PROBES):
        bits[row, (hashes >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), np.bincount(row, minlength=n) if n else np.zeros(0, np.int64)


def text_of(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """Each filter as its count and its bits, in hexadecimal."""
    return "".join(f"{c:02x}{f.tobytes().hex()}" for f, c in zip(*digest, strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """From 0 (no more in common than chance gives) to 1."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return float(not len(b[0]))
    ones_a, ones_b = (np.bitwise_count(x[0].view("<u8")).sum(axis=1).astype(float) for x in (a, b))
    common = np.array([np.bitwise_count(f.view("<u8") & b[0].view("<u8")).sum(axis=1) for f in a[0]], float)
    chance = np.outer(ones_a, ones_b) / BITS
    most = np.minimum.outer(ones_a, ones_b)
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    # a long chain holds a short one by the way; the share of features bounds how like they are
    return float((score.max(axis=1) * a[1]).sum() / max(a[1].sum(), b[1].sum()))


def fit(docs: DataFrame) -> np.ndarray:
    """The rarity rank of every entropy level, from all windows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            texts, size = [], 0
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                texts.append(t)
                size += len(t)
                if size > BLOCK:
                    counts += histogram(texts)
                    texts, size = [], 0
            if texts:
                counts += histogram(texts)
        yield pa.RecordBatch.from_pydict({"level": pa.array(np.arange(LEVELS), pa.int32()), "n": pa.array(counts, pa.int64())})

    found = documents(docs).select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()  # LEVELS rows
    counts = np.zeros(LEVELS, np.int64)
    for r in found:
        counts[r["level"]] = r["n"]
    return rarities(counts)


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, ahead: rows dealt by ranges of doc_id and sorted; each partition ends with (ahead = 1) the row after its last.

    The row that follows the last of all is the first of all.
    """
    rows = documents(docs)
    n = parts(docs.sparkSession)
    at = cuts(rows, "doc_id", n)
    placed = rows.withColumn("pid", bucket("doc_id", at))
    firsts = {r["pid"]: None if r["lost"] else r["first"] for r in placed.groupBy("pid").agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("lost")).collect()}  # one row a partition
    used = sorted(firsts)
    earlier = {p: q for p, q in zip(used, [*used[-1:], *used], strict=False)}
    width = max(used, default=0) + 1
    first = F.array(*(F.lit(firsts.get(p)).cast("long") for p in range(width)))[F.col("pid")]
    before = F.array(*(F.lit(earlier.get(p, 0)) for p in range(width)))[F.col("pid")]
    own = F.struct(F.col("pid").alias("pid"), F.lit(0).alias("ahead"))
    both = F.when(F.col("doc_id").eqNullSafe(first), F.array(own, F.struct(before.alias("pid"), F.lit(1).alias("ahead")))).otherwise(F.array(own))
    sent = placed.select("doc_id", "text", F.explode(both).alias("to")).select("doc_id", "text", "to.pid", "to.ahead")
    return sent.repartitionById(n, F.col("pid")).sortWithinPartitions("ahead", "doc_id", "text").select("doc_id", "text", "ahead")


def compare(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Every document's digest, that of its edited text, and how like it is to that and to the next document's."""

    def block(rows: list[tuple[int, str]], after: tuple[int, str]) -> pd.DataFrame:
        nexts = [*rows[1:], after]
        edited = []
        for (_, text), (_, other) in zip(rows, nexts, strict=True):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + other[:half]).encode())
        own = [t.encode() for _, t in [*rows, after]]
        digests = [chain(h) for h in selected(own + edited, rank)]
        mine, theirs, changed = digests[: len(rows)], digests[1 : len(rows) + 1], digests[len(rows) + 1 :]
        return pd.DataFrame(
            {
                "doc_id": pd.array([d for d, _ in rows], "Int64"),
                "n_chars": [len(t) for _, t in rows],
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
                "fingerprint": [text_of(d) for d in mine],
                "edited_fingerprint": [text_of(d) for d in changed],
                "near_edited": [likeness(a, b) for a, b in zip(mine, changed, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(mine, theirs, strict=True)],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size, ended = 0, False
        for batch in batches:
            for doc_id, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead")), strict=True):
                if ended:
                    continue
                if held and (ahead or size > BLOCK):
                    yield pa.RecordBatch.from_pandas(block(held, (doc_id, text)), schema=OUT, preserve_index=False)
                    held, size = [], 0
                ended = bool(ahead)
                held.append((doc_id, text))
                size += len(text)

    return followed(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
