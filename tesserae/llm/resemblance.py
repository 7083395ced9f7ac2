"""Pairs of texts whose sets of word shingles resemble each other (Jaccard).

A resemblance of 0.8 lets SimHash fingerprints differ in a dozen bits and more,
where every partition of 64 bits is matched by a share of all pairs. So pairs
are sought by sketches: shingle hashes fall into bins, a bin keeps its least
hash, and runs of bins are keys. Candidates are compared by their whole shingle
sets, so what is returned is exact; before that only those go whose numbers of
shingles alone rule the threshold out, which loses none. (How far sketches agree
is no such bound: in a short text one shingle owns many bins.)

A key that many texts share (a passage, a large group of near copies) is not
paired. All texts with such keys are joined by prefixes instead, which loses nothing
whatever keys they share: with each text's shingles in order of the number of those
texts that have them, the rarest first, two texts that resemble each other by the
threshold share a shingle among the first n - ceil(threshold * n) + 1 of both, and at
places that leave enough shingles behind them. What is common to many texts stands
last and joins nobody. The texts of a shingle are held against the one with the least
that is rarer (the centre of a group of copies), then what that does not link
against the next such text, and in the end all that the places allow and that is not
connected yet. So two texts are either compared or connected already.

Defined results: texts without shingles resemble each other and nothing else; a null
text is empty; rows with a null doc_id take no part; repeated rows count once, and of
rows that share a doc_id any may be compared; texts of any length are compared in
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import documents, settle
from tesserae.llm.components import least_labels

BINS, RUN = 192, 8
#: Texts of a key that are paired directly.
ROOM = 24
#: Shingle hashes that a task keeps of texts it has just compared.
KEPT = 2_000_000


def hashes(text: str, width: int) -> np.ndarray:
    from tesserae.llm.simhash import shingle_hashes

    return np.unique(shingle_hashes(text, width))


def sketch(h: np.ndarray) -> np.ndarray:
    """The least hash (32 bits of it) in each bin; an empty bin has the value of the next that is not."""
    if not len(h):
        return np.zeros(BINS, np.uint32)
    bins = (h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)  # h is sorted, and so are its bins
    used, first = np.unique(bins, return_index=True)
    values = (h[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return values[np.searchsorted(used, np.arange(BINS)) % len(used)]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (its distinct shingles) and keys: longs, one for each run of bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, made = [], []
                for t in batch.column("text").to_pylist():
                    h = hashes(t, width)
                    n.append(len(h))
                    made.append(sketch(h))
                x, key = np.stack(made), np.zeros((len(made), BINS // RUN), np.uint64)
                for i in range(RUN):
                    key = (key ^ x[:, i::RUN]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))], names=["doc_id", "n", "keys"])

    return documents(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, n long, keys array<bigint>")


def _compared(found: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """a, b, similarity of those pairs that are at or over the threshold. Texts of documents in a pair only are moved."""
    needed = found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct()
    texts = settle(documents(docs).join(needed.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    both = found.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        held = 0

        def of(doc_id: int, text: str) -> np.ndarray:
            nonlocal held
            if doc_id not in kept:
                h = hashes(text, width)
                if held + len(h) > KEPT:
                    kept.clear()
                    held = 0
                kept[doc_id] = h
                held += len(h)
            return kept[doc_id]

        for batch in batches:
            score = [resemblance(of(a, s), of(b, t)) for a, b, s, t in zip(batch["a"], batch["b"], batch["s"], batch["t"], strict=True)]
            out = batch[["a", "b"]].assign(similarity=np.array(score, float))
            yield out[out["similarity"] >= threshold]

    return settle(both.select("a", "b", "s", "t").mapInPandas(exact, "a long, b long, similarity double"), "alike")


def _prefixes(docs: DataFrame, hot: DataFrame, width: int, threshold: float) -> DataFrame:
    """h, doc_id, n, pos: the shingles of each text's prefix that another text has, and how many of its shingles are rarer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [hashes(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(h) for h in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n", "h"])

    texts = documents(docs).join(hot.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = settle(texts.mapInArrow(run, "doc_id long, n long, h array<bigint>"), "shingles").select("doc_id", "n", F.explode("h").alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    place = Window.partitionBy("doc_id").orderBy("texts", "h")
    ranked = rows.join(counts, "h").withColumn("pos", F.row_number().over(place) - 1)
    first = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    return settle(ranked.where((F.col("texts") > 1) & (F.col("pos") < first)).select("h", "doc_id", "n", "pos"), "prefixes")


def _enough(x: str, y: str, threshold: float):
    """Whether two entries of a shingle leave room for the overlap that the threshold asks for."""
    behind = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return behind >= F.lit(threshold / (1 + threshold)) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - F.lit(1e-6)


def pairs(docs: DataFrame, width: int = 5, threshold: float = 0.8, among: DataFrame | None = None) -> DataFrame:
    """a, b (doc_ids, a < b), similarity: pairs at or over the threshold that connect all that is brought together.

    ``among`` (one column of doc_ids) names the documents in question; rows that
    share one of these doc_ids have the same text.
    """
    made = sketches(docs, width)
    if among is not None:
        made = made.join(among.toDF("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])  # ids grow with the corpus: they are never broadcast
    made = settle(made, "sketches")
    some = made.where("n > 0")
    keyed = some.select("doc_id", "n", F.posexplode("keys").alias("run", "key"))
    sizes = keyed.groupBy("run", "key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    few = keyed.join(sizes.where(F.col("texts") <= ROOM), ["run", "key"]).select("run", "key", "doc_id", "n")
    hot = settle(keyed.join(sizes.where(F.col("texts") > ROOM), ["run", "key"]).select("doc_id").distinct(), "hot")
    bare = made.where("n = 0").select("doc_id")
    low = bare.agg(F.min("doc_id").alias("a"))  # one row
    empty = bare.join(F.broadcast(low), F.col("a") < F.col("doc_id")).select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))

    side = lambda x: few.select("run", "key", F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"))
    may = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - F.lit(1e-9)
    direct = side("a").join(side("b"), ["run", "key"]).where("a < b").where(may).select("a", "b").distinct()
    links = _compared(settle(direct, "candidates"), docs, width, threshold).union(empty)
    if hot.isEmpty():
        return links
    entries = _prefixes(docs, hot, width, threshold)
    tried = None
    for star in (True, True, False):
        roots = least_labels(links).select(F.col("node").alias("doc_id"), "root")
        placed = settle(entries.join(roots, "doc_id", "left").select("h", "doc_id", "n", "pos", F.coalesce("root", "doc_id").alias("root")), "placed")
        parted = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
        left = placed.join(parted, "h", "left_semi")
        if star:
            rarer = F.struct((F.col("pos") / F.col("n")).alias("share"), "doc_id", "n", "pos", "root")
            hubs = left.groupBy("h").agg(F.min(rarer).alias("y")).select("h", "y.*")
            if tried is not None:  # what the first hubs did not link, against the best of that
                out = left.alias("x").join(hubs.select("h", F.col("root").alias("hub")), "h").where("x.root <> hub").select("h", "x.doc_id", "x.n", "x.pos", "x.root")
                left = settle(out, "left")
                hubs = left.groupBy("h").agg(F.min(rarer).alias("y")).select("h", "y.*")
        else:
            left = hubs = settle(left, "left")
        met = left.alias("x").join(hubs.alias("y"), "h").where("x.root <> y.root").where(_enough("x", "y", threshold))
        found = met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = settle(found, "candidates")
        more = _compared(found, docs, width, threshold)
        links, tried = links.union(more), found if tried is None else tried.union(found)
    return links
