"""SimHash fingerprints, and links within a Hamming distance by the generalised pigeonhole principle.

If the 64 bits fall into partitions with thresholds t_i and the sum of t_i + 1
is over the distance, then two fingerprints within the distance differ in at most
t_i bits of some partition i. Bits that go together over the corpus share a
partition, so that some partitions have few distinct values and others many;
a dynamic programme gives every partition its own threshold (-1: not probed) so
that the estimated number of candidates is least. Partition values are probed
and candidates verified by their full distance.

Fingerprints are made distinct first, so any number of copies is one candidate.
A bucket with more than ``ROOM`` fingerprints is not paired: its members are
linked through the codes within one bit of them. Two fingerprints within two bits
of each other share such a code, and a code has at most 65 fingerprints around it,
so this is exact and linear in the members.

Defined results: a null or empty text, or one of white space, has fingerprint 0;
repeated rows keep one result row each; texts of any length count with all their
shingles; of equal fingerprints the least doc_id names the component; a null doc_id
never is a component's name unless it stands alone; an empty table gives no rows;
other columns are ignored by ``classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import documents, settle
from tesserae.llm.components import least_labels
from tesserae.llm.resemblance import pairs

BITS = 64
#: Members of a bucket that are paired directly.
ROOM = 128


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text, as an unsigned integer."""
    return int(_hashes_to_bits([shingle_hashes(text, width, seed)])[0])


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: A-Z are lowered, ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    said = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in said), np.uint64)


def _hashes_to_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """Majority bits of each array of hashes; none set where there are no hashes."""
    out = np.zeros(len(hashes), np.uint64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            counts = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * counts > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the bits as a signed long) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _hashes_to_bits([shingle_hashes(x, width, seed) for x in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found.view(np.int64)})

    return documents(docs).mapInPandas(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Probe:
    """A partition of the bits and how many of them may differ."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def co_occurrence(codes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many fingerprints have both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch["fp"].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both.ravel(), n).astype(np.int64)})

    both, n = np.zeros((BITS, BITS)), 0
    for r in codes.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 64 * 64 + 1 rows
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def grouped_bits(n: int, both: np.ndarray, groups: int) -> list[tuple[int, ...]]:
    """Bits in groups of like width; a group takes the bits that correlate most with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = set(range(BITS)), []
    for g in range(groups):
        width = len(left) // (groups - g)
        mine = [min(left, key=lambda b: (spread[b], b))]  # the most one-sided bit left
        left.discard(mine[0])
        while len(mine) < width:
            best = max(left, key=lambda b: (tie[b, mine].mean(), -b))
            mine.append(best)
            left.discard(best)
        out.append(tuple(sorted(mine)))
    return out


def _estimates(same: int, p: np.ndarray, bits: tuple[int, ...], most: int) -> list[float]:
    """Candidate pairs at thresholds -1, 0, ..., most: 0, the pairs that agree, and what single bits add, taken as independent."""
    agree = p[list(bits)] ** 2 + (1 - p[list(bits)]) ** 2
    odds = (1 - agree) / agree
    out, by_count = [0.0, float(same)], np.array([1.0] + [0.0] * most)
    for o in odds:  # elementary symmetric sums: ways to differ in k bits
        by_count[1:] += o * by_count[:-1]
    for k in range(1, most + 1):
        out.append(out[-1] + same * by_count[k])
    return out


def allocate(costs: list[list[float]], need: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) for the partitions, with t + 1 summing to ``need``, at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(options[: need - used + 1]):
                if used + k not in after or cost + c < after[used + k][0]:
                    after[used + k] = (cost + c, [*chosen, k - 1])
        best = after
    return best[need]


def plan_probes(codes: DataFrame, distance: int = 2) -> list[Probe]:
    """Partitions and thresholds for these fingerprints; partitions of two up to distance + 2 groups are weighed."""
    n, both = co_occurrence(codes)
    p = np.diag(both) / max(n, 1)
    sets = {m: grouped_bits(n, both, m) for m in range(2, distance + 3)}
    named = [(m, g, Probe(bits, 0).mask) for m, groups in sets.items() for g, bits in enumerate(groups)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for i, (_, _, mask) in enumerate(named))))
    sizes = codes.select(keys.alias("k")).groupBy("k.i", "k.key").agg(F.count(F.lit(1)).alias("n"))
    same = {r["i"]: r["pairs"] for r in sizes.groupBy("i").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).collect()}  # one row a partition
    best: tuple[float, list[Probe]] | None = None
    for m, groups in sets.items():
        costs = []
        for g, bits in enumerate(groups):
            at = next(i for i, (a, b, _) in enumerate(named) if (a, b) == (m, g))
            found = _estimates(same.get(at, 0), p, bits, distance)
            ways = np.cumsum([0, 1, len(bits), len(bits) * (len(bits) - 1) / 2])
            costs.append([c + 4 * n * w for c, w in zip(found, ways, strict=False)])  # a row moved costs as much as a few candidates
        cost, thresholds = allocate(costs, distance + 1)
        if best is None or cost < best[0]:
            best = cost, [Probe(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]
    return best[1]


def _variants(code: Column, probe: Probe) -> Column:
    """The partition's values within its threshold of the code's, its own first."""
    own = code.bitwiseAND(F.lit(probe.mask))
    flips = [0]
    for _ in range(probe.threshold):
        flips += [f | 1 << b for f in flips for b in probe.bits if not f >> b & 1]
    return F.transform(F.array(*(F.lit(_signed(f)) for f in sorted(set(flips)))), lambda f: own.bitwiseXOR(f))


def links(codes: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints ``codes`` (fp) that connect just what lies within the distance.

    Every link of a bucket that is paired is there; in larger buckets each code
    within one bit is linked with the least fingerprint around it, which connects
    the same fingerprints.
    """
    if distance > 2:
        raise ValueError("large buckets are linked exactly for a distance of 2 or less")
    probes = plan_probes(codes, distance)
    keyed = []
    for i, probe in enumerate(probes):
        values = F.explode(_variants(F.col("fp"), probe))
        keyed.append(codes.select("fp", F.lit(i).alias("part"), values.alias("key")).withColumn("own", F.col("key") == F.col("fp").bitwiseAND(F.lit(probe.mask))))
    rows = keyed[0]
    for more in keyed[1:]:
        rows = rows.union(more)
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0").drop("owners")
    members = settle(rows.join(sizes, ["part", "key"]), "members")

    few = members.where(F.col("n") <= ROOM)
    left, right = few.select(F.col("fp").alias("a"), "part", "key", "own"), few.select(F.col("fp").alias("b"), "part", "key", F.col("own").alias("own_b"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") < F.col("b")) & (F.col("own") | F.col("own_b"))
    exact = left.join(right, ["part", "key"]).where(near).select("a", "b")

    many = members.where(F.col("n") > ROOM).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in range(BITS)))
    around = many.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("code"))
    least = around.groupBy("code").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("code", "a")
    spread = around.join(least, "code").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    if distance < 2:
        spread = spread.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return exact.union(spread).distinct()


def classes(docs: DataFrame, width: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable over links, of every document."""
    found = settle(fingerprints(docs, width, seed), "fingerprints")
    nodes = settle(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = least_labels(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_code = settle(named.join(lows, "root").select("fp", "component_id"), "by-code")
    return found.join(by_code, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame, width: int = 5, distance: int = 2, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their class: of each class, one row of the least doc_id.

    Texts are classed, not doc_ids: rows that share a doc_id but not a class all stay.
    Classes are joined by fingerprints within the distance; and every distinct text
    is held against all others for shingle sets that resemble each other by the
    threshold, whatever its fingerprint's class. Rows without a doc_id stay: they have
    no name to be a copy by. Rows are named by a hash of doc_id and text; texts move once, when
    all is decided.
    """
    text, low = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    name = F.xxhash64(low, text)
    named = docs.where(low.isNotNull()).select(name.alias("doc_id"), text.alias("text"))
    rows = settle(docs.where(low.isNotNull()).select(name.alias("name"), low.alias("low"), F.xxhash64(text).alias("code"), F.xxhash64(text, F.lit(1)).alias("check")), "names")
    found = settle(classes(named, width, distance, seed).select(F.col("doc_id").alias("name"), F.col("component_id").alias("of")).distinct(), "classes")
    first = settle(rows.groupBy("code", "check").agg(F.min(F.struct("low", "name")).alias("row")).select("row.name"), "firsts")
    near = settle(pairs(named, width, threshold, first).select("a", "b"), "near")
    same = found.join(first.hint("merge"), "name", "left_semi").where("name <> of").select(F.col("of").alias("a"), F.col("name").alias("b"))
    roots = least_labels(near.union(same)).withColumnRenamed("node", "of")
    # a name's own label is that of its class, which holds its text; classes without links are their own
    classed = found.join(roots.hint("merge"), "of", "left").select("name", F.coalesce("root", "of").alias("class"))
    counted = rows.groupBy("name", "low").agg(F.count(F.lit(1)).alias("_n"))
    least = classed.join(counted.hint("merge"), "name").groupBy("class").agg(F.min(F.struct("low", "name", "_n")).alias("row"))
    chosen = settle(least.select(F.col("row.name").alias("_name"), "row._n"), "chosen")
    names = docs.columns
    every = docs.where(low.isNotNull()).withColumn("_name", name)
    some = every.join(chosen.hint("merge"), "_name")  # names grow with the corpus: they are never broadcast
    once = some.where("_n > 1").groupBy("_name").agg(F.first(F.struct(*(F.col(f"`{c}`") for c in names))).alias("row"))
    kept = some.where("_n = 1").select(*names).unionByName(once.select(*(F.col(f"row.`{c}`").alias(c) for c in names)))
    return kept.unionByName(docs.where(low.isNull()))
