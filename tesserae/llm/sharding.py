"""Minimax contiguous sharding of atomic groups.

Equal texts are one group, groups stand in the order of their first doc_id, and
shards are contiguous runs of groups. The largest shard shall be as small as can
be: binary search for the least capacity with which the greedy walk (fill a shard
while the next group fits) needs no more than the shards there are. Many cuts keep
to that capacity, and the greedy ones would leave all slack to the last shard; so
each cut is the group end nearest to its even share that a walk from either side,
filling shards to the capacity, can still reach.

The greedy walk only asks for the last group end at or below a given sum of
sizes. The driver never holds all groups: it holds the sums at the ends of
buckets of doc_ids, which bound each answer from below and above, and so bound
the least capacity. Only buckets in which a cut may fall for a capacity still in
question are opened into finer ones, until each such bucket is one group. A round
reads one aggregate of a bounded number of buckets.

Defined results: a null text has size 8 (nothing plus 8); null and empty texts
are one group: the empty text. A null doc_id
comes before all others. Repeated rows are members of one group, as any copies
are. If texts share a first doc_id (a doc_id that is not unique), they are one
group in the order. A text of any length is one atomic group; one that is larger
than an even share has a shard for itself, and shards may then be empty. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import documents, numbered, settle

#: Buckets that one bucket is opened into.
FAN = 64
#: Buckets of the first round.
FIRST = 4096


@dataclass
class Ends:
    """Sums of sizes at the ends of buckets [low, high) of the order, ascending; a bucket is ``whole`` if it is one group."""

    sums: list[int]
    spans: list[tuple[int, int]]
    whole: list[bool]

    def below(self, x: int) -> int:
        """A bucket end at or below x, which the last group end below x is not less than."""
        i = bisect_right(self.sums, x)
        return self.sums[i - 1] if i else 0

    def above(self, x: int) -> int:
        """What the last group end below x is at most."""
        i = bisect_right(self.sums, x)
        return (self.sums[i - 1] if i else 0) if i == len(self.sums) or self.whole[i] else x

    def holder(self, x: int) -> int:
        """The bucket with the first group end at or above x, for 0 < x <= the total."""
        return bisect_left(self.sums, x)

    def sure(self, x: int) -> bool:
        """Whether the first group end at or above x is known."""
        return x <= 0 or self.whole[self.holder(x)] or self.sums[self.holder(x)] == x

    def next(self, x: int) -> tuple[int, int]:
        """The first group end at or above x (0 is one) is from the first to the second of these."""
        if x <= 0:
            return 0, 0
        end = self.sums[self.holder(x)]
        return (end if self.sure(x) else x), end

    def last(self, x: int) -> int:
        """The last group end at or below x, where that is known."""
        i = bisect_right(self.sums, x)
        return self.sums[i - 1] if i else 0

    def reach(self, capacity: int, shards: int, step) -> int:
        at = 0
        for _ in range(shards):
            at = step(at + capacity)
        return at


def least(low: int, high: int, good) -> int:
    """The least capacity in [low, high] that is good; high must be."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return low


def _sums(groups: DataFrame, spans: list[tuple[int, int]], fan: int, origin: int, wide: int) -> list[tuple[int, int, int, int]]:
    """(low, high, groups, bytes) of the buckets with groups, each span cut into ``fan`` of equal width.

    Spans never cross the first round's buckets, ``wide`` places each from ``origin`` on.
    """
    spark = groups.sparkSession
    cell = lambda x: F.floor((x - F.lit(origin)) / F.lit(wide)).cast("long")
    opened = spark.createDataFrame([(low, high, max(1, -(-(high - low) // fan))) for low, high in spans], "low long, high long, step long")
    same = cell(groups["place"]) == cell(opened["low"]) if len(spans) > 1 else F.lit(True)
    inside = groups.join(F.broadcast(opened), same & (groups["place"] >= opened["low"]) & (groups["place"] < opened["high"]))  # a bounded number of spans
    at = F.col("low") + F.floor((F.col("place") - F.col("low")) / F.col("step")).cast("long") * F.col("step")
    rows = inside.groupBy(at.alias("at"), "high", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    return sorted((r["at"], min(r["at"] + r["step"], r["high"]), r["n"], r["bytes"]) for r in rows)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Least capacity, and the places at which shards 1, 2, ... begin. ``groups`` has place (distinct long) and bytes."""
    edge = groups.agg(F.min("place"), F.max("place")).head()
    if edge[0] is None:
        return 0, []
    origin, wide = edge[0], -(-(edge[1] + 1 - edge[0]) // FIRST)
    found = _sums(groups, [(origin, edge[1] + 1)], FIRST, origin, wide)
    while True:
        ends = _ends(found)
        sums, total = ends.sums, ends.sums[-1]
        start = -(-total // shards)
        sure = least(start, total, lambda c: ends.reach(c, shards, ends.below) >= total)
        possible = least(start, sure, lambda c: ends.reach(c, shards, ends.above) >= total)
        if possible == sure:
            break
        # open the buckets in which a cut may fall for some capacity from possible to sure
        unsure, low, high = set(), 0, 0
        for _ in range(shards):
            first, last = bisect_right(sums, low + possible), bisect_right(sums, high + sure)
            unsure.update(i for i in range(first, min(last + 1, len(sums))) if not ends.whole[i])
            low, high = ends.below(low + possible), ends.above(high + sure)
        finer = _sums(groups, [ends.spans[i] for i in sorted(unsure)], FAN, origin, wide)
        found = sorted([f for i, f in enumerate(found) if i not in unsure] + finer)
    while True:
        ends = _ends(found)
        cuts, unsure = _even(ends, sure, shards)
        if not unsure:
            return sure, [ends.spans[bisect_right(ends.sums, c)][0] for c in cuts if c < ends.sums[-1]]
        finer = _sums(groups, [ends.spans[i] for i in sorted(unsure)], FAN, origin, wide)
        found = sorted([f for i, f in enumerate(found) if i not in unsure] + finer)


def _ends(found: list[tuple[int, int, int, int]]) -> Ends:
    sums, total = [], 0
    for *_, size in found:
        total += size
        sums.append(total)
    return Ends(sums, [(low, high) for low, high, _, _ in found], [n == 1 for _, _, n, _ in found])


def _even(ends: Ends, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Sums at the cuts, and the buckets to open before these are sure."""
    total = ends.sums[-1]
    unsure = set()

    def ask(low: int, high: int) -> None:
        """Each end from low to high may matter."""
        if high > 0:
            unsure.update(i for i in range(ends.holder(max(low, 1)), ends.holder(high) + 1) if not ends.whole[i])

    # from the end: the first end from which the shards that follow still hold the rest
    low = high = total
    least_cut = [total]
    for _ in range(shards):
        if low == high and ends.sure(low - capacity):
            low = high = ends.next(low - capacity)[1]
        else:
            ask(low - capacity, high - capacity)
            low, high = ends.next(low - capacity)[0], ends.next(high - capacity)[1]
        least_cut.append(high)
    least_cut.reverse()
    shares = [total * i // shards for i in range(1, shards)]
    for x in shares:
        if not ends.sure(x):
            ask(x, x)
    if unsure:
        return [], unsure
    at, cuts = 0, []
    for i, share in enumerate(shares, 1):
        first, most = max(at, least_cut[i]), at + capacity
        if share <= first:
            at = first
        elif share >= most:
            if most < total and not ends.sure(most):
                ask(most, most)
            at = ends.last(most)
        else:
            below, above = ends.last(share), ends.next(share)[1]
            at = above if above <= most and above - share < share - below else below
        cuts.append(at)
    return cuts, unsure


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    rows = documents(docs).select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = settle(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    before = rows.agg(F.min("doc_id")).head()[0]
    place = F.coalesce(F.col("first"), F.lit((before or 0) - 1))
    groups = settle(groups.select("digest", place.alias("place"), "bytes"), "groups")
    capacity, starts = minimax_cuts(groups.groupBy("place").agg(F.sum("bytes").alias("bytes")), shards)
    at = F.size(F.filter(F.array(*(F.lit(x) for x in starts)).cast("array<bigint>"), lambda x: x <= F.col("place"))).cast("int")
    dealt = rows.join(groups.select("digest", at.alias("shard")), "digest").drop("digest")
    return numbered(dealt, ["shard"], ["doc_id", "text_crc32"], "slot", rows.count()).select("doc_id", "size", "text_crc32", "shard", "slot")
