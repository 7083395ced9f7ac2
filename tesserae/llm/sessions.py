"""Sessions of late events, batch by batch, by divide and conquer over the time axis.

Events of a user that lie at most ``gap`` apart are in one session. Batches come one
after another and may bring events of any time, so a session can grow and several can
become one: each batch makes a version of every session that it adds to, and retracts
the versions that the new one contains.

A shard is a user's events of a span of time. By itself it gives the history of its
islands (runs of events without a gap), batch by batch. An island that no event beyond
the shard can reach is a session, and its versions are final. An island within the gap
of the shard's border is open: only its history goes on. ``FAN`` neighbouring shards
are one shard of the next level, where for each batch the open islands of neighbours
are joined if they are near enough, and what is open still goes on. Joining is
associative, so shards of any level are made side by side; there are as many rounds
as the logarithm of the span of all events has digits in base ``FAN``. An open island
stays open and only grows, so a shard has two histories at most, one for each border.

What a task holds is bounded whatever the user: copies of an event (same user, time and
batch) are counted before they are moved; a shard of the lowest level has ``span`` units
of time; above it, histories are joined in blocks of ``BLOCK`` batches, each of which
starts from the last states before it. Nothing is collected or broadcast but the least
and the greatest time.

A version is named by its user, batch and start. The start of an open island is known
when its left border is: a join gives ``alias`` rows from the starts of the islands it
joins to its own. Which version retracts which is known where both are seen (``edge``
rows); of several edges of a version, as shards see only part of a session, the
earliest is right.

Defined results: rows with a null user, time or batch take no part; a null value counts
as 0; repeated rows are events of their own; events of one time and batch count
together, in any order; an empty table gives no versions; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import settle

#: Time units of a lowest shard (at least the gap), shards that are joined at once, and batches of a block.
SPAN, FAN, BLOCK = 3600, 16, 1024

VERSION, OPEN, EDGE, ALIAS = range(4)
KEYS = ("user", "node", "part")
MADE = "kind int, user long, node long, batch long, start long, end long, n long, n_new long, n_retracted long, total long, to_batch long, to_start long"
NAMES = [x.split()[0] for x in MADE.split(", ")]
TYPES = [pa.int32()] + [pa.int64()] * 11


class Island:
    """A run of events, as its shard sees it after the batch that last changed it."""

    __slots__ = ("start", "end", "n", "total", "batch", "new", "before")

    def __init__(self, start: int, end: int, n: int, total: int, batch: int, new: int, before: int):
        self.start, self.end, self.n, self.total, self.batch, self.new, self.before = start, end, n, total, batch, new, before


def runs(islands: list[Island], gap: int) -> Iterator[list[Island]]:
    """Neighbours that no gap parts; ``islands`` in order of their starts."""
    run, end = islands[:1], islands[0].end if islands else 0
    for x in islands[1:]:
        if x.start - end <= gap:
            run.append(x)
        else:
            yield run
            run, end = [x], x.end
        end = max(end, x.end)
    if run:
        yield run


def history(rows: list[tuple], gap: int) -> Iterator[tuple]:
    """What a lowest shard makes of its (batch, at, n, total), in order: islands it changed and edges between them."""
    standing: list[Island] = []
    for batch, came in groupby(rows, itemgetter(0)):
        fresh = [Island(at, at, n, total, batch, n, 0) for _, at, n, total in came]
        after = []
        for run in runs(sorted(standing + fresh, key=lambda x: x.start), gap):
            old = [x for x in run if not x.new]
            if len(old) == len(run):
                after += run
                continue
            x = Island(run[0].start, max(y.end for y in run), sum(y.n for y in run), sum(y.total for y in run), batch, 0, 0)
            after.append(x)
            yield OPEN, batch, x.start, x.end, x.n, sum(y.new for y in run), len(old), x.total, None, None
            for y in old:
                yield EDGE, y.batch, y.start, None, None, None, None, None, batch, x.start
        standing = after


def stitched(rows: list[tuple], gap: int) -> Iterator[tuple]:
    """The same for a shard of shards, from their open islands: (carried, batch, child, start, end, n, n_new, n_retracted, total), in order.

    Carried rows are states before the first batch of the block.
    """
    held: dict[int, list[Island]] = {}
    standing: list[list[Island]] = []

    def take(child: int, x: Island) -> None:
        held[child] = sorted([y for y in held.get(child, ()) if not x.start <= y.start <= x.end] + [x], key=lambda y: y.start)

    def now() -> list[list[Island]]:
        return list(runs([x for c in sorted(held) for x in held[c]], gap))

    for (carried, batch), came in groupby(rows, itemgetter(0, 1)):
        for _, _, child, start, end, n, new, before, total in came:
            take(child, Island(start, end, n, total, batch, 0 if carried else new, 1 if carried else before))
        if carried:
            standing = now()
            continue
        after = now()
        at = 0
        for run in after:
            first, last = run[0].start, run[-1].end
            inside = []
            while at < len(standing) and standing[at][0].start <= last:
                inside.append(standing[at])
                at += 1
            new = sum(x.new for x in run)
            if not new:
                continue
            before = sum(x.before for x in run) - sum(len(old) - 1 for old in inside)
            yield OPEN, batch, first, last, sum(x.n for x in run), new, before, sum(x.total for x in run), None, None
            if len(run) > 1:  # a single island has its edges from below
                for old in inside:
                    yield EDGE, max(x.batch for x in old), old[0].start, None, None, None, None, None, batch, first
                for x in run[1:]:
                    if x.new:
                        yield ALIAS, batch, x.start, None, None, None, None, None, None, first
            for x in run:
                x.new, x.before = 0, 1
        standing = after


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(user, node, part) and the rows of each group; the groups' rows lie together."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for its, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
            if its != key:
                if rows:
                    yield key, rows
                key, rows = its, []
            rows.append(row)
    if rows:
        yield key, rows


def _shards(rows: DataFrame, order: list[str], make: Callable[[list[tuple], int], Iterator[tuple]], gap: int, width: int, last: bool) -> DataFrame:
    """Runs ``make`` for each (user, node, part) of ``rows``; islands that nothing beyond the shard can reach become versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (user, node, _), group in grouped(batches):
            low, high = node * width + gap, (node + 1) * width - gap
            for kind, batch, start, end, *rest in make(group, gap):
                if kind == OPEN and (last or (start >= low and end < high)):
                    kind = VERSION
                out.append((kind, user, node, batch, start, end, *rest))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, *order).mapInArrow(run, MADE)


def _carried(rows: DataFrame) -> DataFrame:
    """For each part of a node that has several, the last states before it of each open border of its children."""
    parts = rows.select("user", "node", "part").distinct()
    several = parts.groupBy("user", "node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("user", "node")
    some = rows.join(several.hint("merge"), ["user", "node"], "left_semi")
    sides = some.select("*", F.explode(F.filter(F.array(F.when(F.col("left_open"), 0), F.when(F.col("right_open"), 1)), lambda x: x.isNotNull())).alias("side"))
    row = F.struct("batch", "child", "start", "end", "n", "n_new", "n_retracted", "total")
    lasts = sides.groupBy("user", "node", "part", "child", "side").agg(F.max_by(row, "batch").alias("row"))
    following = F.lead("part").over(Window.partitionBy("user", "node", "child", "side").orderBy("part"))
    lasts = lasts.withColumn("until", following).withColumnRenamed("part", "since")
    met = lasts.join(parts.hint("merge"), ["user", "node"]).where("part > since and (until is null or part <= until)")
    return met.select("user", "node", "part", F.lit(True).alias("carried"), "row.*").distinct()


def versions(events: DataFrame, gap: int, span: int = SPAN, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Every version of every session of ``events`` (user, at, batch, value; longs).

    Returns user, batch, start, end, n_events, n_new (of that batch), n_retracted, total
    (of the values), retracted_batch and retracted_start (of the version that retracts
    it; null if none does).
    """
    if gap < 0 or fan < 2 or block < 1:
        raise ValueError("gap is 0 at least, fan 2, block 1")
    span = max(span, gap, 1)
    some = events.select(*(F.col(c).cast("long").alias(c) for c in ("user", "at", "batch")), F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value"))
    some = some.where("user is not null and at is not null and batch is not null")
    counted = settle(some.groupBy("user", "at", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "events")
    ends = counted.agg(F.min("at").alias("low"), F.max("at").alias("high")).head()  # one row
    zero = ends["low"] or 0
    cells = ((ends["high"] or 0) - zero) // span + 1
    levels = 0
    while fan**levels < cells:
        levels += 1
    at = F.col("at") - F.lit(zero)
    lowest = counted.select("user", F.floor(F.expr(f"(at - {zero}) div {span}")).cast("long").alias("node"), F.lit(0).cast("long").alias("part"), "batch", at.alias("at"), "n", "total")
    made = [settle(_shards(lowest, ["batch", "at"], history, gap, span, levels == 0), "islands")]
    for level in range(1, levels + 1):
        width = span * fan ** (level - 1)
        rows = made[-1].where(F.col("kind") == OPEN).select(
            "user",
            F.expr(f"node div {fan}").alias("node"),
            F.floor(F.col("batch") / F.lit(block)).cast("long").alias("part"),
            *("batch", F.col("node").alias("child"), "start", "end", "n", "n_new", "n_retracted", "total"),
            (F.col("start") < F.col("node") * width + gap).alias("left_open"),
            (F.col("end") >= (F.col("node") + 1) * width - gap).alias("right_open"),
        )
        fields = ["carried", "batch", "child", "start", "end", "n", "n_new", "n_retracted", "total"]
        both = rows.select("user", "node", "part", F.lit(False).alias("carried"), *fields[1:]).unionByName(_carried(rows))
        ordered = both.select(*KEYS, *fields)
        made.append(settle(_shards(ordered, [F.desc("carried"), "batch", "child", "start"], stitched, gap, width * fan, level == levels), "islands"))

    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    found = every.where(F.col("kind") == VERSION)
    edges = every.where(F.col("kind") == EDGE).select("user", "batch", "start", "to_batch", "to_start")
    if levels:
        alias = every.where(F.col("kind") == ALIAS).select("user", F.col("batch").alias("_b"), F.col("start").alias("_s"), F.col("to_start").alias("_t"))
        reach = 1  # an alias may lead to one of a higher level
        while reach < levels:
            further = alias.select(F.col("user"), "_b", F.col("_s").alias("_t"), F.col("_t").alias("_u"))
            longer = alias.join(further.hint("merge"), ["user", "_b", "_t"], "left").select("user", "_b", "_s", F.coalesce("_u", "_t").alias("_t"))
            alias, reach = settle(longer, "alias"), reach * 2
        for batch, start in (("to_batch", "to_start"), ("batch", "start")):
            known = alias.select("user", F.col("_b").alias(batch), F.col("_s").alias(start), "_t")
            others = [c for c in edges.columns if c != start]
            edges = edges.join(known.hint("merge"), ["user", batch, start], "left").select(*others, F.coalesce("_t", start).alias(start))
    first = edges.groupBy("user", "batch", "start").agg(F.min(F.struct("to_batch", "to_start")).alias("to"))
    named = found.join(first.hint("merge"), ["user", "batch", "start"], "left")
    return named.select(
        *("user", "batch", (F.col("start") + zero).alias("start"), (F.col("end") + zero).alias("end"), F.col("n").alias("n_events"), "n_new", "n_retracted", "total"),
        *(F.col("to.to_batch").alias("retracted_batch"), (F.col("to.to_start") + zero).alias("retracted_start")),
    )
