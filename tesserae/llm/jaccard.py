"""Components of texts whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

Multiple-global-order filtering. If two sets are as like as asked for, then in any order
of all shingles that is the same for both they share one of their first
n - ceil(percent n / 100) + 1 (their prefixes), and the first that they share leaves
enough behind it in both. Here there are two orders. Each has a class of its own, a
sixth of all shingles by their hashes: shingles of the class come first, the rarest
first, and all others after them by hash. So a prefix mostly holds what is rare, the
two orders know nothing of each other, and what has to be counted and moved is a sixth
of the corpus for the first order. The second has only those texts that share a prefix shingle with
another in the first. A pair is compared if both orders allow it.

Texts with equal sets are one node, whatever their number. In a list (the nodes that share a
prefix shingle) nobody is paired with everybody: all are held against the node with the
least share of shingles of its own (the centre of a group of copies), then what is left in other
components against the next such node. In the end, what is left of a list without its first
centre, and has room for an overlap with any of the others, meets in pairs; the
members of long lists do so by a third order, of all shingles by their number among
just these members. Comparing is exact, by whole sets. Every link is either found or
connects nodes that are connected.

Shingles are held as 64-bit hashes; two different ones of one pair of texts that have the
same are not told apart. A task holds a block of texts or pairs at a time, never a list.

Defined results: words are parted by ASCII white space, A-Z are lowered; a text of fewer
words than the width has one shingle, all of it; a null or empty text, or one of white
space, has none and is linked with nothing; texts of any length count whole; repeated
rows are in one component, and each has its row; the component's name is its least doc_id; a null
doc_id never is one unless all of its component are null; rows that share a doc_id but not a
text are nodes of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import documents, forget, settle
from tesserae.llm.components import least_labels
from tesserae.llm.simhash import shingle_hashes

WIDTH, PERCENT = 3, 90
#: Classes of shingles, of which each order counts one.
CLASSES = 6
#: Members of a list that are paired directly in the end.
ROOM = 64


def prefix(n, percent: int = PERCENT):
    """How many of n shingles the prefix has; of numbers and of columns."""
    least = F.ceil((n * percent) / 100) if not isinstance(n, int) else -(-n * percent // 100)
    return n - least + 1


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, width))


def ordered(h: np.ndarray, order: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The shingles that may stand in the prefix of this order (its class, then what is missing of the others by hash), and the size of the class."""
    mine = h % np.uint64(CLASSES) == order
    own, lack = h[mine], prefix(len(h), percent) - int(mine.sum())
    return (np.concatenate([own, h[~mine][:lack]]) if lack > 0 else own), len(own)


def tokens(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of every row: doc_id, code (of the text), n, key (of the set), and for each order t (shingles) and s (those of its class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shingles(t, width) for t in batch.column("text").to_pylist()]
                columns = [batch.column("doc_id"), batch.column("code"), pa.array([len(h) for h in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())]
                for order in (0, 1):
                    made = [ordered(h, order, percent) for h in found]
                    columns += [pa.array([t.view(np.int64) for t, _ in made], pa.list_(pa.int64())), pa.array([s for _, s in made], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "code", "n", "key", "t0", "s0", "t1", "s1"])

    rows = documents(docs).withColumn("code", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, code long, n long, key binary, t0 array<bigint>, s0 long, t1 array<bigint>, s1 long")


def entries(some: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """h, node, n, pos, own of what stands in the prefixes of two nodes or more, from node, t, s and n of ``sizes`` (node, n, s).

    ``pos`` is how many shingles of the node come before, ``own`` how many of the class no
    other node has: these are counted and not moved on, and stand before all others.
    """
    rows = some.select("node", F.posexplode("t").alias("i", "h"), "s").select("node", "h", F.when(F.col("i") >= F.col("s"), F.col("i").cast("long")).alias("late"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    met = rows.join(counts.hint("merge"), "h").join(sizes.hint("merge"), "node")
    of_node = Window.partitionBy("node")
    place = F.row_number().over(of_node.orderBy(F.col("late").isNotNull(), "texts", "h")) - 1
    ranked = met.withColumn("r", place).withColumn("many", F.sum(F.col("late").isNull().cast("long")).over(of_node))
    placed = ranked.withColumn("pos", F.coalesce("late", F.col("s") - F.col("many") + F.col("r")))
    own = F.col("s") - F.col("many")
    kept = settle(placed.where(F.col("pos") < prefix(F.col("n"), percent)).select("h", "node", "n", "pos", own.alias("own")), "prefixes")
    lists = kept.groupBy("h").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("h")
    out = settle(kept.join(lists.hint("merge"), "h", "left_semi"), "entries")
    forget(kept)
    return out


def enough(x: str, y: str, pos: str, percent: int):
    """Whether the overlap asked for has room behind two entries of a shingle."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    behind = F.least(n - F.col(f"{x}.{pos}"), m - F.col(f"{y}.{pos}"))
    return behind * (100 + percent) >= percent * (n + m)


def agreed(pairs: DataFrame, second: DataFrame) -> DataFrame:
    """Those pairs (a, b) that share a prefix shingle in the second order too; ``second`` has the shingles of each node as one array."""
    side = lambda name: second.select(F.col("node").alias(name), F.col("hs").alias(f"h{name}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.where(F.arrays_overlap("ha", "hb")).select("a", "b")


class Texts:
    """Compares nodes by whole sets; the texts of nodes in pairs only are moved."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.docs, self.nodes, self.width, self.percent = docs, nodes, width, percent

    def sets(self, named: DataFrame) -> DataFrame:
        """node and h, the whole set, of the nodes named (one column)."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    found = [shingles(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "h"])

        wanted = self.nodes.join(named.hint("merge"), "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("code").alias("_code"))
        rows = documents(self.docs).withColumn("code", F.xxhash64("text"))
        texts = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("code") == F.col("_code"))).select("node", "text")
        return settle(texts.mapInArrow(run, "node long, h array<bigint>").dropDuplicates(["node"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are as like as asked for."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                alike = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    alike.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("y")).hint("merge"), "b")
        out = settle(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
        forget(sets)
        return out


def _placed(first: DataFrame, links: DataFrame | None) -> DataFrame:
    """The entries of lists that hold several components, with the component (root) of each node."""
    if links is None:
        return first.withColumn("root", F.col("node"))
    roots = least_labels(links)
    placed = settle(first.join(roots.hint("merge"), "node", "left").select("h", "node", "n", "pos", "share", F.coalesce("root", "node").alias("root")), "placed")
    several = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    return placed.join(several.hint("merge"), "h", "left_semi")


def _ends(x: str, y: str):
    return F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")


def _rest(left: DataFrame, centres: DataFrame, texts: Texts) -> DataFrame:
    """The pairs (a, b) of a list that no centre has settled. Its first centre is done with; so is who has no room for even the least of the others.

    The members of a list of more than ``ROOM`` meet by an order of all their shingles
    instead, counted among them: who has much of its own has nothing left to meet by.
    """
    percent = texts.percent
    others = left.join(centres.select("h", "node").hint("merge"), ["h", "node"], "left_anti")
    least = others.groupBy("h").agg(F.min("n").alias("least"))
    fit = others.join(least.hint("merge"), "h").where((F.col("n") - F.col("pos")) * (100 + percent) >= percent * (F.col("n") + F.col("least")))
    fit = settle(fit.select("h", "node", "n", "pos", "root"), "fit")
    lists = fit.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high")
    open_ = settle(fit.join(lists.select("h", "many").hint("merge"), "h"), "open")
    other = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & enough("x", "y", "pos", percent)
    met = lambda rows: rows.alias("x").join(rows.alias("y"), "h").where(other).select(*_ends("x", "y"))
    crowded = settle(open_.where(F.col("many") > ROOM).select("node", "root").distinct(), "crowded")
    sets = texts.sets(crowded.select("node"))
    rows = sets.select("node", F.size("h").cast("long").alias("n"), F.explode("h").alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    pos = F.row_number().over(Window.partitionBy("node").orderBy("texts", "h")) - 1
    ranked = rows.join(counts.hint("merge"), "h").withColumn("pos", pos).where((F.col("texts") > 1) & (F.col("pos") < prefix(F.col("n"), percent)))
    whole = settle(ranked.join(crowded.hint("merge"), "node").select("h", "node", "n", "pos", "root"), "whole")
    forget(sets)
    return met(open_.where(F.col("many") <= ROOM)).union(met(whole)).distinct()


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    found = settle(tokens(docs, width, percent).withColumn("row", F.monotonically_increasing_id()), "tokens")
    rep = F.struct("row", "doc_id", "code", "n", "s0", "s1")
    groups = found.where("n > 0").groupBy("key").agg(F.min(rep).alias("rep"), F.min("doc_id").alias("low"))
    nodes = settle(groups.select("key", F.col("rep.row").alias("node"), "rep.doc_id", "rep.code", "rep.n", "rep.s0", "rep.s1", "low"), "nodes")
    texts = Texts(docs, nodes, width, percent)

    def order(k: int, wanted: DataFrame) -> DataFrame:
        named = found.select(F.col("row").alias("node"), F.col(f"t{k}").alias("t"), F.col(f"s{k}").alias("s"))
        some = named.join(wanted.select("node").hint("merge"), "node", "left_semi")
        return entries(some, nodes.select("node", "n", F.col(f"s{k}").alias("s")), percent)

    first = order(0, nodes)
    second = settle(order(1, first.select("node").distinct()).groupBy("node").agg(F.collect_list("h").alias("hs"), F.first("own").alias("own")), "second")  # a node's own prefix
    share = (F.col("own") + F.col("_own")) / F.col("n")
    first = settle(first.join(second.select("node", F.col("own").alias("_own")).hint("merge"), "node").select("h", "node", "n", "pos", share.alias("share")), "both")
    links = tried = hubs = hubs0 = None
    for _ in range(2):
        left = _placed(first, links)
        if hubs is not None:  # the next centre is one of what the first is not connected with
            now = left.join(hubs.select("h", F.col("node").alias("hub")).hint("merge"), "h")
            centre = left.select("h", F.col("node").alias("hub"), F.col("root").alias("of"))
            left = now.join(centre.hint("merge"), ["h", "hub"]).where("root <> of").select("h", "node", "n", "pos", "share", "root")
        rarer = F.struct("share", "node", "n", "pos", "root")
        hubs = settle(left.groupBy("h").agg(F.min(rarer).alias("y")).select("h", "y.node", "y.n", "y.pos", "y.root"), "hubs")
        met = left.alias("x").join(hubs.alias("y").hint("merge"), "h").where("x.root <> y.root").where(enough("x", "y", "pos", percent))
        links, tried = _compared(met.select(*_ends("x", "y")).distinct(), second, texts, links, tried)
        hubs0 = hubs0 if hubs0 is not None else hubs
    links, _ = _compared(_rest(_placed(first, links), hubs0, texts), second, texts, links, tried)

    roots = least_labels(links)
    named = nodes.join(roots.hint("merge"), "node", "left").select("key", "low", F.coalesce("root", "node").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_key = settle(named.join(lows.hint("merge"), "root").select("key", "component_id"), "by-key")
    return found.select("doc_id", "n", "key").join(by_key.hint("merge"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _compared(pairs: DataFrame, second: DataFrame, texts: Texts, links: DataFrame | None, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links and tried pairs with what these pairs add; pairs that only the first order allows are not compared."""
    fresh = pairs if tried is None else pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")
    fresh = settle(agreed(fresh, second), "pairs")
    more = texts.links(fresh)
    return (more if links is None else links.union(more)), (fresh if tried is None else tried.union(fresh))
