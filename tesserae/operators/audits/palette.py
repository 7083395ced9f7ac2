"""Palettes: equal, reordered, contained and nearly equal colour lists.

Pairs are met in cells of a grid over the centroid: palettes whose colours are
close have centroids within 1 of each other, so with cells a little wider than
that a pair is in the same or a neighbouring cell. One side visits its 27 cells,
so every pair meets once; no palette is compared with all.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import color as C
from tesserae.functions.matching import matched_distance
from tesserae.scratch import written

LEAST, MOST = 2, 32
CELL = 1.001


def prepared(palettes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable palettes (id, colors canonical, ordered, unordered, vectors, centroid) and errors (id, error)."""
    canon = palettes.select("id", F.transform("colors", C.canonical_color).alias("colors"))
    count, bad = F.size("colors"), F.exists("colors", lambda c: c.isNull())
    error = F.when(F.col("colors").isNull(), "no colours").when(~count.between(LEAST, MOST), "number of colours").when(bad, "invalid colour")
    marked = canon.withColumn("error", error)
    good = marked.where("error is null").select("id", "colors", F.array_join("colors", ",").alias("ordered"), F.array_join(F.array_sort("colors"), ",").alias("unordered"))
    good = good.withColumn("vectors", F.transform("colors", C.oklab6)).withColumn("centroid", C.centroid(F.col("vectors")))
    return good, marked.where("error is not null").select("id", "error")


def exact_groups(good: DataFrame) -> DataFrame:
    return good.groupBy("ordered").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("ids")


def reordered_families(good: DataFrame) -> DataFrame:
    """The same colours in at least two orders."""
    return good.groupBy("unordered").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count_distinct("ordered").alias("orders")).where("orders > 1").select("ids")


def subset_pairs(good: DataFrame) -> DataFrame:
    """Pairs whose shorter list is contained in the longer, counting repeats.

    They meet on the rarest colour of the shorter list, so common colours do not bring all palettes together.
    """
    counted = good.select("id", F.explode("colors").alias("c"), F.size("colors").alias("size")).groupBy("id", "size", "c").agg(F.count(F.lit(1)).alias("n"))
    popular = counted.groupBy("c").agg(F.count(F.lit(1)).alias("palettes"))
    rare = counted.join(popular, "c").groupBy("id", "size").agg(F.min_by("c", F.struct("palettes", "c")).alias("c"))
    short = rare.alias("s").join(counted.alias("l"), (F.col("s.c") == F.col("l.c")) & (F.col("s.size") < F.col("l.size"))).select(F.col("s.id").alias("short_id"), F.col("l.id").alias("long_id"))
    need = short.join(counted.select(F.col("id").alias("short_id"), "c", "n"), "short_id")
    have = counted.select(F.col("id").alias("long_id"), "c", F.col("n").alias("have"))
    held = need.join(have, ["long_id", "c"], "left").groupBy("short_id", "long_id").agg(F.bool_and(F.coalesce(F.col("have"), F.lit(0)) >= F.col("n")).alias("all"))
    return held.where("all").select("short_id", "long_id")


def near_cells(good: DataFrame) -> DataFrame:
    """Pairs (a_id < b_id, with unordered of both) of one size whose centroids pass the bound over both grounds.

    Only centroids meet; colours are fetched for what is left.
    """
    cell = lambda i: F.floor(F.get("centroid", F.lit(i)) / CELL)
    kept = ("id", "unordered", "centroid")
    # arrays of one, exploded: else every reader of a vector or centroid would work it out again
    once = good.select("id", "unordered", F.explode(F.array("vectors")).alias("vectors")).select("id", "unordered", F.size("vectors").alias("size"), F.explode(F.array(C.centroid(F.col("vectors")))).alias("centroid"))
    base = once.select(*kept, "size", *(cell(i).alias(f"c{i}") for i in range(3)))
    left = base.select(*(F.col(c).alias(f"a_{c}") if c in kept else F.col(c) for c in base.columns))
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in enumerate(ds))) for ds in product((-1, 0, 1), repeat=3)))
    right = base.withColumn("d", F.explode(steps)).select(*(F.col(c).alias(f"b_{c}") for c in kept), "size", *((F.col(f"c{i}") + F.col(f"d.d{i}")).alias(f"c{i}") for i in range(3)))
    bound = [reduce(lambda x, y: x + y, [(F.col("a_centroid")[i] - F.col("b_centroid")[i]) ** 2 for i in range(at, at + 3)]) <= 1.0 + 1e-12 for at in (0, 3)]
    return left.join(right, ["size", "c0", "c1", "c2"]).where((F.col("a_id") < F.col("b_id")) & bound[0] & bound[1])


def classified(good: DataFrame) -> DataFrame:
    """a_id, b_id, relation (near, candidate-reversed, candidate-matched), mean, most for pairs that are not permutations."""
    # equal lists are one: the least id stands for them, and its findings are theirs
    firsts = good.groupBy("ordered").agg(F.min("id").alias("id"))
    held = good.join(firsts.select("id"), "id", "left_semi")
    met = near_cells(held).where("a_unordered <> b_unordered").select("a_id", "b_id")
    lists = lambda p: held.select(F.col("id").alias(f"{p}_id"), F.col("vectors").alias(f"{p}_vectors"))
    found = _classified(met.join(lists("a"), "a_id").join(lists("b"), "b_id"))
    named = good.select("id", "ordered").join(firsts.withColumnRenamed("id", "first_id"), "ordered").select("first_id", "id")
    whose = lambda p: named.select(F.col("first_id").alias(f"{p}_id"), F.col("id").alias(f"{p}_own"))
    every = found.join(whose("a"), "a_id").join(whose("b"), "b_id")
    return every.select(F.least("a_own", "b_own").alias("a_id"), F.greatest("a_own", "b_own").alias("b_id"), "relation", "mean", "most")


def _classified(pairs: DataFrame) -> DataFrame:
    straight = C.distances(F.col("a_vectors"), F.col("b_vectors"))
    turned = C.distances(F.col("a_vectors"), F.reverse("b_vectors"))
    nearest = F.transform("a_vectors", lambda a: F.array_min(F.transform("b_vectors", lambda b: C.worst_distance(a, b))))
    seen = pairs.select("a_id", "b_id", "a_vectors", "b_vectors", straight.alias("s"), turned.alias("t"), nearest.alias("n"))
    near = C.close(F.col("s"))
    ordered = seen.where(near | C.close(F.col("t"))).select("a_id", "b_id", F.when(near, "near").otherwise("candidate-reversed").alias("relation"), C.mean(F.when(near, F.col("s")).otherwise(F.col("t"))).alias("mean"), F.array_max(F.when(near, F.col("s")).otherwise(F.col("t"))).alias("most"))
    rest = seen.where(~near & ~C.close(F.col("t")) & C.close(F.col("n")))  # a lower bound of any matching
    matched = rest.select("a_id", "b_id", matched_distance("a_vectors", "b_vectors").alias("m")).select("a_id", "b_id", F.lit("candidate-matched").alias("relation"), "m.mean", "m.most")
    return ordered.unionByName(matched.where("mean <= 1.0 and most <= 2.0"))


def size_families(palettes: DataFrame) -> DataFrame:
    """source, name, ids, sizes, shared of palettes (id, colors, source, name) that their authors give in several sizes under one name.

    Shared colours are those that each of them has.
    """
    good, _ = prepared(palettes)
    rows = good.select("id", "colors").join(palettes.select("id", "source", "name"), "id").where("source is not null and name is not null")
    groups = rows.groupBy("source", "name").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.sort_array(F.collect_set(F.size("colors"))).alias("sizes"), F.count(F.lit(1)).alias("n"))
    each = rows.select("source", "name", F.explode(F.array_distinct("colors")).alias("c")).groupBy("source", "name", "c").agg(F.count(F.lit(1)).alias("k"))
    common = each.join(groups.select("source", "name", "n"), ["source", "name"]).where("k = n").groupBy("source", "name").agg(F.sort_array(F.collect_list("c")).alias("shared"))
    several = groups.where(F.size("sizes") > 1).join(common, ["source", "name"], "left")
    return several.select("source", "name", "ids", "sizes", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


#: What a pair of palettes can be, in the order in which it is asked.
CLASSES = ("exact", "reordered", "near", "candidate-reversed", "candidate-matched", "subset", "different")


def pair_classes(good: DataFrame) -> DataFrame:
    """relation, n over all pairs of palettes, each counted once, with 0 for what there is none of.

    Nothing is paired for it: equal and reordered pairs follow from the sizes of
    their classes, and different ones are what the others leave.
    """
    twos = lambda by: good.groupBy(by).agg(F.expr("count(1) * (count(1) - 1) div 2").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    named = lambda df, name: df.select(F.lit(name).alias("relation"), "n")
    all_ = good.agg(F.expr("count(1) * (count(1) - 1) div 2").alias("n"))
    found = classified(good).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    rows = named(twos("ordered"), "exact").unionByName(named(twos("unordered"), "unordered")).unionByName(found).unionByName(named(count(subset_pairs(good)), "subset")).unionByName(named(all_, "all"))
    n = lambda name: F.coalesce(F.sum(F.when(F.col("relation") == name, F.col("n"))), F.lit(0))
    known = {"exact": n("exact"), "reordered": n("unordered") - n("exact")} | {c: n(c) for c in CLASSES[2:-1]}
    rest = n("all") - n("unordered") - n("near") - n("candidate-reversed") - n("candidate-matched") - n("subset")
    one = rows.agg(*(v.alias(k) for k, v in known.items()), rest.alias("different"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("relation"), F.col(f"`{c}`").alias("n")) for c in CLASSES))).alias("r")).select("r.*")


def coverage(good: DataFrame, errors: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: palettes, errors, the pair universe, pairs by relation (0 where there are none)."""
    n = good.agg(F.count(F.lit(1)).alias("palettes")).withColumn("pairs", F.expr("palettes * (palettes - 1) div 2"))
    kinds = {k: F.count_if(F.col("relation") == k).alias(k.replace("-", "_")) for k in ("near", "candidate-reversed", "candidate-matched")}
    return n.crossJoin(errors.agg(F.count(F.lit(1)).alias("errors"))).crossJoin(pairs.agg(*kinds.values()))


def with_gradients(palettes: DataFrame, gradients: DataFrame) -> DataFrame:
    """Relations of palettes with gradients (and among gradients), relabelled."""
    both = palettes.select("id", "colors").withColumn("g", F.lit(False)).unionByName(gradients.select("id", "colors").withColumn("g", F.lit(True)))
    good = written(prepared(both)[0], "palettes")
    marks = both.where("g").select("id")
    rows = classified(good)
    named = rows.join(marks.select(F.col("id").alias("a_id"), F.lit(True).alias("ga")), "a_id", "left").join(marks.select(F.col("id").alias("b_id"), F.lit(True).alias("gb")), "b_id", "left")
    return named.where("ga or gb").select("a_id", "b_id", F.concat(F.lit("gradient-"), "relation").alias("relation"), "mean", "most")
