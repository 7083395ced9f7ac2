"""Consolidation of reviewed variants under one canonical record, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae import vocab


class PolicyError(ValueError):
    """A policy that does not fit the records; nothing is consolidated."""


def faults(items: DataFrame, members: DataFrame) -> DataFrame:
    """What speaks against a policy: group, fault. ``items`` has id, pos, kind, code_sha, record_sha; ``members`` group, member, mode, code_sha, record_sha."""
    size = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("member").alias("d"))
    found = members.alias("m").join(items.alias("i"), F.col("m.member") == F.col("i.id"), "left")
    seen = found.select("group", "member", "mode", "id", "pos", "kind", (F.col("m.code_sha") != F.col("i.code_sha")).alias("code"), (F.col("m.record_sha") != F.col("i.record_sha")).alias("record"))
    by = seen.groupBy("group").agg(
        F.count_if(F.col("id").isNull()).alias("missing"), F.count_if("code").alias("code"), F.count_if("record").alias("record"), F.count_distinct("kind").alias("kinds"),
        F.min_by("member", "pos").alias("first"), F.count_if((F.col("mode") == "palette") & (F.col("kind") != "palette")).alias("palette"), F.count_if(~F.col("mode").isin(*vocab.ROLES)).alias("modes"),
    )
    twice = members.groupBy("member").agg(F.collect_set("group").alias("groups"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.explode("groups").alias("group"))
    tests = {"size": ~F.col("n").between(2, 64), "repeated member": F.col("n") != F.col("d"), "missing member": F.col("missing") > 0, "code changed": F.col("code") > 0, "record changed": F.col("record") > 0, "mixed kinds": F.col("kinds") > 1, "not canonical": F.col("first") != F.col("group"), "no palette": F.col("palette") > 0, "unknown mode": F.col("modes") > 0}
    one = by.join(size, "group").select("group", F.explode(F.filter(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())), lambda x: x.isNotNull())).alias("fault"))
    return one.unionByName(twice.distinct().withColumn("fault", F.lit("overlapping groups")))


def unused_repairs(members: DataFrame, repairs: DataFrame) -> DataFrame:
    """id, fault of repairs that are given twice, or are not of the canonical record of a component group."""
    n = repairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    heads = members.where("mode = 'component'").select(F.col("group").alias("id")).distinct().withColumn("used", F.lit(True))
    met = n.join(heads, "id", "left")
    return met.select("id", F.when(F.col("used").isNull(), "unused").when(F.col("n") > 1, "given twice").alias("fault")).where("fault is not null")


def apply(items: DataFrame, members: DataFrame, repairs: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Parents with their variants, and aliases (alias, item_id).

    Every record that is in no group stays as it is. ``repairs`` (id and new
    values of columns) replace fields of a component group's canonical record.
    """
    if strict and (bad := faults(items, members).limit(5).collect()):
        raise PolicyError("; ".join(f"{r['group']}: {r['fault']}" for r in bad))
    columns = items.columns
    placed = items.join(members.select(F.col("member").alias("id"), "group", "mode"), "id", "left")
    if repairs is not None:
        new = [c for c in repairs.columns if c != "id"]
        fixed = repairs.select("id", *(F.col(c).alias(f"_new_{c}") for c in new), F.lit(True).alias("_fixed"))
        placed = placed.join(fixed, "id", "left").select(*(F.when(F.col("_fixed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in placed.columns))
    role = F.when((F.col("mode") == "component") & (F.col("id") != F.col("group")), "component-part")
    for mode, name in vocab.ROLES.items():
        role = role.when(F.col("mode") == mode, name)
    variant = F.struct(F.col("pos"), *(F.col(c) for c in columns if c != "pos"), role.alias("variant_role"))
    grouped = placed.where("group is not null").groupBy("group", "mode").agg(F.array_sort(F.collect_list(variant)).alias("variants"))  # 64 members at most
    base = placed.where("group is null or id = group").drop("group", "mode")
    parents = base.join(grouped, base["id"] == grouped["group"], "left").drop("group")
    parents = parents.withColumn("aliases", F.transform(F.filter("variants", lambda v: v["id"] != F.col("id")), lambda v: v["id"]))
    parents = parents.withColumn("variant_count", F.size(F.filter("variants", lambda v: v["variant_role"] != "component-part")))
    aliases = placed.where("group is not null and id <> group").select(F.col("id").alias("alias"), F.col("group").alias("item_id"))
    return parents, aliases


def report(members: DataFrame) -> DataFrame:
    """By mode: groups, members, cards removed."""
    return members.groupBy("mode").agg(F.count_distinct("group").alias("groups"), F.count(F.lit(1)).alias("members"), (F.count(F.lit(1)) - F.count_distinct("group")).alias("removed"))


def originals(parents: DataFrame) -> DataFrame:
    """Every original identity again: variants of groups and records without a group."""
    own = parents.where("variants is null").select("id", F.col("id").alias("parent_id"))
    return own.unionByName(parents.where("variants is not null").select(F.explode("variants.id").alias("id"), F.col("id").alias("parent_id")))


def groups_of(rows: DataFrame, group: str, position: str, key: str) -> DataFrame:
    """A policy from rows that name their group: the first of a group, by position, is canonical."""
    w = Window.partitionBy(group).orderBy(position)
    return rows.withColumn("_first", F.first(key).over(w)).select(F.col("_first").alias("group"), F.col(key).alias("member"))
