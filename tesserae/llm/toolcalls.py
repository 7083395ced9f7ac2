"""Tool calls of chats: linked with their results, ordered, validated, and written as canonical JSON.

Calls and results meet in one hash join on the call's identifier, after each
side is folded to one row for an identifier (so a repeated identifier never
multiplies). A call may name the call it waits for; its level is the length of
that chain, found by pointer doubling: every round doubles the length of chain
that a call has looked up, so a chain of n calls takes log2(n) rounds. In
order of (level, call before result) nothing comes before what it needs.
Arguments are checked against each tool's schema, and canonical JSON (sorted
keys, no blanks) comes from Spark's variant type.

DataFrame functions only; no Python runs on the executors.

Defined results: a result without a call and a call without a result each have a
row with that status; of calls (or results) that share an identifier the least
by its content is linked, and their number is given; a call that waits for an
unknown call has level 0 and says so; calls that wait for each other in a circle
have no level; null arguments are no JSON; rows with a null identifier are folded
under the empty one; contents of any length are kept in whole; repeated rows are
counted and linked once; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import settle

#: JSON types by what schema_of_variant says.
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}


def _faults(values: Column, name: str, rule: Mapping) -> list[Column]:
    """What is wrong with one property, each null if nothing is."""
    value = values[name]
    there = F.array_contains(F.map_keys(values), name)
    kind = F.schema_of_variant(value)
    fits = kind.rlike(KINDS[rule["type"]])
    out = []
    if rule.get("required"):
        out.append(F.when(~there, F.lit(f"{name}: missing")))
    out.append(F.when(there & ~F.coalesce(fits, F.lit(False)), F.lit(f"{name}: not {rule['type']}")))
    number = F.when(there & fits, F.try_variant_get(value, "$", "double"))
    if "minimum" in rule:
        out.append(F.when(number < rule["minimum"], F.lit(f"{name}: under {rule['minimum']}")))
    if "maximum" in rule:
        out.append(F.when(number > rule["maximum"], F.lit(f"{name}: over {rule['maximum']}")))
    text = F.when(there & fits, F.try_variant_get(value, "$", "string"))
    if "enum" in rule:
        out.append(F.when(~text.isin(*rule["enum"]), F.lit(f"{name}: not one of the values")))
    if "maxLength" in rule:
        out.append(F.when(F.char_length(text) > rule["maxLength"], F.lit(f"{name}: over {rule['maxLength']} characters")))
    return out


def errors(name: Column, arguments: Column, tools: Mapping[str, Mapping]) -> Column:
    """All faults of a call's arguments, in the order of the schema; an empty list if it is valid."""
    values = F.from_json(arguments, "map<string, variant>")
    found = F.when(F.lit(False), F.array(F.lit("")))
    for tool, schema in tools.items():
        faults = [f for prop, rule in schema["properties"].items() for f in _faults(values, prop, rule)]
        if not schema.get("additionalProperties", True):
            known = F.array(*(F.lit(p) for p in schema["properties"]))
            faults.append(F.when(F.size(F.array_except(F.map_keys(values), known)) > 0, F.lit("unknown property")))
        found = found.when(name == tool, F.filter(F.array(*faults), lambda x: x.isNotNull()))
    sound = F.try_parse_json(arguments)
    no_object = sound.isNull() | ~F.coalesce(F.schema_of_variant(sound).startswith("OBJECT<"), F.lit(False))
    return F.when(~F.coalesce(name.isin(*tools), F.lit(False)), F.array(F.lit("unknown tool"))).when(no_object, F.array(F.lit("arguments: no object"))).otherwise(found)


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level (null on a circle, or behind one) and waits ('', 'unknown call', 'circle') of calls (call_id, parent_id), one row an id."""
    ids = calls.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    start = calls.join(ids, "parent_id", "left").select("call_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), (F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("lost"))
    state = settle(start.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "levels")
    n, reach = state.count(), 1
    while reach <= n and not state.where(F.col("up").isNotNull()).isEmpty():
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = settle(state.join(above, "up", "left").select("call_id", F.col("next").alias("up"), "lost", (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        reach *= 2
    circle = F.col("up").isNotNull()
    return state.select("call_id", F.when(~circle, F.col("level")).alias("level"), F.when(circle, "circle").when(F.col("lost"), "unknown call").otherwise("").alias("waits"))


def link(calls: DataFrame, results: DataFrame, tools: Mapping[str, Mapping]) -> DataFrame:
    """One row for each identifier of a call (call_id, parent_id, name, arguments) or result (call_id, content).

    call_id, name, level, waits, n_calls, n_results, status, errors, message (canonical JSON of the linked pair).
    """

    def identified(df: DataFrame) -> DataFrame:
        return df.withColumn("call_id", F.coalesce(F.col("call_id").cast("string"), F.lit("")))

    first = F.min(F.struct("name", "arguments", "parent_id")).alias("call")
    one = settle(identified(calls).groupBy("call_id").agg(first, F.count(F.lit(1)).alias("n_calls")).select("call_id", "call.*", "n_calls"), "calls")
    said = identified(results).groupBy("call_id").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    placed = one.join(levels(one), "call_id")
    both = placed.join(said.hint("shuffle_hash"), "call_id", "full")
    called, answered = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    wrong = F.when(called, errors(F.col("name"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("errors", F.array_join(wrong, "; "))
    status = F.when(~called, "result without call").when(F.col("errors") != "", "invalid").when(~answered, "call without result").otherwise("linked")
    pieces = {"arguments": F.coalesce(canonical(F.col("arguments")), F.lit("null")), "id": _string(F.col("call_id")), "name": _string(F.col("name")), "result": _string(F.col("content"))}
    body = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{key}":'), value) for key, value in pieces.items())), F.lit("}"))
    return both.select("call_id", "name", "level", F.coalesce("waits", F.lit("")).alias("waits"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"), "errors", body.alias("message"))


def _string(text: Column) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}; {} for null
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.char_length(whole) - 6))
