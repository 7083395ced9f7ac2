"""Shaders: equal up to names, equal up to numbers, and alike in their token runs.

A source is read once, as a row of marks: notes and line ends are marks too, since a
uniform's default stands in a note behind it. What follows is a walk over these marks.
Equal shaders are one from then on, held by the least of their ids.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, pairwise, takewhile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import arrow
from tesserae.functions.matching import sequence_ratio
from tesserae.scratch import written
from tesserae.session import spread

# The language's words, types, and the names that hosts and the language define.
TYPES = frozenset("void bool int uint float double vec2 vec3 vec4 ivec2 ivec3 ivec4 bvec2 bvec3 bvec4 uvec2 uvec3 uvec4 mat2 mat3 mat4 sampler2D samplerCube".split())
WORDS = TYPES | frozenset("uniform const varying attribute in out inout precision highp mediump lowp if else for while do break continue return discard true false struct layout flat smooth centroid invariant".split())
GIVEN = frozenset(
    "transition main progress ratio getFromColor getToColor texture texture2D textureCube radians degrees sin cos tan asin acos atan sinh cosh tanh pow exp log exp2 log2 sqrt inversesqrt abs sign floor trunc round roundEven ceil fract mod modf "
    "min max clamp mix step smoothstep isnan isinf length distance dot cross normalize faceforward reflect refract matrixCompMult outerProduct transpose determinant inverse lessThan lessThanEqual greaterThan greaterThanEqual equal notEqual any all not dFdx dFdy fwidth".split()
)
#: Types of uniforms that a host gives a default, the numbers it takes, the number it puts where there is none, and the longest source.
DEFAULTED = frozenset("float int bool vec2 vec3 vec4 ivec2 ivec3 ivec4 sampler2D".split())
MOST_NUMBERS, NO_NUMBER, LONGEST = 4, 0.5, 1_000_000
RUN = 5

#: Kinds of marks, each with what it looks like; the first that fits is taken.
MARKS = {
    "note": r"/\*[\s\S]*?\*/|//[^\n]*",
    "end": r"\n",
    "name": r"[A-Za-z_]\w*",
    "number": r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[uUfF]?",
    "sign": r"[+][+]|[-][-]|[=!<>]=|&&|[|][|]|<<|>>|\S",
}
_MARK = re.compile("|".join(f"({x})" for x in MARKS.values()))
_KINDS = tuple(MARKS)
_FIGURE = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?", re.I)
Mark = tuple[str, str]


def marks(code: str) -> list[Mark]:
    """(kind, text) of everything in a source but blanks."""
    return [(_KINDS[m.lastindex - 1], m[0]) for m in _MARK.finditer(code)]


def declared(said: list[Mark]) -> set[str]:
    """Names that the shader itself gives: they follow a type and are nobody else's."""
    return {name for (_, before), (kind, name) in pairwise(said) if before in TYPES and kind == "name" and name not in WORDS and name not in GIVEN}


def renamed(said: list[Mark], own: set[str]) -> tuple[list[str], dict[str, str]]:
    """The texts with the shader's own names as v0, v1, ... in the order in which they first stand, and the new names."""
    order = dict.fromkeys(text for _, text in said if text in own)
    new = {name: f"v{i}" for i, name in enumerate(order)}
    return [new.get(text, text) for _, text in said], new


def _declaration(every: list[Mark], at: int) -> tuple[str, str, str, int] | None:
    """Type, name, what a note before the semicolon sets it equal to, and the place behind the semicolon, of a uniform that begins here."""
    if every[at][1] != "uniform":
        return None
    solid = (i for i in range(at + 1, len(every)) if every[i][0] != "end")
    places = list(islice(solid, 4))
    words = [every[i] for i in places]
    if len(words) < 3 or words[0][1] not in DEFAULTED or words[1][0] != "name":
        return None
    if words[2][1] == ";":
        return words[0][1], words[1][1], "", places[2] + 1
    note = re.fullmatch(r"/\*\s*=\s*([^*]+)\*/", words[2][1])
    if note is None or len(words) < 4 or words[3][1] != ";":
        return None
    return words[0][1], words[1][1], note[1], places[3] + 1


def uniforms(every: list[Mark]) -> Iterator[tuple[str, str, str]]:
    """Type, name and note of each line's first uniform: the note before its semicolon, else one behind it on that line."""
    at = 0
    while at < len(every):
        found = _declaration(every, at)
        if found is None:
            at += 1
            continue
        kind, name, note, behind = found
        rest = list(takewhile(lambda m: m[0] != "end", every[behind:]))
        said = (re.search(r"//\s*=\s*(.+)", text) for mark, text in rest if mark == "note")
        yield kind, name, note or next((m[1] for m in said if m), "")
        at = behind + len(rest)


def figures(kind: str, note: str) -> list[float]:
    """The numbers of a default."""
    if kind == "bool":
        return [float("true" in note)]
    plain = re.sub(r"i?vec[234]\s*\(", "", note)
    return [float(x) for x in _FIGURE.findall(plain)[:MOST_NUMBERS]] or [NO_NUMBER]


def signature(code: str | None) -> tuple:
    """Renamed tokens with uniform defaults, the same without numbers, tokens, runs of five tokens, error."""
    if not code or not code.strip() or len(code) > LONGEST:
        return None, None, None, None, "no source, or too much"
    every = marks(code)
    said = [m for m in every if m[0] not in ("note", "end")]
    tokens, new = renamed(said, declared(said))
    bare = ["#number" if kind == "number" else text for (kind, _), text in zip(said, tokens, strict=True)]
    defaults = [[kind, new.get(name, name), figures(kind, note)] for kind, name, note in uniforms(every)]
    runs = Counter("\x1f".join(run) for run in zip(*(tokens[i:] for i in range(RUN)), strict=False))
    return json.dumps([tokens, defaults]), json.dumps(bare), tokens, dict(runs), None


SIGNATURE = "exact string, skeleton string, tokens array<string>, shingles map<string,int>, error string"


@arrow(SIGNATURE)
def signatures(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([signature(c) for c in codes], columns=["exact", "skeleton", "tokens", "shingles", "error"])


def prepared(rows: DataFrame) -> DataFrame:
    """id and signature of every shader, read once and written: all that follows reads the table."""
    read = rows.select("id", signatures("code").alias("s")).select("id", "s.*", F.size("s.tokens").alias("size"))
    return written(read, "shaders")


def firsts(good: DataFrame) -> DataFrame:
    """One row for each kind of equal shaders, the one of the least id."""
    sound = good.where("error is null")
    return sound.join(sound.groupBy("exact").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")


def folded_candidates(good: DataFrame, length: float = 0.8, dice: float = 0.8, ratio: float = 0.85) -> DataFrame:
    """Pairs a < b of different skeletons, by token runs in common and then by sequence.

    Equal shaders are held by the least of their ids. Runs meet in an inverted index; a pair needs
    most of its runs in common, so it shares one of the rarest runs of the smaller side, and
    only those are probed, with a digest of the skeleton. Tokens are fetched for the pairs that are left.
    """
    one = written(firsts(good).withColumn("bones", F.xxhash64("skeleton")), "shaders-once")
    runs = one.select("id", "size", "bones", F.explode("shingles").alias("run", "n"))
    common = runs.groupBy("run").agg(F.count(F.lit(1)).alias("holders"))
    sums = runs.groupBy("id").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("holders", "run"))
    rare = runs.join(common.where("holders > 1"), "run").withColumn("place", place).join(sums, "id")
    # Dice >= d leaves at most (1 - d / (2 - d)) of a side's runs unshared; runs of one holder meet nobody and come before all others
    alone = runs.join(common.where("holders = 1"), "run").groupBy("id").agg(F.count(F.lit(1)).alias("lonely"))
    rank = F.col("place") + F.coalesce("lonely", F.lit(0))
    probe = rare.join(alone, "id", "left").where(rank <= F.floor((1 - dice / (2 - dice)) * F.col("total")) + 1).select("id", "size", "bones", "run")
    alike = (F.col("x.bones") != F.col("y.bones")) & (F.least("x.size", "y.size") >= length * F.greatest("x.size", "y.size"))
    met = probe.alias("x").join(probe.alias("y"), "run").where("x.id < y.id").where(alike).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id")).distinct()
    side = lambda p: one.select(F.col("id").alias(f"{p}_id"), F.col("shingles").alias(f"{p}_runs"), F.col("tokens").alias(f"{p}_tokens"))
    both = met.join(side("a"), "a_id").join(side("b"), "b_id")
    shared = F.aggregate(F.map_entries("a_runs"), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at(F.col("b_runs"), e["key"]), F.lit(0))))
    whole = lambda c: F.aggregate(F.map_values(c), F.lit(0), lambda s, x: s + x)
    scored = both.withColumn("dice", 2.0 * shared / (whole("a_runs") + whole("b_runs"))).where(F.col("dice") >= dice)
    return scored.select("a_id", "b_id", "dice", sequence_ratio("a_tokens", "b_tokens").alias("ratio")).where(F.col("ratio") >= ratio)


def candidates(good: DataFrame, length: float = 0.8, dice: float = 0.8, ratio: float = 0.85) -> DataFrame:
    """The same between all members of what is equal: for small catalogs, as n equal shaders and m others give n * m rows."""
    of = classes(good)
    a, b = of.select(F.col("first_id").alias("a_id"), F.col("id").alias("a")), of.select(F.col("first_id").alias("b_id"), F.col("id").alias("b"))
    met = folded_candidates(good, length, dice, ratio).join(a, "a_id").join(b, "b_id")
    return met.select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), "dice", "ratio")


def classes(good: DataFrame, by: str = "exact") -> DataFrame:
    """first_id and id of every sound shader: the least of those equal to it, and its own."""
    sound = good.where("error is null").select("id", F.xxhash64(by).alias("_k"), by)
    return sound.join(sound.groupBy("_k", by).agg(F.min("id").alias("first_id")), ["_k", by]).select("first_id", "id")


def counted(good: DataFrame) -> DataFrame:
    """first_id and members of each kind of equal shaders that has several."""
    return good.where("error is null").groupBy("exact").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("members")).where("members > 1").select("first_id", "members")


def counted_sources(rows: DataFrame) -> DataFrame:
    """What ``counted`` says of rows with id and code, where all that is asked is how many are equal: equal texts are read once, and nothing is written."""
    texts = rows.groupBy("code").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    read = spread(texts, "code").select("id", "n", signatures("code").alias("s"))
    # what is not read has no signature; a filter on it would be put below the grouping of texts, and all rows be read there
    members = F.sum(F.when(F.col("s.exact").isNotNull(), F.col("n")))
    return read.groupBy("s.exact").agg(F.min("id").alias("first_id"), members.alias("members")).where("members > 1").select("first_id", "members")


def counted_families(good: DataFrame) -> DataFrame:
    """first_id and members of what is equal but for numbers, and not all equal."""
    kinds = good.where("error is null").groupBy("skeleton", "exact").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    found = kinds.groupBy("skeleton").agg(F.min("id").alias("first_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("k"))
    return found.where("k > 1").select("first_id", "members")


def exact_groups(good: DataFrame) -> DataFrame:
    """The ids of each kind as one array, for reports of small catalogs."""
    return good.where("error is null").groupBy("exact").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("ids")


def families(good: DataFrame) -> DataFrame:
    """The ids of what is equal but for numbers, and not all equal, as arrays."""
    return good.where("error is null").groupBy("skeleton").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count_distinct("exact").alias("k")).where("k > 1").select("ids")
