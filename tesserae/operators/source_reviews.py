"""Reviews of stored scripts: bound to the script by digest, checked field by field, and used in place of any analysis.

A script is text here and is never run. Its review says what it does, which lines of
which original it is, and has a drawing of its own. Everything wrong is data: the names
of the faults of a record, and where the original says otherwise.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import arrow
from tesserae.operators import reviews
from tesserae.sources.scans import below

# Limits of a stored script, and where originals are kept.
CODE_UNITS, NOTICE_UNITS = 300_000, 120_000
LAST_LINE = 100_000
ORIGINAL = re.compile(r"data/upstream/expansion12-[a-z-]+/[A-Za-z0-9._/-]+")
#: What every reviewed script says of itself.
LIMITATIONS = ("The script is kept as text and is never run.", "The drawing explains what was reviewed; it is not the script's own output.")


def said(value: object, most: int) -> bool:
    """Text with something in it, of at most so many characters, without control characters but for tabs and line ends."""
    return isinstance(value, str) and len(value) <= most and bool(value.strip()) and not re.search(r"[^\t\r\n -\U0010FFFF]", value)


def shown(value: object, most: int) -> bool:
    """Text that a browser, which counts in UTF-16, shows whole."""
    if not said(value, most):
        return False
    astral = sum(map(len, re.findall(r"[\U00010000-\U0010FFFF]+", value)))
    return len(value) + astral <= most and not re.search(r"[\uD800-\uDFFF]", value)


def texts(value: object, most: int, chars: int, least: int = 0) -> bool:
    return isinstance(value, list) and least <= len(value) <= most and all(said(v, chars) for v in value) and len(set(value)) == len(value)


def shaped(value: object, *fields: str) -> bool:
    return isinstance(value, dict) and value.keys() == set(fields)


def whole(value: object) -> bool:
    """An integer; true and false are none."""
    return type(value) is int


def _kept(file: object) -> bool:
    """A pinned file below the folder of originals."""
    return shaped(file, "path", "sha256") and reviews._digest(file["sha256"]) and isinstance(file["path"], str) and bool(ORIGINAL.fullmatch(file["path"])) and reviews.safe_path(file["path"]) and len(file["path"]) <= reviews.ARTIFACT_CHARS


def _receipt(item: dict, _: dict, digest: str) -> bool:
    r = item.get("collectionEvidence")
    return shaped(r, "version", "original", "notice", "storedSha256") and whole(r["version"]) and r["version"] == 1 and r["storedSha256"] == digest and _kept(r["original"]) and _kept(r["notice"])


def _range(_: dict, review: dict, __: str) -> bool:
    r = review.get("sourceRange")
    return shaped(r, "startLine", "endLine") and all(map(whole, r.values())) and 1 <= r["startLine"] <= r["endLine"] <= LAST_LINE


LISTS = {"effects": vocab.EFFECTS, "components": vocab.COMPONENTS, "useCases": vocab.USE_CASES, "techniques": vocab.TECHNIQUES}


def _classification(item: dict, review: dict, _: str) -> bool:
    c = review.get("classification")
    if not shaped(c, "domain", "assetType", *LISTS) or not all(reviews._listed(c[name], allowed) for name, allowed in LISTS.items()):
        return False
    return c["domain"] in vocab.DOMAINS and c["assetType"] in vocab.ASSET_TYPES and c["assetType"] != "reference" and item.get("domain", c["domain"]) == c["domain"]


def _evidence(_: dict, review: dict, __: str) -> bool:
    e = review.get("evidence")
    if not shaped(e, "basis", "confidence", "summaryKO", "summaryEN", "signals"):
        return False
    return e["basis"] == "reviewed-source" and e["confidence"] == "high" and said(e["summaryKO"], 3000) and said(e["summaryEN"], 3000) and texts(e["signals"], 48, 1000, 1)


def _illustration(_: dict, review: dict, __: str) -> bool:
    p = review.get("preview")
    return isinstance(p, dict) and p.get("mode") == "illustration" and reviews._preview(p)


REVIEW = ("version", "sourceSha256", "revision", "sourceRange", "classification", "evidence", "dependencies", "limitations", "preview")
#: Name of a fault -> whether the record (item, its review, the digest of its code) is free of it.
RULES: dict[str, Callable[[dict, dict, str], bool]] = {
    "kind": lambda i, r, d: i.get("kind") == "code" and i.get("language") == "javascript",
    "two reviews": lambda i, r, d: "referenceReview" not in i,
    "id": lambda i, r, d: reviews._ident(i.get("id")),
    "code": lambda i, r, d: shown(i.get("code"), CODE_UNITS),
    "licenseText": lambda i, r, d: shown(i.get("licenseText"), NOTICE_UNITS),
    "preview type": lambda i, r, d: isinstance(i.get("preview"), dict) and i["preview"].get("type") == "reference",
    "fields": lambda i, r, d: shaped(r, *REVIEW),
    "version": lambda i, r, d: whole(r.get("version")) and r["version"] == 1,
    "revision": lambda i, r, d: isinstance(r.get("revision"), str) and re.fullmatch("[a-f0-9]{40}", r["revision"]) is not None,
    "sourceSha256": lambda i, r, d: reviews._digest(r.get("sourceSha256")),
    "stale": lambda i, r, d: r.get("sourceSha256") == d,
    "receipt": _receipt,
    "sourceRange": _range,
    "classification": _classification,
    "evidence": _evidence,
    "dependencies": lambda i, r, d: texts(r.get("dependencies"), 32, 300),
    "limitations": lambda i, r, d: texts(r.get("limitations"), 12, 1200, 1),
    "illustration": _illustration,
}


def faults(record: str | None, review: str | None) -> list[str]:
    """The names of all that is wrong with a record and its review (both JSON objects)."""
    try:
        item, said_of = json.loads(record), json.loads(review)
    except (ValueError, TypeError):
        return ["json"]
    if not isinstance(item, dict) or not isinstance(said_of, dict):
        return ["json"]
    code = item.get("code")
    digest = hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest() if isinstance(code, str) else ""
    return [name for name, sound in RULES.items() if not sound(item, said_of, digest)]


@arrow("array<string>")
def source_faults(records: pd.Series, said_of: pd.Series) -> pd.Series:
    return pd.Series([faults(r, s) for r, s in zip(records, said_of, strict=True)])


RECORD = ("id", "kind", "language", "domain", "code", "licenseText", "preview", "collectionEvidence", "referenceReview")


def record(items: DataFrame) -> Column:
    """What a review is held against, as JSON."""
    return F.to_json(F.struct(*(F.col(c) for c in RECORD if c in items.columns)))


def checked(items: DataFrame) -> DataFrame:
    """id and faults of the records that have a review (``sourceReview``, as JSON), good or bad."""
    return items.where("sourceReview is not null").select("id", source_faults(record(items), "sourceReview").alias("faults"))


def unreviewed(items: DataFrame) -> DataFrame:
    """id of stored scripts without a review."""
    return items.where("kind = 'code' and language = 'javascript' and sourceReview is null").select("id")


def _lines(bodies: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    out = []
    for body, first, last in zip(bodies, firsts, lasts, strict=True):
        try:
            lines = bytes(body).decode("utf-8").splitlines(keepends=True)
            out.append("".join(lines[int(first) - 1 : int(last)]) if 1 <= first <= last <= len(lines) else None)
        except (UnicodeDecodeError, TypeError):
            out.append(None)
    return pd.Series(out, dtype=object)


@arrow("string")
def exact_lines(bodies: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    """Lines first to last of a file with their own ends; null where it has no such lines or is not UTF-8."""
    return _lines(bodies, firsts, lasts)


PLACE = "sourceRange struct<startLine:int,endLine:int>"


def originals_differ(items: DataFrame, folder: str) -> DataFrame:
    """id and fault of reviewed records whose original under ``folder`` is gone, has another digest, or does not say their code in the lines named."""
    wanted = items.where("sourceReview is not null").select("id", "code", F.col("collectionEvidence.original.path").alias("path"), F.col("collectionEvidence.original.sha256").alias("sha"), F.from_json("sourceReview", PLACE)["sourceRange"].alias("r"))
    files = items.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length").between(1, reviews.ORIGINAL_BYTES))
    known = files.select(below(F.col("path"), folder).alias("path"), "content", F.sha2("content", 256).alias("found"))
    met = wanted.join(known, "path", "left")
    fault = (
        F.when(F.col("found").isNull(), "no original").when(F.col("found") != F.col("sha"), "another digest")
        .when(~exact_lines("content", "r.startLine", "r.endLine").eqNullSafe(F.col("code")), "other lines")
    )
    return met.select("id", fault.alias("fault")).where("fault is not null")


SAID = (
    "version int, sourceSha256 string, revision string, classification struct<domain:string,assetType:string,effects:array<string>,components:array<string>,useCases:array<string>,techniques:array<string>>, "
    "evidence struct<signals:array<string>>, dependencies array<string>, limitations array<string>, preview struct<limitations:array<string>>"
)


def analysis(items: DataFrame) -> DataFrame:
    """Reviewed records with the classification of their review, in the columns of an analysis; their code is not looked into."""
    c = lambda path: F.col(f"_r.{path}")
    marked = lambda prefix, values: F.transform(values, lambda x: F.concat(F.lit(prefix), x))
    signals = F.concat(
        c("evidence.signals"), F.array(F.concat(F.lit("stored-source-code-sha256:"), c("sourceSha256")), F.concat(F.lit("upstream-revision:"), c("revision")), F.lit("original-javascript-execution:disabled")),
        marked("source-dependency:", c("dependencies")), marked("source-limitation:", c("limitations")),
    )
    k = "classification."
    fields = {
        "domain": c(k + "domain"), "asset_type": c(k + "assetType"), "effects": c(k + "effects"), "components": c(k + "components"), "properties": F.array().cast("array<string>"),
        "techniques": c(k + "techniques"), "use_cases": c(k + "useCases"), "signals": signals, "basis": F.lit("reviewed-source"), "confidence": F.lit("high"),
    }
    kept = [n for n in items.columns if n not in fields]
    return items.withColumn("_r", F.from_json("sourceReview", SAID)).select(*kept, *(v.alias(n) for n, v in fields.items()))


def limitations(review: Column) -> Column:
    """What a reviewed script's page has to say, in order."""
    r = F.from_json(review, SAID)
    return F.concat(F.array(*map(F.lit, LIMITATIONS)), r["limitations"], r["preview"]["limitations"])

