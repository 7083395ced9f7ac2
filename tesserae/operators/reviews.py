"""Human reviews and collection receipts: every fault as data, and bindings to what was reviewed by digest."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import arrow
from tesserae.operators import dom

# What a review of a link may say.
DOMAINS = ("motion", "design", "mixed", "tooling")
RESOURCES = ("example", "library", "tool", "design-system", "case-study", "collection", "learning", "portfolio")
STATUSES = ("source-reviewed", "metadata-reviewed", "source-unavailable")
CODE, NODES = 100_000, 700
NOTICE_BYTES, ORIGINAL_BYTES = 1 << 20, 16 << 20
FORBIDDEN_CSS = re.compile(r"(?:url|image-set|expression)\s*\(|@import|</?script\b", re.I)
FORBIDDEN_SVG = frozenset(("script", "foreignObject", "style", "iframe", "image"))


def _said(value, most: int) -> bool:
    return isinstance(value, str) and bool(value.strip()) and len(value) <= most and "\x00" not in value


def _listed(value, allowed: tuple[str, ...]) -> bool:
    return isinstance(value, list) and all(v in allowed for v in value if isinstance(v, str)) and all(isinstance(v, str) for v in value) and len(set(value)) == len(value)


def _texts(value, low: int, high: int, most: int) -> bool:
    return isinstance(value, list) and low <= len(value) <= high and all(_said(v, most) for v in value)


def _digest(value) -> bool:
    return isinstance(value, str) and re.fullmatch(r"[a-f0-9]{64}", value) is not None


def _ident(value) -> bool:
    return isinstance(value, str) and re.fullmatch(vocab.ID_PATTERN, value) is not None


#: Characters of an artifact's path and of its link.
ARTIFACT_CHARS, LINK_CHARS = 500, 4000


def web_link(value) -> bool:
    """An http or https link to a host, without a user's name or password in it."""
    if not _said(value, LINK_CHARS):
        return False
    try:
        parts = urlsplit(value)
    except ValueError:
        return False
    return parts.scheme in ("http", "https") and bool(parts.hostname) and not parts.username and not parts.password


def _artifact(value) -> bool:
    if not (isinstance(value, dict) and {"path", "sha256"} <= value.keys() <= {"path", "sha256", "sourceUrl"} and _digest(value["sha256"])):
        return False
    return safe_path(value["path"]) and len(value["path"]) <= ARTIFACT_CHARS and ("sourceUrl" not in value or web_link(value["sourceUrl"]))


def outside(review: str, root: str) -> list[str]:
    """Paths of a review's artifacts that do not lie below ``root``."""
    try:
        said = json.loads(review)["evidence"]["artifacts"]
        return [a["path"] for a in said if not a["path"].startswith(root.rstrip("/") + "/")]
    except (ValueError, TypeError, KeyError, AttributeError):
        return []


def safe_path(path) -> bool:
    """A relative path that stays where it starts."""
    return isinstance(path, str) and 0 < len(path) <= 800 and re.fullmatch(r"[A-Za-z0-9._/-]+", path) is not None and not set(path.split("/")) & {"", ".", ".."}


def harmless_svg(code: str) -> bool:
    if re.search(r"<!DOCTYPE|<!ENTITY", code, re.I):
        return False
    try:
        nodes = list(ElementTree.fromstring(code).iter())
    except (ElementTree.ParseError, ValueError):
        return False
    bare = lambda name: str(name).rsplit("}", 1)[-1]
    if bare(nodes[0].tag) != "svg" or len(nodes) > NODES or any(bare(n.tag) in FORBIDDEN_SVG for n in nodes):
        return False
    for name, value in ((bare(k), v) for n in nodes for k, v in n.attrib.items()):
        links = [t.strip() for _, t in re.findall(r"url\(\s*(['\"]?)(.*?)\1\s*\)", value, re.I)]
        if name.lower().startswith("on") or name == "style" or (name == "href" and not value.startswith("#")) or any(not t.startswith("#") for t in links):
            return False
    return True


def _preview(p) -> bool:
    if not isinstance(p, dict) or not _texts(p.get("limitations"), 1, 12, 1200):
        return False
    if p.get("mode") == "related-asset":
        return p.keys() == {"mode", "assetId", "limitations"} and _ident(p["assetId"])
    must = {"mode", "language", "code", "license", "notice", "attribution", "limitations"}
    if p.get("mode") != "illustration" or not must <= p.keys() <= must | {"dom"} or p["license"] != "CC0-1.0":
        return False
    if not (_said(p["notice"], 4000) and _said(p["attribution"], 200) and _said(p["code"], CODE)):
        return False
    if p["language"] == "css":
        return not FORBIDDEN_CSS.search(p["code"]) and ("dom" not in p or dom.first_fault(p["dom"], dom.ILLUSTRATION) is None)
    return p["language"] == "svg" and "dom" not in p and harmless_svg(p["code"])


def dom_nodes(node) -> int:
    """Nodes of a bounded preview tree, 0 if it is none."""
    nodes, fault = dom.walked(node)
    return 0 if fault else nodes


def _evidence(e) -> bool:
    must = {"basis", "confidence", "summaryKO", "summaryEN", "signals", "artifacts"}
    return (
        isinstance(e, dict) and must <= e.keys() <= must | {"status"} and e["basis"] in ("reviewed-source", "metadata") and e["confidence"] in ("high", "medium", "low") and e.get("status", STATUSES[0]) in STATUSES
        and (e["basis"] != "metadata" or e["confidence"] == "low") and _said(e["summaryKO"], 3000) and _said(e["summaryEN"], 3000) and _texts(e["signals"], 0, 48, 1000)
        and isinstance(e["artifacts"], list) and 1 <= len(e["artifacts"]) <= 8 and all(map(_artifact, e["artifacts"]))
    )


RULES: dict[str, Callable[[object], bool]] = {
    "id": _ident, "sourceSha256": _digest, "targetDomain": lambda v: v in DOMAINS, "resourceType": lambda v: v in RESOURCES, "assetType": lambda v: v in vocab.ASSET_TYPES, "effects": lambda v: _listed(v, vocab.EFFECTS),
    "components": lambda v: _listed(v, vocab.COMPONENTS), "useCases": lambda v: _listed(v, vocab.USE_CASES), "evidence": _evidence, "preview": _preview,
}


def faults(text: str) -> list[str]:
    """The fields of a review (as JSON) that are missing, unknown or not as they must be."""
    try:
        review = json.loads(text)
    except (ValueError, TypeError):
        return ["json"]
    if not isinstance(review, dict):
        return ["json"]
    out = [name for name, rule in RULES.items() if name not in review or not rule(review[name])]
    return out + sorted(review.keys() - RULES.keys())


@arrow("array<string>")
def review_faults(reviews: pd.Series) -> pd.Series:
    return reviews.map(faults)


def bound(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """id, faults of reviews (id, review as JSON) against records (id, kind, record_sha): also those of nothing, of other kinds, and of what has changed."""
    sha = F.get_json_object("review", "$.sourceSha256")
    asset = F.get_json_object("review", "$.preview.assetId")
    met = reviews.select("id", "review", review_faults("review").alias("own"), sha.alias("sha"), asset.alias("asset")).join(items.select("id", F.col("kind").alias("k"), "record_sha"), "id", "left")
    known = items.where("kind <> 'reference'").select(F.col("id").alias("asset"), F.lit(True).alias("stored"))
    met = met.join(known, "asset", "left")
    more = [F.when(F.col("k").isNull(), "no record"), F.when(F.col("k") != "reference", "no reference"), F.when(F.col("record_sha") != F.col("sha"), "record changed"), F.when(F.col("asset").isNotNull() & F.col("stored").isNull(), "no such asset")]
    return met.select("id", F.concat("own", F.filter(F.array(*more), lambda x: x.isNotNull())).alias("faults")).where(F.size("faults") > 0)


def uncovered(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """References without exactly one review."""
    n = reviews.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return items.where("kind = 'reference'").select("id").join(n, "id", "left").where("n is null or n <> 1").select("id", F.coalesce("n", F.lit(0)).alias("reviews"))


#: Why a link was taken out.
REMOVED = ("broken-link", "private", "unavailable")


def removal_faults(removed: DataFrame, items: DataFrame) -> DataFrame:
    """id, faults of removals (id, source_sha256, reason, status, verified_at) against records (id, kind, record_sha)."""
    n = removed.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    met = removed.join(items.select("id", F.col("kind").alias("k"), "record_sha"), "id", "left").join(n, "id")
    no = {
        "no record": F.col("k").isNull(), "no reference": F.col("k") != "reference", "record changed": F.col("record_sha") != F.col("source_sha256"), "given twice": F.col("n") > 1,
        "status": ~F.coalesce(F.col("status").isin(*REMOVED), F.lit(False)), "reason": F.col("reason").isNull() | (F.trim("reason") == "") | (F.char_length("reason") > 3000),
        "verified_at": ~F.coalesce(F.col("verified_at").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.lit(False)),
    }
    faults = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in no.items())), lambda x: x.isNotNull())
    return met.select("id", faults.alias("faults")).where(F.size("faults") > 0)


ANNOTATION = "targetDomain string, resourceType string, assetType string, effects array<string>, components array<string>, useCases array<string>, evidence struct<basis:string,confidence:string,summaryKO:string,summaryEN:string>, preview struct<mode:string,assetId:string>"


def annotated(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with the classification of their review; what was collected of them stays as it is."""
    said = reviews.select("id", F.from_json("review", ANNOTATION).alias("_r"))
    met = items.join(said, "id", "left")
    new = {"asset_type": "assetType", "effects": "effects", "components": "components", "use_cases": "useCases", "basis": "evidence.basis", "confidence": "evidence.confidence"}
    fields = [F.when(F.col("_r").isNotNull(), F.col(f"_r.{new[c]}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns]
    more = {"target_domain": "targetDomain", "resource_type": "resourceType", "preview_mode": "preview.mode", "preview_asset": "preview.assetId"}
    summaries = F.when(F.col("_r").isNotNull(), F.array("_r.evidence.summaryKO", "_r.evidence.summaryEN")).alias("summaries")
    return met.select(*fields, *(F.col(f"_r.{path}").alias(name) for name, path in more.items()), summaries)


RECEIPT = "struct<version:int,original:struct<path:string,sha256:string>,notice:struct<path:string,sha256:string>,storedSha256:string>"


def receipt_faults(items: DataFrame, folder: str) -> DataFrame:
    """id, fault of records (id, kind, code, licenseText, image, receipt) against the files that their receipts name under ``folder``."""
    spark = items.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length").between(1, ORIGINAL_BYTES))
    known = files.select(F.regexp_extract("path", rf"{re.escape(folder.rstrip('/'))}/(.*)$", 1).alias("p"), F.sha2("content", 256).alias("sha"), "length", F.when(F.col("length") <= NOTICE_BYTES, F.decode("content", "UTF-8")).alias("body"))
    r = items.withColumn("stored", F.when(F.col("kind") == "image", F.col("image.sha256")).otherwise(F.sha2(F.coalesce("code", F.lit("")), 256)))
    side = lambda name: known.select(F.col("p").alias(f"{name}_p"), F.col("sha").alias(f"{name}_sha"), F.col("body").alias(f"{name}_body"))
    met = r.join(side("original"), F.col("receipt.original.path") == F.col("original_p"), "left").join(side("notice"), F.col("receipt.notice.path") == F.col("notice_p"), "left")
    plain = lambda c: F.regexp_replace(c, "\r\n", "\n")
    notice = F.trim(F.regexp_replace(plain(F.col("notice_body")), "^﻿", ""))
    tests = {
        "no receipt": F.col("receipt").isNull() | (F.col("receipt.version") != 1), "original differs": ~F.col("original_sha").eqNullSafe(F.col("receipt.original.sha256")), "notice differs": ~F.col("notice_sha").eqNullSafe(F.col("receipt.notice.sha256")),
        "notice is not in the licence": ~F.coalesce(plain(F.col("licenseText")).contains(notice), F.lit(False)), "body differs": ~F.col("stored").eqNullSafe(F.col("receipt.storedSha256")),
        "another origin": (F.col("kind") == "image") & (F.col("image.sourceSha256") != F.col("receipt.original.sha256")),
    }
    return met.select("id", F.explode(F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())).alias("fault"))
