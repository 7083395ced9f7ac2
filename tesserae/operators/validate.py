"""Validation of records: all faults as data, and a strict form that stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import urls

ITEM = (
    "id string, title string, description string, category string, kind string, domain string, tags array<string>, sourceUrl string, sourceName string, license string, licenseUrl string, licenseText string, verifiedAt string, "
    "verification string, preview struct<type:string,variant:string,sampleText:string,scene:string>, code string, colors array<string>, language string, access string, image struct<path:string,mime:string,width:int,height:int,sha256:string,sourceSha256:string>"
)


class RecordError(ValueError):
    """A record that must not be published."""


def rules() -> dict[str, Column]:
    """What must not be: fault -> condition (null counts as no)."""
    c = F.col
    out = {
        "id": ~F.coalesce(c("id").rlike(rf"^{vocab.ID_PATTERN}\z"), F.lit(False)),
        "category": ~F.coalesce(c("category").isin(*vocab.CATEGORIES), F.lit(False)),
        "kind": ~F.coalesce(c("kind").isin(*vocab.KINDS), F.lit(False)),
        "domain": c("domain").isNotNull() & ~c("domain").isin(*vocab.DOMAINS),
        "access": ~F.coalesce(c("access") == "public", F.lit(False)),
        "language": c("language").isNotNull() & ~c("language").isin(*vocab.LANGUAGES),
        "verification": c("verification").isNull(),
        "tags": (F.size("tags") > 64) | F.exists("tags", lambda t: t.isNull() | (F.char_length(t) > 120)),
        "colors": (F.size("colors") > 32) | F.exists("colors", lambda x: x.isNull() | ~x.rlike(rf"^{vocab.HEX_PATTERN}\z")),
        "sourceUrl": ~urls.valid_url(c("sourceUrl")),
        "licenseUrl": c("licenseUrl").isNotNull() & ~urls.valid_url(c("licenseUrl")),
        "preview": c("preview").isNull() | c("preview.type").isNull() | ~c("preview.type").isin(*vocab.PREVIEW_TYPES, "gradient") | (F.char_length("preview.variant") > 120),
        "code": (F.char_length("code") > vocab.CODE_LIMIT) | ((c("kind") == "reference") & c("code").isNotNull()),
        "image": (c("kind") == "image") & (c("image").isNull() | (c("image.mime") != "image/jpeg") | ~c("image.width").between(32, 1024) | ~c("image.height").between(32, 1024) | ~c("image.sha256").rlike(r"^[a-f0-9]{64}\z") | ~c("image.sourceSha256").rlike(r"^[a-f0-9]{64}\z")),
    }
    for name, most in vocab.TEXT_LIMITS.items():
        blank = c(name).isNull() | (F.trim(c(name)) == "") | (F.char_length(name) > most) | (F.instr(c(name), "\x00") > 0)
        out[name] = out[name] | blank if name in out else blank
    return out


def validated(items: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid records, and errors (id, faults). Strict: any error is raised."""
    faults = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules().items())), lambda x: x.isNotNull())
    marked = items.withColumn("_faults", faults)
    errors = marked.where(F.size("_faults") > 0).select("id", F.col("_faults").alias("faults"))
    if strict and (first := errors.head()):
        raise RecordError(f"{first['id']}: {', '.join(first['faults'])}")
    return marked.where(F.size("_faults") == 0).drop("_faults"), errors


def search_text(items: DataFrame) -> Column:
    """What a reader's search looks through: titles, descriptions, names, tags, facets and signals of an entry and its variants."""
    part = lambda c, most=4000: F.substring(F.coalesce(c, F.lit("")), 1, most)
    many = lambda c, most=40: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, most), " ")
    there = set(items.columns)
    pieces = [part(F.col("title")), part(F.col("description"), 6000)] + [part(F.col(n)) for n in ("sourceName", "id", "license", "language") if n in there]
    pieces += [many(F.col("tags"))] if "tags" in there else []
    pieces += [many(F.col("aliases"), 1000)] if "aliases" in there else []
    if "variants" in there:
        own = F.transform(F.slice(F.coalesce("variants", F.array().cast(dict(items.dtypes)["variants"])), 1, 64), lambda v: F.concat_ws(" ", v["id"], v["title"], F.substring(v["description"], 1, 6000)))
        pieces.append(F.array_join(own, " "))
    for name, most in (("properties", 120), ("techniques", 40), ("signals", 120)):
        if name in there:
            pieces.append(many(F.col(name), most))
    return F.concat_ws(" ", *pieces)
