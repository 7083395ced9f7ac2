"""What a catalog publishes beside its bundle: discovery index, browse rows, collections, detail shards, digests of its statistics.

All of it is plans; published files are written by the tasks that have them.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.operators import shards, validate
from tesserae.sources import content

INDEX_VERSION = 2
FOLDER = "catalog-details"
HEAD, TAIL = '{"version":1,"items":[', "]}\n"
BASIC = ("id", "title", "category", "sourceUrl", "sourceName", "license", "kind")
FACETS = ("asset_type", "effects", "components", "use_cases")


def _there(items: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in items.columns]


def discovery(items: DataFrame) -> DataFrame:
    """The compact index: what a reader needs to find an entry, and nothing of what it holds."""
    variants = "variants" in items.columns
    more = []
    if variants:
        each = lambda name: F.transform("variants", lambda v: v[name])
        more = [F.col("aliases"), F.when(F.col("variants").isNotNull(), F.col("variant_count")).alias("variant_count"), each("title").alias("variant_titles"), F.array_distinct(each("sourceName")).alias("variant_source_names")]
    return items.select(*_there(items, *BASIC, "domain", *FACETS, "basis", "confidence", "target_domain", "resource_type", "preview_mode", "preview_asset"), *more)


def preview_domain(mode: Column, asset_domain: Column, language: Column, code: Column) -> Column:
    """The domain of a link's preview: that of the asset it shows, or by whether its own code moves. Null where an asset has none."""
    moves = F.when(language == "svg", code.rlike(r"<(?:animate|animateTransform|set)\b")).otherwise(code.rlike(r"@keyframes\b|(?:animation|transition)(?:-[a-z-]+)?\s*:"))
    own = F.when(F.coalesce(moves, F.lit(False)), "motion").otherwise("design")
    return F.when(mode == "related-asset", F.when(asset_domain.isin(*vocab.DOMAINS), asset_domain)).otherwise(own)


def previewed(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """id, preview_domain of reviews (id, mode, assetId, language, code); null for an asset that is not stored and classified."""
    stored = items.where("kind <> 'reference'").select(F.col("id").alias("assetId"), F.col("domain").alias("_domain"))
    met = reviews.join(stored, "assetId", "left")
    return met.select("id", preview_domain(F.col("mode"), F.col("_domain"), F.col("language"), F.col("code")).alias("preview_domain"))


def details(items: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Shards (shard, path, sha256, bytes, count, body) of all records as JSON in catalog order, and id -> path."""
    bodies = items.select("id", F.col(order).alias("_o"), F.to_json(F.struct(*items.columns)).alias("body"))
    # a record weighs its bytes and a comma; what stands around the records is taken off the bound
    sizes = bodies.select("_o", (F.octet_length("body") + 1).alias("size"))
    placed = shards.assigned(sizes, "_o", "size", vocab.SHARD_BYTES - len(HEAD + TAIL) + 1)
    met = bodies.join(placed, "_o")
    whole = met.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_o", "body"))).alias("r"))  # bounded by the shard's limits
    body = F.concat(F.lit(HEAD), F.array_join(F.col("r.body"), ","), F.lit(TAIL))
    files = whole.select("shard", F.size("r").cast("long").alias("count"), body.alias("body")).withColumn("sha256", F.sha2("body", 256))
    files = files.select("shard", F.concat(F.lit(f"{FOLDER}/"), "sha256", F.lit(".json")).alias("path"), "sha256", F.octet_length("body").cast("long").alias("bytes"), "count", "body")
    return files, met.select("id", "shard").join(files.select("shard", "path"), "shard").select("id", "path")


def browse(items: DataFrame, paths: DataFrame, previews: DataFrame | None = None) -> DataFrame:
    """A row for each entry: the index, the text that a reader's search looks through, and the shard with the rest."""
    more = _there(items, "language", "techniques")
    rows = items.select("id", *(c for c in more), validate.search_text(items).alias("search_text"))
    out = discovery(items).join(rows, "id").join(paths.withColumnRenamed("path", "detail_shard"), "id", "left")
    return out if previews is None else out.join(previews, "id", "left")


def collections(items: DataFrame) -> DataFrame:
    """collection, id, pos: each entry in its category, and stored ones in their domain, too. One row for each, so no collection is gathered."""
    domain = F.when((F.col("kind") != "reference") & F.col("domain").isin(*vocab.DOMAINS), F.concat(F.lit("domain-"), "domain"))
    names = F.filter(F.array("category", domain), lambda x: x.isNotNull())
    return items.select(F.explode(names).alias("collection"), "id", "pos")


def collection_counts(items: DataFrame) -> DataFrame:
    """collection, n for every category and domain, also those with nothing in them."""
    names = [*vocab.CATEGORIES, *(f"domain-{d}" for d in vocab.DOMAINS)]
    every = items.sparkSession.createDataFrame([(n,) for n in names], "collection string")
    found = collections(items).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(found), "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


def write_collections(items: DataFrame, path: str) -> None:
    """JSON lines of each collection in catalog order, under its name; the counts, empty ones included, beside them."""
    rows = collections(items).join(items.drop("pos"), "id")
    # ranges, so a large collection is several files, in order of their names
    rows.repartitionByRange("collection", "pos").sortWithinPartitions("collection", "pos").drop("pos").write.mode("overwrite").partitionBy("collection").json(f"{path}/collections")
    collection_counts(items).coalesce(1).write.mode("overwrite").json(f"{path}/counts")


def write_details(files: DataFrame, folder: str) -> dict[str, int]:
    """Writes the shards that are not there yet, leaves those that are, and removes what is none of them any more; all of it in tasks."""
    return content.write(files.select(F.concat("sha256", F.lit(".json")).alias("name"), "body"), f"{folder}/{FOLDER}")


def detail_faults(files: DataFrame, folder: str) -> DataFrame:
    """path, fault: shards that are missing, changed or too many under the folder."""
    spark = files.sparkSession
    there = spark.read.format("binaryFile").load(f"{folder}/{FOLDER}").select(F.concat(F.lit(f"{FOLDER}/"), F.element_at(F.split("path", "/"), -1)).alias("path"), F.sha2("content", 256).alias("found"))
    met = files.select("path", "sha256").join(there, "path", "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "stale").when(F.col("found") != F.col("sha256"), "changed")
    return met.select("path", fault.alias("fault")).where("fault is not null")


def palette_code_faults(items: DataFrame) -> DataFrame:
    """id of palettes whose code, read as JSON, is not their colours."""
    said = F.from_json("code", "array<string>")
    return items.where((F.col("kind") == "palette") & ~said.eqNullSafe(F.col("colors"))).select("id")


def review_counts(references: DataFrame) -> DataFrame:
    """field, value, n over the reviews of links (target_domain, resource_type, asset_type, preview_mode), and the totals."""
    fields = {"targetDomains": "target_domain", "resourceTypes": "resource_type", "assetTypes": "asset_type", "previewModes": "preview_mode"}
    totals = {"total": F.lit(True), "classified": F.col("resource_type").isNotNull(), "specificAssetTypes": F.col("asset_type") != "reference", "localPreviews": F.col("preview_mode").isNotNull()}
    one = [F.when(F.col(c).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(c).alias("value"))) for f, c in fields.items()]
    all_ = [F.when(F.coalesce(yes, F.lit(False)), F.struct(F.lit("totals").alias("field"), F.lit(name).alias("value"))) for name, yes in totals.items()]
    return references.select(F.explode(F.filter(F.array(*one, *all_), lambda x: x.isNotNull())).alias("f")).groupBy("f.field", "f.value").agg(F.count(F.lit(1)).alias("n"))


class CompositionError(ValueError):
    """Totals that do not add up."""


def composition(items: DataFrame, updated: str | None = None) -> dict[str, int]:
    """Counts of moving and still assets and of links, after a check that they make up the whole."""
    stored = F.col("kind") != "reference"
    r = items.agg(F.count_if(stored & (F.col("domain") == "motion")).alias("motion"), F.count_if(stored & (F.col("domain") == "design")).alias("design"), F.count_if(~stored).alias("references"), F.count_if(stored).alias("stored"), F.count(F.lit(1)).alias("total")).head()
    if r["motion"] + r["design"] != r["stored"] or r["stored"] + r["references"] != r["total"] or r["total"] > 1_000_000_000:
        raise CompositionError(f"{r.asDict()} does not add up")
    if updated is not None and date.fromisoformat(updated).isoformat() != updated:
        raise CompositionError(f"{updated} is no ISO date")
    return {name: r[name] for name in ("motion", "design", "references")}


def chart(counts: dict[str, int], size: int = 240) -> str:
    """A ring of the shares, as SVG: each slice starts where those before it end."""
    total, start, round_ = sum(counts.values()), 0.0, 100.0
    rings = []
    for i, (name, n) in enumerate(sorted(counts.items())):
        share = 100.0 * n / total if total else 0.0
        rings.append(f'<circle r="40" cx="60" cy="60" fill="none" stroke="hsl({90 * i} 60% 50%)" stroke-width="16" pathLength="{round_:g}" stroke-dasharray="{share:.3f} {round_ - share:.3f}" stroke-dashoffset="{-start:.3f}"><title>{name}: {n} ({share:.1f}%)</title></circle>')
        start += share
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}" viewBox="0 0 120 120">{"".join(rings)}</svg>'


def between(text: str, mark: str, body: str) -> str:
    """The text with what stands between the lines ``<!-- mark -->`` and ``<!-- /mark -->`` replaced; each must be there once."""
    first, last = f"<!-- {mark} -->", f"<!-- /{mark} -->"
    if text.count(first) != 1 or text.count(last) != 1 or text.index(first) > text.index(last):
        raise ValueError(f"{mark} is not marked just once")
    return text[: text.index(first) + len(first)] + "\n" + body.strip() + "\n" + text[text.index(last) :]


def name_of(body: str) -> str:
    return hashlib.sha256(body.encode()).hexdigest()
