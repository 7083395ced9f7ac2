"""The catalog: built from record inputs, published as a bundle, and served by search, get, stats and export."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import text as T
from tesserae.functions import urls
from tesserae.operators import analysis, consolidate, dedup, exports, integrity, search, stats, validate
from tesserae.operators import reviews as human
from tesserae.operators import source_reviews as scripts
from tesserae.sources import scans, sinks


def index_tokens(parents: DataFrame) -> DataFrame:
    """id and tokens: the indexed text of an entry and all its variants, columns below each other."""
    merged = lambda own, each: F.when(F.col("variants").isNull(), own).otherwise(F.array_join(F.transform("variants", each), " "))
    texts = {
        "title": merged(F.concat_ws(" ", "id", "title"), lambda v: F.concat_ws(" ", v["id"], v["title"])),
        "description": merged(F.col("description"), lambda v: v["description"]),
        "category": F.col("category"),
        "tags": merged(F.array_join("tags", " "), lambda v: F.array_join(v["tags"], " ")),
        "sourceName": F.when(F.col("variants").isNull(), F.col("sourceName")).otherwise(F.array_join(F.array_distinct(F.transform("variants", lambda v: v["sourceName"])), " ")),
    }
    capped = [F.substring(F.coalesce(texts[n], F.lit("")), 1, vocab.INDEX_CHARS) for n in texts] + [F.substring(analysis.terms("summaries" in parents.columns), 1, vocab.ANALYSIS_CHARS)]
    folded = [T.tokens(T.fold(c)) for c in capped]
    return parents.select("id", F.concat(*folded).alias("tokens"))


def record_digest(items: DataFrame) -> Column:
    """The digest of what was collected of a record: its own columns in order of their names, those without a value, too."""
    names = sorted(c for c in validate_columns() if c in items.columns)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def build(
    base: list[tuple[str, DataFrame]], waves: list[tuple[str, DataFrame]] = (), policy: DataFrame | None = None, removed: DataFrame | None = None,
    repairs: DataFrame | None = None, reviews: DataFrame | None = None, receipts: str | None = None,
) -> dict[str, DataFrame]:
    """All parts of a catalog. Inputs have the columns of ``validate.ITEM`` and row_order; errors stop the build.

    Base inputs are de-duplicated by id and by link and title; waves by content
    only, since several of their records may share a page and a title. ``removed``
    (id, source_sha256, reason, status, verified_at) takes out links that cannot be
    reached, ``repairs`` gives new values to canonical records of component groups,
    ``reviews`` (id, review as JSON) classifies every link. All are bound by digest to
    what they speak of. ``receipts`` is the folder with the originals and notices
    that the records of waves name.
    """
    rows = dedup.ordered_union(base, "row_order")
    valid, _ = validate.validated(rows, strict=True)
    valid = valid.withColumn("_at", F.col("input_order") * F.lit(1 << 40) + F.col("row_order"))
    kept = dedup.deduplicate(valid, "_at").drop("_at")
    gone = None
    if removed is not None:
        pinned = kept.select("id", "kind", "sourceUrl", record_digest(kept).alias("record_sha"))
        _stop(human.removal_faults(removed, pinned), "removal")
        gone = pinned.join(removed.select("id"), "id", "left_semi")
        kept = kept.join(removed.select("id"), "id", "left_anti")
    print_of = dedup.fingerprint(F.col("kind"), F.col("language"), F.col("code"), F.col("colors"), F.col("image.sha256"))
    kept = kept.withColumn("fingerprint", print_of)
    accepted = None
    if waves:
        every = dedup.ordered_union(list(waves), "row_order")
        if receipts is not None:
            _stop(human.receipt_faults(every, receipts), "receipt")
        more, _ = validate.validated(every.withColumn("input_order", F.col("input_order") + len(base)), strict=True)
        if twice := dedup.collisions(kept, more).head():
            raise validate.RecordError(f"{twice['id']}: an id of two inputs")
        accepted, excluded, counts = dedup.merge(kept, more.withColumn("fingerprint", print_of))
        kept = kept.unionByName(accepted.select(kept.columns))
    if "sourceReview" in kept.columns:
        _stop(scripts.checked(kept.withColumn("collectionEvidence", F.col("receipt")) if "receipt" in kept.columns else kept).where(F.size("faults") > 0), "source review")
    items = analysis.analysed_items(kept.drop("fingerprint", "input_name", "receipt"))
    items = items.withColumn("pos", F.col("input_order") * F.lit(1 << 40) + F.col("row_order")).drop("input_order", "row_order")
    items = items.withColumn("code_sha", F.sha2(F.coalesce("code", F.lit("")), 256)).withColumn("record_sha", record_digest(items))
    if policy is None:
        policy = items.sparkSession.createDataFrame([], "group string, member string, mode string, code_sha string, record_sha string")
    if repairs is not None:
        _stop(consolidate.unused_repairs(policy, repairs), "repair")
    parents, aliases = consolidate.apply(items, policy, repairs)
    if reviews is not None:
        _stop(human.bound(reviews, parents), "review")
        _stop(human.uncovered(reviews, parents).select("id", F.lit("not one review").alias("fault")), "review")
        parents = human.annotated(parents, reviews)
    out = {"items": parents, "aliases": aliases, "originals": items.select("id", "kind", "sourceUrl", "sourceName", "code_sha", "record_sha")}
    if gone is not None:
        out["gone"] = gone.select("id", "sourceUrl")
    if accepted is not None:
        out |= {"excluded": excluded, "wave_counts": counts}
    return out


def _stop(faults: DataFrame, what: str) -> None:
    """Raises what the first faults say."""
    if found := faults.limit(5).collect():
        raise validate.RecordError("; ".join(f"{what} {': '.join(str(v) for v in r)}" for r in found))


def derived(parents: DataFrame, originals: DataFrame | None = None, gone: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts that follow from the entries; ``originals`` are all records before consolidation, ``gone`` the links taken out."""
    tokens = index_tokens(parents)
    index = search.Index.build(tokens, "id", F.col("tokens")).with_dictionary(tokens, F.col("tokens"))
    facets = stats.facet_counts(parents, {n: F.col(n) for n in ("category", "kind", "license", "asset_type", "basis", "domain")}, {n: F.col(n) for n in ("effects", "components", "techniques", "use_cases")})
    totals = parents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") != "reference").alias("stored"), F.coalesce(F.sum("variant_count"), F.lit(0)).alias("variants"), F.max(F.substring("verifiedAt", 1, 10)).alias("updated_at"))
    sources = dedup.source_registry(parents, "sourceUrl", ["pos"]).select("source_id", "project", "sourceName", "records")
    if originals is not None:  # providers of variants, too: another one's record may be canonical
        others = dedup.source_registry(originals, "sourceUrl", ["id"]).select("source_id", "project", "sourceName", F.lit(0).cast("long").alias("records"))
        sources = sources.unionByName(others.join(sources, "source_id", "left_anti"))
    if gone is not None and originals is not None:
        lost = gone.select(urls.project_url(F.col("sourceUrl")).alias("project")).join(originals.select(urls.project_url(F.col("sourceUrl")).alias("project")), "project", "left_anti")
        sources = sources.join(lost, "project", "left_anti")
    return {"facets": facets, "totals": totals, "sources": sources} | index.sorted_parts()


def validate_columns() -> list[str]:
    return [c.split()[0] for c in validate.ITEM.replace("struct<type:string,variant:string,sampleText:string,scene:string>", "x").replace("struct<path:string,mime:string,width:int,height:int,sha256:string,sourceSha256:string>", "x").split(", ")]


def publish(parts: dict[str, DataFrame], path: str, version: str | None = None) -> str:
    """Writes the parts and, from the entries as written, what follows from them; the manifest comes last."""
    version = version or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S")
    spark = parts["items"].sparkSession
    for name, df in parts.items():
        sinks.write_part(df, f"{path}/{version}/{name}", sinks.KEYS.get(name))
    back = {name: spark.read.parquet(f"{path}/{version}/{name}") for name in parts}
    sinks.publish(derived(back["items"], back.get("originals"), back.get("gone")), path, version)
    return version


class Catalog:
    """A published bundle, read only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, sinks.published(spark, path)

    def part(self, name: str) -> DataFrame:
        return scans.bundle(self.spark, self.path, name)

    def search(self, **arguments) -> dict:
        """{items, total, limit, offset}; entries only, never their variants."""
        a = search.checked(arguments)
        words = search.phrases(a["query"])
        empty = {"items": [], "total": 0, "limit": a["limit"], "offset": a["offset"]}
        if a["query"] and words is None:
            return empty
        keys = self.part("items").where("access = 'public'").select("id", "title", "category", "license", "kind", "asset_type", "basis", "domain", "effects", "components", "use_cases")
        keys = search.filtered(keys, {n: a[n] for n in ("category", "license", "kind", "asset_type", "basis", "domain")}, {"effects": a["effect"], "components": a["component"], "use_cases": a["use_case"]})
        if words:
            parts = ("postings", "lengths", "prefixes", "figures") if self._there("prefixes") else ("postings", "lengths")  # bundles of before have no dictionary
            hits = search.Index(*(self.part(n) for n in parts)).search(words).withColumnRenamed("doc", "id")
            keys = keys.join(hits, "id")
        total = keys.count()
        found = search.page(search.ordered(keys, "title", "id", bool(words)), a["limit"], a["offset"]).select("id").collect()  # a page
        ids = [r["id"] for r in found]
        rows = {r["id"]: r.asDict(recursive=True) for r in self.part("items").where(F.col("id").isin(ids)).collect()} if ids else {}
        return empty | {"items": [rows[i] for i in ids], "total": total}

    def get(self, item_id: str) -> dict | None:
        """A record by its id, or by an alias: then the one variant it names, with canonical_id and its role."""
        item_id = search.checked_text(item_id, "id", 160)
        items = self.part("items")
        if own := search.by_id(items, item_id).head():
            return own.asDict(recursive=True)
        named = self.part("aliases").where(F.col("alias") == item_id).head()
        if named is None:
            return None
        parent = search.by_id(items, named["item_id"]).head()
        variants = [v for v in (parent["variants"] or ()) if v["id"] == item_id] if parent else []
        if len(variants) != 1:
            raise RuntimeError(f"{item_id}: the bundle is inconsistent")
        out = variants[0].asDict(recursive=True) | {"canonical_id": parent["id"]}
        role = out.pop("variant_role", None)
        return out | ({"variant_role": role} if role in (*vocab.ROLES.values(), "component-part") else {})

    def stats(self) -> dict:
        out = self.part("totals").head().asDict()
        out["sources"] = self.part("sources").count()
        for r in self.part("facets").collect():  # closed vocabularies and licences
            out.setdefault(r["field"], {})[r["value"]] = r["n"]
        return {k: dict(sorted(v.items())) if isinstance(v, dict) else v for k, v in out.items()}

    def export(self) -> DataFrame:
        return search.exported(self.part("items"))

    def verify(self) -> DataFrame:
        """check, faults: how much speaks against each of the bundle's promises."""
        rows = [df.agg(F.count(F.lit(1)).alias("faults")).select(F.lit(name).alias("check"), "faults") for name, df in self._checks().items()]
        return reduce(DataFrame.unionByName, rows)

    def _there(self, name: str) -> bool:
        try:
            self.part(name)
        except scans.Unavailable:
            return False
        return True

    def _checks(self) -> dict[str, DataFrame]:
        items, aliases, lengths, facets = (self.part(n) for n in ("items", "aliases", "lengths", "facets"))
        originals = consolidate.originals(items)
        grouped = items.where("variants is not null")
        own = F.transform("variants", lambda v: v["id"])
        each = grouped.select(F.col("id").alias("parent"), "mode", F.posexplode("variants").alias("at", "v")).select("parent", "mode", "at", "v.*")
        role = F.when((F.col("mode") == "component") & (F.col("id") != F.col("parent")), "component-part")
        for mode, name in vocab.ROLES.items():
            role = role.when(F.col("mode") == mode, name)
        stored = F.col("kind") != "reference"
        total = lambda df, n: df.agg(F.sum(n).alias("n"))
        count = items.agg(F.count(F.lit(1)).alias("m"))
        fresh = derived(items)
        checks = {
            "ids are unique": items.groupBy("id").count().where("count > 1"),
            "entries are public": items.where("access <> 'public' or access is null"),
            "entries are valid": validate.validated(items)[1],
            "variants are valid": validate.validated(each)[1],
            "groups have 2 to 64 members": grouped.where(~F.size("variants").between(2, 64)),
            "the first variant is the entry": grouped.where(own[0] != F.col("id")),
            "aliases are the other variants": grouped.where(F.slice(own, 2, 64) != F.col("aliases")),
            "modes are known": grouped.where(~F.col("mode").isin(*vocab.ROLES)),
            "roles follow from the mode": each.where(~F.col("variant_role").eqNullSafe(role)),
            "parts are not counted as variants": grouped.where(F.col("variant_count") != F.size(F.filter("variants", lambda v: v["variant_role"] != "component-part"))),
            "members are no cards": each.where("id <> parent").select("id").join(items.select("id"), "id", "left_semi"),
            "palette groups hold palettes": each.where("mode = 'palette' and kind <> 'palette'"),
            "aliases name items": integrity.alias_faults(items, aliases),
            "every alias is a variant": aliases.select(F.col("alias").alias("id")).exceptAll(originals.where("id <> parent_id").select("id")),
            "palette code is its colours": exports.palette_code_faults(items),
            "stored entries have a domain, links none": items.where((stored & ~F.coalesce(F.col("domain").isin(*vocab.DOMAINS), F.lit(False))) | (~stored & F.col("domain").isNotNull())),
            "collections part the entries": integrity.not_partitioned(items, [items.where(F.col("category") == c) for c in vocab.CATEGORIES], "id"),
            "every item is indexed": items.select("id").exceptAll(lengths.select(F.col("doc").alias("id"))),
            "the index is of items": lengths.select(F.col("doc").alias("id")).exceptAll(items.select("id")),
            "postings add up to lengths": self.part("postings").groupBy("doc").agg(F.sum("tf").alias("n")).join(lengths, "doc", "full").where(~F.coalesce(F.col("n"), F.lit(0)).eqNullSafe(F.col("length").cast("long"))),
            "facets count items": integrity.differences(facets, fresh["facets"].select(facets.columns)),
            "totals count items": integrity.differences(self.part("totals"), fresh["totals"].select(self.part("totals").columns)),
            "sources cover items": total(self.part("sources"), "records").join(count).where("n <> m"),
            "collections count entries": exports.collection_counts(items).where("collection not like 'domain-%'").agg(F.sum("n").alias("n")).join(count).where("n <> m"),
        }
        if self._there("prefixes"):
            checks["the dictionary counts documents"] = integrity.differences(self.part("prefixes"), fresh["prefixes"])
        if self._there("originals"):
            before = self.part("originals")
            checks |= {
                "no original is lost or invented": integrity.differences(before.select("id"), originals.select("id")),
                "originals are as collected": each.select("id", "record_sha").unionByName(items.where("variants is null").select("id", "record_sha")).join(before.select("id", F.col("record_sha").alias("was")), "id").where("record_sha <> was"),
            }
        if self._there("excluded"):
            out, counts = self.part("excluded"), self.part("wave_counts")
            checks |= {
                "excluded records name what is kept": out.select(F.col("same_as").alias("id")).join(originals, "id", "left_anti"),
                "excluded records are not kept": out.select("id").join(originals, "id", "left_semi"),
                "waves add up": counts.where("received <> accepted + excluded"),
            }
        return checks

    def reconstructed(self, fresh: dict[str, DataFrame]) -> DataFrame:
        """part, side, n: how many rows of a new build from the inputs are not in the bundle (left), and the other way round."""
        rows = []
        for name in ("items", "aliases"):
            plain = lambda df: df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("row"))
            rows.append(integrity.differences(plain(fresh[name]), plain(self.part(name))).groupBy("side").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "side", "n"))
        return reduce(DataFrame.unionByName, rows)
