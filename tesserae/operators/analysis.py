"""Classification of every record by what it holds: reviewed, picture, colours, code, or metadata only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.functions import text as T
from tesserae.operators import source_reviews
from tesserae.operators.features.css import css_analysis
from tesserae.operators.features.glsl import analysed
from tesserae.operators.features.svg import svg_analysis

FIELDS = ("asset_type", "effects", "components", "properties", "techniques", "use_cases", "signals", "valid")


def _strings(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def _made(asset_type, effects=(), components=(), properties=(), techniques=(), use_cases=(), signals: Column | None = None, valid: bool = True) -> Column:
    as_list = lambda v: v if isinstance(v, Column) else _strings(*v)
    kind = asset_type if isinstance(asset_type, Column) else F.lit(asset_type)
    return F.struct(kind.alias("asset_type"), *(as_list(v).alias(n) for n, v in zip(FIELDS[1:6], (effects, components, properties, techniques, use_cases), strict=True)), (signals if signals is not None else _strings()).alias("signals"), F.lit(valid).alias("valid"))


def analysed_items(items: DataFrame) -> DataFrame:
    """Adds asset_type, effects, components, properties, techniques, use_cases, signals, basis, confidence and domain.

    A script's own review (``sourceReview``, where there is such a column) goes before all
    else. Each language is analysed on its own rows, so a parser sees no other's code.
    """
    if "sourceReview" in items.columns:
        said = F.col("sourceReview").isNotNull()
        whole = analysed_items(items.where(~said).drop("sourceReview")).withColumn("sourceReview", F.lit(None).cast("string"))
        return whole.unionByName(source_reviews.analysis(items.where(said)))
    c = F.col
    colors = F.filter("colors", lambda x: x.rlike(rf"^{vocab.HEX_PATTERN}\z"))
    moving = (c("language") == "css") & c("code").rlike(r"(?i)@(?:-webkit-)?keyframes\b")
    coloured = (c("kind") != "reference") & (c("category").isin("palette", "gradient") | (c("kind") == "palette")) & (F.size(colors) > 0) & ~F.coalesce(moving, F.lit(False))
    coded = (c("kind") != "reference") & (F.char_length("code").between(1, vocab.CODE_LIMIT)) & c("language").isin("css", "glsl", "svg")
    way = F.when((c("kind") == "image") & c("image").isNotNull(), "image").when(F.coalesce(coloured, F.lit(False)), "colors").when(F.coalesce(coded, F.lit(False)), c("language")).otherwise("metadata")
    rows = items.withColumn("_way", way)
    nothing = _made("reference", techniques=["reference-link"], use_cases=["reference"], valid=False)

    shape = c("category") == "shape"
    picture = _made(F.when(shape, "shape").otherwise("material"), components=F.when(shape, _strings("shape", "image")).otherwise(_strings("image")), properties=F.when(shape, _strings()).otherwise(_strings("texture")), techniques=F.when(shape, _strings("static-design")).otherwise(_strings("image-texture", "static-design")), use_cases=["design-kit"], signals=F.array(F.concat(F.lit("image-sha256:"), "image.sha256")))
    gradient = (c("category") == "gradient") | F.coalesce(c("preview.type") == "gradient", F.lit(False))
    colour = _made(F.when(gradient, "gradient").otherwise("palette"), components=["color"], properties=["color"], techniques=F.when(gradient, _strings("gradient", "color-values")).otherwise(_strings("color-values")), use_cases=["color-system"], signals=F.array(F.concat(F.lit("hex-values:"), F.array_join(F.slice(colors, 1, 32), ","))))
    whole = lambda name, found: rows.where(c("_way") == name).withColumn("_a", found)
    parts = [whole("image", picture), whole("colors", colour), whole("metadata", nothing)]
    parts.append(whole("css", css_analysis("code", "category", "preview.sampleText")))
    parts.append(whole("svg", svg_analysis("code", "category", "domain")))
    shaders = analysed(rows.where("_way = 'glsl'"), "code", c("preview.scene"))
    made = F.struct(*(c(n) if n in shaders.columns else _strings().alias(n) for n in FIELDS))
    parts.append(shaders.withColumn("_a", made).select(*rows.columns, "_a"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = out.withColumn("_a", F.when(c("_a.valid") | (c("_way") == "metadata"), c("_a")).otherwise(nothing)).withColumn("_basis", F.when(c("_way") == "image", "image").when(c("_way") == "colors", "color-values").when(c("_a.valid"), "code").otherwise(F.when(c("verification") == "source-and-license-reviewed", "reviewed-source").otherwise("metadata")))
    static = c("language").isin("css", "svg") & (c("_basis") == "code") & ~F.arrays_overlap("_a.techniques", _strings("keyframes", "transition", "svg-animation"))
    domain = F.when(c("kind") == "reference", F.lit(None)).when(c("domain").isin(*vocab.DOMAINS), c("domain")).when(c("kind").isin("palette", "image") | F.coalesce(static, F.lit(False)) | (c("_basis") == "color-values"), "design").otherwise("motion")
    out = out.withColumn("_domain", domain)
    design = F.coalesce(c("_domain") == "design", F.lit(False))
    techniques = F.when(design, F.array_union("_a.techniques", _strings("static-design"))).otherwise(c("_a.techniques"))
    more = F.when(c("_a.asset_type").isin("palette", "gradient"), _strings("color-system")).otherwise(_strings("design-kit"))
    uses = F.when(design & F.coalesce(static, F.lit(False)), F.array_union("_a.use_cases", more)).otherwise(c("_a.use_cases"))
    signals = F.when(c("_basis") == "code", F.concat("_a.signals", F.array(F.concat(F.lit("code-sha256:"), F.sha2("code", 256))))).otherwise(c("_a.signals"))
    kept = [n for n in items.columns if n != "domain"]
    return out.select(
        *kept, c("_domain").alias("domain"), c("_a.asset_type").alias("asset_type"), c("_a.effects").alias("effects"), c("_a.components").alias("components"), c("_a.properties").alias("properties"),
        T.in_vocabulary(techniques, vocab.TECHNIQUES).alias("techniques"), T.in_vocabulary(uses, vocab.USE_CASES).alias("use_cases"), signals.alias("signals"), c("_basis").alias("basis"),
        F.when(c("_basis").isin("code", "color-values", "image"), "high").otherwise("low").alias("confidence"),
    )


def terms(summaries: bool = False) -> Column:
    """Index terms of an analysis, with the summaries of a review where there are any."""
    names = ("effects", "components", "properties", "techniques", "use_cases", "signals", *(["summaries"] if summaries else []))
    lists = [F.coalesce(n, F.array().cast("array<string>")) for n in names]
    return F.substring(F.concat_ws(" ", "asset_type", F.coalesce("domain", F.lit("reference")), *(F.array_join(x, " ") for x in lists), "basis"), 1, vocab.ANALYSIS_CHARS)


def reviewed(items: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the facets of their review where its digest still fits, and errors: reviews of nothing or of what has changed."""
    names = [n for n in ("asset_type", "effects", "components", "use_cases") if n in reviews.columns]
    new = reviews.select(F.col("id"), F.col("sourceSha256").alias("_sha"), *(F.col(n).alias(f"_{n}") for n in names))
    met = items.join(new, "id", "full")
    good = F.col("_sha").isNotNull() & (F.col("_sha") == F.col("record_sha"))
    errors = met.where(F.col("_sha").isNotNull() & ~F.coalesce(good, F.lit(False))).select("id", F.when(F.col("record_sha").isNull(), "no such record").otherwise("the record has changed").alias("error"))
    out = met.where("record_sha is not null").select(*(F.when(good, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in items.columns), F.coalesce(good, F.lit(False)).alias("reviewed"))
    return out, errors
