"""Shaders as Column expressions: what a source calls and declares gives its facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import vocab
from tesserae.operators.features import in_order

COORDINATE = r"\b(?:uv|p|texCoord|coord)\b"


def analysed(rows: DataFrame, code: str = "code", scene: Column | None = None) -> DataFrame:
    """Adds asset_type, effects, components, techniques, use_cases, properties, uniforms and valid."""
    text = F.regexp_replace(F.col(code), r"/\*[\s\S]*?\*/|//[^\n]*", " ")
    # arrays of one, exploded: else every rule below would read the source again
    rows = rows.withColumn("_text", F.explode(F.array(text)))
    text = F.col("_text")
    calls = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w{0,79})\s*\("), F.lit(1)))
    samples = F.regexp_extract_all(text, F.lit(r"\bget(?:From|To)Color\s*\(([^;\n]{1,300})"), F.lit(1))
    uniforms = F.slice(F.regexp_extract_all(text, F.lit(r"\buniform\s+(?:float|int|bool|vec[234]|ivec[234]|mat[234]|sampler2D)\s+([A-Za-z_]\w{0,79})\s*;"), F.lit(1)), 1, 64)
    found = F.struct(calls.alias("calls"), samples.alias("samples"), uniforms.alias("uniforms"))
    rows = rows.withColumn("_found", F.explode(F.array(found))).withColumns({"_calls": F.col("_found.calls"), "_samples": F.col("_found.samples"), "uniforms": F.col("_found.uniforms")}).drop("_found")
    c = F.col("_calls")
    calls_any = lambda *names: F.arrays_overlap(c, F.array(*(F.lit(n) for n in names)))
    calls_all = lambda *names: F.size(F.array_intersect(c, F.array(*(F.lit(n) for n in names)))) == len(names)
    sampled = calls_any("getFromColor", "getToColor", "texture", "texture2D")
    turning = calls_all("sin", "cos") & (F.array_contains(c, "mat2") | text.rlike(r"\b(?:rotation|angle)\b"))
    wide = calls_any("floor", "ceil") & text.rlike(COORDINATE)
    masked = calls_any("step", "smoothstep") & text.contains("progress")
    tests = {
        "fade": calls_all("mix", "getFromColor", "getToColor"),
        "mask": masked,
        "pixel": wide,
        "rotate": turning,
        "wave": ~turning & F.array_contains(c, "sin") & text.rlike(COORDINATE),
        "glitch": calls_any("noise", "snoise", "fbm"),
        "scale": F.exists("_samples", lambda a: a.rlike(r"(?:uv|p|coord|texCoord)\s*-\s*(?:vec2\s*\()?\s*0?\.5") & a.contains("*")),
        "slide": F.exists("_samples", lambda a: a.rlike(r"(?:uv|p|coord|texCoord)\s*[+-]\s*(?:progress|direction|vec2)\b")),
        "blur": F.array_contains(c, "blur") | text.rlike(r"\b(?:blurSize|blurAmount|blurStrength)\b"),
    }
    picked = lambda marks: F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in marks.items())), lambda x: x.isNotNull())
    found = picked(tests)
    procedural = F.coalesce(scene == "procedural", F.lit(False)) & ~sampled if scene is not None else F.lit(False)
    out = rows.withColumn("effects", in_order(F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found), vocab.EFFECTS))
    out = out.withColumn("components", in_order(picked({"image": sampled, "layer": sampled, "mask": masked, "grid": wide, "color": procedural}), vocab.COMPONENTS))
    out = out.withColumn("techniques", in_order(picked({"glsl": F.lit(True), "texture-sampling": sampled, "procedural-noise": calls_any("fract", "random", "rand", "noise", "snoise", "fbm")}), vocab.TECHNIQUES))
    out = out.withColumn("properties", picked({"progress": text.rlike(r"\bprogress\b"), "texture": sampled, "uv": sampled}))
    out = out.withColumn("asset_type", F.when(procedural, "shader").otherwise("transition")).withColumn("use_cases", F.array(F.when(procedural, F.lit("ambient")).otherwise(F.lit("scene-change"))))
    return out.withColumn("valid", text.rlike(r"\bvec4\s+transition\s*\(")).drop("_text", "_calls", "_samples")
