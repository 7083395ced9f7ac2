"""Closed vocabularies and limits. Catalogs depend on them as they are."""

CATEGORIES = ("animation", "transition", "typography", "interaction", "background", "loader", "palette", "gradient", "shader", "reference", "pattern", "shape", "material")
KINDS = ("code", "palette", "reference", "image")
DOMAINS = ("motion", "design")
LANGUAGES = ("css", "glsl", "svg", "json", "link", "image", "javascript")
ASSET_TYPES = CATEGORIES
EFFECTS = ("fade", "slide", "scale", "rotate", "flip", "spring", "shake", "pulse", "mask", "glitch", "pixel", "wave", "text", "stagger", "blur", "other")
COMPONENTS = ("text", "shape", "image", "particles", "grid", "stroke", "mask", "layer", "color")
TECHNIQUES = (
    "keyframes", "transition", "transform", "pseudo-element", "clip-path", "filter", "gradient", "glsl", "texture-sampling", "procedural-noise",
    "color-values", "reference-link", "svg-animation", "svg-geometry", "image-texture", "static-design",
)
USE_CASES = ("intro", "outro", "scene-change", "status", "attention", "feedback", "ambient", "color-system", "reference", "design-kit")
RENDERERS = ("css", "glsl", "svg", "palette", "gradient", "image", "none")
BASES = ("code", "color-values", "reviewed-source", "metadata", "image")
#: Facet filters of a search: argument -> allowed values.
FACETS = {"asset_type": ASSET_TYPES, "effect": EFFECTS, "component": COMPONENTS, "use_case": USE_CASES, "basis": BASES, "domain": DOMAINS}
PREVIEW_TYPES = ("css", "glsl", "svg", "palette", "image", "none")
#: Role of a consolidated variant by the group's mode.
ROLES = {"exact": "exact-source", "motion": "motion-variant", "palette": "palette-variant", "component": "motion-variant"}

ID_PATTERN = r"[A-Za-z0-9][A-Za-z0-9._-]{0,159}"
HEX_PATTERN = r"#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})"
TEXT_LIMITS = {"title": 300, "description": 12_000, "sourceName": 200, "sourceUrl": 4_000, "license": 120, "verifiedAt": 32}
CODE_LIMIT = 1_000_000
PAGE_DEFAULT, PAGE_MOST, OFFSET_MOST, QUERY_CHARS, QUERY_WORDS = 24, 100, 100_000, 240, 32
INDEX_CHARS, ANALYSIS_CHARS = 24_000, 20_000
SHARD_BYTES, SHARD_ITEMS = 512 * 1024, 64
PAYLOAD_BYTES = 8 << 20
RATE_CALLS, RATE_SECONDS = 120, 60
#: BM25, as full-text indexes of this kind have it.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
