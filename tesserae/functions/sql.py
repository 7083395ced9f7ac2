"""The library's helpers as SQL functions of a session, and table functions of index tokens.

What built-in expressions can say is a SQL function, which Catalyst puts into the
plan as it stands, so filters and columns are still pushed through it; the others
are Arrow functions. All give null for null, and the table functions give no row for it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae.functions import color, matching, urls
from tesserae.functions import text as T

def _part(url: str, i: int) -> str:
    return rf"regexp_extract({url}, r'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$', {i})"


def _encoded(x: str) -> str:
    again = f"regexp_replace(regexp_replace(url_encode(try_url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'))), r'\\*', '%2A'), '%7E', '~')"
    return f"if({x} rlike r'^[A-Za-z0-9_.~+-]*\\z', {x}, coalesce({again}, {x}))"


def _oklab(ground: float) -> list[str]:
    def light(i: int) -> str:
        channel = lambda k: f"(cast(conv(substring(color, {2 * k}, 2), 16, 10) as double) / 255.0D)"
        mixed = f"({channel(i)} * {channel(4)} + (1.0D - {channel(4)}) * {ground}D)"
        return f"if({mixed} <= 0.04045D, {mixed} / 12.92D, pow(({mixed} + 0.055D) / 1.055D, 2.4D))"

    weighted = lambda row, xs: " + ".join(f"{w!r}D * {x}" for w, x in zip(row, xs, strict=True))
    cone = [f"cbrt({weighted(row, [light(i) for i in (1, 2, 3)])})" for row in color.LMS]
    return [f"({weighted(row, cone)}) * 100.0D" for row in color.LAB]


_SCHEME, _HOST = f"lower({_part('url', 1)})", f"lower({_part('url', 2)})"
_VALID = f"coalesce({_SCHEME} in ('http', 'https') and {_HOST} <> '' and not contains({_HOST}, '@'), false)"
_STEPS = f"filter(split({_part('url', 3)}, '/'), x -> x <> '')"
_VALUE = "if(contains(x, '='), regexp_replace(x, '^[^=]*=', ''), '')"
_QUERY = (
    f"transform(array_sort(filter(split({_part('url', 4)}, '&'), x -> x <> '' and not lower(x) rlike r'{urls.TRACKING}')), "
    f"x -> concat({_encoded('substring_index(x, ' + chr(39) + '=' + chr(39) + ', 1)')}, '=', {_encoded(_VALUE)}))"
)

#: name, parameters, result, expression: each the same rule as the Column function of this name.
BUILT_IN = (
    ("canonical_url", "url string", "string", f"if({_VALID}, concat({_SCHEME}, '://', {_HOST}, coalesce(nullif(regexp_replace({_part('url', 3)}, '/+$', ''), ''), '/'), if(size({_QUERY}) > 0, concat('?', array_join({_QUERY}, '&')), '')), null)"),
    ("project_url", "url string", "string", f"case when {_HOST} = 'github.com' and size({_STEPS}) >= 2 then concat('https://github.com/', lower(array_join(slice({_STEPS}, 1, 2), '/'))) when {_HOST} in ({', '.join(repr(h) for h in urls.SITE_HOSTS)}) then concat('https://', {_HOST}) else canonical_url(url) end"),
    ("canonical_color", "color string", "string", r"case when lower(trim(color)) rlike r'^#[0-9a-f]{3}\z' then concat(regexp_replace(lower(trim(color)), '([0-9a-f])', '$1$1'), 'ff') when lower(trim(color)) rlike r'^#[0-9a-f]{4}\z' then regexp_replace(lower(trim(color)), '([0-9a-f])', '$1$1') when lower(trim(color)) rlike r'^#[0-9a-f]{6}\z' then concat(lower(trim(color)), 'ff') when lower(trim(color)) rlike r'^#[0-9a-f]{8}\z' then lower(trim(color)) end"),
    ("oklab6", "color string", "array<double>", f"if(color is null, null, array({', '.join(_oklab(0.0) + _oklab(1.0))}))"),
    ("numeric_skeleton", "text string", "string", r"regexp_replace(text, r'[-+]?(?:\d*\.\d+|\d+)', '#')"),
)

_MARKED, _BARE = T.MARKED + T.MARKED.upper(), T.PLAIN + T.PLAIN.upper()
#: Signs beyond ASCII are sought first: what looks at each of them closer is many times as slow.
_ODD = rf"text rlike r'[^\x00-\x7F](?<=[^{T.UNMARKED}{_MARKED}])'"
_UNMARKED = f"coalesce(fold_marks(if({_ODD}, text, null)), if(octet_length(text) = char_length(text), text, translate(text, '{_MARKED}', '{_BARE}')))"
#: The same with functions of Python in them: only texts with signs beyond the usual ones go there, the others as null.
#: ``tokenize`` gives pos (from 0) and term of each index token of a text, ``plain_tokens`` those of an unmarked one.
MIXED = (
    ("unmarked", "text string", "string", _UNMARKED),
    ("plain_tokens", "text string", "table(pos int, term string)", f"select pos, col from posexplode(regexp_extract_all(lower(text), r'{T.TOKEN}', 1))"),
    ("tokenize", "text string", "table(pos int, term string)", f"select pos, col from posexplode(regexp_extract_all(lower({_UNMARKED}), r'{T.TOKEN}', 1))"),
)


def register(spark: SparkSession) -> list[str]:
    """Names of the functions that the session's SQL has from now on; registering again replaces them."""
    for name, parameters, result, expression in BUILT_IN:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {expression}")
    fast = {
        "fold_marks": F.pandas_udf(T.fold.__wrapped__, "string"),
        "casefold": F.pandas_udf(T.casefold.__wrapped__, "string"),
        "canonical_json": F.pandas_udf(T.canonical.__wrapped__, "string"),
        "seq_ratio": F.pandas_udf(matching.sequence_ratio.__wrapped__, "double"),
        "min_assignment": F.pandas_udf(matching.matched_distance.__wrapped__, "struct<mean:double,most:double,matching:array<int>>"),
    }
    for name, function in fast.items():
        spark.udf.register(name, function)
    for name, parameters, result, expression in MIXED:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {expression}")
    return [*(b[0] for b in BUILT_IN), *fast, *(m[0] for m in MIXED)]
