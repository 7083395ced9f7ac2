"""URL identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"^(?:utm_[^=]*|fbclid|gclid)(?:=|$)"
#: Hosts whose whole site is one project. Fixed values.
SITE_HOSTS = ("ambientcg.com", "polyhaven.com", "3dtextures.me", "kenney.nl")


def _parts(url: Column) -> dict[str, Column]:
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
    group = lambda i: F.regexp_extract(url, pattern, i)
    return {"scheme": F.lower(group(1)), "host": F.lower(group(2)), "path": group(3), "query": group(4), "fragment": group(5)}


def valid_url(url: Column) -> Column:
    """http(s) with a host and no user information."""
    p = _parts(url)
    return F.coalesce(p["scheme"].isin("http", "https") & (p["host"] != "") & ~p["host"].contains("@"), F.lit(False))


def encoded(text: Column) -> Column:
    """A parameter's name or value, decoded and encoded again in one way: blanks as plus signs, all but plain signs as bytes.

    What stands after a percent sign without being a byte is taken as it is.
    """
    plain = text.rlike(r"^[A-Za-z0-9_.~+-]*\z")
    sound = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    again = F.regexp_replace(F.regexp_replace(F.url_encode(F.try_url_decode(sound)), r"\*", "%2A"), "%7E", "~")
    return F.when(plain, text).otherwise(F.coalesce(again, text))


def canonical_url(url: Column) -> Column:
    """Lower-case origin, no closing slashes, no tracking parameters, the others sorted, no fragment; null if invalid."""
    p = _parts(url)
    path = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    kept = F.array_sort(F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    kept = F.transform(kept, lambda x: F.concat(encoded(F.substring_index(x, "=", 1)), F.lit("="), encoded(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit("")))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(valid_url(url), F.concat(p["scheme"], F.lit("://"), p["host"], path, query))


def project_url(url: Column) -> Column:
    """The project a page belongs to: a repository, a site, or the page itself."""
    p = _parts(url)
    steps = F.filter(F.split(p["path"], "/"), lambda x: x != "")
    repository = F.concat(F.lit("https://github.com/"), F.lower(F.array_join(F.slice(steps, 1, 2), "/")))
    site = F.concat(F.lit("https://"), p["host"])
    return F.when((p["host"] == "github.com") & (F.size(steps) >= 2), repository).when(p["host"].isin(*SITE_HOSTS), site).otherwise(canonical_url(url))


def normalized_url(url: Column) -> Column:
    """Lower-case origin; path, query and fragment as they are."""
    p = _parts(url)
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(valid_url(url), F.concat(p["scheme"], F.lit("://"), p["host"], F.substring(url, F.length(head) + 1, F.length(url))))
