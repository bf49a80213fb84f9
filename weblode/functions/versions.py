"""API version found in a request path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
WHOLE_VERSIONS = ["v1", "v2", "v3", "v4", "v5"]
CANDIDATE_VERSIONS = ["v1", "v2", "v3", "v4", "v5", "v1.0", "v1.1", "v2.0", "v2.1", "v3.0"]
CANDIDATE_PATTERNS = [
    r"/api/v(\d+(?:\.\d+)?)/",
    r"/v(\d+(?:\.\d+)?)/",
    r"/version/(\d+(?:\.\d+)?)/",
    r"/api/(\d+(?:\.\d+)?)/",
]
# --- end of fixed values ----------------------------------------------------


def _v(text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit("v"), text))


def _literal_chain(path: Column, names: list[str], otherwise: Column) -> Column:
    case = F.when(path.contains(f"/{names[0]}/"), names[0])
    for name in names[1:]:
        case = case.when(path.contains(f"/{name}/"), name)
    return case.otherwise(otherwise)


def api_version(path: Column, profile: str = "web") -> Column:
    """Version of a path: null (web) or ``''`` (tui) when there is none.

    web knows ``/v<digits>/`` only. tui tests v1 to v5 first, then takes the
    digits and dots that follow the first ``/api/v``, or else the first ``/v``.
    """
    if profile == "web":
        return F.nullif(F.regexp_extract(path, r"/(v\d+)/", 1), F.lit(""))
    tail = F.when(
        path.contains("/api/v"), _v(F.regexp_extract(path, r"/api/v([0-9.]*)", 1))
    ).otherwise(_v(F.regexp_extract(path, r"/v([0-9.]*)", 1)))
    return F.when(path.isNull(), "").otherwise(_literal_chain(path, WHOLE_VERSIONS, tail))


def api_version_fast(path: Column) -> Column:
    """Text up to the next slash after the first marker, if it starts with a digit."""
    text = (
        F.when(path.contains("/api/v"), F.regexp_extract(path, r"/api/v([^/]*)", 1))
        .when(path.contains("/version/"), F.regexp_extract(path, r"/version/([^/]*)", 1))
        .otherwise(F.regexp_extract(path, r"/v([^/]*)", 1))
    )
    return F.when(text.rlike("^[0-9]"), F.concat(F.lit("v"), text)).otherwise("")


def api_version_candidates(path: Column) -> Column:
    """Known versions by containment, then four general patterns in order."""
    found = F.lit("")
    for pattern in reversed(CANDIDATE_PATTERNS):
        text = F.regexp_extract(path, pattern, 1)
        found = F.when(text != "", _v(text)).otherwise(found)
    return F.when(path.isNull(), "").otherwise(_literal_chain(path, CANDIDATE_VERSIONS, found))


def url_path(url: Column) -> Column:
    """Path part of a URL, from the first slash after scheme and host."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)://(.*)$", 1)).otherwise(url)
    return F.regexp_extract(rest, r"(?s)(/.*)$", 1)


def version_from_url(url: Column) -> Column:
    return api_version(url_path(url), "tui")
