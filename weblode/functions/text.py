"""Small text helpers for paths, users, CSV cells, search and countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
USER_ID_SEPARATOR = "::"
NO_COUNTRY = "UN"
ASCII_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FLAG_OFFSET = 127397  # distance from a capital letter to its regional indicator
ERROR_SEARCH_FIELDS = [
    "level", "message", "client_address", "server_address", "request", "referrer", "host",
]
# --- end of fixed values ----------------------------------------------------


def strip_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def user_id(ip_address: Column, user_agent: Column) -> Column:
    """Readable identity; counts of users compare the two columns instead."""
    return F.concat_ws(USER_ID_SEPARATOR, ip_address, user_agent)


def csv_safe(cell: Column) -> Column:
    """Guard a cell against being read as a spreadsheet formula."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def error_search_text() -> Column:
    """Lower-cased text of an error row over which a search runs."""
    cells = [F.coalesce(F.col(name), F.lit("")) for name in ERROR_SEARCH_FIELDS]
    return F.lower(F.concat_ws(" ", *cells))


def country_code(location: Column) -> Column:
    return F.when(F.length(location) >= 2, F.upper(F.substring(location, 1, 2))).otherwise(NO_COUNTRY)


def flag(code: Column, profile: str = "web") -> Column:
    """Regional-indicator pair; tui gives null unless the code is two letters."""
    indicators = "".join(chr(ord(letter) + FLAG_OFFSET) for letter in ASCII_CAPITALS)
    text = F.translate(F.upper(code), ASCII_CAPITALS, indicators)
    if profile == "web":
        return F.coalesce(text, F.lit(""))
    return F.when(F.upper(code).rlike("^[A-Z]{2}$"), text)
