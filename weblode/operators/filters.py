"""One filter for access rows, one for error rows: each becomes a single predicate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions.text import error_search_text, strip_query
from weblode.functions.versions import api_version
from weblode.operators.periods import Period


@dataclass(frozen=True)
class Settings:
    ignore_404: bool = False
    ignore_params: bool = False
    exclude_bots: bool = False
    excluded_endpoints: tuple[str, ...] = ()

    def counted_path(self) -> Column:
        """Path under which a row is counted."""
        return strip_query(F.col("path")) if self.ignore_params else F.col("path")


@dataclass(frozen=True)
class LogFilter:
    """Every field that is set narrows the rows; an empty filter keeps them all.

    ``status`` is a number or a tuple of inclusive ranges. ``location`` needs a
    ``country`` column (``operators.geo.with_location``), or use ``apply`` with a
    location table. ``path`` compares the path as logged even when parameters
    are ignored in counts.
    """

    period: Period = field(default_factory=Period)
    location: str | None = None
    path: str | None = None
    method: str | None = None
    status: int | tuple[tuple[int, int], ...] | None = None
    referrer: str | None = None
    version: str | None = None
    client: str | None = None
    os: str | None = None
    device_type: str | None = None
    hour: int | None = None
    day_of_week: int | None = None

    def predicates(self, settings: Settings = Settings()) -> list[Column]:
        found = []
        if self.period.bounded or self.period.profile == "tui":
            found.append(self.period.contains(F.col("ts")))
        plain = {
            "country": self.location,
            "path": self.path,
            "method": self.method,
            "referrer": self.referrer,
            "client": self.client,
            "os": self.os,
            "device": self.device_type,
            "hour": self.hour,
            "day_of_week": self.day_of_week,
        }
        found += [F.col(name) == F.lit(wanted) for name, wanted in plain.items() if wanted is not None]
        if self.version is not None:
            found.append(api_version(F.col("path"), self.period.profile) == self.version)
        if self.status is not None:
            found.append(status_in(F.col("status"), self.status))
        if settings.ignore_404:
            found.append(~F.col("status").eqNullSafe(404))
        if settings.exclude_bots:
            found.append(~F.col("is_bot"))
        if settings.excluded_endpoints:
            found.append(~settings.counted_path().isin(list(settings.excluded_endpoints)))
        return found

    def to_column(self, settings: Settings = Settings()) -> Column:
        return reduce(and_, self.predicates(settings), F.lit(True))

    def apply(
        self, df: DataFrame, settings: Settings = Settings(), locations: DataFrame | None = None
    ) -> DataFrame:
        """Filter rows; with ``locations`` those whose address is in the wanted country stay.

        A semi join: rows are read once and never multiplied, and adaptive execution splits
        a hot address. A table stored by day (``log_date``) is read from the period's first day on.
        """
        if self.period.bounded and "log_date" in df.columns:
            df = df.where(F.col("log_date") >= F.to_date(self.period.start()))
        if self.location is None or locations is None:
            return df.where(self.to_column(settings))
        others = replace(self, location=None)
        wanted = locations.where(F.col("country") == self.location).select("ip_address")
        return df.where(others.to_column(settings)).join(wanted, "ip_address", "left_semi")


def status_in(status: Column, wanted: int | tuple[tuple[int, int], ...]) -> Column:
    if isinstance(wanted, int):
        return status == wanted
    return reduce(or_, (status.between(low, high) for low, high in wanted), F.lit(False))


def exclude_endpoints(df: DataFrame, excluded: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Drop rows whose counted path is in a table of paths (column ``path``), for long lists.

    The table is not made distinct first: an aggregation between its shuffle and the join
    would keep adaptive execution from splitting a hot path.
    """
    paths = excluded.select(F.col("path").alias("_path"))
    return df.join(paths, settings.counted_path() == F.col("_path"), "left_anti")


def at_endpoint(path: str, method: str, status: int) -> Column:
    return (F.col("path") == path) & (F.col("method") == method) & (F.col("status") == status)


def by_lookup(column: str, lookup: Callable[[Column], Column], wanted: str) -> Column:
    """Equality on a value looked up from a column, for any Column function."""
    return lookup(F.col(column)) == wanted


@dataclass(frozen=True)
class ErrorFilter:
    period: Period = field(default_factory=Period)
    search: str | None = None
    levels: tuple[str, ...] = ()

    def to_column(self) -> Column:
        """The predicate without the text search."""
        kept = [self.period.contains(F.col("ts"))] if self.period.bounded else []
        if self.levels:
            kept.append(F.lower(F.col("level")).isin(list(self.levels)))
        return reduce(and_, kept, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        """Filter rows. The searched text is pinned by a generator: as part of the predicate
        it would repeat the parsing of seven fields inside one filter."""
        rows = df.where(self.to_column())
        if not self.search:
            return rows
        texts = rows.select("*", F.explode(F.array(error_search_text())).alias("_text"))
        return texts.where(F.col("_text").contains(self.search.lower())).drop("_text")
