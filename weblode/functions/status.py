"""Status classes, rates and usage bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SUCCESS_RANGE = {"web": (200, 399), "tui": (100, 399)}
TUI_RATE_FLOORS = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]
TUI_CPU_CEILINGS = [30, 40, 50, 60, 70, 80]
WEB_USAGE_LIMITS = {"cpu": (50, 80), "memory": (60, 90), "storage": (50, 80)}
SEVERITY_BANDS = {
    "error": ["error", "crit", "critical"],
    "warn": ["alert", "warn", "warning"],
    "info": ["notice", "info", "debug"],
}
# --- end of fixed values ----------------------------------------------------


def in_status_range(status: Column, low: int, high: int) -> Column:
    return status.between(low, high)


def is_success(status: Column) -> Column:
    return in_status_range(status, 200, 299)


def is_redirect(status: Column) -> Column:
    return in_status_range(status, 300, 399)


def is_client_error(status: Column) -> Column:
    return in_status_range(status, 400, 499)


def is_server_error(status: Column) -> Column:
    return in_status_range(status, 500, 599)


def is_error(status: Column) -> Column:
    return is_client_error(status) | is_server_error(status)


def status_class(status: Column) -> Column:
    return (
        F.when(F.coalesce(status, F.lit(0)) == 0, "none")
        .when(status < 300, "2xx")
        .when(status < 400, "3xx")
        .when(status < 500, "4xx")
        .otherwise("5xx")
    )


def succeeded(status: Column, success_range: tuple[int, int]) -> Column:
    """Success in the sense of the success-rate figures."""
    return in_status_range(status, *success_range)


def rate_level(rate: Column) -> Column:
    """1 to 10; null stays null and a rate of zero is level 1."""
    return F.when(rate == 0, 1).otherwise(F.ceil(rate * 10)).cast("int")


def rate_band(rate: Column, profile: str = "web") -> Column:
    if profile == "web":
        return (
            F.when(rate.isNull(), "none").when(rate > 0.7, "good").when(rate < 0.25, "bad").otherwise("fair")
        )
    case = F.when(rate.isNull() | (rate == -1), "none")
    for floor in TUI_RATE_FLOORS:
        case = case.when(rate >= floor, f">={floor}")
    return case.otherwise(f"<{TUI_RATE_FLOORS[-1]}")


def usage_band(usage: Column, kind: str = "cpu", profile: str = "web") -> Column:
    if profile == "tui" and kind == "cpu":
        case = F.when(usage <= TUI_CPU_CEILINGS[0], f"<={TUI_CPU_CEILINGS[0]}")
        for ceiling in TUI_CPU_CEILINGS[1:]:
            case = case.when(usage <= ceiling, f"<={ceiling}")
        return case.otherwise(f">{TUI_CPU_CEILINGS[-1]}")
    low, high = WEB_USAGE_LIMITS[kind]
    return F.when(usage < low, "low").when(usage < high, "medium").otherwise("high")


def severity_band(level: Column) -> Column:
    lowered = F.lower(level)
    case = None
    for band, levels in SEVERITY_BANDS.items():
        hit = lowered.isin(levels)
        case = F.when(hit, band) if case is None else case.when(hit, band)
    return case.otherwise("other")
