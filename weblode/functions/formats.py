"""Display text for byte counts, row counts and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
BYTE_UNITS = ["Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
SHORT_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
UPTIME_UNITS = [("y", 31536000), ("d", 86400), ("h", 3600), ("m", 60), ("s", 1)]
# --- end of fixed values ----------------------------------------------------


def _by_unit(amount: Column, values: list) -> Column:
    """The value for the largest power of 1024 that is not above the amount."""
    case = F.lit(values[0])
    for power in range(1, len(values)):
        case = F.when(amount >= float(1024**power), F.lit(values[power])).otherwise(case)
    return case


def _divisor(amount: Column, units: list[str]) -> Column:
    return _by_unit(amount, [float(1024**power) for power in range(len(units))])


def format_bytes_rounded(amount: Column) -> Column:
    """Whole units, halves up: ``2 KB``."""
    whole = F.floor(amount / _divisor(amount, BYTE_UNITS) + 0.5)
    return F.concat(whole.cast("string"), F.lit(" "), _by_unit(amount, BYTE_UNITS))


def format_bytes(amount: Column, decimals: int = 2) -> Column:
    """Up to ``decimals`` digits without trailing zeros; one byte is ``1 Byte``."""
    digits = max(decimals, 0)
    text = F.format_string(f"%.{digits}f", F.round(amount / _divisor(amount, BYTE_UNITS), digits))
    if digits:
        text = F.regexp_replace(text, r"\.?0+$", "")
    unit = F.when(amount == 1, "Byte").otherwise(_by_unit(amount, BYTE_UNITS))
    return F.when(amount == 0, "0 Bytes").otherwise(F.concat(text, F.lit(" "), unit))


def _one_decimal(n: Column, unit: Column) -> Column:
    """``n / unit`` with one decimal, rounded as the double nearest to it: ties to even.

    The quotient in tenths is a whole-number division. On a tie the double decides:
    it lies above, below or on the tie (2q+1)/20, and both subtractions that find out
    are exact because their operands are within a factor of two.
    """
    tenfold = n.cast("bigint") * 10
    tenths = F.call_function("div", tenfold, unit)
    rest = (tenfold % unit) * 2
    quotient = n / unit
    above = ((tenths * 2 + 1).cast("double") - quotient * 16) - quotient * 4
    up_on_tie = (above < 0) | ((above == 0) & (tenths % 2 == 1))
    rounded = tenths + F.when((rest > unit) | ((rest == unit) & up_on_tie), 1).otherwise(0)
    whole = F.call_function("div", rounded, F.lit(10).cast("bigint"))
    return F.concat(whole.cast("string"), F.lit("."), (rounded % 10).cast("string"))


def format_bytes_short(amount: Column) -> Column:
    """``512 B``, ``1.5 KB``."""
    divisor = _divisor(amount, SHORT_UNITS).cast("bigint")
    scaled = F.concat(_one_decimal(amount, divisor), F.lit(" "), _by_unit(amount, SHORT_UNITS))
    return F.when(amount < 1024, F.concat(amount.cast("string"), F.lit(" B"))).otherwise(scaled)


def format_count(n: Column) -> Column:
    """``950``, ``1.2K``, ``3.4M``."""
    large = n >= 1_000_000
    unit = F.when(large, 1_000_000).otherwise(1_000).cast("bigint")
    letter = F.when(large, "M").otherwise("K")
    return F.when(n < 1_000, n.cast("string")).otherwise(F.concat(_one_decimal(n, unit), letter))


def format_uptime(seconds: Column) -> Column:
    """``1d 2h 5s``: units with a zero amount are left out."""
    parts, rest = [], seconds
    for unit, size in UPTIME_UNITS:
        amount = F.floor(rest / size)
        parts.append(F.when(amount > 0, F.concat(amount.cast("string"), F.lit(unit))))
        rest = F.pmod(rest, F.lit(size))
    text = F.concat_ws(" ", *parts)
    return F.when(text == "", "0s").otherwise(text)
