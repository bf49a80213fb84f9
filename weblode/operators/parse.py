"""Access-log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.functions import user_agent as ua
from weblode.operators.layout import Layout, layout_of

# --- fixed values -----------------------------------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
LOCAL_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"
SHORTEST_LOCAL_TIME = 20  # dd/Mon/yyyy:HH:MM:SS
ZONED_LOCAL_TIME = 26
# --- end of fixed values ----------------------------------------------------

_MARK = "\x01"


def not_blank(line: Column) -> Column:
    return line.rlike(r"\S")


def split_fields(line: Column, layout: Layout) -> Column:
    """``['', field 1, …, field n]`` of a matching line; a shorter array otherwise.

    The pattern runs once per line: the match is rewritten to its groups with a
    mark before each of them and then split. A line that already holds the mark
    takes the slower way of one extraction per group.
    """
    numbers = range(1, len(layout.fields) + 1)
    marked = "".join(f"{_MARK}${{g{number}}}" for number in numbers)
    rewritten = F.regexp_replace(line, _named_groups(layout.pattern) + r"[\s\S]*$", marked)
    one_by_one = F.when(
        line.rlike(layout.pattern),
        F.array(F.lit(""), *[F.regexp_extract(line, layout.pattern, number) for number in numbers]),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(line.contains(_MARK), one_by_one).otherwise(F.split(rewritten, _MARK))


def _named_groups(pattern: str) -> str:
    """Name the capturing groups g1, g2, … so that ``${g1}0`` cannot read as group 10."""
    out, number, index, in_class = [], 0, 0, False
    while index < len(pattern):
        char = pattern[index]
        if char == "\\":
            out.append(pattern[index : index + 2])
            index += 2
            continue
        if char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        if char == "(" and not in_class and pattern[index + 1] != "?":
            number += 1
            out.append(f"(?<g{number}>")
        else:
            out.append(char)
        index += 1
    return "".join(out)


def parse_time(text: Column, profile: str = "web") -> Column:
    """Instant of a log time: ``dd/Mon/yyyy:HH:MM:SS +zzzz`` or ISO 8601 with a zone.

    web takes a missing zone as UTC and wants the month capitalised; tui wants a
    zone and takes any capitalisation. Whatever does not parse is null.
    """
    if profile == "web":
        known_month = F.substring(text, 4, 3).isin(MONTHS)
        zoned = F.when(F.length(text) >= ZONED_LOCAL_TIME, F.substring(text, 1, ZONED_LOCAL_TIME)).otherwise(
            F.concat(F.substring(text, 1, SHORTEST_LOCAL_TIME), F.lit(" +0000"))
        )
        long_enough = F.length(text) >= SHORTEST_LOCAL_TIME
        local = F.when(known_month & long_enough, F.try_to_timestamp(zoned, F.lit(LOCAL_TIME_FORMAT)))
    else:
        local = F.try_to_timestamp(text, F.lit(LOCAL_TIME_FORMAT))
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"),
        text.try_cast("timestamp"),
    )
    return F.when(F.substring(text, 3, 1) == "/", local).otherwise(iso)


def _number(text: Column, kind: str, profile: str) -> Column:
    value = text.try_cast(kind)
    return F.nullif(value, F.lit(0).cast(kind)) if profile == "web" else value


def derive_time(df: DataFrame) -> DataFrame:
    """Add hour and weekday (0 = Sunday) in the session time zone."""
    return df.withColumns({"hour": F.hour("ts"), "day_of_week": F.dayofweek("ts") - 1})


def derive_labels(df: DataFrame, profile: str = "web") -> DataFrame:
    """Add the labels that follow from the user agent."""
    agent, lowered = F.col("user_agent"), F.col("_lowered")
    # A column of its own, so that the text is lowered once and not per test.
    labelled = df.withColumn("_lowered", F.lower(agent)).withColumns(
        {
            "client": ua.client(agent, profile),
            "os": ua.operating_system(agent, profile),
            "device": ua.device(agent, profile),
            "is_bot": ua.is_bot(agent, profile, lowered),
        }
    )
    return labelled.drop("_lowered")


def parse_access(
    lines: DataFrame,
    log_format: str | None = None,
    profile: str = "web",
    keep: tuple[str, ...] = (),
    line: str = "value",
) -> DataFrame:
    """Parse lines; lines that do not match are left out.

    ``keep`` names columns of ``lines`` to carry over. A field the layout lacks
    is ``''`` (text) or null (time and numbers). tui also drops rows without an
    address.
    """
    layout = layout_of(log_format)
    # The generator pins the split array, so that neither the filter below nor the nine
    # columns built from it evaluate the regular expression again.
    fields = lines.select(*keep, F.explode(F.array(split_fields(F.col(line), layout))).alias("_f"))
    matched = fields.where(F.size("_f") == len(layout.fields) + 1)
    if not layout.fields:
        matched = lines.where(F.col(line).rlike(layout.pattern)).select(*keep)

    def text(field: str) -> Column:
        group = layout.group_of(field)
        return F.lit("") if group is None else F.get(F.col("_f"), F.lit(group))

    rows = matched.select(
        *keep,
        text("ip_address").alias("ip_address"),
        parse_time(text("time"), profile).alias("ts"),
        text("method").alias("method"),
        text("path").alias("path"),
        text("http_version").alias("http_version"),
        _number(text("status"), "int", profile).alias("status"),
        _number(text("response_size"), "bigint", profile).alias("response_size"),
        text("referrer").alias("referrer"),
        text("user_agent").alias("user_agent"),
    )
    if profile == "tui":
        rows = rows.where(F.col("ip_address") != "")
    order = [
        "ip_address", "ts", "hour", "day_of_week", "method", "path", "http_version", "status",
        "response_size", "referrer", "user_agent", "client", "os", "device", "is_bot",
    ]
    return derive_labels(derive_time(rows), profile).select(*keep, *order)


def malformed_lines(lines: DataFrame, log_format: str | None = None, line: str = "value") -> DataFrame:
    """The lines the parser leaves out, blank lines aside."""
    text = F.col(line)
    return lines.where(not_blank(text) & ~text.rlike(layout_of(log_format).pattern))
