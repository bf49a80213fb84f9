"""Error-log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TIME_PATTERN = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"
LEVEL_NAMES = "(?:debug|info|notice|warn|error|crit|alert|emerg)"
LEVEL_PATTERN = rf"\[({LEVEL_NAMES})\]"
PROCESS_PATTERN = r"(\d+)#(\d+)"
CONNECTION_PATTERN = r"\*(\d+)"
CLIENT_PATTERN = r"client: ([^,\s]+)"
SERVER_PATTERN = r"server: (\S+)"
REQUEST_PATTERN = r'request: "([^"]+)"'
REFERRER_PATTERN = r'referrer: "([^"]+)"'
HOST_PATTERN = r'host: "([^"]+)"'
UNKNOWN_LEVEL = "unknown"
WHITESPACE = " \t\n\r\f\v"
# --- end of fixed values ----------------------------------------------------


def _optional(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def _message(line: Column) -> Column:
    """What follows the line's prefix: a connection number anywhere, else a bracketed level and the process pair."""
    connection = F.regexp_extract(line, r"(?s)^.*?\*\d+(.*)$", 1)
    process = F.regexp_extract(line, r"(?s)^(?=.*\[" + LEVEL_NAMES + r"\]).*?\d+#\d+.(.+)$", 1)
    return F.when(F.col("cid") != "0", connection).when(process != "", process).otherwise(line)


def parse_errors(
    lines: DataFrame, profile: str = "web", keep: tuple[str, ...] = (), line: str = "value"
) -> DataFrame:
    """Parse error lines; blank lines are left out, everything else gives a row.

    web reads the level in any case, tui in lower case only. Times are in the
    session time zone and null when missing.
    """
    text = F.btrim(F.col(line), F.lit(WHITESPACE))
    level_pattern = ("(?i)" if profile == "web" else "") + LEVEL_PATTERN
    rows = (
        lines.where(F.col(line).rlike(r"\S"))
        .select(*keep, text.alias("_line"))
        .withColumns(
            {
                "ts": F.try_to_timestamp(
                    _optional(F.col("_line"), TIME_PATTERN), F.lit(TIME_FORMAT)
                ),
                "level": F.coalesce(
                    F.lower(_optional(F.col("_line"), level_pattern)), F.lit(UNKNOWN_LEVEL)
                ),
                "pid": F.coalesce(
                    F.regexp_extract("_line", PROCESS_PATTERN, 1).try_cast("int"), F.lit(0)
                ),
                "tid": F.coalesce(
                    F.nullif(F.regexp_extract("_line", PROCESS_PATTERN, 2), F.lit("")), F.lit("0")
                ),
                "cid": F.coalesce(_optional(F.col("_line"), CONNECTION_PATTERN), F.lit("0")),
            }
        )
    )
    raw = F.col("_line")
    return rows.select(
        *keep,
        "ts",
        "level",
        "pid",
        "tid",
        "cid",
        F.btrim(_message(raw), F.lit(WHITESPACE)).alias("message"),
        _optional(raw, CLIENT_PATTERN).alias("client_address"),
        _optional(raw, SERVER_PATTERN).alias("server_address"),
        _optional(raw, REQUEST_PATTERN).alias("request"),
        _optional(raw, REFERRER_PATTERN).alias("referrer"),
        _optional(raw, HOST_PATTERN).alias("host"),
    )
