"""Line layouts: a format string becomes one regular expression plus its field order."""

from __future__ import annotations

import re
from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
# Groups, in order: address, time, method, path, protocol, status, bytes, referrer, agent.
DEFAULT_PATTERN = (
    r'^(?:\S+ )?(\S+) - \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+) "([^"]*)" "([^"]*)"'
)
DEFAULT_FIELDS = (
    "ip_address", "time", "method", "path", "http_version",
    "status", "response_size", "referrer", "user_agent",
)

# Variables whose text is kept: pattern and the fields of its groups.
CAPTURED = {
    "remote_addr": (r"(\S+)", ["ip_address"]),
    "time_local": (r"([^\]]+)", ["time"]),
    "time_iso8601": (r"(\S+)", ["time"]),
    "request": (r"(\S+) (\S+) (\S+)", ["method", "path", "http_version"]),
    "request_method": (r"(\S+)", ["method"]),
    "request_uri": (r"(\S+)", ["path"]),
    "uri": (r"(\S+)", ["path"]),
    "server_protocol": (r"(\S+)", ["http_version"]),
    "status": (r"(\d{3})", ["status"]),
    "body_bytes_sent": (r"(\d+)", ["response_size"]),
    "bytes_sent": (r"(\d+)", ["response_size"]),
    "http_referer": (r'([^"]*)', ["referrer"]),
    "http_user_agent": (r'([^"]*)', ["user_agent"]),
}

# Variables that are matched and dropped.
CONSUMED = {
    "remote_user": r"\S+",
    "host": r"\S+",
    "server_name": r"\S+",
    "server_port": r"\d+",
    "scheme": r"\S+",
    "upstream_addr": r"\S+",
    "upstream_cache_status": r"\S+",
    "upstream_status": r"\d+",
    "request_time": r"[\d.]+",
    "upstream_response_time": r"[\d.-]+",
    "upstream_connect_time": r"[\d.-]+",
    "upstream_header_time": r"[\d.-]+",
    "gzip_ratio": r"[\d.]+",
    "connection": r"\d+",
    "connection_requests": r"\d+",
    "pipe": r"\S+",
    "http_x_forwarded_for": r'[^"]*',
    "http_cookie": r'[^"]*',
    "msec": r"[\d.]+",
    "request_length": r"\d+",
    "ssl_protocol": r"\S+",
    "ssl_cipher": r"\S+",
}
ANY_VARIABLE = r"\S+"
# --- end of fixed values ----------------------------------------------------
VARIABLE = re.compile(r"\$(\w*)", re.ASCII)


@dataclass(frozen=True)
class Layout:
    """A pattern and the field each of its groups holds, in group order."""

    pattern: str
    fields: tuple[str, ...]

    def group_of(self, field: str) -> int | None:
        """Group number of a field; the last one when the layout names it twice."""
        for number in range(len(self.fields), 0, -1):
            if self.fields[number - 1] == field:
                return number
        return None


DEFAULT_LAYOUT = Layout(DEFAULT_PATTERN, DEFAULT_FIELDS)


def layout_of(log_format: str | None) -> Layout:
    """Layout for a format string; an empty format means the default layout."""
    if not log_format:
        return DEFAULT_LAYOUT
    pattern, fields, at = "^", [], 0
    for variable in VARIABLE.finditer(log_format):
        kept, names = CAPTURED.get(variable[1], (CONSUMED.get(variable[1], ANY_VARIABLE), []))
        pattern += re.escape(log_format[at : variable.start()]) + kept
        fields += names
        at = variable.end()
    return Layout(pattern + re.escape(log_format[at:]), tuple(fields))
