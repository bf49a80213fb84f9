import pytest
from helpers import labels_of
from pyspark.sql import functions as F

from weblode.functions import formats, status, text, user_agent, versions
from weblode.operators import geo

# Agents composed for these tests: each holds the mark of one rule, in surroundings of our own.
WIN = "Mozilla/5.0 (Windows NT 10.0; ARM64) AppleWebKit/601 (KHTML, like Gecko) Chrome/88.1 Safari/601"
CLIENTS = {
    WIN: ("Chrome", "Chrome"),
    WIN + " Edg/88.2": ("Edge", "Chrome"),
    WIN + " OPR/74.3": ("Opera", "Chrome"),
    "Mozilla/5.0 (X11; OpenBSD; rv:60.4) Gecko/20180101 Firefox/60.4": ("Firefox", "Firefox"),
    "Mozilla/5.0 (Macintosh; PPC) Version/11.0 Safari/604": ("Safari", "Safari"),
    "Mozilla/5.0 (compatible; Windows NT 6.1; Trident/7.0; rv:11.0)": ("Internet Explorer",) * 2,
    "Mozilla/5.0 (X11; Linux i686) Chromium/70.5 Safari/537": ("Chromium", "Chromium"),
    "Mozilla/5.0 (X11; Linux i686) Gecko/20200202 Firefox/60.2 Seamonkey/2.49": ("Seamonkey",) * 2,
    "curl/7.61": ("Curl", "Curl"),
    "Python/3.8 aiohttp/3.6": ("aiohttp", "aiohttp"),
    "okhttp/3.9": ("OkHttp", "Other"),
    "Go-http-client/2.0": ("Go http", "Go http"),
    "the Better Uptime prober": ("Uptime", "Uptime"),
    "edge Next.js worker": ("Next.js", "Next.js"),
    "OpenAI Image Downloader": ("OpenAI Image Downloader",) * 2,
    "node/v20.2": ("Node.js", "Node.js"),
    "qwop 7 (nobody)": ("Other", "Other"),
    "Mozilla/4.9": ("Other", "Other"),
    "": ("Unknown", "Other"),
}
SYSTEMS = {
    WIN: ("Windows 10/11", "Windows 10/11"),
    "Tool (Windows NT 6.3; ARM)": ("Windows 8.1", "Windows NT 4.0"),
    "Tool (Windows NT 6.1; ARM)": ("Windows 7", "Windows 7"),
    "Tool (Windows NT 5.1; SV1)": ("Windows XP", "Windows XP"),
    "Tool (Windows 95; en)": ("Windows 95", "Windows 95"),
    "Tool (Windows NT 9.9; en)": ("Windows", "Windows NT 4.0"),
    "App (iPhone; CPU iPhone OS 12_1 like Mac OS X)": ("iOS", "iOS"),
    "App (iPad; CPU OS 12_1 like Mac OS X)": ("iOS", "Other"),
    "App (Linux; Android 9; Lamp 3)": ("Android", "Android"),
    "App (X11; CrOS armv7l)": ("ChromeOS", "Linux"),
    "App (Macintosh; PPC)": ("macOS", "MacOS"),
    "Tool (compatible; Googlebot/3)": ("Bot", "Search Bot"),
    "nothing known": ("Other", "Other"),
}
DEVICES = {
    WIN: ("Windows PC", "Windows"),
    "App (iPad; CPU OS 12_1 like Mac OS X)": ("iPad", "Other"),
    "App (Linux; Android 9; Lamp 3) Mobile": ("Android Phone", "Android"),
    "App (Linux; Android 9; Slate)": ("Android Tablet", "Android"),
    "App (Linux; Tizen/5.5)": ("Samsung", "Samsung"),
    "App (X11; CrOS armv7l)": ("Chromebook", "Other"),
    "App (X11; Linux i686)": ("Linux", "Other"),
    "Googlebot/3": ("Bot", "Other"),
}


@pytest.mark.parametrize(
    ("function", "table"),
    [(user_agent.client, CLIENTS), (user_agent.operating_system, SYSTEMS), (user_agent.device, DEVICES)],
)
def test_agent_labels(spark, function, table):
    agents = list(table)
    for index, profile in enumerate(("tui", "web")):
        assert labels_of(spark, lambda c: function(c, profile), agents) == [table[a][index] for a in agents]


def test_bots(spark):
    agents = ["YandexBOT", "some-spider", WIN, "", None, "ia_archiver", "WhatsApp/9"]
    assert labels_of(spark, user_agent.is_bot, agents) == [True, True, False, False, False, True, True]
    tui = labels_of(spark, lambda c: user_agent.is_bot(c, "tui"), agents)
    assert tui == [False, True, False, False, False, True, False]


TUI_VERSIONS = {
    "/api/v4/lamps": "v4", "/v8/chairs": "v8", "/api/v4.7/lamps": "v4.7", "/v2.71/desks": "v2.71", "/lamps": "",
    "": "", "/api/v4": "v4", "/api/v4/v9/lamps": "v4", "/api/v9/lamps?on=yes": "v9", "/v": "", "/api/v": "",
    "/api/vx/lamps": "", "/api/v4.5.6/lamps": "v4.5.6", "/api/v4/": "v4", "api/v4/lamps": "v4",
}
FAST = {
    "/api/v4/lamps": "v4", "/v4/lamps": "v4", "/version/4/lamps": "v4", "/api/v4.6/lamps": "v4.6", "/lamps": "", "": "",
}
CANDIDATES = {
    "/v5.3/desks": "v5.3", "/api/v8/lamps": "v8", "/api/v8.2/desks": "v8.2", "/v12/chairs": "v12",
    "/version/9/lamps": "v9", "/version/9.4/lamps": "v9.4", "/api/6.1/x": "v6.1", "/lamps": "", "": "",
}
URLS = {
    "https://shop.test/api/v4/lamps": "v4", "http://shop.test/v8/desks": "v8", "/api/v9/chairs": "v9",
    "https://shop.test:8443/api/v4/lamps": "v4", "https://shop.test/api/v8/lamps?on=yes": "v8",
    "https://shop.test/lamps": "", "https://shop.test": "",
}


@pytest.mark.parametrize(
    ("function", "table"),
    [
        (lambda c: versions.api_version(c, "tui"), TUI_VERSIONS),
        (versions.api_version_fast, FAST),
        (versions.api_version_candidates, CANDIDATES),
        (versions.version_from_url, URLS),
        (versions.api_version, {"/api/v12/x": "v12", "/v1.1/x": None, "/v1": None, "": None}),
    ],
)
def test_versions(spark, function, table):
    assert labels_of(spark, function, list(table)) == list(table.values())


def test_status_boundaries(spark):
    codes = ["199", "200", "299", "300", "399", "400", "499", "500", "599", "600", None]
    assert labels_of(spark, lambda c: status.status_class(c.cast("int")), codes) == [
        "2xx", "2xx", "2xx", "3xx", "3xx", "4xx", "4xx", "5xx", "5xx", "5xx", "none",
    ]
    errors = labels_of(spark, lambda c: status.is_error(c.cast("int")), codes)
    assert errors == [False] * 5 + [True] * 4 + [False, None]


def test_rate_level_and_bands(spark):
    rates = ["0", "0.05", "0.1", "0.71", "1", None]
    assert labels_of(spark, lambda c: status.rate_level(c.cast("double")), rates) == [1, 1, 1, 8, 10, None]
    assert labels_of(spark, lambda c: status.rate_band(c.cast("double")), rates) == [
        "bad", "bad", "bad", "good", "good", "none",
    ]
    bands = labels_of(spark, lambda c: status.rate_band(c.cast("double"), "tui"), ["-1", "0.9", "0.45", "0.1"])
    assert bands == ["none", ">=0.9", ">=0.4", "<0.4"]
    assert labels_of(spark, status.severity_band, ["ERROR", "critical", "alert", "debug", "emerg"]) == [
        "error", "error", "warn", "info", "other",
    ]


def test_formats(spark):
    number = lambda f: lambda c: f(c.cast("bigint"))
    assert labels_of(spark, number(formats.format_bytes), ["0", "1", "1024", "1536", "1048576", "500"]) == [
        "0 Bytes", "1 Byte", "1 KB", "1.5 KB", "1 MB", "500 Bytes",
    ]
    assert labels_of(spark, number(lambda c: formats.format_bytes(c, 0)), ["1536", "100"]) == ["2 KB", "100 Bytes"]
    assert labels_of(spark, number(formats.format_bytes_rounded), ["1", "1536", "1048576"]) == ["1 Bytes", "2 KB", "1 MB"]
    assert labels_of(spark, number(formats.format_bytes_short), ["1023", "1024", "1280", "1536", "1792"]) == [
        "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.8 KB",
    ]
    counts = ["950", "1000", "1250", "1350", "1450", "1650", "1850", "999999", "3400000"]
    assert labels_of(spark, number(formats.format_count), counts) == [
        f"{int(n) / 1000:.1f}K" if 1000 <= int(n) < 10**6 else n if int(n) < 1000 else f"{int(n) / 10**6:.1f}M"
        for n in counts
    ]
    assert labels_of(spark, number(formats.format_uptime), ["0", "59", "3600", "90061", "31536001"]) == [
        "0s", "59s", "1h", "1d 1h 1m 1s", "1y 1s",
    ]


def test_text_helpers(spark):
    assert labels_of(spark, text.strip_query, ["/a?b?c", "/a", ""]) == ["/a", "/a", ""]
    assert labels_of(spark, text.csv_safe, ["=1", "+1", "-", "@x", "a=b", ""]) == ["'=1", "'+1", "'-", "'@x", "a=b", ""]
    assert labels_of(spark, text.country_code, ["gb", "usa", "x", ""]) == ["GB", "US", "UN", "UN"]
    assert labels_of(spark, text.flag, ["gb", ""]) == ["🇬🇧", ""]
    assert labels_of(spark, lambda c: text.flag(c, "tui"), ["gb", "g1", "gbr"]) == ["🇬🇧", None, None]
    assert labels_of(spark, lambda c: text.user_id(c, F.lit("ua")), ["1.2.3.4"]) == ["1.2.3.4::ua"]


def test_addresses(spark):
    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::1:2"]
    bad = ["256.1.1.1", "1.2.3", "01.2.3.4", "", "abc", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::1"]
    assert labels_of(spark, geo.is_address, good + bad) == [True] * len(good) + [False] * len(bad)
    rows = geo.with_address_key(spark.createDataFrame([(a,) for a in good + bad], "a string").coalesce(1), "a").collect()
    keys = {row.a: tuple(row.key) if row.key else None for row in rows}
    assert keys["1.2.3.4"] == keys["::ffff:1.2.3.4"] == (4, 0, 0x01020304)
    assert keys["::1"] == (6, 0, 1)
    assert keys["1:2:3:4:5:6:7:8"] == (6, 0x0001000200030004, 0x0005000600070008)
    assert keys["2001:db8::1"] == (6, 0x20010DB800000000, 1)
    assert keys["fe80::1:2"][1] == 0xFE80000000000000 - 2**64
    assert all(keys[a] is None for a in bad)
