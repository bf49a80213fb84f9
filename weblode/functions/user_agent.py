"""Client, operating system, device and bot labels from a user agent.

Each classifier is one CASE expression over substring tests, so it stays in
generated code. Labels depend on the user agent alone: counts by label should
aggregate by user agent first (see ``operators.counts.agent_counts``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# (label, substrings); a label applies when any of its substrings occurs.
# The order is the order of precedence.

WEB_CLIENTS = [
    ("Curl", ["curl/"]),
    ("Postman", ["PostmanRuntime/"]),
    ("Insomnia", ["insomnia/"]),
    ("Python requests", ["python-requests/"]),
    ("Nodejs fetch", ["node-fetch/"]),
    ("Seamonkey", ["Seamonkey/"]),
    ("Firefox", ["Firefox/"]),
    ("Chrome", ["Chrome/"]),
    ("Chromium", ["Chromium/"]),
    ("aiohttp", ["aiohttp/"]),
    ("Python", ["Python/"]),
    ("Go http", ["Go-http-client/", "go-http-client/"]),
    ("Java", ["Java/"]),
    ("axios", ["axios/"]),
    ("Dart", ["Dart/"]),
    ("OkHttp", ["OkHttp/"]),
    ("Uptime Kuma", ["Uptime-Kuma/"]),
    ("undici", ["undici/"]),
    ("Lush", ["Lush/"]),
    ("Zabbix", ["Zabbix"]),
    ("Guzzle", ["GuzzleHttp/"]),
    ("Uptime", ["Better Uptime"]),
    ("GitHub Camo", ["github-camo"]),
    ("Ruby", ["Ruby"]),
    ("Node.js", ["node"]),
    ("Next.js", ["Next.js"]),
    ("Vercel Edge Functions", ["Vercel Edge Functions"]),
    ("OpenAI Image Downloader", ["OpenAI Image Downloader"]),
    ("OpenAI", ["OpenAI"]),
    ("Tsunami Security Scanner", ["TsunamiSecurityScanner"]),
    ("iOS", ["iOS/"]),
    ("Safari", ["Safari/"]),
    ("Edge", ["Edg/"]),
    ("Opera", ["OPR/", "Opera/"]),
    ("Internet Explorer", ["; MSIE ", "Trident/"]),
]

# In "Windows NT" entries "." stands for any one character.
WEB_SYSTEMS = [
    ("Windows 3.11", ["Win16"]),
    ("Windows 95", ["Windows 95", "Win95", "Windows_95"]),
    ("Windows 98", ["Windows 98", "Win98"]),
    ("Windows 2000", ["Windows NT 5.0", "Windows 2000"]),
    ("Windows XP", ["Windows NT 5.1", "Windows XP"]),
    ("Windows Server 2003", ["Windows NT 5.2"]),
    ("Windows Vista", ["Windows NT 6.0"]),
    ("Windows 7", ["Windows NT 6.1"]),
    ("Windows 8", ["Windows NT 6.2"]),
    ("Windows 10/11", ["Windows NT 10.0"]),
    ("Windows NT 4.0", ["WinNT", "Windows NT"]),
    ("Windows ME", ["Windows ME"]),
    ("OpenBSD", ["OpenBSD"]),
    ("SunOS", ["SunOS"]),
    ("Android", ["Android"]),
    ("Linux", ["Linux", "X11"]),
    ("MacOS", ["Mac_PowerPC", "Macintosh"]),
    ("QNX", ["QNX"]),
    ("iOS", ["iPhone OS"]),
    ("BeOS", ["BeOS"]),
    ("OS/2", ["OS/2"]),
    (
        "Search Bot",
        [
            "APIs-Google",
            "AdsBot",
            "nuhk",
            "Googlebot",
            "Storebot",
            "Google-Site-Verification",
            "Mediapartners",
            "Yammybot",
            "Openbot",
            "Slurp",
            "MSNBot",
            "Ask Jeeves/Teoma",
            "ia_archiver",
        ],
    ),
]

WEB_DEVICES = [
    ("iPhone", ["iPhone"]),
    ("Android", ["Android"]),
    ("Samsung", ["Tizen/"]),
    ("Mac", ["Macintosh"]),
    ("Windows", ["Windows"]),
]

TUI_BROWSERS = [
    ("Seamonkey", ["Seamonkey/"]),
    ("Firefox", ["Firefox/"]),
    ("Edge", ["Edg/"]),
    ("Opera", ["OPR/", "Opera/"]),
    ("Chromium", ["Chromium/"]),
    ("Chrome", ["Chrome/"]),
    ("Internet Explorer", ["; MSIE ", "Trident/"]),
    ("iOS", ["iOS/"]),
    ("Safari", ["Safari/"]),
]

TUI_TOOLS = [
    ("Curl", ["curl/"]),
    ("Postman", ["PostmanRuntime/"]),
    ("Insomnia", ["insomnia/"]),
    ("Python requests", ["python-requests/"]),
    ("Nodejs fetch", ["node-fetch/"]),
    ("aiohttp", ["aiohttp/"]),
    ("Python", ["Python/"]),
    ("Go http", ["Go-http-client/", "go-http-client/"]),
    ("Java", ["Java/"]),
    ("axios", ["axios/"]),
    ("Dart", ["Dart/"]),
    ("OkHttp", ["okhttp/", "OkHttp/"]),
    ("Uptime Kuma", ["Uptime-Kuma/"]),
    ("undici", ["undici/"]),
    ("Lush", ["Lush/"]),
    ("Zabbix", ["Zabbix"]),
    ("Guzzle", ["GuzzleHttp/"]),
    ("Uptime", ["Better Uptime"]),
    ("GitHub Camo", ["github-camo"]),
    ("Ruby", ["Ruby"]),
    ("Next.js", ["Next.js"]),
    ("Vercel Edge Functions", ["Vercel Edge Functions"]),
    ("OpenAI Image Downloader", ["OpenAI Image Downloader"]),
    ("OpenAI", ["OpenAI"]),
    ("Tsunami Security Scanner", ["TsunamiSecurityScanner"]),
    ("Node.js", ["node"]),
]

# Version text after "Windows NT ", by prefix.
TUI_WINDOWS_NT = [
    ("Windows 10/11", "10.0"),
    ("Windows 8.1", "6.3"),
    ("Windows 8", "6.2"),
    ("Windows 7", "6.1"),
    ("Windows Vista", "6.0"),
    ("Windows Server 2003", "5.2"),
    ("Windows XP", "5.1"),
    ("Windows 2000", "5.0"),
    ("Windows NT 4.0", "4.0"),
]

TUI_SYSTEMS = [
    ("Windows 3.11", ["Win16"]),
    ("Windows 95", ["Windows 95", "Win95"]),
    ("Windows 98", ["Windows 98", "Win98"]),
    ("Windows ME", ["Windows ME"]),
    ("iOS", ["iPhone OS", "iPad"]),
    ("Android", ["Android"]),
    ("ChromeOS", ["CrOS"]),
    ("macOS", ["Macintosh", "Mac_PowerPC"]),
    ("OpenBSD", ["OpenBSD"]),
    ("SunOS", ["SunOS"]),
    ("QNX", ["QNX"]),
    ("BeOS", ["BeOS"]),
    ("OS/2", ["OS/2"]),
    ("Linux", ["Linux", "X11"]),
]

TUI_DEVICES = [
    ("Samsung", ["Tizen/"]),
    ("Mac", ["Macintosh", "Mac_PowerPC"]),
    ("Windows PC", ["Windows NT"]),
    ("Chromebook", ["CrOS"]),
    ("Linux", ["Linux", "X11"]),
]

TUI_BOT_MARKS = [
    "bot", "Bot", "spider", "Spider", "crawl", "Crawl",
    "Slurp", "APIs-Google", "AdsBot", "Mediapartners", "ia_archiver",
]

# Matched without regard to case.
WEB_BOT_MARKS = [
    "bot", "crawler", "spider", "scraper", "crawl",
    "Googlebot", "Bingbot", "Slurp", "DuckDuckBot", "Baiduspider", "YandexBot", "Sogou", "Exabot",
    "facebookexternalhit", "Twitterbot", "LinkedInBot", "WhatsApp", "TelegramBot", "ia_archiver",
    "AhrefsBot", "SemrushBot", "MJ12bot", "DotBot", "APIs-Google", "AdsBot", "nuhk", "Storebot",
    "Google-Site-Verification", "Mediapartners", "Yammybot", "Openbot", "MSNBot", "Ask Jeeves",
]
# --- end of fixed values ----------------------------------------------------


def _any_of(ua: Column, marks: list[str]) -> Column:
    def test(mark: str) -> Column:
        if mark.startswith("Windows NT ") and "." in mark:
            return ua.contains(mark.split(".")[0]) & ua.rlike(mark)
        return ua.contains(mark)

    return reduce(or_, (test(m) for m in marks))


def _first_label(ua: Column, rules: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """Label of the first rule that applies, as one CASE expression."""
    (label, marks), *rest = rules
    case = F.when(_any_of(ua, marks), F.lit(label))
    for label, marks in rest:
        case = case.when(_any_of(ua, marks), F.lit(label))
    return case.otherwise(otherwise)


def _with_guard(ua: Column, rules: list[tuple[str, list[str]]], guard: str, otherwise: Column) -> Column:
    """As ``_first_label``, but the leading rules, all of whose marks hold ``guard``, are tried
    only when the guard occurs: one test instead of two dozen for most agents."""
    count = 0
    while count < len(rules) and all(guard in mark for mark in rules[count][1]):
        count += 1
    guarded = F.when(ua.contains(guard), _first_label(ua, rules[:count], F.lit(None)))
    return F.coalesce(guarded, _first_label(ua, rules[count:], otherwise))


def client(ua: Column, profile: str = "web") -> Column:
    if profile == "web":
        return F.when(ua.isNull(), "Unknown").otherwise(_first_label(ua, WEB_CLIENTS, F.lit("Other")))
    tool = _first_label(ua, TUI_TOOLS, F.lit("Other"))
    return (
        F.when(F.coalesce(ua, F.lit("")) == "", "Unknown")
        .when(ua.startswith("Mozilla/"), _first_label(ua, TUI_BROWSERS, tool))
        .otherwise(tool)
    )


def operating_system(ua: Column, profile: str = "web") -> Column:
    if profile == "web":
        return F.when(ua.isNull(), "Unknown").otherwise(_with_guard(ua, WEB_SYSTEMS, "Win", F.lit("Other")))
    mark = "Windows NT "
    nt_version = F.substr(ua, F.instr(ua, mark) + len(mark), F.lit(4))
    nt = F.lit("Windows")
    for label, prefix in reversed(TUI_WINDOWS_NT):
        nt = F.when(nt_version.startswith(prefix), label).otherwise(nt)
    bot_or_other = F.when(is_bot(ua, "tui"), "Bot").otherwise("Other")
    return (
        F.when(F.coalesce(ua, F.lit("")) == "", "Unknown")
        .when(ua.contains(mark), nt)
        .otherwise(_with_guard(ua, TUI_SYSTEMS, "Win", bot_or_other))
    )


def device(ua: Column, profile: str = "web") -> Column:
    if profile == "web":
        return F.when(ua.isNull(), "Unknown").otherwise(_first_label(ua, WEB_DEVICES, F.lit("Other")))
    bot_or_other = F.when(is_bot(ua, "tui"), "Bot").otherwise("Other")
    android = F.when(ua.contains("Mobile"), "Android Phone").otherwise("Android Tablet")
    return (
        F.when(F.coalesce(ua, F.lit("")) == "", "Unknown")
        .when(ua.contains("iPhone"), "iPhone")
        .when(ua.contains("iPad"), "iPad")
        .when(ua.contains("Android"), android)
        .otherwise(_first_label(ua, TUI_DEVICES, bot_or_other))
    )


def is_bot(ua: Column, profile: str = "web", lowered: Column | None = None) -> Column:
    """Whether an agent looks like a bot; ``lowered`` is its lower-case text if there is a column for it."""
    if profile == "web":
        # Substring tests on the lowered text are several times faster than one
        # case-insensitive alternation; a mark that holds another one is redundant.
        marks = [mark.lower() for mark in WEB_BOT_MARKS]
        needed = [mark for mark in marks if not any(other != mark and other in mark for other in marks)]
        hit = _any_of(F.lower(ua) if lowered is None else lowered, needed)
    else:
        hit = _any_of(ua, TUI_BOT_MARKS)
    return F.coalesce(hit, F.lit(False))
