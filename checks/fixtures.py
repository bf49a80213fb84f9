"""Log-shaped data derived from the given tables.

The SQL texts use functions that Spark and DuckDB share, so the checks can build
the same rows in both. ``{time}`` is the one place where the two differ.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.operators.error_parse import parse_errors
from weblode.operators.geo import distinct_addresses, networks_from_ranges, resolve
from weblode.operators.parse import derive_labels, derive_time
from weblode.session import shared_dir

AS_OF = dt.datetime(2024, 1, 31)

ACCESS_ROWS = """
SELECT e.event_id AS event_id,
  CAST(date_trunc('second', e.ts) AS TIMESTAMP) AS ts,
  concat('10.0.', CAST(e.user_id % 32 AS STRING), '.', CAST(e.user_id % 251 AS STRING)) AS ip_address,
  CASE WHEN e.event_type IN ('signup','purchase') THEN 'POST' ELSE 'GET' END AS method,
  CASE e.event_id % 9
    WHEN 0 THEN '/' WHEN 1 THEN '/pricing' WHEN 2 THEN '/api/v1/users'
    WHEN 3 THEN '/api/v2/orders' WHEN 4 THEN '/docs'
    WHEN 5 THEN concat('/search?q=', e.event_type) WHEN 6 THEN '/api/v1.1/items'
    WHEN 7 THEN '/version/3/feed' ELSE '/static/css/app.css' END AS path,
  CASE e.event_id % 3 WHEN 0 THEN 'HTTP/2.0' ELSE 'HTTP/1.1' END AS http_version,
  CASE e.event_type
    WHEN 'error' THEN CASE e.event_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 403 ELSE 503 END
    WHEN 'signup' THEN 201
    WHEN 'click' THEN CASE WHEN e.event_id % 5 = 0 THEN 301 ELSE 200 END
    ELSE CASE WHEN e.event_id % 211 = 0 THEN 101 ELSE 200 END END AS status,
  CASE WHEN e.event_id % 50 = 0 THEN 0 ELSE CAST(floor(e.value * 100) AS BIGINT) END AS response_size,
  CASE WHEN e.event_id % 4 = 0 THEN '-' ELSE p.url END AS referrer,
  CASE e.user_id % 10
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 14_2) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Safari/605.1.15'
    WHEN 2 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:122.0) Gecko/20100101 Firefox/122.0'
    WHEN 3 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0'
    WHEN 4 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1'
    WHEN 5 THEN 'Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Mobile Safari/537.36'
    WHEN 6 THEN 'curl/7.68.0' WHEN 7 THEN 'python-requests/2.28'
    WHEN 8 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
    ELSE '' END AS user_agent,
  e.event_id % 97 = 0 AS is_malformed
FROM (SELECT *, (SELECT count(*) FROM pages) AS all_pages FROM events) e
LEFT JOIN pages p ON p.page_id = e.event_id % e.all_pages
"""  # noqa: E501

ACCESS_LINE = """
CASE WHEN is_malformed THEN concat('malformed ', CAST(event_id AS STRING)) ELSE
concat(ip_address, ' - - [', {time}, ' +0000] "', method, ' ', path, ' ', http_version, '" ',
  CAST(status AS STRING), ' ', CAST(response_size AS STRING), ' "', referrer, '" "', user_agent, '"') END
"""

# The documented layout with ISO times, request timing and labelled fields.
TIMED_FORMAT = (
    '$remote_addr - $remote_user [$time_iso8601] "$request" $status $body_bytes_sent '
    'rt=$request_time ref="$http_referer" ua="$http_user_agent"'
)
TIMED_LINE = """
concat(ip_address, ' - - [', {time}, '+00:00] "', method, ' ', path, ' ', http_version, '" ',
  CAST(status AS STRING), ' ', CAST(response_size AS STRING), ' rt=0.', CAST(event_id % 10 AS STRING),
  ' ref="', referrer, '" ua="', user_agent, '"')
"""

ERROR_ROWS = """
SELECT e.event_id AS event_id,
  CAST(date_trunc('second', e.ts) AS TIMESTAMP) AS ts,
  CASE e.event_id % 5 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' WHEN 2 THEN 'info' ELSE 'error' END AS level,
  e.event_id % 900 + 100 AS pid, e.user_id % 7 AS tid,
  CASE WHEN e.event_id % 6 = 0 THEN '' ELSE concat(' *', CAST(e.event_id AS STRING)) END AS cid_text,
  CASE e.event_id % 3 WHEN 0 THEN 'lost the peer (104: reset)'
    WHEN 1 THEN 'no room left (28: disk)' ELSE 'gave up waiting' END AS body,
  CASE WHEN e.event_id % 4 = 0 THEN ''
    ELSE concat(', client: 10.0.', CAST(e.user_id % 32 AS STRING), '.', CAST(e.user_id % 251 AS STRING),
      ', server: example.com, request: "GET / HTTP/1.1", host: "example.com"') END AS tail_text
FROM events e
"""

ERROR_LINE = """
concat({time}, ' [', level, '] ', CAST(pid AS STRING), '#', CAST(tid AS STRING), ':', cid_text, ' ', body, tail_text)
"""

NETWORKS = """
SELECT 167772160 + n_nationkey * 256 AS network_lo, 167772160 + n_nationkey * 256 + 255 AS network_hi,
  n_name AS country FROM nation
"""

# Nested networks of both families, down to the whole IPv4 space, and addresses in them.
CIDR_NETWORKS = """
SELECT concat('10.0.', CAST(n_nationkey AS STRING), '.0/24') AS network, n_name AS country FROM nation
UNION ALL SELECT concat('2001:db8:', CAST(n_nationkey AS STRING), '::/48') AS network, n_name AS country FROM nation
UNION ALL SELECT DISTINCT '10.0.0.0/8' AS network, 'EIGHT' AS country FROM nation
UNION ALL SELECT DISTINCT '0.0.0.0/0' AS network, 'ALL' AS country FROM nation
UNION ALL SELECT DISTINCT '2001:db8::/32' AS network, 'DOC' AS country FROM nation
"""
NESTED_ADDRESSES = """
SELECT DISTINCT concat('10.0.', CAST(user_id % 32 AS STRING), '.', CAST(user_id % 251 AS STRING)) AS ip_address,
  user_id % 32 AS part, 'four' AS family FROM events
UNION ALL SELECT DISTINCT concat('2001:db8:', CAST(user_id % 32 AS STRING), '::', CAST(user_id % 9 AS STRING)),
  user_id % 32, 'six' FROM events
UNION ALL SELECT DISTINCT concat('192.0.2.', CAST(user_id % 5 AS STRING)), user_id % 5, 'out' FROM events
UNION ALL SELECT DISTINCT concat('fe80::', CAST(user_id % 5 AS STRING)), user_id % 5, 'none' FROM events
"""

# One sample per event: four hosts, nested fields as host-sample records have them.
HOST_SAMPLES = """
SELECT CAST(user_id % 4 AS STRING) AS host, event_id AS uptime, CAST(ts AS TIMESTAMP) AS timestamp,
  named_struct('model', 'm', 'cores', 2, 'speed', CAST(2.5 AS DOUBLE), 'usage', least(value, CAST(100 AS DOUBLE)),
    'core_usage', array(least(value, CAST(100 AS DOUBLE)), CAST(user_id % 100 AS DOUBLE))) AS cpu,
  named_struct('free', 1000 - event_id % 1000, 'available', 1000 - event_id % 1000, 'used', event_id % 1000,
    'total', CAST(1000 AS BIGINT)) AS memory,
  array(named_struct('filesystem', 'tmp', 'size', CAST(10 AS BIGINT), 'used', CAST(1 AS BIGINT), 'mounted_on', '/tmp'),
    named_struct('filesystem', 'root', 'size', CAST(500 AS BIGINT), 'used', user_id % 500, 'mounted_on', '/')) AS disk
FROM events
"""

# A catalog of files: one per page, as large as its text.
FILE_CATALOG = r"""
SELECT name, size, lower(regexp_extract(name, '(\.[^.]*)$', 1)) AS extension FROM (
  SELECT concat(CASE page_id % 7 WHEN 0 THEN 'error' ELSE 'site' END, CAST(page_id AS STRING),
    CASE page_id % 8 WHEN 0 THEN '.log' WHEN 1 THEN '.log.3' WHEN 2 THEN '.log.2.gz' WHEN 3 THEN '.ZIP'
      WHEN 4 THEN '.tar' WHEN 5 THEN '.log.x' WHEN 6 THEN '' ELSE '.txt' END) AS name,
    CAST(length(html) AS BIGINT) AS size FROM pages) named
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_frames(sql: str) -> str:
    """The text with table names as parameters of ``spark.sql``."""
    for name in ("events", "pages", "nation"):
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return sql


def access_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the access log before they become lines."""
    return spark.sql(
        over_frames(ACCESS_ROWS),
        events=table(spark, sf_dir, "events"),
        pages=table(spark, sf_dir, "pages"),
    )


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = ACCESS_LINE.format(time="date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')")
    return access_rows(spark, sf_dir).select("event_id", F.expr(line).alias("value"))


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = TIMED_LINE.format(time="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")
    return access_rows(spark, sf_dir).select("event_id", F.expr(line).alias("value"))


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = ERROR_LINE.format(time="date_format(ts, 'yyyy/MM/dd HH:mm:ss')")
    rows = spark.sql(over_frames(ERROR_ROWS), events=table(spark, sf_dir, "events"))
    return rows.select("event_id", F.expr(line).alias("value"))


def network_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NETWORKS.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))


def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HOST_SAMPLES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def access_log(spark: SparkSession, sf_dir: str, profile: str = "web", labels: bool = False) -> DataFrame:
    """The parsed access log, as ``write_log_table`` stores it, with the event number.

    The label columns are added on request: building their expressions takes longer
    than most queries.
    """
    rows = access_rows(spark, sf_dir).where("NOT is_malformed").drop("is_malformed")
    if profile == "web":
        rows = rows.withColumn("response_size", F.nullif("response_size", F.lit(0).cast("bigint")))
    rows = derive_time(rows)
    return derive_labels(rows, profile) if labels else rows


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_errors(error_lines(spark, sf_dir), keep=("event_id",))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location of every address in the log; addresses outside all networks have empty texts."""
    return resolve(distinct_addresses(access_rows(spark, sf_dir)), networks_from_ranges(network_ranges(spark, sf_dir)))


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(over_frames(FILE_CATALOG).replace("\\", "\\\\"), pages=table(spark, sf_dir, "pages"))


def write_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The log lines as files in a new folder: current, rotated, compressed, error and unrelated ones, with blank lines."""
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    access, errors = access_lines(spark, sf_dir), error_lines(spark, sf_dir)
    written = [
        (access.where("event_id % 3 = 0"), "access-{}.log", None), (access.where("event_id % 3 = 1"), "access-{}.log.1", None),
        (access.where("event_id % 3 = 2"), "access-{}.log.2.gz", "gzip"), (errors, "error-{}.log", None),
        (access.where("event_id % 5 = 0"), "notes-{}.1", None),
    ]
    for number, (rows, name, compression) in enumerate(written):
        parts = f"{folder}/parts/{number}"
        with_blanks = rows.select(F.explode(F.array("value", F.lit(""), F.lit("  "))).alias("value"))
        with_blanks.write.option("compression", compression or "none").text(parts)
        source = files.Path(parts)
        system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for i, found in enumerate(f for f in system.listStatus(source) if f.getPath().getName().startswith("part-")):
            system.rename(found.getPath(), files.Path(f"{folder}/{name.format(i)}"))
    return folder


#: Rows that a task sorts when files are written in order, so that its memory does not follow the input.
SLICE_ROWS = 100_000


def write_in_order(rows: DataFrame, order: tuple[str, ...], folder: str, targets: dict[int, str], line_sep: str = "\n") -> None:
    """A text file, named below ``folder``, for each number in ``targets``: ``value`` of the rows of that ``part``, in the given order.

    Ranges of the order are sorted and written by tasks of their own. The file system has one
    writer a file: a task that appends the ranges block by block and holds one block.
    """
    spark = rows.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    slices = f"{folder}/slices-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // SLICE_ROWS)), "part", *order).sortWithinPartitions("part", *order)
    dealt.select("part", "value").write.partitionBy("part").option("lineSep", line_sep).text(slices)

    def join(numbers: Iterator[int]) -> None:
        import shutil

        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(slices) if "://" in slices else (fs.LocalFileSystem(), slices.removeprefix("file:"))
        for number in numbers:
            found = system.get_file_info(fs.FileSelector(f"{inner}/part={number}"))
            with system.open_output_stream(f"{inner}/joined-{number}") as out:
                for path in sorted(info.path for info in found if info.base_name.startswith("part-")):
                    with system.open_input_stream(path) as file:
                        shutil.copyfileobj(file, out, 1 << 20)

    spark.sparkContext.parallelize(list(targets), len(targets)).foreachPartition(join)
    system = files.Path(slices).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for number, target in targets.items():
        placed = files.Path(f"{folder}/{target}")
        system.mkdirs(placed.getParent())
        system.delete(placed, False)  # a file of that name is replaced
        system.rename(files.Path(f"{slices}/joined-{number}"), placed)
    system.delete(files.Path(slices), True)


NAMED_FILES = 3


def write_named_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder ``log.d`` with one access and one error log for each remainder of the event number, lines in its order."""
    folder = f"{shared_dir(spark)}/named-{uuid.uuid4().hex}"
    for kind, rows in (("access", access_lines(spark, sf_dir)), ("error", error_lines(spark, sf_dir))):
        dealt = rows.withColumn("part", F.col("event_id") % NAMED_FILES)
        write_in_order(dealt, ("event_id",), folder, {number: f"log.d/{kind}-{number}.log" for number in range(NAMED_FILES)})
    return f"{folder}/log.d"


# Lines without an address, and their layout.
NAMELESS_FORMAT = '[$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"'


def nameless_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_lines(spark, sf_dir).select("event_id", F.regexp_replace("value", r"^\S+ - - ", "").alias("value"))


def host_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host samples under the names their JSON records have."""
    return host_samples(spark, sf_dir).select(
        "host", "uptime", "timestamp", F.struct("cpu.model", "cpu.cores", "cpu.speed", "cpu.usage", F.col("cpu.core_usage").alias("coreUsage")).alias("cpu"), "memory",
        F.transform("disk", lambda d: F.struct(d["filesystem"].alias("filesystem"), d["size"].alias("size"), d["used"].alias("used"), d["mounted_on"].alias("mountedOn"))).alias("disk"),
    )

# One agent or more for every rule, with the labels it must get: agent, then client, system and
# device in web, then client, system and device in tui. ``None`` stands for ``Other``.
_NO_SYSTEM = (None, None)
_TOOLS = [
    ("curl/8.1", "Curl", "Curl"), ("PostmanRuntime/7.2", "Postman", "Postman"), ("insomnia/9.0", "Insomnia", "Insomnia"),
    ("python-requests/2.9", "Python requests", "Python requests"), ("node-fetch/3", "Nodejs fetch", "Nodejs fetch"), ("aiohttp/3.9", "aiohttp", "aiohttp"),
    ("Python/3.11 plain", "Python", "Python"), ("Go-http-client/2.0", "Go http", "Go http"), ("go-http-client/1.1", "Go http", "Go http"), ("Java/21", "Java", "Java"),
    ("axios/1.6", "axios", "axios"), ("Dart/3.1", "Dart", "Dart"), ("OkHttp/5", "OkHttp", "OkHttp"), ("okhttp/4.9", None, "OkHttp"),
    ("Uptime-Kuma/1.2", "Uptime Kuma", "Uptime Kuma"), ("undici/6", "undici", "undici"), ("Lush/2", "Lush", "Lush"), ("Zabbix 6.4", "Zabbix", "Zabbix"),
    ("GuzzleHttp/7", "Guzzle", "Guzzle"), ("Better Uptime check", "Uptime", "Uptime"), ("github-camo (77ab)", "GitHub Camo", "GitHub Camo"), ("Ruby 3.2", "Ruby", "Ruby"),
    ("node 20", "Node.js", "Node.js"), ("Next.js Middleware", "Next.js", "Next.js"), ("Vercel Edge Functions", "Vercel Edge Functions", "Vercel Edge Functions"),
    ("OpenAI Image Downloader", "OpenAI Image Downloader", "OpenAI Image Downloader"), ("OpenAI fetch", "OpenAI", "OpenAI"),
    ("TsunamiSecurityScanner", "Tsunami Security Scanner", "Tsunami Security Scanner"), ("something else", None, None), ("Mozilla/5.0 nothing known", None, None),
]
_BROWSERS = [
    ("Seamonkey/2.5", "Seamonkey", "Seamonkey"), ("Firefox/120.0", "Firefox", "Firefox"), ("Chrome/120 Safari/537", "Chrome", "Chrome"), ("Chromium/99 Safari/537", "Chromium", "Chromium"),
    ("Chrome/120 Safari/537 Edg/120", "Chrome", "Edge"), ("Safari/537 Edg/18", "Safari", "Edge"), ("Chrome/120 OPR/106", "Chrome", "Opera"), ("Opera/12", "Opera", "Opera"),
    ("iOS/17 app", "iOS", "iOS"), ("Version/17 Safari/605", "Safari", "Safari"), ("(any; MSIE 9.0)", "Internet Explorer", "Internet Explorer"), ("Trident/7.0", "Internet Explorer", "Internet Explorer"),
    ("Edg/120 alone", "Edge", "Edge"),
]
_SYSTEMS = [
    ("Win16", "Windows 3.11", None, "Windows 3.11", None), ("Windows 95", "Windows 95", "Windows", "Windows 95", None), ("Win95", "Windows 95", None, "Windows 95", None),
    ("Windows 98", "Windows 98", "Windows", "Windows 98", None), ("Win98", "Windows 98", None, "Windows 98", None), ("Windows ME", "Windows ME", "Windows", "Windows ME", None),
    ("Windows NT 5.0", "Windows 2000", "Windows", "Windows 2000", "Windows PC"), ("Windows NT 5.1", "Windows XP", "Windows", "Windows XP", "Windows PC"),
    ("Windows NT 5.2", "Windows Server 2003", "Windows", "Windows Server 2003", "Windows PC"), ("Windows NT 6.0", "Windows Vista", "Windows", "Windows Vista", "Windows PC"),
    ("Windows NT 6.1", "Windows 7", "Windows", "Windows 7", "Windows PC"), ("Windows NT 6.2", "Windows 8", "Windows", "Windows 8", "Windows PC"),
    ("Windows NT 6.3", "Windows NT 4.0", "Windows", "Windows 8.1", "Windows PC"), ("Windows NT 10.0", "Windows 10/11", "Windows", "Windows 10/11", "Windows PC"),
    ("Windows NT 4.0", "Windows NT 4.0", "Windows", "Windows NT 4.0", "Windows PC"), ("OpenBSD amd64", "OpenBSD", None, "OpenBSD", None), ("SunOS sun4u", "SunOS", None, "SunOS", None),
    ("Linux; Android 14; Phone Mobile", "Android", "Android", "Android", "Android Phone"), ("Linux; Android 13; Slate", "Android", "Android", "Android", "Android Tablet"),
    ("X11; Linux x86_64", "Linux", None, "Linux", "Linux"), ("Linux armv7l", "Linux", None, "Linux", "Linux"), ("Linux; Tizen/6.0", "Linux", "Samsung", "Linux", "Samsung"),
    ("Macintosh; Intel", "MacOS", "Mac", "macOS", "Mac"), ("Mac_PowerPC", "MacOS", None, "macOS", "Mac"), ("QNX nto", "QNX", None, "QNX", None), ("BeOS BePC", "BeOS", None, "BeOS", None),
    ("OS/2 Warp", "OS/2", None, "OS/2", None), ("iPhone; CPU iPhone OS 17_1", "iOS", "iPhone", "iOS", "iPhone"), ("X11; CrOS x86_64", "Linux", None, "ChromeOS", "Chromebook"),
]
AGENTS = [
    *[(agent, web, *_NO_SYSTEM, tui, *_NO_SYSTEM) for agent, web, tui in _TOOLS],
    *[(f"Mozilla/5.0 {agent}", web, *_NO_SYSTEM, tui, *_NO_SYSTEM) for agent, web, tui in _BROWSERS],
    *[(f"Mozilla/5.0 ({system}) Firefox/1.0", "Firefox", web, web_device, "Firefox", tui, tui_device) for system, web, web_device, tui, tui_device in _SYSTEMS],
]


def with_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with one of the agents above, in turn."""
    agents = spark.createDataFrame([(i, row[0]) for i, row in enumerate(AGENTS)], "place bigint, user_agent string")
    return table(spark, sf_dir, "events").select((F.col("event_id") % len(AGENTS)).alias("place")).join(agents, "place").select("user_agent")
