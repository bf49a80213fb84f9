"""Addresses to locations: a longest-prefix join on distinct addresses, then an equi-join."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.operators.lookup import lookup, one_per_key

# --- fixed values -----------------------------------------------------------
IPV4_BODY = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV6_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6_GROUPS = 8
IPV4_BITS, IPV6_BITS = 32, 128
# --- end of fixed values ----------------------------------------------------

#: Networks of at most so many prefix bits are looked up by block, not by address.
BLOCK_BITS = {4: 16, 6: 48}
_KEY_TYPE = "struct<family:int,hi:bigint,lo:bigint>"
_LONG = "bigint"


def _ipv6_pattern() -> str:
    """Eight groups, or fewer around one ``::``: so many before it, the rest at most after it."""
    shapes = [f"(?:{IPV6_GROUP}:){{{IPV6_GROUPS - 1}}}{IPV6_GROUP}"]
    for before in range(IPV6_GROUPS):
        head = f"(?:{IPV6_GROUP}:){{{before}}}" if before else ":"
        after = IPV6_GROUPS - 1 - before
        tail = f"(?::{IPV6_GROUP}){{1,{after}}}|:" if after else ":"
        shapes.append(f"{head}(?:{tail})")
    return "^(?:" + "|".join(shapes) + ")$"


def _is_ipv4(address: Column) -> Column:
    return address.rlike(f"^{IPV4_BODY}$")


def is_address(address: Column) -> Column:
    """Whether a text is an IPv4 address or an IPv6 address, the latter also with a dotted tail."""
    plain = F.regexp_replace(address, f":{IPV4_BODY}$", ":0:0")
    return _is_ipv4(address) | (address.contains(":") & plain.rlike(_ipv6_pattern()))


def _number(words: Column, base: int) -> Column:
    return F.aggregate(words, F.lit(0).cast(_LONG), lambda acc, word: acc * base + word)


def _word_number(words: Column) -> Column:
    """Four 16-bit words as one 64-bit pattern."""
    return F.aggregate(
        words, F.lit(0).cast(_LONG), lambda acc, word: F.shiftleft(acc, 16).bitwiseOR(word)
    )


def with_address_key(df: DataFrame, address: str, key: str = "key") -> DataFrame:
    """Add ``(family, hi, lo)`` of a valid address, else null.

    IPv4 is kept in ``lo``; an IPv4 address mapped into IPv6 counts as IPv4. The steps
    are columns of their own, so that each text is taken apart once.
    """
    dotted = F.regexp_extract(address, f"({IPV4_BODY})$", 1)
    octets = F.transform(F.filter(F.split(dotted, r"\."), lambda o: o != ""), lambda o: o.try_cast(_LONG))
    split_at = F.when(F.col("_text").contains("::"), F.split("_text", "::", 2)).otherwise(F.array("_text"))
    words = lambda part: F.transform(
        F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda g: g != ""),
        lambda g: F.conv(g, 16, 10).try_cast(_LONG),
    )
    missing = F.greatest(F.lit(IPV6_GROUPS) - F.size("_left") - F.size("_right"), F.lit(0))
    zeros = F.array_repeat(F.lit(0).cast(_LONG), missing)
    mapped = (F.col("_hi") == 0) & (F.shiftright("_lo", 32) == 0xFFFF)
    v4 = F.struct(F.lit(4), F.lit(0).cast(_LONG), F.col("_v4")).cast(_KEY_TYPE)
    v6_as_v4 = F.struct(F.lit(4), F.lit(0).cast(_LONG), F.col("_lo").bitwiseAND(F.lit(0xFFFFFFFF).cast(_LONG)))
    v6 = F.struct(F.lit(6), F.col("_hi"), F.col("_lo")).cast(_KEY_TYPE)
    steps = [
        {"_valid": is_address(F.col(address)), "_plain": _is_ipv4(F.col(address)), "_v4": _number(octets, 256)},
        {
            # A dotted tail of an IPv6 address becomes its last two groups.
            "_text": F.when(F.col("_plain"), "").otherwise(
                F.when(dotted == "", F.col(address)).otherwise(
                    F.concat(
                        F.regexp_replace(address, f"{IPV4_BODY}$", ""),
                        F.hex(F.shiftright("_v4", 16)),
                        F.lit(":"),
                        F.hex(F.col("_v4").bitwiseAND(F.lit(0xFFFF).cast(_LONG))),
                    )
                )
            )
        },
        {"_parts": split_at},
        {"_left": words(F.get("_parts", F.lit(0))), "_right": words(F.get("_parts", F.lit(1)))},
        {"_words": F.concat("_left", zeros, "_right")},
        {"_hi": _word_number(F.slice("_words", 1, 4)), "_lo": _word_number(F.slice("_words", 5, 4))},
        {
            key: F.when(
                F.col("_valid"),
                F.when(F.col("_plain"), v4).otherwise(F.when(mapped, v6_as_v4.cast(_KEY_TYPE)).otherwise(v6)),
            )
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    helpers = [name for step in steps[:-1] for name in step]
    return df.drop(*helpers)


def _clear_low(word: Column, bits: Column) -> Column:
    """Zero the lowest ``bits`` bits (0 to 64) of a word."""
    shifted = F.call_function("shiftleft", F.call_function("shiftright", word, bits), bits)
    return F.when(bits >= 64, F.lit(0).cast("bigint")).otherwise(shifted)


def network_of(key: Column, prefix: Column) -> Column:
    """Network address of a key at a prefix length."""
    host_bits = F.when(key["family"] == 4, IPV4_BITS - prefix).otherwise(IPV6_BITS - prefix).cast("int")
    return F.struct(
        key["family"].alias("family"),
        _clear_low(key["hi"], F.greatest(host_bits - 64, F.lit(0))).alias("hi"),
        _clear_low(key["lo"], F.least(host_bits, F.lit(64))).alias("lo"),
    )


_PLACE = ["country", "city", "lat", "lon"]


def _place_columns(networks: DataFrame) -> list[Column]:
    kinds = {"country": "string", "city": "string", "lat": "double", "lon": "double"}
    return [
        (F.col(name) if name in networks.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in kinds.items()
    ]


def _one_place(networks: DataFrame) -> DataFrame:
    """One row per network: the smallest place."""
    best = networks.groupBy("prefix", "net").agg(F.min(F.struct(*_PLACE)).alias("_one"))
    return best.select("prefix", "net", "_one.*")


def networks_from_cidr(networks: DataFrame, cidr: str = "network") -> DataFrame:
    """Prefix table from ``a.b.c.d/n`` or ``x::/n`` texts: ``prefix, net, country, city, lat, lon``.

    A network that occurs twice keeps its smallest location.
    """
    parts = F.split(F.col(cidr), "/")
    texts = networks.select(
        F.get(parts, F.lit(0)).alias("_address"),
        F.get(parts, F.lit(1)).try_cast("int").alias("given"),
        *_place_columns(networks),
    )
    keyed = with_address_key(texts, "_address")
    keyed = keyed.select("given", *_PLACE, F.explode(F.array("key")).alias("key")).where("key is not null")
    full = F.when(F.col("key.family") == 4, IPV4_BITS).otherwise(IPV6_BITS)
    prefixed = keyed.select(F.coalesce("given", full).alias("prefix"), "key", *_PLACE)
    return _one_place(prefixed.select("prefix", network_of(F.col("key"), F.col("prefix")).alias("net"), *_PLACE))


def networks_from_ranges(networks: DataFrame) -> DataFrame:
    """Prefix table from IPv4 ranges given as numbers ``network_lo`` … ``network_hi``.

    Any range is a union of aligned blocks, at most two per prefix length: the first
    and the last block of that length inside the range whose parent is not inside.
    """
    low, high = F.col("network_lo").cast("bigint"), F.col("network_hi").cast("bigint")

    def blocks(prefix: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (IPV4_BITS - prefix).cast("int"))
        first = low + F.pmod(-low, size)
        last = high + 1 - F.pmod(high + 1, size) - size

        def maximal(start: Column) -> Column:
            parent = start - F.pmod(start, size * 2)
            inside = (start >= low) & (start + size - 1 <= high)
            parent_inside = (parent >= low) & (parent + size * 2 - 1 <= high)
            return inside & ((prefix == 0) | ~parent_inside)

        found = F.array_distinct(F.array(F.when(maximal(first), first), F.when(maximal(last), last)))
        return F.transform(
            F.filter(found, lambda start: start.isNotNull()),
            lambda start: F.struct(
                prefix.alias("prefix"),
                F.struct(F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"), start.alias("lo")).alias("net"),
            ),
        )

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(IPV4_BITS)), blocks))
    return _one_place(networks.select(F.inline(every), *_place_columns(networks)))


def distinct_addresses(df: DataFrame, address: str = "ip_address") -> DataFrame:
    """Valid addresses, once each."""
    return df.select(F.col(address).alias("ip_address")).distinct().where(is_address(F.col("ip_address")))


def _longest(keyed: DataFrame, names: list[str], networks: DataFrame, prefixes: Column) -> DataFrame:
    """``keyed`` with the ``place`` of the longest network of one of the ``prefixes`` that holds ``key``, or null; ``names`` tell its rows apart."""
    tries = keyed.select(*names, "key", F.explode_outer(prefixes).alias("prefix"))
    tries = tries.select(*names, "prefix", network_of(F.col("key"), F.col("prefix")).alias("net"))
    table = networks.select("prefix", "net", F.struct(*_PLACE).alias("place"), F.col("prefix").alias("found"))
    return tries.join(table, ["prefix", "net"], "left").groupBy(*names).agg(F.max_by("place", "found").alias("place"))


def resolve(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Location of each address: the longest network that holds it, else empty texts.

    ``addresses`` holds distinct addresses. Networks larger than a block (/16, IPv6 /48) are
    looked up once a block that occurs, smaller ones once an address, at every prefix length
    the table has, by equality on the network address. So the keys of a join are never as few
    as the large networks: /0 meets as many rows as there are blocks, at most 65,536 of IPv4,
    however many addresses lie in it, and a /17 at most 32,768. Spark broadcasts a side only
    when its size allows.
    """
    block_bits = lambda family: F.when(family == 4, BLOCK_BITS[4]).otherwise(BLOCK_BITS[6])
    small_only = networks.where(F.col("prefix") > block_bits(F.col("net.family")))
    lengths = small_only.agg(F.collect_set(F.struct(F.col("net.family").alias("family"), "prefix")).alias("lengths")).scalar()
    keyed = with_address_key(addresses.select("ip_address"), "ip_address")
    # The generator pins the key, so that no step below takes the text apart again.
    keyed = keyed.select("ip_address", F.explode(F.array("key")).alias("key"))
    keyed = keyed.withColumn("block", F.when(F.col("key").isNotNull(), network_of(F.col("key"), block_bits(F.col("key.family")))))
    keyed = keyed.withColumn("lengths", lengths)
    fitting = F.transform(F.filter("lengths", lambda length: length["family"] == F.col("key.family")), lambda length: length["prefix"])
    small = _longest(keyed, ["ip_address", "block"], networks, fitting)
    blocks = small.where(F.col("block").isNotNull()).select("block", F.col("block").alias("key")).distinct()
    # Blocks are few, so every length is tried; the table need not be read for those it has.
    large = _longest(blocks, ["block"], networks, F.sequence(F.lit(0), block_bits(F.col("key.family"))))
    placed = small.join(large.select("block", F.col("place").alias("around")), "block", "left").select("ip_address", F.coalesce("place", "around").alias("place"))
    return placed.select(
        "ip_address",
        F.coalesce("place.country", F.lit("")).alias("country"),
        F.coalesce("place.city", F.lit("")).alias("city"),
        F.col("place.lat").alias("lat"),
        F.col("place.lon").alias("lon"),
    )


def with_location(df: DataFrame, locations: DataFrame, *columns: str) -> DataFrame:
    """Attach location columns (default ``country``) to log rows; unknown addresses get null.

    A location table holds an address once. Rows of hot addresses are spread (see
    ``lookup``). Counts by country should use ``counts.location_counts``, which joins
    after aggregating by address.
    """
    return lookup(df, locations, "ip_address", list(columns or ("country",)))


def unknown_addresses(df: DataFrame, locations: DataFrame, profile: str = "web") -> DataFrame:
    """Distinct addresses without a location; in web an empty country counts as none."""
    if profile == "web":
        known = locations.where(F.col("country") != "")
        wanted = df
    else:
        known, wanted = locations, df.where(F.col("ip_address") != "")
    return wanted.select("ip_address").distinct().join(known.select("ip_address"), "ip_address", "left_anti")


def country_names(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Attach display names from a table ``country, name``, to counted rows."""
    return counts.join(one_per_key(names.select("country", "name"), "country"), "country", "left")


def live_points(df: DataFrame, locations: DataFrame, as_of: dt.datetime, window: str = "1 hour") -> DataFrame:
    """Recent requests on the map: ``ts, lat, lon, status`` for rows whose place is known."""
    recent = df.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {window}"))
    needed = recent.select("ip_address", "ts", "status", "user_agent", "path")
    placed = lookup(needed, locations, "ip_address", ["lat", "lon"])
    return placed.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("ts", "lat", "lon", "status")
