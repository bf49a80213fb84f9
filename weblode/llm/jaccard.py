"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Every text becomes the set of its five-word shingles. Equal texts are one class before
anything else, so copies cost one row each. A class gets ``TREES`` labels of ``DEPTH``
min-hashes; each tree is its labels in sorted order, where the texts that share a prefix
stand together as in a prefix trie. The tries are range-partitioned over the cluster, equal
labels included, and read once in order.

A text's matched prefix is shortened adaptively: it meets its nearest neighbours with the
longest shared prefix first, then, while it has met fewer than ``PARTNERS``, those with
shorter ones, down to the length at which ``TREES`` trees together reach the target recall
for the threshold. Besides, every text meets the leader (the class with most copies, then
the smallest) of its group at that shortest length, so groups of any size hang together
without all pairs. Each pair met is verified on the whole shingle sets; verified links give
the classes. Further rounds compare what the first left apart: a group whose members are
in different classes meets another leader, until a round finds no new link. Last, all pairs
of such groups that are still in different classes are compared, small groups pair by pair,
crowded ones in salted blocks that return links only: whoever shares a shortest prefix has
been compared or is in one class.

Cases: null texts count as empty; texts without words link to nothing but equal ones; a
text of fewer than five words is one shingle; equal shingle sets are similarity 1; repeated
rows are copies; null ids are allowed and come back null; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import shuffle_partitions, stage, text_key

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 12
DEPTH = 8
TARGET_RECALL = 0.995
PARTNERS = 2
PIECE = 1 << 22
#: Groups of at most so many texts are compared pair by pair in the end, larger ones in blocks.
SMALL = 8
#: Texts in a block of comparison, and the width of the distance cells of link counting.
BLOCK = 128
CELL = 0.01
COLUMNS = 1 << 14
#: Links that one task connects.
LINKS = 1 << 17
_U = np.uint64
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def least_prefix(threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with probability ``recall``."""
    length = 1
    while length < DEPTH and 1 - (1 - threshold ** (length + 1)) ** trees >= recall:
        length += 1
    return length


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (run of bytes other than ASCII white space), all at once."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACES[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    powers = np.full(len(raw), base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(len(raw), pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.zeros(len(raw) + 1, np.uint64)
    # Each byte is spread over all bits first, so that words of few letters differ everywhere.
    np.cumsum(_BYTES[raw] * powers, out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def all_word_hashes(data: bytes) -> np.ndarray:
    """``word_hashes`` of a text of any length, in pieces cut at white space."""
    if len(data) <= PIECE:
        return word_hashes(data)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _SPACES[data[end]]:
            end += 1
        found.append(word_hashes(data[at:end]))
        at = end
    return np.concatenate(found)


def shingles(data: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending; one for all words of a shorter text."""
    words = all_word_hashes(data)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    value = np.zeros(n, np.uint64)
    for i in range(size):
        value = _mixed(value ^ words[i : i + n]) + _U(i + 1)
    return np.unique(value)


#: Odd multipliers of the min-hashes, of well mixed numbers.
_FACTORS = _mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | _U(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` min-hashes: the leading 32 bits of the least product with each factor."""
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for first in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[first : first + 2048] * _FACTORS[:, None]).min(axis=1), out=least)
    return (least >> _U(32)).astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two ascending sets of distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def _labels(classes: DataFrame) -> DataFrame:
    """key, size of the shingle set, labels by tree (four bytes a min-hash, so that order is trie order) of each class with words."""
    schema = "key string, size int, labels array<binary>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, sizes, labels = [], [], []
            frame = frame.drop_duplicates("key")
            for key, text in zip(frame["key"], frame["text"]):
                hashes = shingles(text.encode("utf-8", "surrogatepass"))
                if len(hashes):
                    rows = signature(hashes).astype(">u4").reshape(TREES, DEPTH)
                    keys.append(key), sizes.append(len(hashes)), labels.append([row.tobytes() for row in rows])
            if keys:  # columns of an empty frame would have no type
                yield pd.DataFrame({"key": keys, "size": sizes, "labels": labels})

    return classes.select("key", "text").mapInPandas(run, schema)


def _neighbours(tries: DataFrame, least: int) -> DataFrame:
    """(a, b) of texts that stand near each other in a sorted trie and share at least ``least`` min-hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: list[tuple[int, bytes, str]] = []
        for frame in frames:
            out = []
            for tree, label, key in zip(frame["tree"], frame["label"], frame["key"]):
                label, met = bytes(label), 0
                # Shorten the prefix step by step until enough partners are met.
                for length in range(DEPTH, least - 1, -1):
                    for other_tree, other, other_key in reversed(recent):
                        if other_tree != tree or other[: 4 * length] != label[: 4 * length]:
                            break
                        if length == DEPTH or other[: 4 * length + 4] != label[: 4 * length + 4]:
                            if met < PARTNERS:
                                out.append((min(key, other_key), max(key, other_key)))
                            met += 1
                    if met >= PARTNERS:
                        break
                recent = [*recent[-PARTNERS + 1 :], (tree, label, key)]
            yield pd.DataFrame(out, columns=["a", "b"])

    parts = max(1, shuffle_partitions(tries.sparkSession))
    placed = tries.repartitionByRange(parts, "tree", "label", "key").sortWithinPartitions("tree", "label", "key")
    return placed.select("tree", "label", "key").mapInPandas(run, "a string, b string")


def _leaders(tries: DataFrame, members: DataFrame, turn: int) -> DataFrame:
    """(a, b) of every text and the leader of its group at the shortest prefix, if ``members`` puts them in different classes.

    The first leader is the text with most copies, each later turn takes another.
    """
    order = -F.col("copies") if turn == 0 else F.xxhash64("key", F.lit(turn))
    cut = tries.select("key", "prefix").join(members.select("key", "class", "copies"), "key")
    grouped = cut.groupBy("prefix").agg(
        F.min(F.struct(order.alias("order"), "key", "class")).alias("lead"), F.min("class").alias("low"), F.max("class").alias("high")
    )
    grouped = grouped.where("low <> high").select("prefix", F.col("lead.key").alias("lead"), F.col("lead.class").alias("lead_class"))
    met = cut.join(grouped, "prefix").where("class <> lead_class")
    return met.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def _mixed_groups(tries: DataFrame, classes: DataFrame) -> DataFrame:
    """prefix, key, size, class, n of the groups of n texts that are in different classes; of groups of the same texts one."""
    cut = tries.select("prefix", "key", "size").join(classes.select("key", "class"), "key")
    groups = cut.groupBy("prefix").agg(
        F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"),
    )
    groups = groups.where("low <> high").groupBy("n", "s", "x").agg(F.min("prefix").alias("prefix")).select("prefix", "n")
    return stage(cut.join(groups, "prefix"), "mixed")


def _small_pairs(groups: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different classes not in ``tried`` that share a group of at most ``SMALL`` and whose sizes allow a link."""
    one = groups.where(F.col("n") <= SMALL).select("prefix", F.col("key").alias("a"), F.col("size").alias("m"), "class")
    other = one.withColumnsRenamed({"a": "b", "m": "o_m", "class": "o_class"})
    near = F.least("m", "o_m") >= threshold * F.greatest("m", "o_m") - 1e-9
    pairs = one.join(other, "prefix").where((F.col("a") < F.col("b")) & (F.col("class") != F.col("o_class")) & near)
    return pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")


def _crowded_links(groups: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of links that connect all classes linked inside a group of more than ``SMALL``.

    A group's texts are dealt to blocks by the size of their sets (linked sets are in the
    same or the next cell of sizes) and, for a class that fills a block, by class. Blocks
    meet in tasks of their own, but not those of one class; a task returns at most as many
    links as it has classes.
    """
    step = max(-math.log(threshold), 1e-6) * (1 + 1e-9)
    crowded = groups.where(F.col("n") > SMALL)
    full = crowded.groupBy("prefix", "class").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("prefix", "class", F.col("class").alias("part"))
    placed = crowded.join(full, ["prefix", "class"], "left")
    placed = stage(
        placed.select("prefix", "key", "class", F.coalesce("part", F.lit("")).alias("part"), F.floor(F.log("size") / step).alias("cell")), "crowded"
    )
    cells = stage(placed.groupBy("prefix", "part", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cells")
    other = cells.withColumnsRenamed({c: f"o_{c}" for c in ("part", "cell", "blocks")})
    own = F.col("part") == F.col("o_part")
    tasks = cells.join(other, "prefix").where((F.abs(F.col("cell") - F.col("o_cell")) <= 1) & ~(own & (F.col("part") != "")))
    tasks = tasks.where((F.col("part") < F.col("o_part")) | (own & (F.col("cell") <= F.col("o_cell"))))
    tasks = tasks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1)))
    same = own & (F.col("cell") == F.col("o_cell")) & (F.col("salt") == F.col("o_salt"))
    tasks = tasks.where(~own | (F.col("cell") < F.col("o_cell")) | (F.col("salt") <= F.col("o_salt")))
    names = ["prefix", "part", "cell", "salt", "o_part", "o_cell", "o_salt"]
    dealt = placed.join(cells, ["prefix", "part", "cell"])
    dealt = dealt.select("prefix", "part", "cell", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("salt"), "key", "class")
    first = tasks.select(names).join(dealt, names[:4]).select(*names, "key", "class", F.lit(0).alias("side"))
    moved = dealt.withColumnsRenamed({"part": "o_part", "cell": "o_cell", "salt": "o_salt"})
    second = tasks.where(~same).select(names).join(moved, ["prefix", *names[4:]]).select(*names, "key", "class", F.lit(1).alias("side"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "key"])
        keys, groups_, n = frame["key"].to_numpy(), pd.factorize(frame["class"])[0], int((frame["side"] == 0).sum())
        sets = [shingles(text.encode("utf-8", "surrogatepass")) for text in frame["text"]]
        sizes = np.array([len(x) for x in sets])
        # Shingles of one set only are shared with none.
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = np.split(seen[column] > 1, np.cumsum(sizes)[:-1])
        sets = [x[kept] for x, kept in zip(sets, several)]
        left, right = (slice(0, n), slice(n, None)) if n < len(sets) else (slice(0, n), slice(0, n))
        shared = shared_counts(sets[left], sets[right])
        found = shared / (sizes[left][:, None] + sizes[right][None, :] - shared)
        linked = (found >= threshold) & (groups_[left][:, None] != groups_[right][None, :])
        root, out = list(range(len(keys))), []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in zip(*np.nonzero(linked)):
            x, y = top(groups_[left][i]), top(groups_[right][j])
            if x != y:
                root[x] = y
                a, b = sorted((keys[left][i], keys[right][j]))
                out.append((a, b, found[i, j]))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    compared = first.unionByName(second).join(pool, "key").groupBy(names)
    return compared.applyInPandas(run, "a string, b string, similarity double")


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose shingle sets reach the threshold. ``docs`` has key and text, one row a class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, held = [], {}
            for a, b, text, other in zip(frame["a"], frame["b"], frame["text"], frame["other"]):
                for key, value in ((a, text), (b, other)):
                    if key not in held:
                        if len(held) > 64:
                            held = {k: held[k] for k in (a, b) if k in held}
                        held[key] = shingles(value.encode("utf-8", "surrogatepass"))
                found = jaccard(held[a], held[b])
                if found >= threshold:
                    out.append((a, b, found))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    left = docs.select(F.col("key").alias("a"), "text")
    right = docs.select(F.col("key").alias("b"), F.col("text").alias("other"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text", "other").mapInPandas(run, "a string, b string, similarity double")


def _stars(links: DataFrame, blocks: int) -> DataFrame:
    """(a, b) of every text b of a block of links and the smallest text a that the block connects it to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[str, str] = {}

        def top(x: str) -> str:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for frame in frames:
            for a, b in zip(frame["a"], frame["b"]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        out = [(top(x), x) for x in list(root)]
        if out:
            yield pd.DataFrame([(a, b) for a, b in out if a != b], columns=["a", "b"])

    return links.repartition(blocks).mapInPandas(run, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """key and class (smallest key connected) of every linked key.

    Blocks of ``LINKS`` links are connected in a task each. With several blocks, rounds
    alternate joining every neighbour that is larger to the smallest neighbour, and every
    neighbour that is smaller, until nothing changes; each round is written out.
    """
    edges = links.select("a", "b").where("a <> b")
    blocks = max(1, -(-edges.count() // LINKS))
    edges = stage(_stars(edges, blocks), "links")
    if blocks > 1:
        edges = _joined(edges)
    return edges.groupBy("b").agg(F.min("a").alias("class")).select(F.col("b").alias("key"), "class").unionByName(
        edges.select(F.col("a").alias("key"), F.col("a").alias("class")).distinct()
    )


def _joined(edges: DataFrame) -> DataFrame:
    """(a, b) of the smallest text connected and every other one."""
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # Larger neighbours and the text itself hang on the smallest of the neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.least("m", "a").alias("m"))
        large = large.unionByName(least.select(F.col("a").alias("x"), F.least("m", "a").alias("m"))).where("x <> m")
        edges = large.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        # Smaller neighbours hang on the smallest too.
        low = edges.groupBy("b").agg(F.min("a").alias("m"))
        small = edges.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = stage(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges
        before = now


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, links, classes, pool).

    ``members``: id and key (of its text) for each row. ``links``: verified pairs (a, b,
    similarity) of keys of different texts that hold the classes together. ``pool``: key and
    text of the texts that met another. ``classes``: key, copies, first_id, class for each
    text; ``class`` is the smallest key of the connected texts.
    """
    keyed = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("key"))
    members = keyed.select(id_col, "key")
    texts = stage(members.groupBy("key").agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")), "texts")
    labels = _labels(keyed).dropDuplicates(["key"])
    least = least_prefix(threshold)
    tries = labels.select("key", "size", F.posexplode("labels").alias("tree", "label"))
    tries = stage(tries.withColumn("prefix", F.xxhash64("tree", F.substring("label", 1, 4 * least))), "tries")
    # Most texts share their shortest prefix with no other in most trees; only groups go on.
    groups = tries.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    tries = stage(tries.join(groups, "prefix", "left_semi"), "groups")
    classes = texts.withColumn("class", F.col("key"))
    met = stage(_neighbours(tries, least).unionByName(_leaders(tries, classes, 0)).distinct(), "pairs")
    # Whoever shares a prefix with anyone meets at least the leader, so later rounds need no other texts.
    wanted = texts.join(met.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key").select("key", F.col("first_id").alias("_id"))
    pool = keyed.join(wanted, (keyed["key"] == wanted["key"]) & keyed[id_col].eqNullSafe(wanted["_id"]), "left_semi")
    pool = stage(pool.select("key", "text").dropDuplicates(["key"]), "pool")
    tried, links, turn = met, None, 0
    while True:
        found = stage(_verified(met, pool, threshold), "verified")
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        classes = _classes(texts, links)
        turn += 1
        met = stage(_leaders(tries, classes, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(met)
    # What neighbours and leaders left apart: links between different classes, so none is known.
    groups = _mixed_groups(tries, classes)
    found = _verified(_small_pairs(groups, tried, threshold), pool, threshold)
    found = stage(found.unionByName(_crowded_links(groups, pool, threshold)).dropDuplicates(["a", "b"]), "verified")
    if found.isEmpty():
        return members, links, classes, pool
    links = links.unionByName(found)
    return members, links, _classes(texts, links), pool


def _classes(texts: DataFrame, links: DataFrame) -> DataFrame:
    """key, class, copies, first_id of each text, staged."""
    joined = texts.join(components(links), "key", "left")
    return stage(joined.select("key", F.coalesce("class", "key").alias("class"), "copies", "first_id"), "classes")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[part], column[part] - first] = 1
        total += grid[: len(left)] @ grid[len(left) :].T
    return total


def count_links(classes: DataFrame, links: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """key, n_links: the number of different texts that reach the threshold with each text, all pairs of a class considered.

    No pair is written out. A class whose verified links are all its pairs is counted from
    them. In a larger class the texts are sorted into cells by their distance from one
    leader. Jaccard distance is a metric: two cells near the leader are linked throughout,
    two cells whose distances differ too much not at all, and only the others are compared,
    block by block, inside tasks that return one count for each text.
    """
    far = 1 - threshold
    own = classes.select("key", "class", "copies")
    given = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    known = links.join(own, links["a"] == own["key"]).groupBy("class").agg(F.count("*").alias("known"))
    sizes = own.groupBy("class").agg(F.count("*").alias("m"), F.min(F.struct((-F.col("copies")).alias("order"), "key")).alias("_lead"))
    sizes = sizes.where("m > 2").join(known, "class").where("2 * known < m * (m - 1)")
    open_classes = stage(sizes.select("class", "m", F.col("_lead.key").alias("lead")), "open")
    members = own.join(open_classes, "class").select("key", "class", "lead", "m")
    large = members.where((F.col("m") > BLOCK) & (F.col("key") != F.col("lead")))
    to_lead = _verified(large.select(F.col("key").alias("a"), F.col("lead").alias("b")), pool, -1.0)
    distance = F.when(F.col("m") <= BLOCK, F.lit(None)).when(F.col("key") == F.col("lead"), 0.0).otherwise(1 - F.col("similarity"))
    placed = members.join(to_lead.select(F.col("a").alias("key"), "similarity"), "key", "left").withColumn("d", distance)
    # Small classes are one cell of unknown distances.
    placed = stage(placed.select("key", "class", "d", F.coalesce(F.floor(F.col("d") / CELL), F.lit(-1)).cast("int").alias("cell")), "cells")
    cells = placed.groupBy("class", "cell").agg(
        F.count("*").alias("n"), F.coalesce(F.min("d"), F.lit(0.0)).alias("near"), F.coalesce(F.max("d"), F.lit(1.0)).alias("far")
    ).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    cells = stage(cells, "cells")
    # At most 1 / CELL cells of a class meet here.
    other = cells.select("class", *[F.col(c).alias(f"o_{c}") for c in ("cell", "n", "near", "far", "blocks")])
    met = cells.join(other, "class")
    sure = F.col("far") + F.col("o_far") <= far - 1e-9
    implied = met.where(sure).groupBy("class", "cell").agg(F.sum(F.col("o_n") - F.when(F.col("cell") == F.col("o_cell"), 1).otherwise(0)).alias("implied"))
    apart = F.greatest(F.col("o_near") - F.col("far"), F.col("near") - F.col("o_far")) > far + 1e-9
    tasks = met.where(~sure & ~apart & (F.col("cell") <= F.col("o_cell")))
    tasks = tasks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1))).where("cell < o_cell OR salt <= o_salt")
    tasks = tasks.select("class", "cell", "salt", "o_cell", "o_salt")
    dealt = placed.join(cells.select("class", "cell", "blocks"), ["class", "cell"])
    dealt = dealt.select("key", "class", "cell", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("salt"))
    same = (F.col("cell") == F.col("o_cell")) & (F.col("salt") == F.col("o_salt"))
    first = tasks.join(dealt, ["class", "cell", "salt"]).select("key", "class", "cell", "salt", "o_cell", "o_salt", F.lit(0).alias("side"))
    second = tasks.where(~same).join(dealt.withColumnsRenamed({"cell": "o_cell", "salt": "o_salt"}), ["class", "o_cell", "o_salt"])
    both = first.unionByName(second.select("key", "class", "cell", "salt", "o_cell", "o_salt", F.lit(1).alias("side")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(text.encode("utf-8", "surrogatepass")) for text in frame["text"]]
        side, keys = frame["side"].to_numpy(), frame["key"].to_numpy()
        left = [x for x, s in zip(sets, side) if s == 0]
        right = [x for x, s in zip(sets, side) if s == 1] or left
        shared = shared_counts(left, right)
        sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
        linked = shared >= threshold * (sizes - shared)
        if right is left:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"key": keys[side == 0], "n": linked.sum(axis=1)})
        return pd.DataFrame({"key": np.concatenate([keys[side == 0], keys[side == 1]]), "n": np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])})

    compared = both.join(pool, "key").groupBy("class", "cell", "salt", "o_cell", "o_salt").applyInPandas(run, "key string, n bigint")
    sums = placed.join(implied, ["class", "cell"], "left").select("key", F.coalesce("implied", F.lit(0)).alias("n")).unionByName(compared)
    sums = sums.groupBy("key").agg(F.sum("n").alias("n_links"))
    return given.join(sums.select("key"), "key", "left_anti").unionByName(sums)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, key, class_id, text_id, n_copies, n_links, keep for each row of ``df``.

    ``class_id`` is the smallest id of the connected texts, ``text_id`` that of the rows of
    the same text, ``n_copies`` the number of those other rows, ``n_links`` the number of
    different texts that reach the threshold with this one. ``keep`` is true for the one text of each class whose id
    is the class's.
    """
    members, links, classes, pool = join(df, id_col, text_col, threshold)
    counted = count_links(classes, links, pool, threshold)
    first = classes.groupBy("class").agg(F.min(F.struct("first_id", "key")).alias("_first"))
    known = classes.join(first, "class").join(counted, "key", "left").select(
        "key", F.col("_first.first_id").alias("class_id"), F.col("first_id").alias("text_id"), (F.col("copies") - 1).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), (F.col("_first.key") == F.col("key")).alias("keep"),
    )
    return members.join(known, "key").select(id_col, "key", "class_id", "text_id", "n_copies", "n_links", "keep")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the smallest id; of fully equal rows one stays."""
    _, _, classes, _ = join(df, id_col, text_col)
    first = classes.groupBy("class").agg(F.min(F.struct("first_id", "key")).alias("_first"))
    kept = stage(first.select(F.col("_first.first_id").alias("_id"), F.col("_first.key").alias("_kept")), "kept")
    key = f"key_{uuid.uuid4().hex}"  # no column of the caller's
    rows = df.withColumn(key, text_key(text_col))
    rows = rows.join(kept, rows[id_col].eqNullSafe(kept["_id"]) & (rows[key] == kept["_kept"]), "left_semi")
    return rows.dropDuplicates([id_col, key]).drop(key)


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "text_id", "n_copies", "n_links", "keep")


# All pairs of texts that share a shingle, counted exactly. Texts are named by the smallest id of their rows.
OP3_SQL = r"""
WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT t, count(*) AS copies, min(doc_id) AS id FROM rows_ GROUP BY t),
words AS (SELECT id, list_filter(string_split_regex(t, '[ \t\n\r\x0b\x0c]+'), lambda w: w <> '') AS w FROM texts),
places AS (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM places),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.id = shared.a JOIN sizes y ON y.id = shared.b
  WHERE shared.n >= 0.8 * (x.n + y.n - shared.n)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT id, id AS root FROM texts UNION SELECT both_.b, reached.root FROM reached JOIN both_ ON both_.a = reached.id),
classes AS (SELECT id, min(root) AS class_id FROM reached GROUP BY id),
degrees AS (SELECT a AS id, count(*) AS n_links FROM both_ GROUP BY a)
SELECT rows_.doc_id, classes.class_id, texts.id AS text_id, copies - 1 AS n_copies, coalesce(n_links, 0) AS n_links, texts.id = classes.class_id AS keep
FROM rows_ JOIN texts USING (t) JOIN classes ON classes.id = texts.id LEFT JOIN degrees ON degrees.id = texts.id
"""
