"""Merkle manifest of a dataset, with proofs by the octopus multiproof.

A row's leaf is a digest of its columns. The leaves of a group stand in order of their ids;
every ``ARITY`` consecutive nodes become the digest of their joined digests until one is
left, the group's subroot, and the subroots in order of their groups likewise give the root.

Ranks come from one range-partitioned sort: places inside each partition, and the rows of
the partitions before (a group that holds a third of all rows is spread over many). Leaves
then live in blocks of ``ARITY ** 3`` neighbours. A block hashes its own lower levels; the
levels above, a 4096th of the rows, are grouped run by run.

Proofs: each block of leaves lists the coordinates (tree, level, run, members) of nodes that
none of its leaves gives or derives, the minimal union for all its proofs together. One join
fetches them. The block then derives the interiors its leaves share once, keeps for every
node the siblings from there to the root, and expands one proof a leaf from these.

Cases: null columns are ``-``, so an empty text differs from a null one; null ids come
first, null groups form the first group; rows that repeat an id are ordered by leaf, equal
rows are leaves of their own; texts of any length are hashed whole; a group of one row has
its leaf as subroot, a table of one row has it as root and an empty proof; an empty table
gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import shuffle_partitions, stage

ARITY = 16
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
#: The tree over the subroots.
TOP = -1


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(column: str | Column) -> Column:
    """``-`` for null, else the bytes of the value's text, a colon and the text."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: str | Column) -> Column:
    return F.sha2(F.concat(*[canonical(c) for c in columns]), 256)


def level_sizes(n: int) -> list[int]:
    """Nodes of each level, from the leaves to the last single node."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def in_order(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``part`` and ``local``, offsets: group, part, before, n).

    A row's place in its group is ``before + local``. The offsets have one row for each
    partition and group in it.
    """
    keys = [F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order]]
    # The running number tells equal rows apart, so that the ranges can cut between them.
    numbered = df.withColumn("row_number", F.monotonically_increasing_id())
    parts = shuffle_partitions(df.sparkSession)
    placed = numbered.repartitionByRange(parts, *keys, F.asc("row_number")).sortWithinPartitions(*keys).drop("row_number")
    at = df.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, count = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            local = []
            for value in batch.column(at).to_pylist():
                if value != now:
                    now, count = value, 0
                local.append(count)
                count += 1
            columns = [*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", part int, local bigint"
    rows = stage(placed.mapInArrow(run, schema), "ordered")
    counted = rows.groupBy(group, "part").agg(F.count("*").alias("m"))
    # A group has at most one row a partition here.
    before = F.expr(f"sum(m) OVER (PARTITION BY `{group}` ORDER BY part) - m")
    offsets = counted.select(group, "part", before.alias("before"), F.expr(f"sum(m) OVER (PARTITION BY `{group}`)").alias("n"))
    return rows, stage(offsets, "offsets")


@dataclass
class Manifest:
    #: tree, n, pos, block beside the columns of each row
    rows: DataFrame
    #: tree, level, run, digests of the nodes in it
    runs: DataFrame
    #: tree, group, n, subroot
    groups: DataFrame
    #: the root (null for an empty table), the number of groups
    root: str | None
    n_groups: int


def _block_levels(digests: list[str], n: int) -> tuple[list[tuple[int, int, list[str]]], str]:
    """(level, run inside the block, digests) of a whole block, and its last node."""
    found = []
    for level, size in enumerate(level_sizes(n)[:-1]):
        if level == BLOCK_LEVELS:
            break
        runs = [digests[i : i + ARITY] for i in range(0, len(digests), ARITY)]
        found += [(level, i, run) for i, run in enumerate(runs)]
        digests = [digest("".join(run)) for run in runs]
    return found, digests[0]


def build(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(runs, roots: tree, digest) of trees with leaves ``tree, n, pos, digest``; ``most`` is the largest n."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        found, last = _block_levels(table.column("digest").to_pylist(), n)
        found = [(tree, n, level, block * ARITY ** (BLOCK_LEVELS - level - 1) + i, nodes, None) for level, i, nodes in found]
        found.append((tree, n, BLOCK_LEVELS if n > BLOCK else -1, block, None, last))
        return pa.table(dict(zip(_BUILT.names, map(list, zip(*found)))), schema=_BUILT)

    blocks = rows.select("tree", "n", "pos", "digest").withColumn("block", F.floor(F.col("pos") / BLOCK))
    lower = stage(blocks.groupBy("tree", "block").applyInArrow(run, BUILT), "merkle")
    runs = [lower.where("digests IS NOT NULL").select("tree", "level", "run", "digests")]
    roots = [lower.where("level = -1").select("tree", F.col("last").alias("digest"))]
    nodes = lower.where(F.col("level") == BLOCK_LEVELS).select("tree", "n", F.col("run").alias("pos"), F.col("last").alias("digest"))
    for level, size in enumerate(level_sizes(most)[:-1]):
        if level < BLOCK_LEVELS:
            continue
        sorted_nodes = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        grouped = nodes.groupBy("tree", "n", F.floor(F.col("pos") / ARITY).alias("run")).agg(sorted_nodes["digest"].alias("digests"))
        grouped = stage(grouped.withColumn("digest", F.sha2(F.array_join("digests", ""), 256)), "merkle")
        runs.append(grouped.select("tree", F.lit(level).alias("level"), "run", "digests"))
        alone = F.col("n") <= ARITY ** (level + 1)
        roots.append(grouped.where(alone).select("tree", "digest"))
        nodes = grouped.where(~alone).select("tree", "n", F.col("run").alias("pos"), "digest")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(runs), union(roots)


BUILT = "tree bigint, n bigint, level int, run bigint, digests array<string>, last string"
_BUILT = pa.schema([
    ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("run", pa.int64()), ("digests", pa.list_(pa.string())), ("last", pa.string()),
])


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> Manifest:
    """The trees of a table of leaves; ``leaves`` has one row a leaf, ordered in its group by ``order`` and then the leaf."""
    rows, offsets = in_order(leaves, group, [*order, leaf])
    sizes = offsets.groupBy(group).agg(F.max("n").alias("n")).withColumn("one", F.lit(0))
    ranked, ranks = in_order(sizes, "one", [group])
    total = ranks.agg(F.max("n").alias("n")).first()["n"] or 0
    largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    groups = ranked.join(ranks.select(F.col("part").alias("p"), "before"), F.col("part") == F.col("p"))
    groups = stage(groups.select((F.col("before") + F.col("local")).alias("tree"), F.col(group).alias("of"), "n"), "groups")
    placed = offsets.join(groups.select("tree", "of"), F.col(group).eqNullSafe(F.col("of")))
    placed = placed.select(F.col("part").alias("p"), "of", "tree", "n", "before")
    # The partition is part of the key, so a large group meets its offset in many tasks.
    known = rows.join(placed, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("of")))
    pos = F.col("before") + F.col("local")
    known = known.select(*leaves.columns, "tree", "n", pos.alias("pos"), F.floor(pos / BLOCK).alias("block"))
    known = stage(known, "leaves")
    runs, subroots = build(known.select("tree", "n", "pos", F.col(leaf).alias("digest")), largest)
    subroots = stage(groups.join(subroots, "tree").withColumnRenamed("digest", "subroot"), "subroots")
    over = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(total).cast("bigint").alias("n"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"))
    top_runs, top = build(over, total)
    root = top.first()
    return Manifest(known, runs.unionByName(top_runs), subroots, root and root["digest"], total)


def missing(known: set[int], n: int) -> list[tuple[int, int, list[int]]]:
    """(level, run, members) of the nodes that proofs of the ``known`` leaves need and cannot derive."""
    found = []
    for level, size in enumerate(level_sizes(n)[:-1]):
        above = {pos // ARITY for pos in known}
        for run in sorted(above):
            first = run * ARITY
            members = [m for m in range(min(ARITY, size - first)) if first + m not in known]
            if members:
                found.append((level, run, members))
        known = above
    return found


def derive(known: dict[int, str], fetched: dict[tuple[int, int], dict[int, str]], n: int) -> tuple[list[dict[int, list[str]]], str]:
    """Whole runs above the known leaves, level by level, and the last node."""
    levels = []
    for level, size in enumerate(level_sizes(n)[:-1]):
        runs = {}
        for run in sorted({pos // ARITY for pos in known}):
            first, given = run * ARITY, fetched.get((level, run), {})
            runs[run] = [known[first + m] if first + m in known else given[m] for m in range(min(ARITY, size - first))]
        levels.append(runs)
        known = {run: digest("".join(nodes)) for run, nodes in runs.items()}
    return levels, next(iter(known.values()))


def siblings_above(levels: list[dict[int, list[str]]], after: str) -> list[dict[int, str]]:
    """For every derived node of each level: the siblings on its way up, joined, then ``after``."""
    above = [{} for _ in levels] + [{0: after}]
    for level in range(len(levels) - 1, 0, -1):
        for pos in levels[level - 1]:
            nodes, m = levels[level][pos // ARITY], pos % ARITY
            above[level][pos] = "".join([*nodes[:m], *nodes[m + 1 :]]) + above[level + 1][pos // ARITY]
    return above


def fold(leaf: str, pos: int, levels: list[dict[int, list[str]]]) -> str:
    """The last node if the leaf at ``pos`` were ``leaf``, with the siblings as they are."""
    for runs in levels:
        nodes = runs[pos // ARITY]
        leaf = digest("".join([*nodes[: pos % ARITY], leaf, *nodes[pos % ARITY + 1 :]]))
        pos //= ARITY
    return leaf


def _requests(wanted: DataFrame, n_groups: int) -> DataFrame:
    """tree, block, of (tree of the node), level, run, members: what the block of leaves has to fetch."""
    schema = "tree bigint, block bigint, of bigint, level int, run bigint, members array<int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tree, block, n, places in zip(frame["tree"], frame["block"], frame["n"], frame["places"]):
                own = missing({block * BLOCK + int(p) for p in places}, n)
                out += [(tree, block, tree, *x) for x in own] + [(tree, block, TOP, *x) for x in missing({tree}, n_groups)]
            yield pd.DataFrame(out, columns=["tree", "block", "of", "level", "run", "members"])

    places = F.collect_set((F.col("pos") % BLOCK).cast("int"))
    return wanted.groupBy("tree", "block").agg(F.max("n").alias("n"), places.alias("places")).mapInPandas(run, schema)


PROOF = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(made: Manifest, wanted: DataFrame, carry: list[str], leaf: str = "leaf", claimed: str = "claimed") -> DataFrame:
    """Proof of each row of ``wanted`` (rows of ``made.rows``): ``carry``, leaf and the columns of ``PROOF``.

    ``claimed`` is null, or the leaf that is checked in place of the true one.
    """
    kept = wanted.select(*carry, F.col(leaf).alias("leaf_"), F.col(claimed).alias("claimed_"), "tree", "n", "pos", "block")
    kinds = [made.rows.schema[c].dataType.simpleString() for c in carry]
    asked = _requests(kept, made.n_groups)
    nodes = made.runs.withColumnRenamed("tree", "of")
    fetched = asked.join(nodes, ["of", "level", "run"]).select(
        "tree", "block", "of", "level", "run", "members", F.transform("members", lambda m: F.get("digests", m)).alias("digests")
    )
    root, n_groups = made.root, made.n_groups

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tree, n = key[0].as_py(), left.column("n")[0].as_py()
        given = {tree: {}, TOP: {}}
        for row in right.to_pylist():
            given[row["of"]][row["level"], row["run"]] = dict(zip(row["members"], row["digests"]))
        places, leaves, claims = (left.column(c).to_pylist() for c in ("pos", "leaf_", "claimed_"))
        levels, subroot = derive(dict(zip(places, leaves)), given[tree], n)
        over, derived = derive({tree: subroot}, given[TOP], n_groups)
        rest = [over[i][tree // ARITY ** (i + 1)] for i in range(len(over))]
        at = [tree // ARITY**i % ARITY for i in range(len(over))]
        after = "".join("".join([*nodes[:m], *nodes[m + 1 :]]) for nodes, m in zip(rest, at))
        above = siblings_above(levels, after)
        proofs, folded = [], []
        for pos, claim in zip(places, claims):
            if levels:
                nodes, m = levels[0][pos // ARITY], pos % ARITY
                proofs.append(digest("".join([*nodes[:m], *nodes[m + 1 :], above[1][pos // ARITY]])))
            else:
                proofs.append(digest(after))
            folded.append(derived if claim is None else fold(fold(claim, pos, levels), tree, over))
        size = left.num_rows
        made_columns = [
            pa.array([subroot] * size), pa.array([root] * size), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded], pa.bool_()),
        ]
        names = [*carry, leaf, "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table([*[left.column(i) for i in range(len(carry) + 1)], *made_columns], names=names)

    schema = ", ".join(f"`{c}` {k}" for c, k in zip(carry, kinds)) + f", `{leaf}` string, {PROOF}"
    return kept.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(run, schema)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ("doc_id", "source", "lang", "n_chars")
    tampered = leaf_digest(*fields, F.translate("text", UPPER, LOWER))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_digest(*fields, "text").alias("leaf"), F.when(chosen, tampered).alias("claimed"))
    made = manifest(leaves, "source", ["doc_id"])
    return prove(made, made.rows, ["doc_id"])


_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)))"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen(CAST({f} AS VARCHAR)), ':', CAST({f} AS VARCHAR)) END" for f in fields]
    return f"sha256(concat({', '.join(parts)}))"


# Nodes level by level; a node's siblings are those of its run, and a proof walks up through them.
OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claimed FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM docs
), trees AS (
  SELECT tree, 0 AS level, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM trees WHERE n > 1 GROUP BY tree, level, pos // 16, n
), subroots AS (SELECT tree, node AS subroot FROM trees WHERE n = 1),
over_ AS (
  SELECT 0 AS level, tree AS pos, subroot AS node, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM over_ WHERE n > 1 GROUP BY level, pos // 16, n
), nodes AS (SELECT tree, level, pos, node FROM trees WHERE n > 1 UNION ALL SELECT -1, level, pos, node FROM over_ WHERE n > 1),
runs AS (SELECT tree, level, pos // 16 AS run, list(node ORDER BY pos) AS digests FROM nodes GROUP BY ALL),
steps AS (
  SELECT p.tree AS t, p.pos AS leaf_pos, false AS over_top, r.level, (p.pos // CAST(pow(16, r.level) AS BIGINT)) % 16 AS m, r.digests
  FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.pos // CAST(pow(16, r.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.tree, p.pos, true, r.level, (p.tree // CAST(pow(16, r.level) AS BIGINT)) % 16, r.digests
  FROM placed p JOIN runs r ON r.tree = -1 AND r.run = p.tree // CAST(pow(16, r.level + 1) AS BIGINT)
), paths AS (
  SELECT t, leaf_pos, list({{'m': m, 'digests': digests}} ORDER BY over_top, level) AS path,
    string_agg(array_to_string(list_concat(digests[: m], digests[m + 2 :]), ''), '' ORDER BY over_top, level) AS proof FROM steps GROUP BY t, leaf_pos
), walked AS (
  SELECT p.tree, p.pos, coalesce(p.claimed, p.leaf) AS node, coalesce(w.path, []) AS path, 1 AS i
  FROM placed p LEFT JOIN paths w ON w.t = p.tree AND w.leaf_pos = p.pos
  UNION ALL
  SELECT tree, pos, sha256(array_to_string(list_concat(list_append(path[i].digests[: path[i].m], node), path[i].digests[path[i].m + 2 :]), '')), path, i + 1
  FROM walked WHERE i <= len(path)
), folded AS (SELECT tree, pos, node FROM walked WHERE i = len(path) + 1)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT node FROM over_ WHERE n = 1) AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
  f.node AS folded_root, f.node = (SELECT node FROM over_ WHERE n = 1) AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN folded f ON f.tree = p.tree AND f.pos = p.pos
LEFT JOIN paths w ON w.t = p.tree AND w.leaf_pos = p.pos
"""
