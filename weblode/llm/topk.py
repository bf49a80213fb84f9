"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors become integers (``floor(scale * x)``). Candidates are grouped by length into
norm buckets between quantiles, each bucket in blocks of bounded size (a bucket that holds
a third of all vectors is many blocks). Queries are packed into blocks too. A first pass
compares every query with the longest vectors and takes its k-th score as a floor. A
second pass pairs query blocks with the candidate blocks that can still reach a floor: a
group holds a tile of query blocks and a stretch of candidate blocks, and floors rise from
one block to the next. Both sides of a group are shuffled by its key and of bounded size;
no table that holds vectors is ever broadcast, whatever size Spark takes it for.
Inside a pair each query turns its floor into a local cosine threshold for the block and
prunes by length (scan the longest vectors while their length can reach the floor) or by
coordinates (the values a vector at that cosine can have in the query's largest
coordinates), then verifies the products of what is left.

Every bound is exact with a margin for rounding, so the result is exact. Cases: vectors
that are null, or hold a null or a non-finite component, take no part; vectors of unequal
size count as padded with zeros; equal vectors tie and rank by smaller id; repeated ids
are rows of their own, but a query never meets rows of its own id; queries with fewer
than k candidates get all; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import stage

SCALE = 64
BUCKETS = 64
BLOCK_ROWS = 2048
QUERY_ROWS = 512
#: Query blocks, and candidate blocks at most, that meet in a group.
TILE = 32
STRETCH = 16
#: Stretches are shorter than that if there are fewer groups than this, and groups share that many shuffle partitions at most.
GROUPS = 96
PARTITIONS = 2000
FOCUS = 3
#: Below this local cosine coordinates exclude little, and length alone prunes.
COORDINATE_FROM = 0.35
#: Products of integers are exact in doubles up to here.
EXACT = 2.0**52


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, vector (array of bigint) and norm of the rows that take part."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    kept = df.where(F.col(vector_col).isNotNull() & usable).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    return kept.withColumn("norm", F.sqrt(square))


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each block: keys, ids, dims and the matrix as bytes, longest vectors first."""
    schema = ", ".join(f"{k} int" for k in keys) + ", n int, dims int, ids binary, norms binary, matrix binary"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["norm", "id"], ascending=[False, True], kind="stable")
        dims = max((len(v) for v in frame["vector"]), default=0)
        matrix = np.zeros((len(frame), dims), np.int64)
        for i, vector in enumerate(frame["vector"]):
            matrix[i, : len(vector)] = vector
        small = np.abs(matrix).max(initial=0) < 2**15
        row = {k: [int(v)] for k, v in zip(keys, key)}
        row |= {"n": [len(frame)], "dims": [dims if small else -dims]}
        row |= {"ids": [frame["id"].to_numpy("int64").tobytes()], "norms": [frame["norm"].to_numpy("float64").tobytes()]}
        row |= {"matrix": [matrix.astype(np.int16 if small else np.int64).tobytes()]}
        return pd.DataFrame(row)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def _matrix(n: int, dims: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int16 if dims >= 0 else np.int64).reshape(n, abs(dims)).astype(np.int64)


def best_in_block(query: np.ndarray, query_id: int, floor: float, ids: np.ndarray, vectors: np.ndarray,
                  floats: np.ndarray, norms: np.ndarray, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of at most k candidates that score at least ``floor``; blocks are ordered by falling norm."""
    length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
    none = np.empty(0, np.int64)
    if not len(ids):
        return none, none
    end = len(ids)
    chosen = None
    if floor > 0:
        if length == 0 or length * norms[0] * (1 + 1e-9) < floor:
            return none, none
        # Length: vectors past ``end`` are too short to reach the floor.
        end = int(np.searchsorted(-norms * (1 + 1e-9), -floor / length, side="right"))
        local = floor / (length * norms[0])
        if local >= COORDINATE_FROM:
            unit = query / length
            near = np.ones(end, bool)
            for f in np.argsort(-np.abs(unit))[:FOCUS]:
                # A unit vector at cosine t or more has this coordinate within t*u -+ sqrt((1-t2)(1-u2));
                # it may be exceeded up to the query's own direction, where the cosine is 1.
                t, u = min(1.0, local) - 1e-9, unit[f]
                reach = float(np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - u * u))) + 1e-9
                low = t * u - reach if u > -t else -1.0
                high = t * u + reach if u < t else 1.0
                near &= (units[:end, f] >= low) & (units[:end, f] <= high)
            chosen = np.flatnonzero(near)
    part = slice(0, end) if chosen is None else chosen
    if length * norms[0] < EXACT:
        scores = (floats[part] @ query.astype(np.float64)).astype(np.int64)
    else:
        scores = vectors[part] @ query
    found = ids[part]
    keep = found != query_id
    if floor != -np.inf:
        keep &= scores >= floor
    found, scores = found[keep], scores[keep]
    if len(found) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        found, scores = found[scores >= edge], scores[scores >= edge]
    order = np.lexsort((found, -scores))[:k]
    return found[order], scores[order]


FOUND = "query_block int, query_row int, query_id bigint, vec_id bigint, score bigint"
_FOUND = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in FOUND.split(", ")])
QUERY_COLUMNS = ["query_block", "q_n", "q_dims", "q_ids", "q_norms", "q_matrix"]
_QUERY_KINDS = "query_block int, q_n int, q_dims int, q_ids binary, q_norms binary, q_matrix binary"


class _Block:
    """A candidate block, ready to be compared with queries."""

    def __init__(self, n: int, dims: int, ids: bytes, norms: bytes, matrix: bytes):
        self.vectors, self.ids, self.norms = _matrix(n, dims, matrix), np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64)
        self._floats()

    def _floats(self) -> None:
        self.floats = self.vectors.astype(np.float64)
        self.units = self.floats / np.maximum(self.norms, 1e-300)[:, None]

    def best(self, queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``best_in_block`` of each query."""
        width = max(queries.shape[1], self.vectors.shape[1])
        if width > self.vectors.shape[1]:
            self.vectors = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))
            self._floats()
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        return [best_in_block(q, i, t, self.ids, self.vectors, self.floats, self.norms, self.units, k) for q, i, t in zip(queries, ids, floors)]


def _listed(query_block: int, query_ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Columns of ``FOUND`` for the (ids, scores) of each query of a block."""
    size = [len(x) for x, _ in found]
    return {
        "query_block": np.full(sum(size), query_block, np.int32), "query_row": np.repeat(np.arange(len(found), dtype=np.int32), size),
        "query_id": np.repeat(query_ids, size), "vec_id": np.concatenate([x for x, _ in found] or [np.empty(0, np.int64)]),
        "score": np.concatenate([x for _, x in found] or [np.empty(0, np.int64)]),
    }


def _compare_with(packed: DataFrame, k: int, block: Broadcast) -> DataFrame:
    """``FOUND`` of every query block beside one candidate block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        candidates = _Block(*block.value)
        for frame in frames:
            for row in frame.itertuples():
                ids = np.frombuffer(row.q_ids, np.int64)
                found = candidates.best(_matrix(row.q_n, row.q_dims, row.q_matrix), ids, np.full(row.q_n, -np.inf), k)
                yield pd.DataFrame(_listed(row.query_block, ids, found))

    return packed.mapInPandas(run, FOUND)


def _compare(queries: DataFrame, candidates: DataFrame, k: int, groups: int) -> DataFrame:
    """``FOUND`` of the query blocks and candidate blocks of each (stretch, tile), the k best of a query there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        ids = [np.frombuffer(r["q_ids"], np.int64) for r in rows]
        floors = [np.frombuffer(r["floors"], np.float64).copy() for r in rows]
        heaps = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * len(x) for x in ids]
        # The longest vectors first: they raise the floors most.
        for i in np.lexsort((right.column("salt").to_numpy(), right.column("bucket").to_numpy())) if rows else ():
            block = _Block(*(right.column(c)[int(i)].as_py() for c in ("n", "dims", "ids", "norms", "matrix")))
            for r, own, floor, heap in zip(rows, ids, floors, heaps):
                for q, (found, scores) in enumerate(block.best(_matrix(r["q_n"], r["q_dims"], r["q_matrix"]), own, floor, k)):
                    if not len(found):
                        continue
                    found, scores = np.concatenate([heap[q][0], found]), np.concatenate([heap[q][1], scores])
                    order = np.lexsort((found, -scores))[:k]
                    heap[q] = found[order], scores[order]
                    if len(order) == k:
                        floor[q] = max(floor[q], heap[q][1][-1])
        listed = [_listed(r["query_block"], own, heap) for r, own, heap in zip(rows, ids, heaps)]
        return pa.Table.from_batches([pa.RecordBatch.from_pydict(x, schema=_FOUND) for x in listed], schema=_FOUND)

    parts = min(groups, PARTITIONS)
    left, right = (x.repartition(parts, "stretch", "tile").groupBy("stretch", "tile") for x in (queries, candidates))
    return left.cogroup(right).applyInArrow(run, FOUND)


def search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query; both sides as ``quantized`` gives them."""
    spark = queries.sparkSession
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    found = candidates.agg(F.percentile_approx("norm", shares, 100 * BUCKETS).alias("bounds")).first()
    bounds = sorted(set(found["bounds"] or []), reverse=True)
    # Bucket 0 holds the longest vectors.
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    bucketed = candidates.withColumn("bucket", F.size(F.filter(edges, lambda b: b > F.col("norm"))))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("rows"), F.max("norm").alias("longest")).collect()  # at most BUCKETS rows
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not sizes:
        return spark.createDataFrame([], schema)
    sizes = sorted((r["bucket"], -(-r["rows"] // BLOCK_ROWS), r["longest"]) for r in sizes)
    blocks_of = F.create_map(*[F.lit(x) for bucket, n, _ in sizes for x in (bucket, n)])
    salt = F.pmod(F.xxhash64("id", "vector"), F.element_at(blocks_of, F.col("bucket"))).cast("int")
    blocks = stage(_blocks(bucketed.withColumn("salt", salt), ["bucket", "salt"]), "candidates")

    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = queries.withColumn("query_block", F.pmod(F.xxhash64("id", "vector"), F.lit(query_blocks)).cast("int"))
    packed = stage(_blocks(dealt, ["query_block"]), "queries").select(
        "query_block", *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "norms", "matrix")]
    )

    # One block of the longest vectors gives the floors: about BLOCK_ROWS vectors, sent to all.
    seed = (F.col("bucket") == sizes[0][0]) & (F.col("salt") == 0)
    block = blocks.where(seed).select("n", "dims", "ids", "norms", "matrix").first()
    block = tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in block) if block else (0, 0, b"", b"", b"")
    first = stage(_compare_with(packed, k, spark.sparkContext.broadcast(block)), "floors")

    # Each query's k-th score so far, in the order of its block.
    kth = first.groupBy("query_block", "query_row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
    kth = kth.groupBy("query_block").agg(F.collect_list(F.struct("query_row", "n", "low")).alias("kth"))
    with_floors = packed.join(kth.hint("merge"), "query_block", "left")

    # Neighbouring blocks make a stretch, the longest vectors in the first one.
    tiles = -(-query_blocks // TILE)
    total = sum(n for _, n, _ in sizes)
    length = max(1, min(STRETCH, total * tiles // GROUPS))
    tops: list[float] = []
    starts, place = {}, 0
    for bucket, n, top in sizes:
        starts[bucket], place = place, place + n
        tops += [top] * (-(-place // length) - len(tops))
    start_of = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                floors = np.full(row.q_n, -np.inf)
                for x in row.kth if row.kth is not None else ():
                    if x["n"] >= k:
                        floors[x["query_row"]] = x["low"]
                lengths = np.frombuffer(row.q_norms, np.float64)
                for stretch, top in enumerate(tops):
                    # Whole stretches that no query of the block can use are left out.
                    if ((floors <= 0) | (lengths * top * (1 + 1e-9) >= floors)).any():
                        yield pd.DataFrame([(*(getattr(row, c) for c in QUERY_COLUMNS), floors.tobytes(), stretch, row.query_block // TILE)],
                                           columns=[*QUERY_COLUMNS, "floors", "stretch", "tile"])

    wanted = with_floors.mapInPandas(spread, f"{_QUERY_KINDS}, floors binary, stretch int, tile int")
    stretch = F.floor((F.element_at(start_of, F.col("bucket")) + F.col("salt")) / length).cast("int")
    others = blocks.where(~seed).withColumns({"stretch": stretch, "tile": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    every = first.unionByName(_compare(wanted, others, k, len(tops) * tiles))
    ranked = every.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_block, query_row ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    rows = stage(quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
    return search(rows.where(F.col("id") % 20 == 0), rows, 20)


OP9_SQL = """
WITH used AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM used q JOIN used c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
