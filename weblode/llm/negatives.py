"""Hard-negative mining: exact scores of anchors against all rows by tiled Strassen products.

Vectors become integers (``floor(scale * x)``). Anchors and candidates are packed into
blocks, and a task multiplies one block of anchors with a stretch of candidate blocks, tile
by tile: tiles are padded with zeros to even sizes and multiplied by Strassen's seven
products, recursively, down to ``LEAF``. Additions are exact in 64-bit integers; sums that
pass 64 bits on the way wrap around, which is exact modulo 2**64, so only the scores
themselves have to fit.

Two rounds read the tiles. The first keeps for each anchor a heap of its best rows of the
same label, its positives. They set the window of scores a negative may have; the second
round keeps for each anchor and positive a heap of the best rows of other labels inside
that window. Heaps of tiles are merged inside the task, then those of all tasks by key;
each holds a fixed number of rows, so what is shuffled does not depend on the label's size.

Cases: rows with a null label, a null vector, or a null or non-finite component take no
part; vectors of unequal size count as padded with zeros; equal scores are ordered by
smaller id; equal vectors and a label that holds most rows are rows like others; every row
whose id repeats is an anchor of its own, but rows of the anchor's own id are not its
positives; anchors without positives, windows without rows (those of negative positive
scores are empty) and empty tables give no rows. Extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Negatives score between these hundredths of the positive's score.
WINDOW = (30, 90)
ANCHOR_ROWS = 1024
BLOCK_ROWS = 2048
#: Candidate blocks that a task goes through with one block of anchors.
STRETCH = 4
#: Tiles with a side of at most this are multiplied directly.
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= LEAF:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b)[:n, :m]
    i, j, h = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((n, m), np.int64)
    out[:i, :h], out[:i, h:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :h], out[i:, h:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def products(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of every anchor with every vector; the shorter vectors are padded with zeros."""
    width = max(anchors.shape[1], vectors.shape[1])
    anchors, vectors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, vectors))
    return strassen(anchors, np.ascontiguousarray(vectors.T))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in order, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        inside = np.flatnonzero(scores >= edge)
    else:
        inside = np.arange(len(scores))
    return inside[np.lexsort((ids[inside], -scores[inside]))[:k]]


def merged(heap: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a heap (scores, ids) and more rows."""
    scores, ids = np.concatenate([heap[0], scores]), np.concatenate([heap[1], ids])
    chosen = best(scores, ids, k)
    return scores[chosen], ids[chosen]


_NOTHING = (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives, and the hundredths of the positive's score between which negatives lie."""

    positives: int = POSITIVES
    negatives: int = NEGATIVES
    window: tuple[int, int] = WINDOW

    def bounds(self, score: int) -> tuple[int, int]:
        """Least and largest score of a negative."""
        low, high = self.window
        return -(-low * score // 100), high * score // 100


def quantized(df: DataFrame, id_col: str, vector_col: str, label: str | Column, scale: int = SCALE) -> DataFrame:
    """id, vector (array of bigint) and label of the rows that take part."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    kept = df.where(F.col(vector_col).isNotNull() & usable)
    return kept.select(F.col(id_col).cast("bigint").alias("id"), whole.alias("vector"), label.cast("bigint").alias("label")).where("label IS NOT NULL")


def _packed(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """(block, ids, labels, dims, matrix of each block, how many blocks)."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector", F.monotonically_increasing_id()), F.lit(blocks)))

    def run(table: pa.Table) -> pa.Table:
        vectors = table.column("vector").combine_chunks()
        sizes = np.asarray(vectors.value_lengths())
        dims = int(sizes.max(initial=0))
        matrix = np.zeros((len(sizes), dims), np.int64)
        matrix[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        as_bytes = [np.ascontiguousarray(table.column(c).to_numpy(), np.int64).tobytes() for c in ("id", "label")]
        return pa.table({"block": [table.column("block")[0].as_py()], "ids": [as_bytes[0]], "labels": [as_bytes[1]], "dims": [dims], "matrix": [matrix.tobytes()]}, schema=_PACKED)

    return dealt.groupBy("block").applyInArrow(run, PACKED), blocks


PACKED = "block bigint, ids binary, labels binary, dims int, matrix binary"
_PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("dims", pa.int32()), ("matrix", pa.binary())])


def _unpacked(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(table.column(c)[i].as_py(), np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(table.column("matrix")[i].as_py(), np.int64).reshape(len(ids), table.column("dims")[i].as_py())


def _cells(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (anchor block, stretch of candidate blocks): one group is one task's work."""
    stretches = -(-n_blocks // STRETCH)
    left = anchors.select(F.col("block").alias("anchor_block"), F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))).alias("stretch"), "ids", "labels", "dims", "matrix")
    right = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("anchor_block"), F.floor(F.col("block") / STRETCH).cast("int").alias("stretch"),
        "block", "ids", "labels", "dims", "matrix",
    )
    left = left.withColumn("anchor_block", F.col("anchor_block").cast("int"))
    return left, right


FOUND = "anchor_block int, anchor_row int, anchor_id bigint, vec_id bigint, score bigint"
_FOUND = pa.schema([("anchor_block", pa.int32()), ("anchor_row", pa.int32()), ("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def positives(left: DataFrame, right: DataFrame, rule: Rule) -> DataFrame:
    """anchor_block, anchor_row, anchor_id, place, positive_id, positive_score of each anchor's best rows of its label."""

    def run(key: tuple, anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        if not anchors.num_rows or not blocks.num_rows:
            return _FOUND.empty_table()
        ids, labels, matrix = _unpacked(anchors, 0)
        heaps = [_NOTHING] * len(ids)
        for i in range(blocks.num_rows):
            others, other_labels, vectors = _unpacked(blocks, i)
            scores = products(matrix, vectors)
            for a in range(len(ids)):
                same = np.flatnonzero((other_labels == labels[a]) & (others != ids[a]))
                heaps[a] = merged(heaps[a], scores[a, same], others[same], rule.positives)
        sizes = [len(s) for s, _ in heaps]
        rows = np.repeat(np.arange(len(ids)), sizes)
        return pa.table([
            pa.array(np.full(len(rows), key[0].as_py()), pa.int32()), pa.array(rows, pa.int32()), pa.array(ids[rows], pa.int64()),
            pa.array(np.concatenate([x for _, x in heaps]), pa.int64()), pa.array(np.concatenate([s for s, _ in heaps]), pa.int64()),
        ], schema=_FOUND)

    keys = ("anchor_block", "stretch")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)
    place = F.expr("row_number() OVER (PARTITION BY anchor_block, anchor_row ORDER BY score DESC, vec_id)")
    kept = found.withColumn("place", place).where(F.col("place") <= rule.positives)
    return kept.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"})


MINED = "anchor_block int, anchor_row int, place int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
_MINED = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in MINED.split(", ")])


def negatives(left: DataFrame, right: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """The best rows of other labels inside each positive's window, with their rank."""
    windows = found.groupBy("anchor_block").agg(
        F.sort_array(F.collect_list(F.struct("anchor_row", "place", "positive_id", "positive_score"))).alias("windows")
    )  # at most ANCHOR_ROWS * rule.positives entries
    armed = left.join(windows, "anchor_block").select(*left.columns, "windows")

    def run(key: tuple, anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        if not anchors.num_rows or not blocks.num_rows:
            return _MINED.empty_table()
        ids, labels, matrix = _unpacked(anchors, 0)
        wanted = [(w, *rule.bounds(w["positive_score"])) for w in anchors.column("windows")[0].as_py()]
        wanted = [x for x in wanted if x[1] <= x[2]]
        heaps = [_NOTHING] * len(wanted)
        used = sorted({w["anchor_row"] for w, _, _ in wanted})
        at = {a: i for i, a in enumerate(used)}
        for i in range(blocks.num_rows if used else 0):
            others, other_labels, vectors = _unpacked(blocks, i)
            scores = products(matrix[used], vectors)
            for j, (w, low, high) in enumerate(wanted):
                row = scores[at[w["anchor_row"]]]
                inside = np.flatnonzero((row >= low) & (row <= high) & (other_labels != labels[w["anchor_row"]]))
                heaps[j] = merged(heaps[j], row[inside], others[inside], rule.negatives)
        out = [
            (key[0].as_py(), w["anchor_row"], w["place"], int(ids[w["anchor_row"]]), w["positive_id"], w["positive_score"], int(n), int(s))
            for (w, _, _), (top, who) in zip(wanted, heaps) for s, n in zip(top, who)
        ]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out), _MINED)], schema=_MINED) if out else _MINED.empty_table()

    keys = ("anchor_block", "stretch")
    mined = armed.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, MINED)
    rank = F.expr("row_number() OVER (PARTITION BY anchor_block, anchor_row, place ORDER BY negative_score DESC, negative_id)")
    return mined.withColumn("rank", rank).where(F.col("rank") <= rule.negatives)


def mine(anchors: DataFrame, candidates: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both sides as ``quantized`` gives them."""
    packed_anchors, n_anchors = _packed(anchors, ANCHOR_ROWS)
    packed, n_blocks = _packed(candidates, BLOCK_ROWS)
    left, right = _cells(stage(packed_anchors, "anchors"), stage(packed, "candidates"), n_anchors, n_blocks)
    found = stage(positives(left, right, rule), "positives")
    mined = negatives(left, right, found, rule)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    used = stage(quantized(rows, "vec_id", "embedding", label), "vectors")
    return mine(used.where(F.col("id") % 100 == 0), used)


OP13_SQL = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM used a JOIN used c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
