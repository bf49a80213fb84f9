import math
import random

import duckdb
import numpy as np
import pytest

from weblode.llm import negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 130), (0, 4, 5), (70, 0, 40), (200, 64, 129)])
def test_strassen(shape, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 4)
    n, k, m = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**20), 2**20, (n, k)), rng.integers(-(2**20), 2**20, (k, m))
    assert (negatives.strassen(a, b) == a @ b).all()
    # Sums may pass 64 bits on the way; the product itself does not.
    big = np.full((40, 2), 2**62 - 1)
    assert (negatives.strassen(big, np.array([[1] * 40, [-1] * 40])) == 0).all()


def brute(rows):
    used = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, k in used:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), j, other) for j, c, other in used]
        for ps, p, _ in sorted((s, j, o) for s, j, o in scored if o == k and j != i)[:5]:
            inside = sorted((s, j) for s, j, o in scored if o != k and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(i, p, rank, j, -ps, -s) for rank, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS block", "'a' AS place", "2 AS stretch")
    used = negatives.quantized(frame, "vec_id", "embedding", "label")
    return sorted(tuple(r) for r in negatives.mine(used.where("id % 100 = 0"), used).collect())


def test_against_brute_force(spark, monkeypatch):
    for name, value in {"ANCHOR_ROWS": 3, "BLOCK_ROWS": 37, "STRETCH": 2, "LEAF": 4}.items():
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i * 10, [c + rng.gauss(0, 0.3) for c in centres[i % 4]], rng.choice([0, 0, 0, 1, 2])) for i in range(160)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(30)]  # equal vectors
    rows += [(7000, None, 1), (7100, [1.0, None], 1), (7200, [float("nan")] * 6, 0), (7300, [0.5] * 6, None), (7400, [0.0] * 6, 2), (7500, [-9.0] * 6, 3), (7600, [1.0], 0)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 200


def test_few_rows_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [2.0, 2.0], 1), (2, [1.0, 0.5], 2), (2, [1.0, 0.5], 2), (100, [], 1), (300, [1.0], 5)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert found(spark, [(0, [1.0], 1)]) == [] and found(spark, []) == []


def test_query_matches_sql(spark, sf):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = negatives.op13_negatives(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(connection.execute(negatives.OP13_SQL).fetchall())
    kinds = [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert got.dtypes == kinds
