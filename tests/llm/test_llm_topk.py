import math
import random

import duckdb

from weblode.llm import topk


def brute(rows, k):
    used = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.setdefault(i, []).append([math.floor(64 * x) for x in v])
    flat = [(i, v) for i, vs in used.items() for v in vs]
    out = []
    for i, q in flat:
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in flat if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, k=20):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS bucket", "'a' AS norm", "2 AS salt")
    used = topk.quantized(frame, "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.search(used.where("id % 20 = 0"), used, k).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(150)]
    rows += [(200 + i, [x * rng.choice([0.1, 1, 9]) for x in rows[i][1]]) for i in range(60)]
    rows += [(300 + i, rows[0][1]) for i in range(50)]  # a hot vector
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, [0.0] * 6), (1100, [-5.0] * 6)]
    assert found(spark, rows) == brute(rows, 20)


def test_few_rows_unequal_sizes_and_large_values(spark):
    rows = [(0, [1.0, 2.0]), (20, [3.0]), (21, []), (22, [-1.0, -1.0, 5.0]), (40, [3e6, -2e6]), (41, [2e6, 3e6])]
    assert found(spark, rows) == brute(rows, 20)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []


def test_query_matches_sql(spark, sf):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = topk.op9_topk(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(connection.execute(topk.OP9_SQL).fetchall())
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_vectors_are_shuffled_by_group_and_never_broadcast(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("QUERY_ROWS", 4), ("TILE", 2), ("STRETCH", 3), ("GROUPS", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(5)]) for i in range(400)]
    rows += [(1000 + 20 * i, rows[20][1]) for i in range(30)]  # repeated vectors, which Parquet packs small
    used = topk.quantized(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    got = topk.search(used.where("id % 20 = 0"), used, 5)
    # Tables of blocks look small to Spark; what they hold may not go through the driver.
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)
