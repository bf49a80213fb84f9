import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from weblode.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def canonical(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """(last node, joined siblings of each leaf on its way up)."""
    proofs, at = ["" for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[i] += "".join(run[: p % 16] + run[p % 16 + 1 :])
        at = [p // 16 for p in at]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute(rows):
    """(id, leaf, subroot, root, proof) of rows (id, source, leaf)."""
    first = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x.encode())
    groups = defaultdict(list)
    for i, source, leaf in rows:
        groups[source].append((i, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        inside = sorted(groups[source], key=lambda r: (first(r[0]), r[1]))
        trees.append((inside, *climb([leaf for _, leaf in inside])))
    root, above = climb([t[1] for t in trees])
    return sorted(
        repr((i, leaf, subroot, root, h(proof + up))) for (inside, subroot, proofs), up in zip(trees, above) for (i, leaf), proof in zip(inside, proofs)
    )


def leaves(frame):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    return frame.select("doc_id", "source", merkle.leaf_digest(*fields).alias("leaf"), F.lit(None).cast("string").alias("claimed"), F.lit(1).alias("pos_"))


def proved(frame):
    made = merkle.manifest(leaves(frame), "source", ["doc_id"])
    return merkle.prove(made, made.rows, ["doc_id"]).collect()


@pytest.mark.parametrize("levels", [1, 3])
def test_against_brute_force(spark, make, prose, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rows = [(i, prose(i, 3), "en", "hot") for i in range(700)] + [(1000 + i, prose(i, 2), None, f"s{i % 40}") for i in range(90)]
    rows += [(2000 + i, "", "de", None) for i in range(17)] + [(3000, "x", "de", "é"), (3001, "x", "de", "z")]
    got = proved(make(rows))
    wanted = brute([(i, s, h(*map(canonical, (i, s, k, len(t), t)))) for i, t, k, s in rows])
    assert sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256)) for r in got) == wanted
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_odd_rows(make, odd):
    rows = [(*r, "en", "a") for r in odd] + [(1, "one", None, None), (5, "é", None, "b"), (5, "É", None, "b")]
    got = proved(make(rows))
    wanted = brute([(i, s, h(*map(canonical, (i, s, k, len(t or ""), t)))) for i, t, k, s in rows])
    assert sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256)) for r in got) == wanted


def test_one_row_and_empty_table(make):
    (row,) = proved(make([(1, "x")]))
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h("") and row.verified
    assert proved(make([])) == []


def test_proofs_of_a_few_rows_fetch_what_they_lack(make, prose):
    frame = make([(i, prose(i, 3), "en", "a" if i % 3 else "b") for i in range(900)])
    made = merkle.manifest(leaves(frame), "source", ["doc_id"])
    every = {r.doc_id: r for r in merkle.prove(made, made.rows, ["doc_id"]).collect()}
    some = merkle.prove(made, made.rows.where("doc_id IN (7, 8, 500)"), ["doc_id"]).collect()
    assert {r.doc_id: r for r in some} == {i: every[i] for i in (7, 8, 500)}
    # Neighbours share a run: their union lacks 14 leaves, not twice 15.
    assert merkle.missing({0, 1}, 16) == [(0, 0, list(range(2, 16)))]
    assert merkle.missing(set(range(16)), 17) == [(1, 0, [1])] and merkle.missing({16}, 17) == [(1, 0, [0])]
    assert merkle.missing({3}, 1) == []


def test_changed_leaves_do_not_verify(make, prose):
    frame = make([(i, prose(i, 3), "en", f"s{i % 2}") for i in range(60)])
    claimed = F.when(F.col("doc_id") == 17, F.sha2(F.lit("other"), 256)).when(F.col("doc_id") == 18, F.col("leaf"))
    made = merkle.manifest(leaves(frame).withColumn("claimed", claimed), "source", ["doc_id"])
    got = {r.doc_id: r for r in merkle.prove(made, made.rows, ["doc_id"]).collect()}
    assert [i for i, r in got.items() if not r.verified] == [17] and got[17].folded_root != got[17].root


def test_query_matches_sql(spark, sf):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = merkle.op12_merkle(spark, sf)
    rows = got.collect()
    wanted = connection.execute(merkle.OP12_SQL)
    assert [d[0] for d in wanted.description] == got.columns
    assert sorted(map(tuple, rows)) == sorted(wanted.fetchall())
    assert all(r.verified or zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
