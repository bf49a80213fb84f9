import random
from collections import Counter

import numpy as np
import pytest

from weblode.llm import jaccard


def sets(text):
    words = (text or "").encode().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(texts, threshold=0.8):
    """Links of each distinct text and the connected classes."""
    distinct = sorted({t or "" for t in texts})
    known = {t: sets(t) for t in distinct}
    linked = {t: [o for o in distinct if o != t and similarity(known[t], known[o]) >= threshold] for t in distinct}
    classes = {}
    for start in distinct:
        waiting = [start] if start not in classes else []
        while waiting:
            t = waiting.pop()
            if t not in classes:
                classes[t] = start
                waiting += linked[t]
    return linked, classes


def check(rows, got):
    linked, classes = brute([t for _, t in rows])
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, t or "")
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, set()).add(classes[by_id[r.doc_id]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(classes.values()))
    for r in got:
        assert r.n_links == len(linked[by_id[r.doc_id]]), r
        assert by_id[r.text_id] == by_id[r.doc_id]
    copies = Counter(t or "" for _, t in rows)
    assert all(r.n_copies == copies[by_id[r.doc_id]] - 1 for r in got)
    kept = {by_id[r.doc_id] for r in got if r.keep}
    assert len(kept) == len(groups)


@pytest.mark.parametrize("block", [128, 8])
def test_against_brute_force(make, prose, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(1)
    base = prose(1, 160).split()

    def edited(n):
        words = list(base)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(0, " ".join(base))] + [(i, edited(rng.choice([0, 1, 1, 2, 3]))) for i in range(1, 60)]
    rows += [(100 + i, prose(100 + i, 60)) for i in range(30)]
    rows += [(200 + i, prose(100 + i, 60) + (" tail end of it" if i % 2 else "")) for i in range(15)]
    # A chain: each like the next, the ends unlike.
    chain = prose(7, 200).split()
    rows += [(300 + i, " ".join(chain[6 * i : 6 * i + 100])) for i in range(12)]
    rows += [(400, "one two three"), (401, "one two three"), (402, "one two four"), (403, "one two three four five six")]
    check(rows, jaccard.near_duplicates(make(rows)).collect())


def test_crowded_template_group(make, prose, monkeypatch):
    """Boilerplate texts at 0.75 share their prefixes; pairs at 0.86 among them must meet, side by side or not."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    base = prose(1, 300)
    rows = []
    for i in range(300):
        tail = prose(1000 + i, 50).split()
        rows.append((i, f"{base} {' '.join(tail)}"))
        if i % 6 == 0:
            rows.append((1000 + i, f"{base} {' '.join(tail[:25])} {prose(5000 + i, 25)}"))
    # A class that fills blocks of its own.
    words = prose(9, 300).split()
    rows += [(2000 + i, " ".join([*words[: i % 140 + 80], f"new{i}", *words[i % 140 + 81 :]])) for i in range(150)]
    check(rows, jaccard.near_duplicates(make(rows)).collect())


def test_odd_rows(make, odd):
    got = jaccard.near_duplicates(make(odd)).collect()
    assert len(got) == len(odd)
    by_class = Counter(r.class_id for r in got if r.doc_id in (4, 5))
    assert list(by_class.values()) == [3]
    assert {r.n_links for r in got} == {0}
    frame = make(odd)
    kept = jaccard.without_near_duplicates(frame)
    assert kept.dtypes == frame.dtypes
    assert Counter((r.text or "") for r in kept.collect()) == Counter({t or "": 1 for _, t in odd})
    assert jaccard.near_duplicates(make([])).count() == 0 and jaccard.without_near_duplicates(make([])).count() == 0


def test_recall_at_the_threshold():
    least = jaccard.least_prefix()
    assert 1 - (1 - 0.8**least) ** jaccard.TREES >= jaccard.TARGET_RECALL
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(150):
        pool = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.sort(pool[:180]), np.sort(pool[20:])
        assert jaccard.jaccard(a, b) == 0.8
        x, y = (jaccard.signature(s).reshape(jaccard.TREES, jaccard.DEPTH)[:, :least] for s in (a, b))
        met += (x == y).all(axis=1).any()
    assert met >= 146


def test_components_of_paths_and_stars(spark):
    links = [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("s0", f"s{i}") for i in range(1, 30)] + [("z", "a")]
    frame = spark.createDataFrame(links, "a string, b string")
    got = {r.key: r["class"] for r in jaccard.components(frame).collect()}
    assert all(got[f"p{i:03}"] == "p000" for i in range(41)) and all(got[f"s{i}"] == "s0" for i in range(30))
    assert got["z"] == got["a"] == "a" and len(got) == 73
    assert jaccard.components(frame.limit(0)).count() == 0


def test_pieces_of_a_long_text(prose, monkeypatch):
    data = prose(3, 3000).encode()
    whole = jaccard.shingles(data)
    monkeypatch.setattr(jaccard, "PIECE", 500)
    assert (jaccard.shingles(data) == whole).all() and len(whole) == len(sets(data.decode()))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(docs, jaccard.op3_jaccard(spark, sf).collect())


def test_parts_without_any_word(make):
    rows = [(i, t) for i, t in enumerate([None, "", "  ", None, "\n"])]
    frame = make(rows).repartition(3).unionByName(make([(10, "one two three four five six seven")]).coalesce(1))
    assert sorted(r.doc_id for r in jaccard.without_near_duplicates(frame).collect()) == [0, 2, 4, 10]
    assert jaccard.near_duplicates(make(rows).coalesce(1)).count() == 5


def test_own_columns_come_back(make):
    frame = make([(1, "a b c d e f g"), (2, "a b c d e f g")]).selectExpr("*", "doc_id + 5 AS _key", "'k' AS _kept", "7 AS _id")
    kept = jaccard.without_near_duplicates(frame)
    assert kept.columns == frame.columns and [(r.doc_id, r._key, r._kept, r._id) for r in kept.collect()] == [(1, 6, "k", 7)]


@pytest.mark.parametrize("block", [4, 1 << 17])
def test_components_of_a_chain_in_blocks(spark, monkeypatch, block):
    """Links of one block are connected in one step; a chain over many blocks comes out the same."""
    monkeypatch.setattr(jaccard, "LINKS", block)
    steps, stage = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: steps.append(name) or stage(df, name))
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(30)] + [("x", "y"), ("x", "y"), ("z", "x"), ("w", "w")]
    found = jaccard.components(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert sorted((r["key"], r["class"]) for r in found) == sorted([(f"{i:03d}", "000") for i in range(31)] + [(k, "x") for k in "xyz"])
    assert block == 4 or len(steps) == 1
    assert jaccard.components(spark.createDataFrame([], "a string, b string")).count() == 0
