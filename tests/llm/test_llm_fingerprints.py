import hashlib

import pytest
from pyspark.sql import functions as F

from weblode.llm import fingerprints as fp


def sets(text):
    words = (text or "").encode().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sketches(spark, rows, **options):
    frame = fp.with_sketch(spark.createDataFrame(rows, "id int, text string"), "text", "sketch", **options)
    return {r.id: r.sketch for r in frame.collect()}


def test_small_texts_are_exact(spark, prose):
    texts = [None, "", " \n", "a", "a b c d", "a b c d e", "a  b\tc\nd e", "a b c d e f", prose(1, 120), prose(1, 120) + " more"]
    got = sketches(spark, list(enumerate(texts)))
    assert [len(got[i]) for i in range(len(texts))] == [len(sets(t)) for t in texts]
    assert got[5] == got[6] and all(s == sorted(set(s)) and all(0 <= x < 2**63 for x in s) for s in got.values())
    pairs = [(i, j, got[i], got[j]) for i in range(len(texts)) for j in range(len(texts))]
    frame = spark.createDataFrame(pairs, "i int, j int, a array<bigint>, b array<bigint>")
    for r in frame.select("i", "j", fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_count(F.col("a")).alias("n")).collect():
        a, b = sets(texts[r.i]), sets(texts[r.j])
        assert r.r == pytest.approx(similarity(a, b)) and r.n == len(a)
        assert r.c == pytest.approx(len(a & b) / len(a) if a else 1.0)


def test_estimates_and_text_form(spark, prose):
    a, b = prose(1, 4000), " ".join(prose(1, 4000).split()[1000:] + prose(2, 1000).split())
    got = sketches(spark, [(0, a), (1, b)], k=512)
    assert len(got[0]) == 512
    frame = spark.createDataFrame([(got[0], got[1])], "a array<bigint>, b array<bigint>")
    x, y = F.col("a"), F.col("b")
    row = frame.select(
        fp.resemblance(x, y, 512).alias("r"), fp.containment(x, y, 512).alias("c"), fp.distinct_count(x, 512).alias("n"), fp.from_text(fp.to_text(x)).alias("back"), "a"
    ).first()
    A, B = sets(a), sets(b)
    assert row.r == pytest.approx(similarity(A, B), abs=0.08) and row.c == pytest.approx(len(A & B) / len(A), abs=0.12)
    assert row.n == pytest.approx(len(A), rel=0.15) and row.back == row.a


def test_merged_parts_are_the_whole(spark, prose):
    words = prose(3, 900).split()
    # Parts overlap by four words, so that no shingle is lost.
    parts = [("k", " ".join(words[i : i + 104])) for i in range(0, 900, 100)] + [("k", None), ("e", ""), (None, "a b")]
    frame = fp.with_sketch(spark.createDataFrame(parts, "key string, text string"), "text", "sketch")
    merged = {r.key: r.sketch for r in fp.merge(frame, ["key"], "sketch").collect()}
    whole = sketches(spark, [(0, " ".join(words)), (1, "a b")])
    assert merged == {"k": whole[0], "e": [], None: whole[1]}


def edited(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or ""))
    out = []
    for place, i in enumerate(order):
        text, following = rows[i][1] or "", rows[order[(place + 1) % len(order)]][1] or ""
        n = len(text) // 4
        out.append((rows[i][0], len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest(), len(sets(following))))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_and_next(make, odd, prose, monkeypatch, parts):
    monkeypatch.setattr(fp, "shuffle_partitions", lambda spark: parts)
    for rows in (odd, [(5 * i % 97, prose(i, i % 9)) for i in range(60)], [(3, "only one row")], [(1, "a"), (1, "b"), (1, "c")], []):
        got = fp.edited_fingerprints(make(rows), k=100_000).collect()
        assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, len(r.next_sketch))) for r in got) == edited(rows)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = fp.op5_fingerprints(spark, sf)
    assert not any(x in frame._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    rows = {r.doc_id: r for r in frame.collect()}
    docs.sort()
    by_text = {}
    for place, (i, text) in enumerate(docs):
        following, n, r = docs[(place + 1) % len(docs)][1], len(text) // 4, rows[i]
        changed = text[: len(text) - n] + following[:n]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(similarity(sets(text), sets(changed)), abs=0.2)
        assert r.near_next == pytest.approx(similarity(sets(text), sets(following)), abs=0.2)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
