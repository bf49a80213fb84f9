import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weblode.llm import suffixes


def brute(texts, width):
    """(n_bytes, n_removed, n_spans, digest) of each text."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if starts[d[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def found(frame, **options):
    rows = suffixes.find_repeats(frame, **options).collect()
    return sorted(
        (repr(r.row.doc_id), r.n_bytes, r.n_removed, len(r.runs), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows
    )


@pytest.mark.parametrize("r", range(5))
def test_cover_has_every_difference(r):
    cover, v = suffixes.difference_cover(r)
    assert len(cover) == 6 * r + 4
    assert {(int(a) - int(b)) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("width, slot_bytes", [(400, 1 << 20), (400, 3000), (60, 2000), (16, 500)])
def test_against_brute_force(make, prose, width, slot_bytes):
    passage, other = prose(50, 90), prose(51, 70)
    texts = [
        prose(1, 300), prose(1, 300), prose(2, 200), f"{prose(3, 50)} {passage} {prose(4, 50)}", f"{passage} {prose(5, 120)}",
        f"{prose(6, 33)} {passage}", other * 3, prose(7, 150)[:-1], prose(7, 150), "é" * 500, "x" * width, "x" * (width - 1), None, "",
        passage[:-20], f"ß{other}",
    ]
    rows = list(enumerate(texts))
    wanted = sorted((repr(i), *w) for i, w in zip(range(len(texts)), brute(texts, width)))
    assert found(make(rows), width=width, slot_bytes=slot_bytes, buckets=3) == wanted


@pytest.mark.parametrize("width, shorter, slot_bytes", [(400, 200, 1 << 20), (400, 200, 3000), (60, 20, 2000), (60, 50, 900)])
def test_two_widths_against_brute_force(make, prose, width, shorter, slot_bytes):
    passage, other, short = prose(50, 90), prose(51, 70), prose(52, 52)
    texts = [
        prose(1, 300), prose(1, 300), prose(8, 9), prose(8, 9), f"{prose(3, 50)} {passage} {prose(4, 50)}", f"{passage} {prose(5, 120)}", f"{prose(6, 33)} {short} {prose(9, 9)}",
        other * 3, f"{short[2:]} {prose(7, 40)}", "é" * 500, "x" * width, "y" * shorter, "y" * shorter, None, "", passage[:250] + "#" + passage[251:],
    ]
    frame = make(list(enumerate(texts)))
    options = {"width": width, "shorter": shorter, "slot_bytes": slot_bytes, "buckets": 3}
    assert found(frame, **options) == sorted((repr(i), *w) for i, w in enumerate(brute(texts, width)))
    wanted = {i: (removed, spans) for i, (_, removed, spans, _) in enumerate(brute(texts, shorter))}
    rows = suffixes.find_repeats(frame, **options).collect()
    assert {r.row.doc_id: (sum(p.end - p.start for p in r.passages), len(r.passages)) for r in rows} == wanted


def test_passages_have_words(make, prose):
    rng = random.Random(8)
    short = " ".join("".join(rng.choices("abcdefgh", k=rng.choice([2, 3, 4, 5]))) for _ in range(51))
    few = " ".join("".join(rng.choices("abcdefgh", k=30)) for _ in range(9))
    assert len(short) < 300 and 250 < len(few) < 300
    rows = [(1, f"{prose(1, 40)} {short} {prose(2, 40)}"), (2, f"{short} {prose(3, 60)}"), (3, f"{prose(4, 30)} {few}"), (4, f"{few} {prose(5, 30)}")]
    cut = {r.doc_id: r.text for r in suffixes.without_repeats(make(rows), width=suffixes.PASSAGE, least_words=suffixes.PASSAGE_WORDS).collect()}
    assert cut[3] == rows[2][1] and cut[4] == rows[3][1]
    assert all(short[10:-10] not in cut[i] for i in (1, 2)) and cut[2].strip() == prose(3, 60)
    both = {r.row.doc_id: r for r in suffixes.find_repeats(make(rows), shorter=suffixes.PASSAGE, least_words=suffixes.PASSAGE_WORDS).collect()}
    assert [len(both[i].passages) for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and all(r.n_removed == 0 for r in both.values())


def test_runs_at_the_edge_of_the_width(make, prose):
    same = prose(9, 200)[:400]
    rows = [(1, f"A{same}B"), (2, f"C{same}D"), (3, f"E{same[:399]}F"), (4, same)]
    got = {r.row.doc_id: [(x.start, x.end) for x in r.runs] for r in suffixes.find_repeats(make(rows)).collect()}
    assert got == {1: [(1, 401)], 2: [(1, 401)], 3: [], 4: [(0, 400)]}


def test_odd_rows_and_long_texts_in_pieces(make, odd, monkeypatch):
    wanted = sorted((repr(r[0]), *w) for r, w in zip(odd, brute([t for _, t in odd], 400)))
    assert found(make(odd)) == wanted
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    assert found(make(odd)) == wanted


def test_empty_table(make):
    assert found(make([])) == []


def test_without_repeats_keeps_columns_and_whole_characters(make, prose):
    same = "é" * 300
    rows = [(1, f"{same} {prose(1, 20)}"), (2, f"a{same} {prose(2, 20)}"), (3, None), (4, prose(3, 400)), (5, prose(3, 400))]
    frame = make(rows)
    cut = suffixes.without_repeats(frame)
    assert cut.dtypes == frame.dtypes
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert set(kept) == {1, 2, 3} and kept[3] == "" and "é" not in kept[1] and kept[2].startswith("a")


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    wanted = {d.doc_id: w for d, w in zip(docs, brute([d.text for d in docs], 400))}
    rows = suffixes.op1_suffixes(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == wanted
    assert all(r.passage_bytes >= r.n_removed for r in rows) and sum(r.n_passages > r.n_spans for r in rows) > 0
