import hashlib
import random

import pytest

from weblode.llm import pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load_pieces())


def brute(model, text):
    """Viterbi over the whole marked text, one character at a time."""
    if not text:
        return []
    known = {model["texts"][i]: i for i in model["normal"]}
    marked = pieces.MARK + text.replace(pieces.MARK, pieces.LITERAL).replace(" ", pieces.MARK)
    longest, unknown = max(map(len, known)), min(model["scores"][i] for i in model["normal"]) - 10
    best, back = [0.0], [None]
    for end in range(1, len(marked) + 1):
        tries = []
        for start in range(max(0, end - longest), end):
            if (i := known.get(marked[start:end])) is not None:
                tries.append((best[start] + model["scores"][i], end - start, i))
        tries.append((best[end - 1] + unknown, 0, None))
        score, length, i = max(tries, key=lambda t: (t[0], t[1]))
        best.append(score), back.append((max(1, length), i))
    out, end = [], len(marked)
    while end:
        length, i = back[end]
        char = marked[end - 1]
        raw = (pieces.MARK if char == pieces.LITERAL else char).encode()
        out = ([i] if i is not None else [model["bytes"][b] for b in raw]) + out
        end -= length
    return out


TEXTS = ["", "a", " ", "  ", "Hello  world\n\tx", " lead and trail ", "日本語 😀 é", "a▁b ▁ ▁▁", "=" * 70, "the the the", "\x00�", "supercalifragilistic " * 4]


def test_against_one_character_at_a_time(codec):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("ab e th ing ▁日\n😀,.", k=rng.randint(1, 60))) for _ in range(60)]
    assert [list(x) for x in codec.encode(texts)] == [brute(codec.model, t) for t in texts]
    assert [list(x) for x in codec.encode(texts[::-1])] == [brute(codec.model, t) for t in texts[::-1]]


def test_scores_at_least_the_merge_order_of_the_library(codec, prose):
    import sentencepiece

    model, scores = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE), codec.model["scores"]
    for seed in range(30):
        text = prose(seed, 80)
        ours, merged = codec.encode([text])[0], model.encode(text)
        assert sum(scores[i] for i in ours) >= sum(scores[i] for i in merged)
        assert model.decode([int(i) for i in ours]) == text


def test_exact_round_trip_and_long_words(codec, monkeypatch):
    rng = random.Random(5)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(300)), "x" * 30_000]
    found = codec.encode(texts)
    assert [codec.decode(x) for x in found] == texts
    monkeypatch.setattr(pieces, "STRETCH", 37)
    codec._forget()
    assert [list(x) for x in codec.encode(texts)] == [list(x) for x in found]
    monkeypatch.setattr(pieces, "CACHED", 0)
    assert [list(x) for x in codec.encode(texts)] == [list(x) for x in found]


def test_odd_rows(make, odd):
    rows = pieces.encode(make(odd)).collect()
    assert sorted(r.decoded for r in rows) == sorted(t or "" for _, t in odd)
    assert all(bool(r.ids) == bool(r.decoded) for r in rows)
    assert pieces.encode(make([])).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op6_pieces(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    model = pieces.load_pieces()
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
    for r in sorted(rows, key=lambda r: r.n_tokens)[:60]:
        assert r.ids == brute(model, docs[r.doc_id])
