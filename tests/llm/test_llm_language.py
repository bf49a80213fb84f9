import zlib

from weblode.llm import language


def texts(prose, label, n):
    marks = {"aa": "ka lu mi", "bb": "ster ung ach"}[label].split()
    return [" ".join(f"{marks[(i + j) % 3]}{w}" for j, w in enumerate(prose(1000 + i, 12).split())) for i in range(n)]


def test_learns_and_never_reads_held_out_labels(make, prose):
    rows = [(2 * i + (k == "bb"), t, k, "s") for k in ("aa", "bb") for i, t in enumerate(texts(prose, k, 120))]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = language.train(make(rows))
    # Other labels on held-out rows and null labels change nothing.
    other = [(i, t, "zz" if held(i) else k, s) for i, t, k, s in rows] + [(10_001, "anything at all", None, "s")]
    assert (language.train(make(other)).table == model.table).all() and model.languages == ["aa", "bb"]
    got = {r["row"].doc_id: r for r in language.predict(make(rows), model).collect()}
    tested = [i for i, *_ in rows if held(i)]
    right = sum(got[i].lang_pred == k for i, _, k, _ in rows if held(i))
    assert len(tested) > 40 and right / len(tested) > 0.97
    assert sum(not got[i].accepted for i in tested) <= 0.03 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(make, prose, odd):
    model = language.train(make([(i, t, k, "s") for k in ("aa", "bb") for i, t in enumerate(texts(prose, k, 30))]))
    frame = make(odd)
    rows = language.predict(frame, model).collect()
    assert len(rows) == len(odd)
    for row in rows:
        letters = any(c.isalpha() for c in row["row"].text or "")
        assert (row.lang_pred in ("aa", "bb")) == letters and (row.lang_pred == "und") == (not letters)
        assert letters or (row.score == 0 and not row.accepted)
    assert language.predict(frame, model).select("row.*").dtypes == frame.dtypes


def test_pieces_of_a_long_text_add_up(prose, monkeypatch):
    letters, text = language.letter_table(), prose(1, 5000)
    whole = language.counts(text, letters)
    monkeypatch.setattr(language, "PIECE", 997)
    parts = language.counts(text, letters)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_no_labels_and_empty_table(make):
    model = language.train(make([]))
    assert model.languages == [] and language.predict(make([]), model).count() == 0
    assert [r.lang_pred for r in language.predict(make([(1, "some text")]), model).collect()] == ["und"]


def test_query_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = language.op2_language(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(not r.accepted for r in rows) / len(rows) < 0.01


def test_languages_on_one_id_and_on_null_ids(make, prose):
    many = texts(prose, "aa", 1000)
    rows = [(3, t, "aa", "s") for t in many] + [(3, many[0], "aa", "s")] * 2000
    rows += [(i, t, "bb", "s") for i, t in enumerate(texts(prose, "bb", 100)) if i != 3]
    rows += [(None, f"zyx wvu tsr {t}", "cc", "s") for t in texts(prose, "bb", 5)]
    model = language.train(make(rows))
    assert model.languages == ["aa", "bb", "cc"]
    got = language.predict(make([(1, texts(prose, "aa", 1001)[-1]), (2, texts(prose, "bb", 101)[-1])]), model).collect()
    assert [r.lang_pred for r in got] == ["aa", "bb"]
