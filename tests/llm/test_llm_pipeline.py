import random

import corpus_pipeline
import __spark_entry__ as entry

LETTERS = {"aa": "kalumitorega", "bb": "sternungachpf"}


def prose(seed, label, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(LETTERS[label], k=rng.randint(2, 8))) for _ in range(n))


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert names == [
        "op1_suffixes", "op2_language", "op3_jaccard", "op4_licenses", "op5_fingerprints", "op6_pieces", "op7_packing", "op8_secrets", "op9_topk", "op10_chats",
        "op11_tokens", "op12_merkle", "op13_negatives", "pipeline",
    ]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "secret_scan", "best_fit_packing"]


def rows():
    passage = prose(900, "aa", 90)
    found = [(i, prose(i, "aa" if i % 3 else "bb", 120), "aa" if i % 3 else "bb", "src0" if i % 2 else "src1") for i in range(100)]
    found += [
        (200, found[5][1], "aa", "src2"), (201, found[6][1] + " and one", "bb", "src2"), (202, None, "aa", "src3"), (203, "1234 !!", None, None), (204, "", "bb", "src1"),
        (205, f"{prose(300, 'aa', 60)} {passage} {prose(301, 'aa', 60)}", "aa", "src4"), (206, f"{prose(302, 'aa', 60)} {passage}", "aa", "src4"),
        (207, prose(303, "aa", 30) + ' token = "0123456789abcdef0123" ' + prose(304, "aa", 30), "aa", "src5"), (208, prose(305, "aa", 5000), "aa", "src5"),
        (200, found[5][1], "aa", "src2"), (None, prose(306, "bb", 50), "bb", None),
    ]
    return found


def test_each_stage_takes_effect(spark, make):
    docs = make(rows())
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        if name != "best_fit_packing":
            assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    ids = {name: set(x) for name, x in kept.items()}
    everything = set(range(100)) | set(range(200, 209)) | {None}
    assert ids["language_id"] == everything - {202, 203, 204}
    assert ids["jaccard_join"] == ids["language_id"] - {200, 201}
    assert ids["suffix_dedup"] == ids["jaccard_join"]
    assert prose(900, "aa", 90)[5:80] in kept["jaccard_join"][205].text
    for i in (205, 206):
        row = kept["suffix_dedup"][i]
        assert prose(900, "aa", 90)[5:80] not in row.text and row.n_chars == len(row.text)
    clean = kept["secret_scan"][207]
    assert "0123456789abcdef" not in clean.text and "<secret>" in clean.text and clean.n_chars == len(clean.text)
    untouched = [i for i in range(100)]
    assert all(kept["secret_scan"][i].text == kept["language_id"][i].text for i in untouched)
    assert ids["best_fit_packing"] == ids["secret_scan"]
    packed = docs.collect()
    words = {i: [] for i in ids["secret_scan"]}
    for r in sorted(packed, key=lambda r: r.piece):
        words[r.doc_id] += r.text.split()
    assert all(words[i] == r.text.split() for i, r in kept["secret_scan"].items())


def test_repeated_passages_of_short_words_go(spark, make):
    rng = random.Random(4)
    passage = " ".join("".join(rng.choices("kalumit", k=rng.choice([2, 3, 4, 5]))) for _ in range(51))
    docs = make([(1, f"{prose(1, 'aa', 60)} {passage} {prose(2, 'aa', 60)}", "aa", "a"), (2, f"{prose(3, 'aa', 90)} {passage}", "aa", "a"), (3, prose(4, "aa", 90), "aa", "a")])
    kept = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_passages(spark, docs, None).collect()}
    assert len(passage) < 260 and all(passage[5:-5] not in kept[i] for i in (1, 2)) and kept[3] == prose(4, "aa", 90)


def test_empty_table(spark, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        assert docs.count() == 0


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf).collect()
    assert len({r.doc_id for r in found}) > 100 and all(r.n_tokens <= 2048 for r in found)
