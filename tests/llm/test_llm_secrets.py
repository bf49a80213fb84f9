import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weblode.llm import secrets


def brute(text):
    """Base spans by the patterns as given."""
    out = []
    for number, (_, pattern, group, least) in enumerate(secrets.BASE):
        out += [(m.start(), number, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKeN", " = ", ":", "=", '"', "'", "secret", "api_key", "apikey", "AKIA", "AKIAZZZZ0123456789", "0f" * 9, "ſecret", "K", "a", "-", "ABCDEFGHIJKLMN", "\n", " ", "é"]), max_size=14).map("".join))
def test_base_is_as_the_patterns_say(text):
    assert secrets.base_spans(text) == brute(text)


HIDDEN = "q7Rz2Lw9Tt4Bv8Kp"


@pytest.mark.parametrize("text", [
    f'db_pwd = "{HIDDEN}"', f"PRIVATE_ACCESS_KEY={HIDDEN}", f"clientCredential: '{HIDDEN}'", f'{{"authorization": "{HIDDEN}"}}',
    f'X = "{HIDDEN}"\nconnect(user, pwd=X)\npwd = X', f'A = "{HIDDEN}"\nB = A\nC = B\npassphrase := C', f'pwd = "q7Rz2Lw9" + "{HIDDEN}"',
    f"export DB_PWD={HIDDEN}",
])
def test_names_make_literals_secret(text):
    base, every = secrets.all_spans(text)
    assert [text[s:e] for s, k, e in every if k == 3] == [HIDDEN] and base == [x for x in every if x[1] < 3]
    assert HIDDEN not in secrets.redact(text, every)


@pytest.mark.parametrize("text", [
    "The password is kept elsewhere.", 'pwd = "changeme"', f'colour = "{HIDDEN}"', "key: value and more words", 'A = "x"\nB = A\nA = B',
    "auth: see https://example.org/a/long/page/name", "note: this is a sentence; next: another one", 'pwd = "several plain words here"',
    "", "===", "pwd =", 'pwd = "never closed',
])
def test_clean_texts_stay_clean(text):
    base, every = secrets.all_spans(text)
    assert every == base == brute(text)


def test_covered_literals_are_not_listed_twice():
    text = 'token = "0123456789abcdef0123"'
    assert [secrets.KINDS[k] for _, k, _ in secrets.all_spans(text)[1]] == ["assign", "hex"]


def test_redaction_of_overlapping_spans():
    assert secrets.redact("abcdefgh", [(1, 0, 4), (3, 2, 5), (6, 1, 7)]) == "a<secret>f<secret>h"


def test_odd_rows(make, odd):
    rows = [*odd, (20, f"漢 token = {HIDDEN} 字")]
    frame = make(rows)
    got = secrets.scan(frame).collect()
    assert len(got) == len(rows)
    assert [[(x.kind, x.start, x.end) for x in r.spans] for r in got if r["row"].doc_id == 20] == [[("assign", 2, 2 + 8 + 16)]]
    clean = secrets.redact_rows(frame)
    odd = [(i, t if i != 9 else "<secret>") for i, t in odd]  # sixty thousand hexadecimal digits are one span
    assert clean.dtypes == frame.dtypes
    assert sorted(repr(r.text) for r in clean.where("doc_id is null or doc_id < 20").collect()) == sorted(repr(t) for _, t in odd)
    assert secrets.redact_rows(make([])).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = secrets.op8_secrets(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        shown = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))
