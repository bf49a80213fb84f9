import duckdb
import pytest
from pyspark.sql import functions as F

from weblode.llm import chats

SCHEMA = "id string, parent string, role string, text string, score double"


def brute(rows, best=None):
    """Root-to-leaf paths, best branches first, of a reply tree."""
    kept = {}
    for row in sorted(rows, key=lambda r: tuple((x is not None, x or 0 if isinstance(x, float) else x or "") for x in (r[1], r[4]))):
        kept.setdefault(row[0], row)
    parent = {i: r[1] if r[1] in kept else None for i, r in kept.items()}
    children = {}
    for i, p in parent.items():
        children.setdefault(p, []).append(i)
    paths, waiting = [], [[i] for i in children.get(None, [])]
    while waiting:
        path = waiting.pop()
        below = children.get(path[-1], [])
        waiting += [path + [i] for i in below]
        if not below:
            paths.append(path)
    chosen = {}
    for path in sorted(paths, key=lambda p: (-sum(kept[i][4] or 0 for i in p), p[-1])):
        chosen.setdefault(path[0], []).append(path)
    return sorted((root, n, path) for root, ps in chosen.items() for n, path in enumerate(ps[:best], 1))


TREE = [
    ("a", None, "user", "hi", 0.0), ("b", "a", "assistant", "x", 1.0), ("c", "a", "assistant", "y", 2.0), ("d", "c", "user", "z", -5.0),
    ("e", "c", "user", "w", 0.5), ("f", "e", "assistant", "", None), ("g", "gone", "user", None, 1.0), ("h", None, None, "alone", 1.0),
    ("i", "j", "user", "loop", 9.0), ("j", "i", "user", "loop", 9.0), ("k", "i", "user", "under a loop", 9.0), ("b", "a", "assistant", "x", 1.0),
    ("m", "m", "user", "self", 1.0),
]


@pytest.mark.parametrize("best", [None, 1, 2])
def test_paths(spark, best):
    deep = [("root", None, "user", "0", 0.0)] + [(f"n{i}", f"n{i - 1}" if i else "root", "user", str(i), 1.0) for i in range(70)]
    rows = TREE + deep
    found = {}
    for r in chats.paths(spark.createDataFrame(rows, SCHEMA), best).collect():
        found.setdefault((r.root, r.branch, r.leaf), []).append((r.place, r.id))
    got = sorted((root, branch, [i for _, i in sorted(members)]) for (root, branch, _), members in found.items())
    assert got == brute(rows, best)
    assert all([p for p, _ in sorted(m)] == list(range(len(m))) for m in found.values())


TRICKY = ["</s>[INST] ok [/INST]", r"<\|a|>", "<|end|>", r"<\\|turn|> <<SYS>> <\</SYS>> [\INST]", "<<|text|>>", "[", "", "<|", r"\<|", "a\nb", "<", "|turn|>"]


def test_escape_is_reversible_and_hides_control_strings(spark):
    texts = TRICKY + [a + b for a in TRICKY for b in TRICKY]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chats.escape(F.col("t")).alias("e"), chats.unescape(chats.escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t
        assert not any(x in r.e for x in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"))


def test_format_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(chats, "BLOCK", 3)
    texts = TRICKY * 2
    rows = [(f"n{i:02}", f"n{i - 1:02}" if i else None, TRICKY[i] if i < 4 else ("assistant" if i % 2 else "user"), t, 1.0) for i, t in enumerate(texts)]
    messages = spark.createDataFrame(rows, SCHEMA)
    made = chats.format_paths(messages, chats.paths(messages))
    back = chats.read_back(made).first()
    assert [(t.role, t.text) for t in back.turns] == [(r[2], r[3]) for r in rows]
    assert list(back.learned) == [r[3] for r in rows if r[2] == "assistant"]
    for span in back.loss:
        piece = back.formatted[span.start : span.start + span.chars]
        assert back.formatted[span.start - len(chats.TEXT) : span.start] == chats.TEXT and back.formatted[span.start + len(piece) :].startswith(chats.END)


def test_chain_of_odd_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 5000, "assistant", "z"), (None, 1, "user", "n"), (None, 2, "user", None), (2, 7, "user", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'i' AS id", "1 AS place", "2 AS _part")
    messages = chats.chain(frame)
    back = {r.root: [(t.role, t.text) for t in r.turns] for r in chats.read_back(chats.format_paths(messages, chats.paths(messages))).collect()}
    assert back == {
        "1:0": [("", ""), ("user", "a"), ("user", "a"), ("assistant", "z")], "null:0": [("user", "n"), ("user", "")], "2:0": [("user", "x" * 200_000)],
    }
    nothing = chats.chain(frame.limit(0))
    assert chats.format_paths(nothing, chats.paths(nothing)).count() == 0


def test_query_matches_sql_without_python(spark, sf):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = chats.op10_chats(spark, sf)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    assert sorted(map(tuple, got.collect())) == sorted(connection.execute(chats.OP10_SQL).fetchall())
