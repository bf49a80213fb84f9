import glob
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from weblode.llm import tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return open(tokens.vocabulary_path(), encoding="utf-8").read()


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


TEXTS = [
    "", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n\nb c", "it's we'll ' s '' x", "x<|endoftext|>y z", "漢字 😀 é ñ   b", "1 234  5,6 .. -- !", "\t tab \t", "a\x1c b \x1c c",
    "one two three " * 50, "ab" * 5000, "don 't  don't", " lead and trail ", "\r\n x \r\n",
    "line one\nline two, three.\nfour's 5th 6,7 (eight)", "a\n\n\nb", "\nx", "x\n", "x\ty\nz", "é\nñ x", "a\xa0 b\xa0\nc", "a\x1f\nb c", "end.<|endoftext|>\nnext", "don't\n't 's\ns", "a\x01b c", "\x01",
]


def test_chunks_are_tokenized_as_in_the_whole_text(library, vocabulary, monkeypatch):
    encoder = tokens.Encoder(vocabulary)
    assert encoder.apart
    for batch in (TEXTS, TEXTS[::-1], TEXTS[3:9]):
        sizes, ids = encoder.encode(batch, 2)
        parts = [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert parts == [whole(library, t) for t in batch]
    monkeypatch.setattr(tokens, "CACHED", 3)
    assert list(encoder.encode(TEXTS, None)[1]) == [i for t in TEXTS for i in whole(library, t)[:-1]]
    assert all("".join(tokens.chunks(t)) == t for t in TEXTS)
    # A vocabulary with its own white space rules is not cut.
    assert not tokens.byte_level(open(tokens.vocabulary_path("word_bpe_49k.json"), encoding="utf-8").read())


def test_only_new_atoms_and_special_strings_reach_the_library(library, vocabulary, monkeypatch):
    texts = ["Où étaient-ils l'été ? Là\u00a0!\n", "x\u3000 y", "漢字 और ½Ⅷ²", "a\u2003\u2003b 'tis 'll's 's", *(t for t in TEXTS if "<|" not in t)]
    encoder = tokens.worker_encoder(vocabulary)
    assert tokens.worker_encoder(vocabulary) is encoder  # the next task of the worker
    # Texts without special strings, whatever their letters and white space, are no work for the whole tokenizer.
    monkeypatch.setattr(encoder, "plain", lambda rest: pytest.fail(f"tokenized whole: {rest}"))
    first = encoder.encode(texts, 2)
    # Atoms that are known are no work for the library at all.
    monkeypatch.setattr(encoder, "_learn", lambda new: pytest.fail(f"tokenized again: {new}"))
    for sizes, ids in (first, encoder.encode(texts, 2)):
        assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole(library, t) for t in texts]


def test_atoms_are_the_librarys(library, vocabulary):
    draw = random.Random(5)
    pieces = [" ", " ", "\n", "'", "s", "t", "re", "ll", "S", "x", "1", ".", "é", "漢", "😀", "\u00a0", "\u3000", "\t", "\x1c", "\x85", "½", "\u0301", "'s", "<|endoftext|>"]
    texts = ["".join(draw.choices(pieces[: draw.choice([10, len(pieces)])], k=draw.randint(0, 25))) for _ in range(1500)]
    sizes, ids = tokens.Encoder(vocabulary).encode(texts, 2)
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole(library, t) for t in texts]


def written(spark, frame, tmp_path, **options):
    path = str(tmp_path / "out")
    tokens.write_tokens(frame, path, **options)
    return path


def test_round_trip_with_odd_rows(spark, make, odd, library, tmp_path):
    frame = make([*odd, (None, "later"), (4, "another text of the id")])
    path = written(spark, frame, tmp_path)
    rows = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted((r.doc_id for r in frame.collect()), key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    wanted = sorted(repr((r.doc_id, whole(library, r.text))) for r in frame.collect())
    assert sorted(repr((r.id, list(r.ids))) for r in rows) == wanted


def test_empty_table(spark, make, tmp_path):
    path = written(spark, make([]), tmp_path)
    assert tokens.read_tokens(spark, path).count() == 0 and tokens.read_range(spark, path, 0, 10).count() == 0


@pytest.mark.parametrize("encoding, wanted", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_encodings_row_groups_and_indexes(spark, make, prose, tmp_path, encoding, wanted):
    frame = make([(i, prose(i, 150)) for i in range(1500)])
    path = written(spark, frame, tmp_path, ids_encoding=encoding, row_group_bytes=60_000, page_bytes=4_000)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/tokens/*.parquet")]
    assert sum(f.metadata.num_row_groups for f in files) > 2 * len(files)
    for f in files:
        group = f.metadata.row_group(0)
        kinds = {group.column(j).path_in_schema: group.column(j) for j in range(group.num_columns)}
        assert wanted in kinds["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in kinds["offset"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in kinds.values())
    with pytest.raises(ValueError):
        tokens.write_tokens(frame, path, ids_encoding="plain")


def test_selective_reads(spark, make, prose, library, tmp_path):
    texts = [prose(i, 20 + i % 30) for i in range(200)]
    path = written(spark, make(list(enumerate(texts))), tmp_path, row_group_bytes=20_000, page_bytes=1_000)
    every = [i for t in texts for i in whole(library, t)]
    for first, end in ((0, 1), (0, 50), (777, 1300), (len(every) - 3, len(every) + 50), (5, 5), (len(every), len(every) + 9)):
        rows = sorted(tokens.read_range(spark, path, first, end).collect(), key=lambda r: r.start)
        assert [i for r in rows for i in r.ids] == every[first:end]
        assert not rows or rows[0].start == first
    plan = tokens.read_range(spark, path, 777, 1300)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "offset" in plan.split("PushedFilters")[1]
    narrow = tokens.read_tokens(spark, path).select("id", "start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in narrow.split("ReadSchema")[1].split("\n")[0]


def test_query(spark, sf, library):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda d: d.doc_id)
    wanted, at = [], 0
    for d in docs:
        ids = whole(library, d.text)
        wanted.append((d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokens.op11_tokens(spark, sf)
    assert sorted(map(tuple, got.collect())) == wanted
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
