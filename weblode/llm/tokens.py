"""Token files: texts as token ids in Parquet list columns, written in id order for selective reads.

Rows are range-partitioned by id, tokenized part by part and written in that order, one file
a part. The ids are a list column with dictionary pages (a vocabulary fits one dictionary,
which leaves two bytes or less an id); the other columns rise slowly within a file and get
delta encoding. Row groups and pages are small and their indexes are written, so a reader
that wants some documents, or the tokens from one place to another, opens only the pages that
can hold them, and one that wants lengths and places reads no token at all.

A row's place among all tokens is the offset inside its part plus the tokens of the parts
before; the latter are one row a part, in a table beside the files.

Tokenizing: the places where the vocabulary splits letters, digits, marks and white space are
found for a whole batch by array operations on its bytes; what a character counts as, the
library's own patterns say. The atoms between them are looked up in one table, and the library's
model tokenizes those not met yet, many in a call; the table is dropped after a task, a Python
worker keeps the vocabulary. Texts with strings of special tokens are cut between words first,
and the parts with such strings go to the library as they are.

Cases: null and empty texts have only the end id; null ids come first; rows that repeat an
id are ordered by a hash of the text, equal rows as they come; texts of any length are
tokenized whole, written alone in a batch; an empty table gives no rows. Extra columns are
left out.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.storage import shuffle_partitions
from weblode.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Text bytes of a part, where that gives more parts than the session's shuffle partitions.
PART_BYTES = 1 << 28
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
#: Text bytes that a batch of output is made of.
BATCH = 1 << 21
#: Atoms, and bytes of them, that a task remembers between batches.
CACHED = 1 << 18
CACHED_BYTES = 1 << 26
#: Atoms that the library gets in one call.
JOINED = 500
# A space or newline with white space beside it, or at an end, is no place to cut.
_UNSAFE = re.compile(r"\s[ \n]|[ \n]\s|\A[ \n]|[ \n]\Z")
_RARE_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BESIDE = ("  ", "\n\n", " \n", "\n ", " \t", "\t ", "\n\t", "\t\n", "\n\r", "\r\n", " \r", "\r ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
OTHER, LETTER, DIGIT, SPACE, UNKNOWN = range(5)
# --- fixed values -----------------------------------------------------------
# How byte-level vocabularies split text: what counts as a letter, digit or white space, endings after an apostrophe.
PATTERNS = {LETTER: r"\p{L}", DIGIT: r"\p{N}", SPACE: r"\s"}
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
# --- end of fixed values ----------------------------------------------------


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level(vocabulary: str) -> bool:
    """Whether chunks may be tokenized apart: byte-level splitting without leading space, nothing before it or around it."""
    made = json.loads(vocabulary)
    split = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return bool(plain) and all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in made.get("added_tokens", []))


def safe(text: str) -> bool:
    """Whether every space and newline stands alone between two other characters."""
    if text[:1] in ("", " ", "\n") or text[-1] in (" ", "\n") or any(pair in text for pair in _BESIDE):
        return False
    return not _RARE_SPACE.search(text) or not _UNSAFE.search(text)


def chunks(text: str) -> list[str]:
    """Parts of a text that are tokenized alike alone and in it; joined they are the text."""
    if not safe(text):
        first, *rest = _CUT.split(text)
        return [first, *[" " + part for part in rest]]
    found = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        found += [first, *[" " + part for part in rest], "\n"]
    found.pop()
    return found


def byte_characters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = np.r_[33:127, 161:173, 174:256]
    table = np.zeros(256, np.uint32)
    table[shown] = shown
    table[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))
    return table


class Encoder:
    """Ids of batches of texts."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.model = Tokenizer(self.tokenizer.model)  # takes atoms, one a line, as the vocabulary spells them
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.spelled = byte_characters()
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        model = made["model"]
        spelled_whole = model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        self.apart = byte_level(vocabulary) and spelled_whole and all(chr(c) in names for c in self.spelled)
        self.widths = np.zeros(max(names.values(), default=-1) + 1, np.int64)
        self.widths[list(names.values())] = list(map(len, names))
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn_kinds(np.arange(128))
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.held = 0
        self.sizes, self.starts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_kinds(self, points: np.ndarray) -> None:
        """What the library's patterns take these characters for."""
        from tokenizers import Regex, pre_tokenizers

        every = points.astype("<u4").tobytes().decode("utf-32-le")
        self.kinds[points] = OTHER
        for kind, pattern in PATTERNS.items():
            found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
            self.kinds[[ord(c) for part, _ in found for c in part]] = kind

    def _byte_kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of each byte's character."""
        kinds = self.kinds[:256][data]
        wide = data >= 0x80
        if wide.any():
            points = np.frombuffer(data[wide].tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            new = np.unique(points[self.kinds[points] == UNKNOWN])
            if len(new):
                self._learn_kinds(new)
            widths = 2 + (points >= 0x800) + (points >= 0x10000)
            kinds[wide] = np.repeat(self.kinds[points], widths)
        return kinds

    def _begins(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where atoms begin in texts that stand one behind the other and begin at ``texts``, none of them empty."""
        kinds = self._byte_kinds(data)
        opens = np.zeros(len(data) + 1, bool)
        opens[texts] = opens[-1] = True
        begins = opens.copy()
        begins[1:-1] |= kinds[1:] != kinds[:-1]
        # An apostrophe that begins an atom takes an ending along, letters behind it are another atom.
        marks = np.flatnonzero((data == ord("'")) & begins[:-1])
        spaced = (marks > 0) & (data[marks - 1] == ord(" ")) & ~opens[marks]
        marks = marks[~spaced]
        for ending in ENDINGS:
            at = marks[marks + len(ending) < len(data)]
            for k, letter in enumerate(ending.encode(), 1):
                at = at[(data[at + k] == letter) & ~opens[at + k]]
            begins[at + 1] = False
            begins[at + 1 + len(ending)] = True
        # The last of some white space stands apart from the rest, if the text goes on; a space belongs to what follows.
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~opens[1:-1])
        one = data[last] == ord(" ")
        begins[last[one] + 1] = False
        begins[last[one]] = True
        rest = last[~one]
        wide = data[rest] >= 0x80
        begins[rest - np.where(wide, np.where(data[rest - 1] >= 0xC0, 1, 2), 0)] = True
        return np.flatnonzero(begins)

    def _learn(self, new: list[bytes]) -> None:
        found = []
        for first in range(0, len(new), JOINED):
            atoms = new[first : first + JOINED]
            size = np.fromiter(map(len, atoms), np.int64, len(atoms))
            spelled = self.spelled[np.frombuffer(b"".join(atoms), np.uint8)]
            lines = np.insert(spelled, np.cumsum(size)[:-1], ord("\n")).astype("<u4").tobytes().decode("utf-32-le")
            ids = np.array(self.model.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.int32)
            # A token of a byte-level vocabulary is as long as the bytes it stands for, which tells the atoms apart.
            ends = np.cumsum(self.widths[ids])
            last = np.searchsorted(ends, np.cumsum(size))
            if not len(ends) or ends[-1] != size.sum() or (ends[last] != np.cumsum(size)).any():
                raise ValueError("tokens do not add up to their atoms")
            found.append((np.diff(last, prepend=-1), ids))
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        self.held += sum(map(len, new))
        self.sizes = np.concatenate([self.sizes, *[sizes for sizes, _ in found]])
        self.ids = np.concatenate([self.ids, *[ids for _, ids in found]])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _atoms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids): Python sees distinct atoms only."""
        made = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(made.buffers()[1], np.int64)[: len(texts) + 1] if texts else np.zeros(1, np.int64)
        data = np.frombuffer(made.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        if not len(data):
            return np.zeros(len(texts), np.int64), np.empty(0, np.int32)
        begins = self._begins(data, bounds[:-1][np.diff(bounds) > 0])
        atoms = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), made.buffers()[2]])
        coded = atoms.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.numbers.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.numbers) + np.arange(len(new))
            self._learn([names[i] for i in new])
        flat = numbers[np.asarray(coded.indices)]
        ends = np.concatenate([[0], np.cumsum(self.sizes[flat])])
        return np.diff(ends[np.searchsorted(begins, bounds)]), _runs(self.starts, self.sizes, flat, self.ids)

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids): texts without special strings."""
        special = [any(name in text for name in self.added) for text in texts]
        if not any(special):
            return self._atoms(texts)
        alone = self.plain([text for text, left in zip(texts, special) if left])
        sizes, ids = self._atoms([text for text, left in zip(texts, special) if not left])
        counts = np.empty(len(texts), np.int64)
        counts[special], counts[~np.array(special)] = list(map(len, alone)), sizes
        left = np.repeat(special, counts)
        every = np.empty(len(left), np.int32)
        every[left], every[~left] = list(chain.from_iterable(alone)), ids
        return counts, every

    def encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after the other), ``end`` behind each text."""
        tail = [] if end is None else [end]
        if not self.apart:
            found = [x + tail for x in self.plain(texts)]
            sizes = np.array([len(x) for x in found], np.int64)
            return sizes, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        if len(self.numbers) > CACHED or self.held > CACHED_BYTES:
            self.clear()
        split = [chunks(text) if any(name in text for name in self.added) else [text] for text in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        sizes, ids = self._parts(list(chain.from_iterable(split)))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        if tail:
            ids = np.insert(ids, bounds, end).astype(np.int32)
        return np.diff(bounds, prepend=0) + len(tail), ids


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> Encoder:
    """A worker's encoder: the vocabulary is loaded once, not in each task."""
    return Encoder(vocabulary)


def _runs(starts: np.ndarray, sizes: np.ndarray, order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, each from its start on, one after the other in the given order."""
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    return values[np.repeat(starts[order] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Stretches of texts of about ``BATCH`` bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, "right")))
        yield at, [text or "" for text in column.slice(at, last - at).to_pylist()]
        at = last


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """part, offset, id, n_tokens, ids of each row, sorted by id within range-partitioned parts."""
    spark = df.sparkSession
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as file:  # the driver alone reads the file
        sent = spark.sparkContext.broadcast(file.read())
    total = df.agg(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    parts = max(shuffle_partitions(spark), -(-total // PART_BYTES))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("number"))
    keys = [F.asc_nulls_first("id"), F.asc("tie"), F.asc("number")]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, at = TaskContext.get().partitionId(), worker_encoder(sent.value), 0
        for batch in batches:
            for first, texts in _batches(batch.column(1)):
                sizes, ids = encoder.encode(texts, end_id)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), part), pa.int32()), pa.array(at + ends - sizes, pa.int64()), batch.column(0).slice(first, len(texts)),
                        pa.array(sizes, pa.int32()), lists,
                    ],
                    names=["part", "offset", "id", "n_tokens", "ids"],
                )
                at += int(ends[-1]) if len(ends) else 0
        encoder.clear()

    return placed.mapInArrow(run, f"part int, offset bigint, id {kind}, n_tokens int, ids array<int>")


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, end_id: int | None = END_ID,
                 ids_encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Token files in ``path/tokens`` and the table of parts in ``path/parts``.

    ``ids_encoding`` is ``dictionary`` or ``delta``; the latter suits ids that stay close to
    their neighbours.
    """
    if ids_encoding not in ("dictionary", "delta"):
        raise ValueError("ids_encoding must be dictionary or delta")
    spark = df.sparkSession
    writer = encoded(df, id_col, text_col, vocabulary, end_id).write.option("compression", "zstd")
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    writer = writer.option("parquet.enable.dictionary#ids.list.element", str(ids_encoding == "dictionary").lower())
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.dictionary.page.size", 1 << 20)
    writer.parquet(f"{path}/tokens")
    # Reads two narrow columns; one row a part, so the window is small.
    counted = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    before = F.expr("coalesce(sum(tokens) OVER (ORDER BY part) - tokens, 0)")
    counted.withColumn("before", before).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, ids, part of each row; columns that are not used are not read."""
    rows = spark.read.parquet(f"{path}/tokens")
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    placed = rows.join(F.broadcast(parts), "part")  # one row a part: bounded by the number of files
    return placed.select("id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids", "part")


def read_range(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """id, start, ids of the tokens from place ``first`` up to ``end``, cut at both ends.

    The table of parts gives a condition on part and offset, which the scan uses to leave out
    row groups and pages.
    """
    parts = spark.read.parquet(f"{path}/parts").where((F.col("before") < end) & (F.col("before") + F.col("tokens") > first))
    wanted = parts.select("part", "before").collect()  # parts that hold the range
    hit = F.lit(False)
    for p in wanted:
        of_part = (F.col("part") == p["part"]) & (F.col("offset") < end - p["before"]) & (F.col("offset") + F.col("n_tokens") > first - p["before"])
        hit = hit | of_part
    rows = spark.read.parquet(f"{path}/tokens").where(F.col("part").isin([p["part"] for p in wanted]) & hit)
    before = F.create_map(*[F.lit(x) for p in wanted for x in (p["part"], p["before"])]) if wanted else F.create_map().cast("map<int,bigint>")
    start = F.element_at(before, F.col("part")) + F.col("offset")
    skipped = F.greatest(F.lit(first) - start, F.lit(0)).cast("int")
    size = (F.least(start + F.col("n_tokens"), F.lit(end)) - start).cast("int") - skipped
    return rows.select("id", (start + skipped).alias("start"), F.slice("ids", skipped + 1, size).alias("ids"))


def checksums(rows: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(carry))
            data = np.asarray(lists.flatten()).astype("<u4").view(np.uint8)
            bounds = (np.asarray(lists.offsets) - lists.offsets[0].as_py()) * 4
            found = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.int64())], names=[*carry, "ids_crc32"])

    return rows.select(*carry, "ids").mapInArrow(run, f"{kinds}, ids_crc32 bigint")


def op11_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    rows = read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids")
    return checksums(rows, ["doc_id", "start", "n_tokens"])
