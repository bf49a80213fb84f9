"""Suffix-array dedup: finds every byte covered by a string of ``width`` bytes that starts twice.

The suffixes that matter are those that agree with another on ``width`` bytes. They are
found blockwise with a difference cover:

1. Cover samples. Positions of a document that fall in a difference cover modulo v are
   named by a hash of the width - v + 1 bytes that follow. Of any two equal strings of
   ``width`` bytes, some offset below v is a sample in both, and the two samples have one
   name; a sample whose name occurs once therefore rules out every suffix before it that
   reaches it first. The samples are about 9 % of all positions and five bytes each.
2. Suffix buckets. Only suffixes within reach of a repeated sample are sorted, by the hash
   of their first ``width`` bytes, one bucket at a time; equal neighbours are repeats.
3. Each document gets the union of its repeated strings as removed runs.

A shorter width can be asked for beside ``width``: its repeats (passages) are found first,
and the suffixes of the larger width are then only those that repeat at the shorter one where
they start and where they end.

Names are hashes, not ranks of sorted strings: a suffix would have to carry the ranks of all
samples within a period, which is more than four times the input in one shuffle (figures in the
README). Names have 40 bits and suffixes 64 bits beyond their bucket, and a wrong name
can only add work; a suffix hash is decisive (two families of 64 bits, buckets by one and
order by the other).

Rows live in slots of about ``slot_bytes`` of text, kept in a bucketed table, so the
passes shuffle no text; buckets grow in number with the text, not in size. A slot sends each distinct hash once, so a hot passage costs one
entry a slot; of equal texts of ``width`` bytes or more only one takes part, and all are
removed whole.

Cases: null and empty texts have nothing to remove; matches never cross rows; equal rows
count as repeats of each other, whatever their ids; texts of any length are hashed in
pieces; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import shuffle_partitions, stage, stage_bucketed

WIDTH = 400
COVER_ORDER = 2
SLOT_BYTES = 1 << 20
#: Text bytes whose samples and suffixes one bucket holds, where the session's shuffle partitions are fewer.
BUCKET_BYTES = 1 << 26
#: Repeats of the shorter width count as passages from so many words (or ``WIDTH`` bytes) on.
PASSAGE = 200
PASSAGE_WORDS = 50
PIECE = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


def difference_cover(r: int) -> tuple[np.ndarray, int]:
    """(cover, v): 6r + 4 residues that have every difference modulo v = 24r^2 + 36r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return np.concatenate([[0], np.cumsum(steps)]), 24 * r * r + 36 * r + 13


def cover_for(width: int) -> tuple[np.ndarray, int]:
    """The largest cover up to ``COVER_ORDER`` that leaves at least half of ``width`` to the names."""
    for r in range(COVER_ORDER, -1, -1):
        cover, v = difference_cover(r)
        if v <= width // 2:
            return cover, v
    return np.arange(1), 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each family's base and of its inverse modulo 2**64."""
    found = []
    for base in _BASES:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(1, size), b, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        found.append((both[0], both[1]))
    return found


class Hashes:
    """Hashes of substrings of one piece of bytes, in two independent families."""

    def __init__(self, data: bytes | memoryview, powers: list[tuple[np.ndarray, np.ndarray]]):
        self.powers = powers
        self.size = len(data)
        raw = np.frombuffer(data, np.uint8)
        if self.size >= 8:
            words = np.ndarray((self.size - 7,), "<u8", raw, strides=(1,)).copy()
            self.words = _mixed(words)
        else:
            self.words = np.empty(0, np.uint64)
        self.sums: dict[int, np.ndarray] = {}

    def at(self, starts: np.ndarray, width: int, family: int) -> np.ndarray:
        """Hash of the ``width`` (8 or more) bytes at each start."""
        powers, inverses = self.powers[family]
        if family not in self.sums:
            sums = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(self.words * powers[: len(self.words)], out=sums[1:])
            self.sums[family] = sums
        sums = self.sums[family]
        return _mixed((sums[starts + (width - 7)] - sums[starts]) * inverses[starts])


def _pieces(size: int, width: int) -> Iterator[tuple[int, int]]:
    """(first start, end of starts) so that each piece has at most ``PIECE`` starts."""
    for first in range(0, max(0, size - width + 1), PIECE):
        yield first, min(first + PIECE, size - width + 1)


def sample_starts(first: int, end: int, cover: np.ndarray, v: int) -> np.ndarray:
    """Cover positions in [first, end), counted from the start of the row."""
    blocks = np.arange(first // v, -(-end // v)) * v
    found = (blocks[:, None] + cover[None, :]).ravel()
    return found[(found >= first) & (found < end)]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


class Slot:
    """The rows of one slot, in an order that every pass repeats."""

    def __init__(self, rows: pa.Table, replies: pa.Table, widths: tuple[int, ...], buckets: int):
        self.widths, self.width, self.buckets = widths, widths[0], buckets
        self.cover, self.v = cover_for(self.width)
        self.name_width = self.width - self.v + 1
        digests = rows.column("digest").to_pylist()
        self.order = sorted(range(len(digests)), key=digests.__getitem__)
        data = rows.column("data")
        self.data = [data[i].as_buffer() for i in self.order]
        kinds, flags = replies.column("kind").to_pylist(), replies.column("flag").to_pylist()
        places, payloads = replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()
        self.powers = _powers(min(PIECE + widths[-1], max(map(len, self.data), default=0)) + 1)
        copies = {p: f for k, p, f in zip(kinds, payloads, flags) if k == 0}
        self.masks = {kind: {} for kind in range(1, len(widths) + 2)}
        for kind, place, payload in zip(kinds, places, payloads):
            if kind:
                self.masks[kind][place] = payload
        # Equal texts: whole ones go, and one of them stands for all.
        self.again, self.idle, seen = [], [], set()
        for i, text in zip(self.order, self.data):
            digest = digests[i]
            again = digest in copies
            self.again.append(again)
            self.idle.append(len(text) < self.width or (again and (not copies[digest] or digest in seen)))
            seen.add(digest)
        self.found: dict[int, list[np.ndarray]] = {}

    def samples(self) -> list[np.ndarray]:
        """Name of each cover sample of each row that takes part."""
        found = []
        for data, idle in zip(self.data, self.idle):
            names = []
            if not idle:
                view = memoryview(data)
                for first, end in _pieces(len(view), self.name_width):
                    starts = sample_starts(first, end, self.cover, self.v) - first
                    names.append(Hashes(view[first : end + self.name_width - 1], self.powers).at(starts, self.name_width, 0))
            found.append(np.concatenate(names) if names else np.empty(0, np.uint64))
        return found

    def blobs(self, values: np.ndarray, places: np.ndarray, keep: int) -> list[tuple[int, bytes]]:
        """(bucket, entries of ``keep`` bytes) of values that are ordered by bucket."""
        edges = np.searchsorted(places, np.arange(self.buckets + 1))
        raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :keep]
        return [(b, raw[edges[b] : edges[b + 1]].tobytes()) for b in range(self.buckets) if edges[b] < edges[b + 1]]

    def marked(self, kind: int, places: np.ndarray) -> np.ndarray:
        """Which of the entries sent in round ``kind`` were found in other slots too."""
        out = np.zeros(len(places), bool)
        edges = np.searchsorted(places, np.arange(self.buckets + 1))
        for place, mask in self.masks[kind].items():
            first, end = edges[place], edges[place + 1]
            out[first:end] = np.unpackbits(np.frombuffer(mask, np.uint8), count=end - first).astype(bool)
        return out

    def candidates(self) -> list[np.ndarray]:
        """Starts of the suffixes of each row that a repeated sample reaches."""
        samples = self.samples()
        names, counts = np.unique(np.concatenate(samples) if samples else np.empty(0, np.uint64), return_counts=True)
        again = names[(counts > 1) | self.marked(1, _bucket(names, self.buckets))]
        found = []
        for data, names in zip(self.data, samples):
            last = len(data) - self.width + 1
            if not len(names) or not len(again) or last <= 0:
                found.append(np.empty(0, np.int64))
                continue
            at = np.minimum(np.searchsorted(again, names), len(again) - 1)
            starts = sample_starts(0, len(data) - self.name_width + 1, self.cover, self.v)[again[at] == names]
            edges = np.zeros(last + 1, np.int64)
            np.add.at(edges, np.minimum(np.maximum(starts - self.v + 1, 0), last), 1)
            np.add.at(edges, np.minimum(starts + 1, last), -1)
            found.append(np.flatnonzero(np.cumsum(edges[:-1]) > 0))
        return found

    def narrowed(self, level: int) -> list[np.ndarray]:
        """Starts of strings of this level's width whose first and last part repeat at the level before."""
        step, width, found = self.widths[level] - self.widths[level - 1], self.widths[level], []
        for data, hits in zip(self.data, self.hits(level - 1)):
            hits = hits[hits <= len(data) - width]
            found.append(hits[np.isin(hits + step, self.found[level - 1][len(found)], assume_unique=True)])
        return found

    def suffixes(self, level: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Candidate starts and hashes of each row; then the distinct hashes, their buckets and local counts, by bucket."""
        width = self.widths[level]
        starts, hashes, others = self.narrowed(level) if level else self.candidates(), [], []
        for data, wanted in zip(self.data, starts):
            own, other, view = [], [], memoryview(data)
            for first, end in _pieces(len(view), width):
                here = wanted[(wanted >= first) & (wanted < end)] - first
                if len(here):
                    piece = Hashes(view[first : end + width - 1], self.powers)
                    own.append(piece.at(here, width, 1))
                    other.append(_bucket(piece.at(here, width, 0), self.buckets).astype(np.int32))
            hashes.append(np.concatenate(own) if own else np.empty(0, np.uint64))
            others += other
        values, index, counts = np.unique(
            np.concatenate(hashes) if hashes else np.empty(0, np.uint64), return_index=True, return_counts=True
        )
        places = np.concatenate(others)[index].astype(np.int64) if others else np.empty(0, np.int64)
        order = np.argsort(places, kind="stable")
        return starts, hashes, values[order], places[order], counts[order]

    def hits(self, level: int) -> list[np.ndarray]:
        """Starts of the repeated strings of each row that takes part."""
        if level not in self.found:
            starts, hashes, values, places, counts = self.suffixes(level)
            again = np.sort(values[(counts > 1) | self.marked(2 + level, places)])
            found = []
            for wanted, own in zip(starts, hashes):
                if len(own) and len(again):
                    at = np.minimum(np.searchsorted(again, own), len(again) - 1)
                    found.append(wanted[again[at] == own])
                else:
                    found.append(np.empty(0, np.int64))
            self.found[level] = found
        return self.found[level]

    def repeated(self, level: int) -> list[list[tuple[int, int]]]:
        """Maximal repeated runs of each row, in the order of ``self.order``."""
        width, runs = self.widths[level], []
        for data, again, hits in zip(self.data, self.again, self.hits(level)):
            if again and len(data) >= width:
                runs.append([(0, len(data))])
            elif not len(hits):
                runs.append([])
            else:
                # Runs of windows that touch or overlap.
                gaps = np.flatnonzero(np.diff(hits) > width)
                firsts, lasts = hits[np.concatenate([[0], gaps + 1])], hits[np.concatenate([gaps, [len(hits) - 1]])]
                runs.append([(int(a), int(b) + width) for a, b in zip(firsts, lasts)])
        return runs


def _repeated(sent: DataFrame, keep: int, kind: int) -> DataFrame:
    """Replies to the slots: a bitmap over each blob whose entries other blobs of the bucket hold too."""

    def run(table: pa.Table) -> pa.Table:
        slots, blobs = table.column("slot").to_pylist(), table.column("blob").to_pylist()
        sizes, joined = [len(blob) // keep for blob in blobs], b"".join(blobs)
        del blobs
        if keep == 8:
            values = np.frombuffer(joined, "<u8")
        else:
            padded = np.zeros((len(joined) // keep, 8), np.uint8)
            padded[:, :keep] = np.frombuffer(joined, np.uint8).reshape(-1, keep)
            values = padded.view("<u8").ravel()
        # The bucket is sorted; every entry with an equal neighbour is marked.
        order = np.argsort(values)
        ranked = values[order]
        same = np.zeros(len(values), bool)
        if len(values) > 1:
            equal = ranked[1:] == ranked[:-1]
            same[order[1:][equal]] = True
            same[order[:-1][equal]] = True
        out, at = {"slot": [], "kind": [], "bucket": [], "payload": [], "flag": []}, 0
        bucket = table.column("bucket")[0].as_py()
        for slot, size in zip(slots, sizes):
            mask = same[at : at + size]
            at += len(mask)
            if mask.any():
                for name, value in zip(out, (slot, kind, bucket, np.packbits(mask).tobytes(), False)):
                    out[name].append(value)
        return pa.table(out, schema=_REPLY)

    return sent.groupBy("bucket").applyInArrow(run, REPLY)


REPLY = "slot int, kind int, bucket int, payload binary, flag boolean"
_REPLY = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("flag", pa.bool_())])
SENT = "slot int, bucket int, blob binary"
_SENT = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def _send(rows: DataFrame, replies: DataFrame, widths: tuple[int, ...], buckets: int, level: int | None) -> DataFrame:
    """The distinct hashes of each slot by bucket: of its suffixes at a level, or of its samples."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"slot": [], "bucket": [], "blob": []}
        if left.num_rows:
            slot = Slot(left, right, widths, buckets)
            if level is not None:
                _, _, values, places, _ = slot.suffixes(level)
                blobs = slot.blobs(values, places, 8)
            else:
                values = np.unique(np.concatenate(slot.samples()))
                blobs = slot.blobs(values, _bucket(values, buckets), 5)
            number = left.column("slot")[0].as_py()
            for bucket, blob in blobs:
                out["slot"].append(number), out["bucket"].append(bucket), out["blob"].append(blob)
        return pa.table(out, schema=_SENT)

    return rows.select("slot", "digest", "data").groupBy("slot").cogroup(replies.groupBy("slot")).applyInArrow(run, SENT)


def passages(data: bytes | memoryview, runs: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """The runs of at least ``least_words`` words or ``WIDTH`` bytes."""
    return [(a, b) for a, b in runs if b - a >= WIDTH or len(bytes(data[a:b]).split()) >= least_words]


def find_repeats(df: DataFrame, text_col: str = "text", *, width: int = WIDTH, shorter: int | None = None, least_words: int = 0,
                 slot_bytes: int = SLOT_BYTES, buckets: int | None = None, whole_characters: bool = False) -> DataFrame:
    """Each row of ``df`` as struct ``row`` with n_bytes, n_removed, runs (array of start, end), passages (likewise) and kept (binary).

    ``runs`` are covered by repeated strings of ``width`` bytes and removed from ``kept``;
    ``passages`` by those of ``shorter`` bytes (default: ``width``), as far as they have
    ``least_words`` words (or ``WIDTH`` bytes, for scripts without spaces). Without ``shorter``
    the runs are held to ``least_words`` too. ``whole_characters`` drops from ``kept`` what is
    no longer a whole UTF-8 character. Widths must be at least 16, ``shorter`` below ``width``.
    """
    spark = df.sparkSession
    widths = (width,) if shorter is None else (shorter, width)
    if min(widths) < 16 or widths[0] > width or (shorter == width):
        raise ValueError("widths must be at least 16, the shorter one below width")
    names = [f"c{i}" for i in range(len(df.columns))]
    data = F.coalesce(F.col(f"c{df.columns.index(text_col)}").cast("binary"), F.lit(b""))
    inner = df.toDF(*names).withColumn("data", data)
    total = inner.agg(F.sum(F.octet_length("data")).alias("bytes")).first()["bytes"] or 0
    slots = max(1, -(-total // slot_bytes))
    buckets = buckets or max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))
    passed = [n for n, c in zip(names, df.columns) if c != text_col]
    rows = inner.withColumn("slot", F.pmod(F.xxhash64(*passed, "data"), F.lit(slots)).cast("int"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("data", 256))).drop(f"c{df.columns.index(text_col)}")
    rows = stage_bucketed(rows, "slots", "slot", shuffle_partitions(spark))

    # Equal texts: how many there are, and the slot whose copy stands for all.
    here = rows.where(F.octet_length("data") >= widths[0]).groupBy("slot", "digest").agg(F.count("*").alias("n"))
    several = here.groupBy("digest").agg(F.sum("n").alias("n"), F.min("slot").alias("home")).where("n > 1")
    copies = stage(
        here.select("slot", "digest").join(several, "digest").select(
            "slot", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("digest").alias("payload"), (F.col("slot") == F.col("home")).alias("flag")
        ),
        "copies",
    )
    samples = stage(_repeated(_send(rows, copies, widths, buckets, None), 5, 1), "samples")
    known = copies.unionByName(samples)
    for level in range(len(widths)):
        known = known.unionByName(stage(_repeated(_send(rows, known, widths, buckets, level), 8, 2 + level), "suffixes"))

    kinds = [f for f in rows.schema.fields if f.name in passed]
    shown = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds] + ["text binary, n_bytes bigint, n_removed bigint, runs array<struct<start:bigint,end:bigint>>, passages array<struct<start:bigint,end:bigint>>, kept binary"])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = Slot(left, right, widths, buckets)
        runs, spans = slot.repeated(len(widths) - 1), slot.repeated(0)
        spans = [passages(data, found, least_words) for data, found in zip(slot.data, map(list, spans))]
        if len(widths) == 1:
            runs = spans
        kept = []
        for data, gone in zip(slot.data, runs):
            view, at, parts = memoryview(data), 0, []
            for first, end in gone:
                parts.append(view[at:first])
                at = end
            rest = b"".join([*parts, view[at:]])
            kept.append(rest.decode("utf-8", "ignore").encode() if gone and whole_characters else rest)
        ordered = left.take(pa.array(slot.order, pa.int64()))
        columns = [ordered.column(name) for name in passed]
        columns += [
            ordered.column("data"), pa.array([len(d) for d in slot.data], pa.int64()),
            pa.array([sum(b - a for a, b in gone) for gone in runs], pa.int64()),
            *[pa.array([[{"start": a, "end": b} for a, b in x] for x in found], run_type) for found in (runs, spans)], pa.array(kept, pa.binary()),
        ]
        return pa.table(columns, names=[*passed, "text", "n_bytes", "n_removed", "runs", "passages", "kept"])

    cogrouped = rows.groupBy("slot").cogroup(known.groupBy("slot"))
    # Replies come for slots with rows only, so the left side is never empty.
    found = cogrouped.applyInArrow(finish, shown)
    back = [F.col("text").cast("string").alias(c) if c == text_col else F.col(n).alias(c) for n, c in zip(names, df.columns)]
    return found.select(F.struct(*back).alias("row"), "n_bytes", "n_removed", "runs", "passages", "kept")


def without_repeats(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with repeated strings cut out of the text; rows of which nothing is left go.

    A character that a cut leaves incomplete is dropped too. Other rows keep their text; null
    texts come back empty.
    """
    found = find_repeats(df, text_col, whole_characters=True, **options)
    found = found.where((F.col("n_removed") == 0) | (F.octet_length("kept") > 0))
    cut = F.col("kept").cast("string")
    return found.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


def op1_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_repeats(docs, shorter=PASSAGE, least_words=PASSAGE_WORDS)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("runs").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("bigint").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("bigint"), lambda n, p: n + p["end"] - p["start"]).alias("passage_bytes"),
    )
