"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text gets a leading ``▁`` and has its spaces replaced by ``▁``; it falls apart into words
(marks, then other characters), because no piece holds a mark after another character. Each
distinct word of a batch is segmented once: words of equal length form a matrix and advance
together, hashes of all substrings probe the sorted keys of the pieces of each length, and
the best score of every end, with the longest last piece among equals, stores the length of
that piece as backpointer. Characters without a piece become byte pieces. Segments maximise
the sum of piece scores, as in a unigram model; with a BPE vocabulary that is not always the
merge order's choice.

Decoding is exact: ``decode(encode(text)) == text``, also for a literal ``▁``, which is
encoded as bytes. Cases: null and empty texts have no tokens and decode to the empty text;
words of any length are searched in stretches of columns; equal texts get equal tokens.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LITERAL = "\ud800"  # stands for a literal mark; no valid text holds it
CELLS = 1 << 19
STRETCH = 4096
CACHED = 1 << 17
CHUNK = 1 << 20
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BASE = 0x9E3779B97F4A7C15


def load_pieces(path: str = MODEL_FILE) -> dict:
    """Plain values of a model: piece texts, scores and byte ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = range(model.get_piece_size())
    normal = [i for i in known if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {
        "texts": [model.id_to_piece(i) for i in known],
        "scores": [model.get_score(i) for i in known],
        "normal": normal,
        "bytes": {int(model.id_to_piece(i)[1:-1], 16): i for i in known if model.is_byte(i)},
    }


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Codec:
    """Encoder and decoder over the values of ``load_pieces``."""

    def __init__(self, model: dict):
        self.model = model
        by_length: dict[int, list[int]] = {}
        for i in model["normal"]:
            by_length.setdefault(len(model["texts"][i]), []).append(i)
        self.longest = max(by_length)
        self._forget()
        self.powers = self._powers(STRETCH + self.longest)
        self.tables = {}
        for length, ids in by_length.items():
            points = np.array([[ord(c) for c in model["texts"][i]] for i in ids], np.uint64)
            keys = _mixed((_mixed(points + np.uint64(1)) * self.powers[0][:length]).sum(axis=1, dtype=np.uint64))
            order = np.argsort(keys)
            seen = np.zeros(1 << 18, bool)
            seen[keys >> np.uint64(46)] = True
            self.tables[length] = (keys[order], np.array([model["scores"][i] for i in ids])[order], np.array(ids, np.int32)[order], seen)
        self.unknown = min(model["scores"][i] for i in model["normal"]) - 10.0
        flat = [model["texts"][i].replace(MARK, " ").encode() for i in range(len(model["texts"]))]
        for value, i in model["bytes"].items():
            flat[i] = bytes([value])
        for i in set(range(len(flat))) - set(model["normal"]) - set(model["bytes"].values()):
            flat[i] = b""
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.flat_size = np.array([len(x) for x in flat])
        self.flat_start = np.concatenate([[0], np.cumsum(self.flat_size)[:-1]])

    @staticmethod
    def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size + 1, b, np.uint64)
            x[0] = 1
            found.append(np.multiply.accumulate(x))
        return found[0], found[1]

    def _segment(self, points: np.ndarray) -> np.ndarray:
        """Backpointers (length of the last piece, 0 for bytes) of each end of equally long words."""
        count, size = points.shape
        back = np.zeros((count, size + 1), np.uint8)
        # The best scores of the last ends, one column for each piece length.
        best = np.full((count, self.longest), -np.inf)
        best[:, -1] = 0.0
        for first in range(0, size, STRETCH):
            start = max(0, first - self.longest + 1)
            end = min(size, first + STRETCH)
            sums = np.zeros((count, end - start + 1), np.uint64)
            np.cumsum(_mixed(points[:, start:end] + np.uint64(1)) * self.powers[0][: end - start], axis=1, out=sums[:, 1:])
            scores = {}
            for length, (keys, values, _, seen) in self.tables.items():
                if length <= end - start:
                    hashes = _mixed((sums[:, length:] - sums[:, :-length]) * self.powers[1][: end - start - length + 1])
                    found = np.full(hashes.shape, -np.inf)
                    # Few substrings pass the table of leading bits; those probe the sorted keys.
                    here = np.nonzero(seen[hashes >> np.uint64(46)])
                    likely = hashes[here]
                    at = np.minimum(np.searchsorted(keys, likely), len(keys) - 1)
                    found[here] = np.where(keys[at] == likely, values[at], -np.inf)
                    scores[length] = found
            lengths = sorted(scores, reverse=True)
            for stop in range(first + 1, end + 1):
                tries = [best[:, -length] + scores[length][:, stop - length - start] if stop - length >= start else None for length in lengths]
                used = [i for i, x in enumerate(tries) if x is not None]
                stack = np.stack([tries[i] for i in used] + [best[:, -1] + self.unknown])
                choice = stack.argmax(axis=0)  # the first of equal scores: the longest piece
                back[:, stop] = np.array([lengths[i] for i in used] + [0], np.uint8)[choice]
                best = np.concatenate([best[:, 1:], stack[choice, np.arange(count)][:, None]], axis=1)
        return back

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the number of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        parts, counts = [], np.zeros(len(words), np.int64)
        for first, end in zip(edges, np.append(edges[1:], len(words))):
            size = int(lengths[order[first]])
            step = max(1, CELLS // (size * 8))
            for at in range(first, end, step):
                chosen = order[at : min(end, at + step)]
                joined = "".join(map(words.__getitem__, chosen)).encode("utf-32-le", "surrogatepass")
                points = np.frombuffer(joined, "<u4").reshape(len(chosen), size).astype(np.uint64)
                ids, counts[chosen] = self._walk(points, self._segment(points))
                parts.append(ids)
        if not parts:
            return np.empty(0, np.int32), counts
        # From the order of lengths back to that of the words.
        begins = np.empty(len(words), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts)[_spread(begins, counts)], counts

    def _walk(self, points: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the backpointers of all words at once; tokens of all words and the number of each."""
        count, size = points.shape
        starts = np.zeros((count, size + 1), bool)
        at = np.full(count, size)
        live = np.arange(count)
        while len(live):
            step = np.maximum(back[live, at[live]].astype(np.int64), 1)
            at[live] -= step
            starts[live, at[live]] = True
            live = live[at[live] > 0]
        rows, firsts = np.nonzero(starts[:, :-1])
        ends = np.where(np.append(rows[1:] != rows[:-1], True), size, np.append(firsts[1:], size))
        raw = back[rows, ends] == 0
        ids, width = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int64)
        for length, (keys, _, piece_ids, _) in self.tables.items():
            here = np.flatnonzero((ends - firsts == length) & ~raw)
            if len(here):
                parts = points[rows[here][:, None], firsts[here][:, None] + np.arange(length)]
                hashes = _mixed((_mixed(parts + np.uint64(1)) * self.powers[0][:length]).sum(axis=1, dtype=np.uint64))
                ids[here] = piece_ids[np.searchsorted(keys, hashes)]
        if raw.any():
            # Characters without a piece widen to their bytes.
            chars, which = np.unique(points[rows[raw], firsts[raw]], return_inverse=True)
            spelled = [self._raw(chr(int(c))) for c in chars]
            sizes = np.array([len(x) for x in spelled])
            flat, begins = np.array(sum(spelled, []), np.int32), np.cumsum(sizes) - sizes
            width[raw] = sizes[which]
            wide = np.repeat(ids, width)
            wide[np.repeat(raw, width)] = flat[_spread(begins[which], sizes[which])]
            ids = wide
        return ids, np.bincount(np.repeat(rows, width), minlength=count)

    def _raw(self, char: str) -> list[int]:
        return [self.model["bytes"][b] for b in (MARK if char == LITERAL else char).encode()]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.number) > CACHED:
            self._forget()
        parts = []
        for text in texts:
            marked = MARK + text.replace(MARK, LITERAL).replace(" ", MARK) if text else ""
            words = _WORD.findall(marked)
            parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        ids, counts = self.encode_words(list(islice(self.number, len(self.counts), None)))
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        begins = np.cumsum(self.counts) - self.counts
        return [self.ids[_spread(begins[p], self.counts[p])] for p in parts]

    def _forget(self) -> None:
        """Words are numbered as they come and keep their tokens between batches, up to ``CACHED`` words."""
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; the leading space is the encoder's."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        data = self.flat[_spread(self.flat_start[ids], self.flat_size[ids])].tobytes()
        return data.decode("utf-8", "replace").removeprefix(" ")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs."""
    if not len(sizes):
        return np.empty(0, np.int64)
    total = int(sizes.sum())
    skipped = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return skipped + np.arange(total)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """id, ids (array of int), decoded (the text read back from ids) of each row. Only the driver reads the model file."""
    sent = df.sparkSession.sparkContext.broadcast(load_pieces(model_file))  # as many entries as the vocabulary
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(sent.value)
        for frame in frames:
            texts, at = frame[text_col].to_numpy(), 0
            while at < len(texts):
                # About ``CHUNK`` characters at a time go in and out, so long texts stand alone.
                chosen, size = [], 0
                while at < len(texts) and (not chosen or size < CHUNK):
                    chosen.append(texts[at] if isinstance(texts[at], str) else "")
                    size += len(chosen[-1])
                    at += 1
                ids = codec.encode(chosen)
                names = frame[id_col].iloc[at - len(chosen) : at]
                yield pd.DataFrame({
                    id_col: names, "ids": pd.Series(ids, index=names.index, dtype=object), "decoded": [codec.decode(x) for x in ids],
                })

    return df.select(id_col, text_col).mapInPandas(run, schema)


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = encode(docs)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )
