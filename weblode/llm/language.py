"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed subwords (letter runs of
``ORDERS`` characters inside a word, word edges included). Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled
rows, then a temperature and a rejection threshold are fitted on a held-back part of it.
Prediction uses every subword of the whole text and nothing but the text.

Cases: a null text or one without letters gets ``und``, score 0, not accepted; without
any labelled row every text gets ``und``; equal texts get equal predictions; a text of any
length is summed in pieces; null labels are not learned from, null ids are ids like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import map_texts, stage

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
#: Most labelled rows of a language that training reads; the bound on what reaches the driver.
PER_LANGUAGE = 300
#: Most languages that are learned: those with the most labelled rows.
MOST_LANGUAGES = 200
EPOCHS = 12
PIECE = 1 << 18
#: Share of the held-back rows that rejection may lose.
REJECT_SHARE = 0.002
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # subword bucket -> logits, the product of embeddings and softmax weights
    bias: np.ndarray
    temperature: float
    least_score: float


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def subwords(text: str, letters: np.ndarray) -> np.ndarray:
    """Bucket of every subword of the text; other characters count as word edges."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.empty(0, np.int64)
    is_letter = letters[np.minimum(points, 0x10FFFF)]
    if not is_letter.any():
        return np.empty(0, np.int64)
    code = np.zeros(len(points) + 2, dtype=np.uint64)
    code[1:-1] = np.where(is_letter, points, 0)
    inside = code > 0
    found = []
    value, clean = np.zeros(len(code), dtype=np.uint64), np.ones(len(code), dtype=bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        # No edge strictly inside; an edge may start or end the subword.
        clean = clean[:m] & (inside[n - 2 : n - 2 + m] if n > 2 else True)
        kept = clean & (inside[:m] | inside[n - 1 :]) if n > 1 else inside[:m]
        if n in ORDERS:
            mixed = value[kept]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def pieces(text: str) -> Iterator[str]:
    """Parts of at most ``PIECE`` characters, cut at white space where there is some."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            cut = text.rfind(" ", start, end)
            end = cut if cut > start else end
        yield text[start:end]
        start = end


def counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for part in pieces(text if isinstance(text, str) else ""):
        total += np.bincount(subwords(part, letters), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


def fit(labels: list[str], features: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Train on the given sample; every fifth row calibrates instead."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    known = [(languages.index(y), x, w / w.sum()) for y, (x, w) in zip(labels, features) if len(x)]
    rng = np.random.default_rng(seed)
    known = [known[i] for i in rng.permutation(len(known))]
    held = known[::5] if len(known) >= 50 else known
    train = [row for i, row in enumerate(known) if i % 5] if len(known) >= 50 else known
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = max(1, EPOCHS * len(train))
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            y, x, w = train[i]
            rate = 2.0 * (1 - done / steps)
            done += 1
            rows = embeddings[x]
            mean = w @ rows
            logits = mean @ weights + bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[y] -= 1
            back = weights @ slope
            weights -= 0.5 * rate * np.outer(mean, slope)
            bias -= 0.05 * rate * slope
            # The mean spreads the gradient over the subwords; the rate makes up for their number.
            embeddings[x] = rows - rate * (w * len(w) ** 0.5)[:, None] * back
    table = (embeddings @ weights).astype(np.float32)
    model = Model(languages, table, bias, 1.0, 0.0)
    calibrate(model, held)
    return model


def calibrate(model: Model, held: list) -> None:
    """The temperature with the best likelihood, and the score that all but ``REJECT_SHARE`` of right rows reach."""
    if not held:
        return
    logits = np.array([w @ model.table[x] + model.bias for _, x, w in held], np.float64)
    truth = np.array([y for y, _, _ in held])

    def chances(temperature: float) -> np.ndarray:
        scaled = logits / temperature
        scaled -= scaled.max(axis=1, keepdims=True)
        grown = np.exp(scaled)
        return grown / grown.sum(axis=1, keepdims=True)

    tries = np.geomspace(0.25, 8, 41)
    losses = [-np.log(np.maximum(chances(t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in tries]
    model.temperature = float(tries[int(np.argmin(losses))])
    best = chances(model.temperature)
    right = best[best.argmax(axis=1) == truth].max(axis=1)
    floor = 1.2 / max(2, len(model.languages))
    model.least_score = float(min(max(floor, 0.5), np.quantile(right, REJECT_SHARE))) if len(right) else floor


def is_held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the ``per_language`` rows of each language with the smallest hashes of id and text.

    Held-out rows and rows without label are never read; rows without an id are rows like
    others, repeated rows count once. Only the subword counts of the sample reach the driver:
    at most per_language * MOST_LANGUAGES rows of BUCKETS counts.
    """
    place = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    usable = F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col))
    allowed = df.where(usable).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), place.alias("place"))
    common = allowed.groupBy("label").agg(F.count("*").alias("rows"), F.approx_count_distinct("place").alias("kinds"))
    common = stage(common.orderBy(F.desc("rows"), "label").limit(MOST_LANGUAGES), "languages")
    # Of a common language only about three times the wanted rows are ranked: those with small hashes.
    # ``kinds`` counts different rows, so copies of a few rows do not make the bound too low.
    share = F.col("place") / F.lit(2.0**64) + 0.5
    near = allowed.select("label", "place").join(F.broadcast(common), "label").where(share <= 3.0 * per_language / F.col("kinds"))
    ranked = near.select("label", "place").distinct().withColumn("rank", F.expr("row_number() OVER (PARTITION BY label ORDER BY place)"))
    chosen = stage(ranked.where(F.col("rank") <= per_language).select("label", "place"), "sample")
    schema = "label string, buckets array<int>, counts array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for frame in frames:
            found = [counts(text, letters) for text in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "buckets": [x for x, _ in found], "counts": [w for _, w in found]})

    # At most per_language * MOST_LANGUAGES hashes: a bounded broadcast.
    sample = allowed.join(F.broadcast(chosen), ["label", "place"]).groupBy("label", "place").agg(F.min("text").alias("text"))
    rows = sample.select("label", "text").mapInPandas(run, schema).toPandas()
    order = sorted(range(len(rows)), key=lambda i: (rows.label[i], len(rows.buckets[i]), bytes(np.asarray(rows.buckets[i])), bytes(np.asarray(rows["counts"][i]))))
    rows = rows.iloc[order]
    return fit(
        list(rows.label), [(np.asarray(x, np.int32), np.asarray(w, np.float32)) for x, w in zip(rows.buckets, rows["counts"])]
    )


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Each row of ``df`` as struct ``row`` with lang_pred, score and accepted."""
    # BUCKETS * languages floats, sent as plain values.
    sent = df.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        use, letters = Model(**sent.value), letter_table()

        def one(text: str | None) -> tuple[str, float, bool]:
            total, number = np.zeros(len(use.languages)), 0
            for part in pieces(text or ""):
                if len(found := subwords(part, letters)):
                    number += len(found)
                    total += use.table[found].sum(axis=0, dtype=np.float64)
            if not number or not use.languages:
                return UNKNOWN, 0.0, False
            logits = (total / number + use.bias) / use.temperature
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            best = int(chance.argmax())
            return use.languages[best], float(chance[best]), bool(chance[best] >= use.least_score)

        return lambda texts: list(zip(*map(one, texts))) or [[], [], []]

    return map_texts(df, text_col, "lang_pred string, score double, accepted boolean", make)


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), train(docs))
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"), "lang_pred", "score", "accepted")
