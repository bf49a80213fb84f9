"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 63-bit hashes of a text's
word shingles. A text with at most k shingles is represented exactly. Sketches of
parts merge into the sketch of the whole.

Cases: null text counts as empty; a text without words has an empty sketch; a text
with fewer words than a shingle has one shingle of all its words; equal texts have
equal sketches. Two empty sketches resemble each other fully (1.0), an empty and a
non-empty one not at all (0.0).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import shuffle_partitions

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
HASH_SPAN = float(2**63)
_MASK = 2**63 - 1
_FIRST = -(2**63)


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")


def _hash_at(parts: Column, size: int):
    def hashed(word: Column, i: Column) -> Column:
        shingle = [word] + [F.get(parts, i + j) for j in range(1, size)]
        return F.xxhash64(*shingle).bitwiseAND(F.lit(_MASK))

    return hashed


def with_sketch(df: DataFrame, text_col: str, out_col: str, size: int = SHINGLE_WORDS, k: int = SKETCH_SIZE) -> DataFrame:
    """Adds the sketch of ``text_col`` as ``out_col`` (array of bigint)."""
    parts = f"_words_{uuid.uuid4().hex[:8]}"
    known = df.withColumn(parts, words(F.col(text_col)))
    word_array = F.col(parts)
    hashes = F.transform(word_array, _hash_at(word_array, size))
    # Positions past the last whole shingle hash fewer words and are cut off.
    whole = F.slice(hashes, 1, F.greatest(F.size(word_array) - F.lit(size - 1), F.lit(1)))
    sketch = F.slice(F.sort_array(F.array_distinct(whole)), 1, k)
    empty = F.array().cast("array<bigint>")
    return known.withColumn(out_col, F.when(F.element_at(word_array, 1) == "", empty).otherwise(sketch)).drop(parts)


def to_text(sketch: Column) -> Column:
    """Sixteen hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def from_text(text: Column) -> Column:
    digits = F.length(text)
    starts = F.when(digits >= 16, F.sequence(F.lit(1), digits - 15, F.lit(16))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.conv(F.substring(text, i, F.lit(16)), 16, 10).cast("bigint"))


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity: the share of both among the k smallest of the union."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.size(low)).cast("double")


def distinct_count(sketch: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    exact = F.size(sketch).cast("double")
    return F.when(F.size(sketch) < k, exact).otherwise(F.lit((k - 1) * HASH_SPAN) / F.element_at(sketch, -1))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b holds too."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    shared = resemblance(a, b, k) * distinct_count(union, k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared))


def merge(df: DataFrame, keys: list[str], sketch_col: str, k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch for each key from the sketches of its parts.

    Each task keeps at most k hashes of a key before the shuffle, so a hot key moves
    k hashes from each task. Keys whose parts are all empty keep an empty sketch.
    """
    hashes = df.select(*keys, F.explode_outer(sketch_col).alias("_hash")).distinct()
    ranked = hashes.withColumn("_rank", F.expr(f"row_number() OVER (PARTITION BY {', '.join(f'`{x}`' for x in keys)} ORDER BY _hash NULLS LAST)"))
    low = ranked.where(F.col("_rank") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch_col))


def with_next(df: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """Each row with ``next_text``: the text of the next row by (id, text); the last row gets the first's.

    Returns (``id_col``, ``text_col``, next_text, _part, _key, _own), ``_own`` false for
    the helper copies that start the following part; drop them after use. Rows are dealt
    to parts between quantiles of the id, and the first row of a part is also sent to the
    part before, so nothing needs a global order in one task. A null id sorts first. The
    number of quantiles is bounded by ``parts`` (default: four for each shuffle partition).
    """
    parts = parts or 4 * shuffle_partitions(df.sparkSession)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_FIRST))
    keyed = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), key.alias("_key"))
    shares = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    found = df.select(key.alias("_key")).agg(
        F.percentile_approx("_key", shares, 100 * parts).alias("bounds"), F.min("_key").alias("first")
    ).first()
    bounds = sorted(set(found["bounds"] or []) - {found["first"]})
    first = found["first"] if found["first"] is not None else _FIRST
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    last = len(bounds)
    place = F.size(F.filter(edges, lambda b: b <= F.col("_key")))
    dealt = keyed.withColumn("_part", place)
    # (part, turn): turn 0 is the row itself, 1 a copy for the part before, 2 a copy that closes the circle.
    copies = F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("turn")))
    before = F.when(
        F.array_contains(edges, F.col("_key")), F.array(F.struct((F.col("_part") - 1).alias("part"), F.lit(1).alias("turn")))
    )
    around = F.when(F.col("_key") == first, F.array(F.struct(F.lit(last).alias("part"), F.lit(2).alias("turn"))))
    none = F.slice(copies, 1, 0)
    spread = dealt.withColumn("_to", F.explode(F.concat(copies, F.coalesce(before, none), F.coalesce(around, none))))
    order = "PARTITION BY _part ORDER BY _turn, _key, `{0}`".format(text_col)
    return spread.select(
        id_col, text_col, "_key", F.col("_to.part").alias("_part"),
        F.col("_to.turn").alias("_turn"),
    ).withColumn("next_text", F.expr(f"lead(`{text_col}`) OVER ({order})")).withColumn("_own", F.col("_turn") == 0)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH_SIZE) -> DataFrame:
    """Each document's sketch beside those of its edited text and of the next document.

    The edited text has the last quarter of the code points (rounded down) replaced by as
    many of the next document's first ones. Returns one row for each row of ``df``:
    id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch. A null text is empty;
    repeated ids are ordered by text; an only document is its own next.
    """
    rows = with_next(df, id_col, text_col)
    n = F.length(text_col)
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col(text_col), n - cut), F.left("next_text", cut))
    rows = rows.withColumn("_n", n.cast("bigint")).withColumn("_edited", edited)
    rows = with_sketch(rows, text_col, "sketch", k=k)
    rows = with_sketch(rows, "_edited", "edited_sketch", k=k)
    rows = rows.select(
        id_col, "_part", "_turn", "_key", "_own", "_n", F.sha2("_edited", 256).alias("edited_sha256"), "sketch", "edited_sketch", text_col
    )
    order = "PARTITION BY _part ORDER BY _turn, _key, `{0}`".format(text_col)
    rows = rows.withColumn("next_sketch", F.expr(f"lead(sketch) OVER ({order})")).where("_own")
    return rows.select(
        id_col, F.col("_n").alias("n_chars"), "edited_sha256", "sketch", "edited_sketch", "next_sketch"
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = edited_fingerprints(docs)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("sketch")).alias("fingerprint"),
        to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_within"),
    )
