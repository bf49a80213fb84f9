"""Best-fit packing of documents into sequences of bounded length, with conflicts.

Rows are dealt to shards by a hash, so no task sees more than about ``shard_rows`` rows
and a hot source or group of copies spreads evenly. Each shard packs its rows from the
longest down into bins ordered by what is left in them. A bin carries one bitmap of the
sources and one of the duplicate clusters it may not take again; from the first bin that
is large enough the search moves to the next until one is compatible, so each document
goes to the tightest compatible bin, or opens a new one.

A bin holds at most ``per_source`` documents of a source and one of a cluster. A document
longer than a bin is cut: full pieces fill bins of their own, the rest is packed like a
document (its cluster keeps it from copies of itself).

The hash takes in where a row stands in the table, so repeated rows are dealt to many shards
as well.

Cases: null and empty texts have length 0 and are placed like any other row; null
sources and null clusters conflict with nothing; equal lengths are ordered by id, cluster
and source; repeated rows are packed each for itself, in different bins if they have a
cluster; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 4096
PER_SOURCE = 2


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1).cast("bigint")


def pack(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int = PER_SOURCE) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, bin, offset, length) of each piece; items are taken from the longest down.

    ``sources`` and ``clusters`` are small numbers or None. Ties keep the given order.
    """
    placed, jobs, next_bin = [], [], 0
    for item, length in enumerate(lengths):
        full = max(0, length - 1) // capacity
        for piece in range(full):
            placed.append((item, piece, next_bin, 0, capacity))
            next_bin += 1
        jobs.append((full * capacity - length, item, full))
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    barred: dict[int, list] = {}  # bin -> [source bitmap, cluster bitmap, documents by source]
    for negative, item, piece in sorted(jobs):
        length = -negative
        source, cluster = sources[item], clusters[item]
        source_bit = 1 << source if source is not None else 0
        cluster_bit = 1 << cluster if cluster is not None else 0
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            bits = barred[open_bins[at][1]]
            if not bits[0] & source_bit and not bits[1] & cluster_bit:
                break
            at += 1
        if at < len(open_bins):
            residual, number = open_bins.pop(at)
        else:
            residual, number = capacity, next_bin
            barred[number] = [0, 0, {}]
            next_bin += 1
        bits = barred[number]
        bits[1] |= cluster_bit
        if source is not None:
            bits[2][source] = bits[2].get(source, 0) + 1
            if bits[2][source] >= per_source:
                bits[0] |= source_bit
        placed.append((item, piece, number, capacity - residual, length))
        insort(open_bins, (residual - length, number))
    return placed


def best_fit(df: DataFrame, id_col: str, length: str | Column, source_col: str, cluster: str | Column, *,
             capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, per_source: int = PER_SOURCE, keep_text: str | None = None) -> DataFrame:
    """One row for each piece: id, piece, pieces, bin_id, bin_offset, n_tokens, and text if ``keep_text`` names its column.

    ``length`` is a count of tokens; ``bin_id`` is unique over all shards. The text of an
    uncut document is as it was, that of a piece its words with single spaces.
    """
    text = [F.col(keep_text).alias("_text")] if keep_text else []
    columns = df.select(
        F.col(id_col), _column(length).cast("bigint").alias("_length"), F.col(source_col).alias("_source"), _column(cluster).alias("_cluster"), *text
    )
    shards = max(1, -(-df.count() // shard_rows))
    dealt = columns.withColumn("_shard", F.pmod(F.xxhash64(id_col, "_cluster", "_length", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, piece int, pieces int, bin_id bigint, bin_offset bigint, n_tokens bigint"
    schema += ", text string" if keep_text else ""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([id_col, "_cluster", "_source", "_length"], kind="stable", na_position="first").reset_index(drop=True)

        def numbers(values: pd.Series) -> list:
            codes, _ = pd.factorize(values)
            return [int(c) if c >= 0 else None for c in codes]

        lengths = frame["_length"].fillna(0).astype("int64").tolist()
        rows = pack(lengths, numbers(frame["_source"]), numbers(frame["_cluster"]), capacity, per_source)
        found = np.array(rows, dtype=np.int64).reshape(-1, 5)
        pieces = np.bincount(found[:, 0], minlength=len(frame))
        made = pd.DataFrame({
            id_col: frame[id_col].take(found[:, 0]).reset_index(drop=True), "piece": found[:, 1].astype("int32"),
            "pieces": pieces[found[:, 0]].astype("int32"), "bin_id": (int(key[0]) << 32) + found[:, 2],
            "bin_offset": found[:, 3], "n_tokens": found[:, 4],
        })
        if keep_text:
            made["text"] = [
                frame["_text"][item] if pieces[item] == 1 else words_between(frame["_text"][item], piece * capacity, piece * capacity + size)
                for item, piece, _, _, size in rows
            ]
        return made

    return dealt.groupBy("_shard").applyInPandas(run, schema)


def _column(given: str | Column) -> Column:
    return F.col(given) if isinstance(given, str) else given


def words_between(text: str, first: int, end: int) -> str:
    """Words ``first`` to ``end`` of a text, split as ``n_words`` counts them."""
    return b" ".join(text.encode().split()[first:end]).decode()


def copies_of(text: Column) -> Column:
    """The cluster of texts equal but for case and white space; null for texts without words."""
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.when(flat != "", F.xxhash64(flat))


def with_measures(docs: DataFrame, text_col: str = "text", words: str = "_words", copies: str = "_copies") -> DataFrame:
    """Adds the length in words and the cluster of copies, under names that ``docs`` must not have."""
    taken = {words, copies} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist; name others")
    return docs.withColumns({words: n_words(F.col(text_col)), copies: copies_of(F.col(text_col))})


def op7_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    return best_fit(docs, "doc_id", n_words(text), "source", copies_of(text))
