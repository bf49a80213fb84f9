"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Units of comparison are the lines of a file that mention licensing, and all such lines of
the file together. Every term, of a template or not, is weighted by the share of all units
of the corpus that have it, so that a line scores alike in a small and a large corpus of one
mix, and the sparse vectors meet the templates by joins on the term. A file takes the template
with the highest cosine at or above the threshold. A licence file licenses its directory;
files without a licence of their own take that of the nearest directory above (their own
first), found by joining each distinct directory's ancestors, not each file's.

Cases: null and empty texts have no units; null paths are files at the root without a
name; equal cosines take the first template name; several licence files of a directory
take the highest cosine, then the first licence name and path; repeated paths keep each
row; an empty table gives no rows. Only the named columns are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.storage import stage

THRESHOLD = 0.55
#: Added to the share of units with a term: the weight of rare terms has a limit whatever the number of units.
SMOOTH = 0.05
#: Terms with more than this share of the counts, fewer than its inverse, are joined by broadcast.
COMMON = 0.001
TRIGGER = r"(?i)licen[cs]e|licensed|copyright|spdx|public domain|permission is hereby|redistribution and use|all rights reserved"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"

# Short notices by which these licences are stated in headers and licence files.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
                 "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, dots inside numbers kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\d)|(?<!\d)\."), lambda t: t != "")


def template_terms(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """license, template, term, tf: a bounded table, as large as the templates."""
    chosen = TEMPLATES if templates is None else templates
    rows = [(name, f"{name}#{i}", text) for name, texts in sorted(chosen.items()) for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "license string, template string, text string")
    return table.select("license", "template", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "template", "term").agg(F.count("*").alias("tf"))


def units(files: DataFrame) -> DataFrame:
    """file, unit, text: each line that mentions licensing (numbered from 0), and all of a file's together (unit -1).

    ``files`` has file (a unique number) and text.
    """
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\r\n]+"), lambda line: F.rlike(line, F.lit(TRIGGER)))
    found = files.select("file", lines.alias("lines")).where(F.size("lines") > 0)
    every = F.when(F.size("lines") > 1, F.concat("lines", F.array(F.array_join("lines", "\n")))).otherwise(F.col("lines"))
    number = F.when((F.size("lines") > 1) & (F.col("unit") == F.size("lines")), F.lit(-1)).otherwise(F.col("unit"))
    return found.select("file", "lines", F.posexplode(every).alias("unit", "text")).select("file", number.alias("unit"), "text")


def matches(found: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file, license, cosine of the best template of each file that reaches the threshold."""
    counted = found.select("file", "unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("file", "unit", "term").agg(F.count("*").alias("tf"))
    counted = stage(counted, "terms")
    total, rows = max(1, found.count()), counted.count()
    seen = stage(counted.groupBy("term").agg(F.count("*").alias("df")), "df")
    rare = F.log(F.lit(1 + SMOOTH) / (F.coalesce(F.col("df"), F.lit(0)) / F.lit(total) + F.lit(SMOOTH))) + 1.0
    vocabulary = templates.select("term").distinct()  # words of the templates
    weights = stage(vocabulary.join(seen, "term", "left").select("term", rare.alias("idf")), "idf")
    common = F.broadcast(seen.where(F.col("df") > rows * COMMON).select("term", rare.alias("idf")))
    weighed = counted.join(common, "term").unionByName(
        counted.join(common, "term", "left_anti").join(seen.select("term", rare.alias("idf")), "term")
    )
    weighed = weighed.withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weighed.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    goal = templates.join(F.broadcast(weights), "term").withColumn("t", F.col("tf") * F.col("idf"))
    goal_length = goal.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("goal"))
    goal = goal.select("license", "template", "term", "t").join(goal_length, "template")
    dots = weighed.join(F.broadcast(goal), "term").groupBy("file", "unit", "license", "template").agg(
        F.sum(F.col("w") * F.col("t")).alias("dot"), F.first("goal").alias("goal")
    )
    cosine = F.round(F.col("dot") / (F.col("length") * F.col("goal")), 9)
    scored = dots.join(lengths, ["file", "unit"]).select("file", "license", cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    best = scored.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license")).alias("_b"))
    return best.select("file", "_b.license", (-F.col("_b.order")).alias("cosine"))


def directory(path: Column) -> Column:
    """Path without its last part; empty at the root."""
    return F.regexp_replace(F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(""), "/+$", "")


def ancestors(folder: Column) -> Column:
    """The folder and every folder above it, the root ('') last."""
    parts = F.split(folder, "/")
    depth = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD,
         templates: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, own_license, cosine, license, via (own, inherited, none) and from_dir for each row, after the ``keep`` columns."""
    spark = files.sparkSession
    rows = files.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    numbered = rows.withColumn("file", F.xxhash64(*[f"_k{i}" for i in range(len(keep))], "path", "text"))
    found = matches(stage(units(numbered).dropDuplicates(["file", "unit"]), "units"), template_terms(spark, templates), threshold)
    plain = numbered.drop("text").withColumn("dir", directory(F.coalesce(F.col("path"), F.lit(""))))
    own = stage(plain.join(found, "file", "left"), "own")
    name = F.regexp_extract(F.coalesce(F.col("path"), F.lit("")), r"[^/]*$", 0)
    granted = own.where(F.col("license").isNotNull() & F.rlike(name, F.lit(LICENCE_FILE)))
    granted = granted.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "license", "path")).alias("_g"))
    granted = granted.select(F.col("dir").alias("from_dir"), F.col("_g.license").alias("granted"))
    folders = own.select("dir").distinct()
    above = folders.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "from_dir")).join(granted, "from_dir")
    nearest = above.groupBy("dir").agg(F.min(F.struct("up", "from_dir", "granted")).alias("_n")).select("dir", "_n.from_dir", "_n.granted")
    # Folders can be many: an ordinary join, whose hot folders are split at run time.
    full = own.join(nearest, "dir", "left")
    via = F.when(F.col("license").isNotNull(), "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none")
    return full.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("path"), F.col("license").alias("own_license"), "cosine",
        F.coalesce("license", "granted").alias("license"), via.alias("via"),
        F.when((via == "inherited"), F.col("from_dir")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/a/b/doc-N.txt by digits of the id; every 97th is a LICENSE file one to three folders deep."""
    source = F.coalesce(F.col("source"), F.lit("none"))
    a, b = F.pmod("doc_id", F.lit(8)).cast("string"), F.pmod(F.floor(F.col("doc_id") / 8), F.lit(8)).cast("string")
    deep = F.concat_ws("/", source, a, b)
    folder = F.when(F.pmod("doc_id", F.lit(97)) != 0, deep).otherwise(
        F.element_at(F.array(source, F.concat_ws("/", source, a), deep), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    )
    name = F.when(F.pmod("doc_id", F.lit(97)) == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(document_paths(docs), keep=("doc_id",))
