"""Chat formatting from reply trees, in DataFrame functions only.

A message names the one it replies to. Iterated self-joins that double the distance
find every message's root and the score of the way to it, branches are ranked by that
score, the chosen leaves are expanded back to root-to-leaf paths by the same doubled
pointers, and every chosen path is formatted as one conversation.

Cases: a message whose parent is null or missing is a root; messages on a cycle of
replies, or below one, are on no path and drop out; of messages with one id the
smallest (parent, role, text, score) is kept; null role and text are empty, a null score
counts 0; equal branch scores rank by leaf id; an empty table gives no rows. Only the
named columns are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.llm.storage import stage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates, escaped wherever they occur in roles and texts.
CONTROL = r"/s>|s>|/?INST\]|<SYS>>|</SYS>>|\|"
BLOCK = 256


def escape(text: Column) -> Column:
    """A backslash after the first character of each control string, one more where some are there already."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The exact inverse of ``escape``."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def _pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Doubled pointers and the finished nodes.

    ``nodes`` has id, up (null at a root) and total. Level i holds (id, up) with ``up``
    the ancestor 2**i steps above. Finished: id, root, total and hops of the whole way.
    """
    columns = ["id", "up", "total", "top", "hops"]
    nodes = nodes.withColumn("top", F.col("id")).withColumn("hops", F.lit(1).cast("bigint")).select(*columns)
    current = stage(nodes, "replies")
    size, levels, ended = current.count(), [], current.where("up IS NULL")
    while True:
        open_rows = current.where("up IS NOT NULL")
        if open_rows.isEmpty() or 2 ** len(levels) > 2 * size:
            # What is still open after so many steps leads into a cycle.
            return levels, ended.select("id", F.col("top").alias("root"), "total", "hops")
        levels.append(open_rows.select("id", "up"))
        # Only open messages move on; finished ones are met as they are.
        above = open_rows.unionByName(ended).toDF("up", "_up", "_total", "_top", "_hops")
        current = stage(
            open_rows.join(above, "up").select(
                "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
                F.col("_top").alias("top"), (F.col("hops") + F.col("_hops")).alias("hops"),
            ),
            "replies",
        )
        ended = ended.unionByName(current.where("up IS NULL"))


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Members of the chosen root-to-leaf paths: leaf, id, place (0 at the root), branch (rank from 1), root.

    ``messages`` has id, parent and score. ``best`` keeps so many branches of each root.
    """
    messages = messages.groupBy("id").agg(F.min(F.struct("parent", "score")).alias("_m"))
    messages = stage(messages.select("id", "_m.parent", F.coalesce("_m.score", F.lit(0.0)).alias("score")), "messages")
    present = messages.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    nodes = messages.join(present, "parent", "left").select(
        "id", F.when(F.col("_there"), F.col("parent")).alias("up"), F.col("score").cast("double").alias("total")
    )
    levels, ended = _pointers(nodes)
    parents = messages.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    leaves = ended.join(parents, "id", "left_anti")
    leaves = leaves.withColumn("branch", F.expr("row_number() OVER (PARTITION BY root ORDER BY total DESC, id)"))
    if best is not None:
        leaves = leaves.where(F.col("branch") <= best)
    leaves = leaves.select(F.col("id").alias("leaf"), "root", "branch", "hops")
    members = leaves.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("bigint").alias("below"))
    for i, level in enumerate(levels):
        farther = members.join(level, "id").select("leaf", F.col("up").alias("id"), (F.col("below") + 2**i).alias("below"))
        members = stage(members.unionByName(farther), "members")
    return members.join(leaves, "leaf").select("leaf", "id", (F.col("hops") - 1 - F.col("below")).alias("place"), "branch", "root")


def format_paths(messages: DataFrame, members: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation for each path: leaf, root, branch, formatted, loss.

    ``formatted`` is ``<|turn|>role<|text|>text<|end|>`` for each turn, roles and texts
    escaped. ``loss`` marks what is learned: (turn, start, chars) of each text of a role in
    ``learned``, counted in code points of ``formatted``. Turns are joined in blocks first,
    so a long conversation is put together by many tasks; only its finished string is whole.
    """
    texts = messages.groupBy("id").agg(F.min(F.struct("parent", "role", "text")).alias("_m"))
    texts = texts.select("id", F.coalesce("_m.role", F.lit("")).alias("role"), escape(F.coalesce("_m.text", F.lit(""))).alias("text"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = members.join(texts, "id").select(
        "leaf", "root", "branch", "place", F.floor(F.col("place") / BLOCK).alias("block"),
        F.concat(head, "text", F.lit(END)).alias("turn"), F.length(head).cast("bigint").alias("head"),
        F.when(F.col("role").isin(*learned), F.length("text").cast("bigint")).alias("chars"),
    )
    turns = turns.withColumn("size", F.length("turn").cast("bigint"))
    in_block = turns.groupBy("leaf", "root", "branch", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "turn", "head", "chars", "size"))).alias("turns")
    )
    marks = F.transform("turns", lambda t: F.struct(t["place"].alias("turn"), t["head"].alias("head"), t["chars"].alias("chars"), t["size"].alias("size")))
    in_block = in_block.select("leaf", "root", "branch", "block", F.array_join(F.col("turns.turn"), "").alias("text"), marks.alias("marks"))
    whole = in_block.groupBy("leaf", "root", "branch").agg(F.sort_array(F.collect_list(F.struct("block", "text", "marks"))).alias("blocks"))
    whole = whole.select("leaf", "root", "branch", F.array_join(F.col("blocks.text"), "").alias("formatted"), F.flatten("blocks.marks").alias("_marks"))
    start = F.lit(0).cast("bigint")
    loss = F.aggregate(
        "_marks",
        F.struct(start.alias("at"), F.array().cast("array<struct<turn:bigint,start:bigint,chars:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["size"]).alias("at"),
            F.when(m["chars"].isNull(), acc["spans"]).otherwise(
                F.concat(acc["spans"], F.array(F.struct(m["turn"].alias("turn"), (acc["at"] + m["head"]).alias("start"), m["chars"].alias("chars"))))
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select("leaf", "root", "branch", "formatted", loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader gets from ``formatted`` and ``loss`` alone: ``turns`` (role, text) and ``learned`` texts."""
    pieces = F.split(F.col("formatted"), F.lit(r"<\|end\|>"), -1)
    rows = formatted.withColumn("_pieces", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    rows = rows.withColumn("_parts", F.transform("_pieces", lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), r"<\|text\|>", 2)))
    rows = rows.withColumn(
        "turns",
        F.transform("_parts", lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))),
    )
    # A span is read inside the piece of its turn: the pieces' starts are running sums.
    starts = F.aggregate(
        "_pieces",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("list")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + len(END)).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list")
        ),
        lambda acc: acc["list"],
    )
    rows = rows.withColumn("_starts", starts)

    def cut(span: Column) -> Column:
        turn = span["turn"].cast("int")
        first = span["start"] - F.get("_starts", turn) + 1
        return unescape(F.substring(F.get("_pieces", turn), first.cast("int"), span["chars"].cast("int")))

    return rows.withColumn("learned", F.transform("loss", cut)).drop("_pieces", "_parts", "_starts")


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before it.

    Rows of a conversation are ordered by (turn, role, text), nulls first; repeated rows
    are turns of their own. Places are counted in stretches of 1,024 turn numbers and then
    shifted by the sizes of the stretches before, so a hot conversation is many groups.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / 1024).alias("_part"))
    sizes = rows.groupBy("conv_id", "_part").count()
    before = F.expr("sum(count) OVER (PARTITION BY conv_id ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    offsets = sizes.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_place", F.expr("row_number() OVER (PARTITION BY conv_id, _part ORDER BY turn, role, text)"))
    rows = rows.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_part").eqNullSafe(F.col("_p")))
    place = (F.col("_place") + F.col("_before") - 1).cast("bigint")
    rows = rows.select("conv_id", place.alias("place"), "role", "text")
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return rows.select(
        F.concat(name, F.lit(":"), F.col("place")).alias("id"),
        F.when(F.col("place") > 0, F.concat(name, F.lit(":"), F.col("place") - 1)).alias("parent"),
        "conv_id", "role", "text", F.lit(1.0).alias("score"),
    )


def op10_chats(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    messages = stage(chain(rows.unionByName(extra)), "turns")
    formatted = format_paths(messages, paths(messages))
    back = read_back(formatted)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    conv = F.substring_index("root", ":", 1)
    return back.select(
        F.when(conv != "null", conv).cast("bigint").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


# The same digests straight from the table. Lengths of the formatted text follow from the template.
OP10_SQL = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/s>|s>|/?INST\]|<SYS>>|</SYS>>|\|)', '\1\\\2\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(/s>|s>|/?INST\]|<SYS>>|</SYS>>|\|)', '\1\\\2\3', 'g') AS t FROM all_rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 23) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
