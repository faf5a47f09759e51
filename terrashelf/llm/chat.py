"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted (by turn, role, text; nulls last). Adjacent turns of one
role are merged into a block by an array aggregation, and the blocks are concatenated:

    ### role: text<next>text</turn>

Control strings cannot occur inside a text or a role, since ``\\`` ``#`` ``<`` ``:`` are written there as ``\\0`` to
``\\3``; every backslash of the output begins such a code, so the way back is exact. The loss mask of a
conversation is an array of spans (start, end in code points of the formatted string), one for every assistant text; the
marks between them are outside.

A conversation is formatted in one row, as its digest needs all of it in order; a group is bounded by the longest
conversation, whose formatted text Spark takes up to 2 GB. Rows without a conversation id are no conversation that could be put
in order: each is formatted as a conversation of its own, so they spread however many there are.

Cases: a null text is empty and a null role is the empty role. Null turns sort last. Rows that repeat are turns of their
own. Rows without a conversation id are conversations of one turn, with a null id. Further columns are not carried. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import running, table
from terrashelf.session import scratch_path

#: Fixed values of the template.
HEAD, MARK, NEXT, END = "### ", ": ", "<next>", "</turn>\n"
LEARNED = "assistant"
#: Escaped signs in the order of their codes; the backslash is escaped first and restored last.
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("#", "\\2"), (":", "\\3")]
#: Fixed rows of the query: a conversation whose texts look like marks.
NASTY = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _merged(turns: Column) -> Column:
    """Sorted turns to blocks of adjacent turns of one role: each block starts where the role changes.

    The starts are found first and every block is cut out as a slice, so long conversations stay linear in their text.
    """
    size = F.size(turns)
    places = F.sequence(F.lit(1), size)
    role = lambda i: F.element_at(turns, i)["role"]
    starts = F.filter(places, lambda i: (i == 1) | (role(i) != role(F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(size + 1))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda s: F.struct(
            role(s["a"]).alias("role"),
            F.transform(F.slice(turns, s["a"], s["b"] - s["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to conv_id, formatted, loss_mask."""
    row = F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"),
        escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )
    whole = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    alone = turns.where(F.col("conv_id").isNull()).select("conv_id", F.array(row).alias("turns"))
    blocks = whole.unionByName(alone).select("conv_id", _merged(F.col("turns")).alias("blocks"))
    shown = F.transform("blocks", lambda b: F.concat(
        F.lit(HEAD), b["role"], F.lit(MARK), F.array_join(b["texts"], NEXT), F.lit(END)))
    # Each text with what stands before it, in code points: a block's head or the mark between merged texts.
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        (b["role"] == LEARNED).alias("learned"),
        F.when(i == 0, len(HEAD) + len(MARK) + F.length(b["role"])).otherwise(len(NEXT)).alias("before"),
        F.length(t).alias("length"),
        F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("after"),
    ))))
    exploded = blocks.select("conv_id", F.array_join(shown, "").alias("formatted"), pieces.alias("pieces"))
    size = lambda p: p["before"] + p["length"] + p["after"]
    placed = exploded.withColumn("pieces", F.arrays_zip(
        F.col("pieces").alias("p"), running(F.transform("pieces", size)).alias("at")))
    start = lambda z: (z["at"] + z["p"]["before"]).cast("int")
    spans = F.transform(F.filter("pieces", lambda z: z["p"]["learned"]), lambda z: F.struct(
        start(z).alias("start"), (start(z) + z["p"]["length"]).alias("end")))
    return placed.select("conv_id", "formatted", spans.alias("loss_mask"))


def turns_in(formatted: Column) -> Column:
    """A formatted conversation back to its turns, an array of (role, text), as they were before merging."""
    blocks = F.split(formatted, F.lit(END), -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b, F.instr(b, MARK) + len(MARK)), F.lit(NEXT), -1),
        lambda t: F.struct(
            unescaped(F.substr(b, F.lit(1 + len(HEAD)), F.instr(b, MARK) - 1 - len(HEAD))).alias("role"),
            unescaped(t).alias("text"),
        ),
    )))


def read_turns(chats: DataFrame) -> DataFrame:
    """``format_chats`` output back to conv_id and turns."""
    return chats.select("conv_id", turns_in(F.col("formatted")).alias("turns"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nasty = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(NASTY).alias("text"),
    )
    path = scratch_path(spark, "chat")
    formatted = format_chats(turns.unionByName(nasty))
    formatted.write.parquet(path)
    written = spark.read.schema(formatted.schema).parquet(path)
    return digests(written)


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted output holds, computed from it alone."""
    learned = F.array_join(F.transform("loss_mask", lambda s: unescaped(
        F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    listed = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", turns_in(F.col("formatted")).alias("turns"), learned.alias("learned"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_NASTY_SQL = "'" + NASTY.replace("'", "''") + "'"
SQL = f"""
WITH turns AS (
    SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role,
           coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, NULL, 0, 'user', {_NASTY_SQL} UNION ALL SELECT -7, NULL, 1, 'assistant', {_NASTY_SQL}),
placed AS (
    SELECT *, row_number() OVER w AS place,
           coalesce(lag(role) OVER w <> role, true) AS starts,
           length(text) + length(regexp_replace(text, '[^\\\\<#:]', '', 'g')) AS long,
           length(role) + length(regexp_replace(role, '[^\\\\<#:]', '', 'g')) AS role_long
    FROM turns WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(long + CASE WHEN starts THEN role_long + {len(HEAD) + len(MARK) + len(END)} ELSE {len(NEXT)} END) AS formatted_chars
FROM placed GROUP BY conv_id, alone"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLE = {"op10_chat_format": SQL}
