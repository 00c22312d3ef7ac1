"""Conversations as one training text each, with a loss mask, and back; built-in functions only.

A block is ``### role``, a line feed, the texts and ``</turn>`` with a line feed. Adjacent
turns of one role share a block and are parted by ``<turn/>``. Inside roles and texts the
characters that control strings need are escaped: a backslash as ``\\b``, ``<`` as ``\\l``,
``#`` as ``\\h`` (and a line feed in a role as ``\\n``), so an escaped text holds no control
string and unescaping gives back every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END, NEXT = "### ", "</turn>\n", "<turn/>"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=_ESCAPES) -> Column:
    """The backslash comes back last: no other escape can begin in what it gives."""
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans: (begin, length) in code points, from 0.

    Reads conv_id, turn, role and text; other columns are ignored. Turns are ordered by turn
    (null last), then role and text; repeated rows are turns of their own. A null role or text
    counts as empty; a null conv_id is a conversation of its own; an empty table gives no
    rows. Each span is one text of ``trained_role``. A conversation is one value by nature.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("turn").cast("long").isNull().alias("late"),
                F.col("turn").cast("long").alias("turn"),
                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            )
        )
    )
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(ordered.alias("turns"))

    def lead(turn: Column, i: Column) -> Column:
        header = F.concat(F.lit(HEAD), escape(turn["role"], _ROLE_ESCAPES), F.lit("\n"))
        # get() counts from 0 and gives null before the first turn.
        earlier = F.get("turns", i - 1)["role"]
        return (
            F.when(earlier.isNull(), header)
            .when(earlier == turn["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), header))
        )

    marked = grouped.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                lead(t, i).alias("lead"), escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("trained")
            ),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans"))

    def add(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["lead"])
        length = F.length(part["text"]).cast("long")
        span = F.array(F.struct(begin.alias("begin"), length.alias("length")))
        return F.struct(
            (begin + length).alias("at"),
            F.when(part["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return marked.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate("parts", start, add)["spans"].alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turns(block: Column) -> Column:
        header = F.substring_index(block, "\n", 1)
        role = unescape(F.substring(header, F.lit(len(HEAD) + 1), F.length(header)), _ROLE_ESCAPES)
        body = F.substring(block, F.length(header) + 2, F.length(block))
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def trained_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.transform(spans, lambda s: F.substring(formatted, s["begin"].cast("int") + 1, s["length"].cast("int")))
    return F.array_join(F.transform(parts, lambda p: unescape(p)), "")


def digest_rows(formatted: DataFrame) -> DataFrame:
    """What reading the formatted texts back gives, as counts and digests."""
    turns = formatted.select(
        "conv_id",
        "formatted",
        read_back(F.col("formatted")).alias("turns"),
        trained_text(F.col("formatted"), F.col("loss_spans")).alias("trained"),
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
