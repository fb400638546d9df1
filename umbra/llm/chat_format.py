"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one
role are merged into one block, and the pieces are concatenated. The template is

    <s>role\\n[INST]text[/INST][INST]text[/INST]</s>

with one ``[INST]`` segment for each original turn of a block, so the turns can be
read back. Inside roles and texts a backslash is doubled and each control string
gets a backslash after its first character; that is undone by dropping one
backslash before any character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed control strings of the template.
OPEN, CLOSE, SEGMENT, SEGMENT_END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (OPEN, CLOSE, SEGMENT, SEGMENT_END)


def escape(text: Column) -> Column:
    """Make ``text`` free of control strings, reversibly."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, pieces array<struct<text, loss>>.

    ``pieces`` is the loss mask: the texts joined give ``formatted``, and ``loss``
    marks the pieces that count. Input columns conv_id, turn, role, text; others
    are ignored. Null text or role counts as empty, a null turn sorts first, ties
    sort by role and text, repeated rows stay, and a null conv_id is one
    conversation. An empty table gives no rows. A conversation is one output
    string, so its turns meet in one row by definition.
    """
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", t.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def pieces_of(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.col("turns")[i - 1]["role"])
        opens = before.isNull() | (before != x["role"])
        head = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(x["role"]), F.lit("\n"))
        plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        return F.array(
            plain(F.concat(F.when(opens, head).otherwise(F.lit("")), F.lit(SEGMENT))),
            F.struct(escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss")),
            plain(F.lit(SEGMENT_END)),
        )

    end = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    pieces = turns.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces_of)), end).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """The original turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.split(formatted, CLOSE, -1)

    def of_block(b: Column) -> Column:
        head = F.substring_index(b, SEGMENT, 1)
        role = unescape(F.substring(head, F.lit(len(OPEN) + 1), F.length(head) - len(OPEN) - 1))
        rest = F.split(b, r"\[INST\]", -1)
        return F.transform(
            F.slice(rest, F.lit(2), F.size(rest) - 1),
            lambda s: F.struct(role.alias("role"), unescape(F.substring(s, F.lit(1), F.length(s) - len(SEGMENT_END))).alias("text")),
        )

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), of_block))


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped and in order."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of :func:`format_chats`, as counts and SHA-256 digests."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("pieces")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
