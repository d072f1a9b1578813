r"""Chat formatting with Spark expressions only: turns to one marked string per conversation, and back.

A conversation's turns are collected as structs, sorted by (turn, role, text), and adjacent turns of one role are merged
into one block by array functions. The marks are ``<turn>``, ``<says>``, ``<part>`` (between the merged texts of a block)
and ``</turn>`` with a line feed. Inside roles and texts ``\`` becomes ``\s`` and ``<`` becomes ``\l``; so no text holds a
``<``, every ``\`` is followed by s or l, and the two replacements are undone in any order.

The loss mask is given as segments: ``formatted`` is their concatenation, and ``loss`` is true for the texts of the roles
that are trained on, never for marks.

Defined results: a null text or role is empty; a null turn sorts first; equal turns are all kept; a conversation of null id
is one conversation; an empty table gives an empty result; columns other than the four named are not read. One
conversation becomes one string, so it must fit into a task, as it must fit into the field of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, SAYS, PART, CLOSE = "<turn>", "<says>", "<part>", "</turn>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(rows: DataFrame, trained: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, segments (array of struct(text, loss)), n_blocks (turns after merging)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # Merged by role: a turn opens a block unless the one before has its role, and closes it unless the next one has.
    opens = lambda t, i: (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
    closes = lambda t, i: (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
    pieces = F.flatten(F.transform("turns", lambda t, i: F.array(
        F.struct(F.when(opens(t, i), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SAYS))).otherwise(F.lit(PART)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), t["role"].isin(*trained).alias("loss")),
        F.struct(F.when(closes(t, i), F.lit(CLOSE)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
    )))
    out = chats.withColumn("segments", F.filter(pieces, lambda p: p["text"] != ""))
    blocks = F.size(F.filter(F.transform("turns", opens), lambda x: x))
    return out.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", blocks.alias("n_blocks"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct(role, text), in order, merged blocks taken apart again."""
    blocks = F.filter(F.split(formatted, OPEN, -1), lambda b: b != "")
    # Each step binds its result to the next lambda's variable: a block is split once, not once for each of its parts.
    halves = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(1), F.char_length(b) - len(CLOSE)), SAYS, -1))
    parted = F.transform(halves, lambda h: F.struct(unescape(F.element_at(h, 1)).alias("role"), F.split(F.element_at(h, 2), PART, -1).alias("parts")))
    return F.flatten(F.transform(parted, lambda b: F.transform(b["parts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
