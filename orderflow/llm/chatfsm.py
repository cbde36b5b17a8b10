"""Chat formatting by a finite-state machine over roles (DataFrame functions only).

A template declares the control strings, which roles may follow which, and for each
segment whether it counts for the loss. The machine's state is the last role, so the
order check is one look back. Control strings inside a text are escaped: ``<``, k
backslashes and ``|`` become ``<``, k + 1 backslashes and ``|``; the reverse takes one away.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Declares the format; ``loss`` names the roles whose text is learned."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


DEFAULT = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at the first line end, so its own are written as backslash and n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row a turn: conv_id, turn, role, text, legal, and its segments array<struct<text, loss>>.

    Turns are ordered by (turn, role, text), nulls first; a null role or text is the empty
    one; rows with a null conv_id form one conversation. ``legal`` tells whether the role
    may follow the one before it (or start, at the first turn).
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    state = F.coalesce(F.lag("role").over(order), F.lit(""))
    first = F.row_number().over(order) == 1
    legal = F.lit(False)
    for was, may in template.follows.items():
        legal = legal | ((first if was == "" else ~first & (state == was)) & F.col("role").isin(*may))
    learned = F.col("role").isin(*template.loss)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.array(piece(F.concat(F.lit(template.start), escape_role(F.col("role")), F.lit("\n")), F.lit(False)),
                       piece(escape(F.col("text")), learned), piece(F.lit(template.end + "\n"), F.lit(False)))
    return rows.select("conv_id", "turn", "role", "text", legal.alias("legal"), segments.alias("segments"))


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, n_illegal, formatted, segments.

    Every conversation is formatted; ``valid`` is false if a turn is out of order.
    ``segments`` concatenated give ``formatted``; those with ``loss`` are learned. The
    result is one string a conversation, so only that much of it meets in a task. An
    empty table gives an empty result; further columns are ignored.
    """
    grouped = turns(conversations, template).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.when(F.col("legal"), 0).otherwise(1)).alias("n_illegal"),
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("rows"))
    segments = F.flatten(F.transform("rows", lambda r: r["segments"]))
    grouped = grouped.select("conv_id", "n_turns", (F.col("n_illegal") == 0).alias("valid"), "n_illegal", segments.alias("segments"))
    return grouped.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``formatted`` with turns array<struct<role, text>> parsed from the string, and the learned text."""
    blocks = F.split("formatted", r"\Q" + template.start + r"\E", -1)
    tail = len(template.end) + 1

    def parse(block: Column) -> Column:
        body = F.substring(block, F.lit(1), F.length(block) - tail)
        at = F.locate("\n", body)
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substring(body, at + 1, F.length(body))).alias("text"))

    parsed = F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1))), parse)
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.withColumns({"turns": parsed, "learned": learned})
