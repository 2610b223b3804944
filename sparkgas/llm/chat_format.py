r"""Chat formatting with a grammar that can be read back.

A conversation is a sequence of turns::

    ### <role>:
    <text>
    </turn>

A turn is rendered as it is, parsed again and compared with its source.  Only
where the parser finds something else is it escaped: one more backslash before
every control string, counting those already there, and before backslashes and
line ends in a role.  The parser always takes one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import chunked, let, part_of, scan

OPEN, MARK, CLOSE = "### ", ":\n", "\n</turn>\n"
CONTROL = r"(###|</turn>)"
TURNS = "array<struct<role:string,text:string>>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*+)" + CONTROL, r"\\$1$2")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*+)" + CONTROL, "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A backslash and n is a line end, two backslashes are one; pairs are read from the left."""
    newline = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n")
    return F.replace(newline, F.lit("\\\\"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MARK), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """``(role, text)`` of every turn in a formatted conversation; an empty list if it is none.

    A turn ends at the first close mark after its own start; escaped texts
    hold no bare one.  Its first line is the role.
    """
    turns = F.split(formatted, CLOSE, -1)
    line = lambda t: F.substring_index(t, "\n", 1)
    read = lambda t: F.struct(
        unescape_role(F.substring(line(t), F.lit(len(OPEN) + 1), F.length(line(t)) - len(OPEN) - 1)).alias("role"),
        unescape_text(F.substring(t, F.length(line(t)) + 2, F.length(t))).alias("text"),
    )
    return F.transform(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))), read).cast(TURNS)


def format_turn(turn: Column) -> Column:
    """A turn rendered plainly if it reads back as it is, else escaped."""
    plain = render(turn["role"], turn["text"])
    hard = render(escape_role(turn["role"]), escape_text(turn["text"]))
    alone = F.struct(turn["role"].alias("role"), turn["text"].alias("text"))
    bare = turn["text"].contains("###") | turn["text"].contains("</turn>")
    return F.when(~bare & (parse(plain) == F.array(alone).cast(TURNS)), plain).otherwise(hard)


def format_chats(
    chats: DataFrame,
    loss_roles: tuple[str, ...] = ("assistant",),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv_id, formatted, loss_spans, round_trip)``, one row per conversation.

    ``loss_spans`` are the places (code points, end exclusive) of the texts of
    ``loss_roles`` in ``formatted``; ``round_trip`` tells that parsing gives back
    all turns.  Null texts and roles count as empty; rows of a conversation are
    ordered by turn, nulls first, then by role and text, so repeated rows are
    repeated turns; a null id is a conversation of its own; an empty table gives
    no rows; other columns are ignored.  A conversation is one output row, so its
    turns are brought together once.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = chats.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shown = turns.select("conv_id", "turns", F.transform("turns", format_turn).alias("parts"))
    formatted = shown.select("conv_id", "turns", "parts", F.array_join("parts", "").alias("formatted"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS)
    return formatted.select(
        "conv_id",
        "formatted",
        _loss_spans(F.col("turns"), F.col("parts"), loss_roles).alias("loss_spans"),
        (parse(F.col("formatted")) == source).alias("round_trip"),
    )


def _loss_spans(turns: Column, parts: Column, loss_roles: tuple[str, ...]) -> Column:
    own = F.zip_with(turns, parts, lambda t, p: F.struct(t["role"].alias("role"), p.alias("part")))

    def placed(starts: Column) -> Column:
        spans = F.zip_with(
            own,
            starts,
            lambda x, at: F.struct(
                x["role"].isin(*loss_roles).alias("loss"),
                (at + F.length(F.substring_index(x["part"], "\n", 1)) + 1).alias("start"),
                (at + F.length(x["part"]) - len(CLOSE)).alias("end"),
            ),
        )
        return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(scan(F.transform(parts, F.length)), placed).cast("array<struct<start:bigint,end:bigint>>")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    own = lambda chunks: F.transform(spans, lambda s: unescape_text(part_of(chunks, s["start"], s["end"])))
    return F.array_join(let(chunked(formatted), own), "")
