"""Chat formatting of typed content parts, with Spark columns only.

A visitor per kind of part (text, image, audio, document) turns each part into a
string, an attachment reference and a count of expanded tokens. Parts of a turn keep
their order, joined by `[NEXT]`; a turn gets the markers of its role; a conversation
starts with `<s>`. Control strings inside texts get one backslash after their first
character, however many they have already, and lose it again on reading, so any text comes
back as it was.

Edge cases: a null text, role or list of parts counts as empty; an unknown kind of part is
treated as text; equal turns are ordered by role and content; rows without a
conversation id form one conversation with a null id; an empty table gives none. A conversation is
one record, so all its turns meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BEGIN, NEXT = "<s>", "[NEXT]"
MARKERS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")  # any other role: name, then content
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}
_REST = r"(/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|END\]|NEXT\]|IMG\]|AUD\]|DOC\])"
ESCAPE, UNESCAPE = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST

PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


@dataclass(frozen=True)
class Visitor:
    """What becomes of one kind of part: its string, whether it is an attachment, and its tokens."""

    render: Callable[[Column], Column]
    attached: bool
    tokens: Callable[[Column], Column]


def visitors(image_tokens: int = 1, audio_tokens: int = 2, document_tokens: int = 256) -> dict[str, Visitor]:
    """The default visitors; an attachment stands for `units` (patches, frames, pages) times a number of tokens."""
    per = {"image": image_tokens, "audio": audio_tokens, "document": document_tokens}
    out = {"text": Visitor(lambda p: escape(p["text"]), False, lambda p: F.lit(0).cast("long"))}
    for kind, each in per.items():
        out[kind] = Visitor(lambda p, kind=kind: F.lit(PLACEHOLDERS[kind]), True, lambda p, each=each: F.coalesce(p["units"], F.lit(1)) * F.lit(each))
    return out


def visit(part: Column, by_kind: dict[str, Visitor], what: Callable[[Visitor], Column]) -> Column:
    out = None
    for kind, visitor in by_kind.items():
        if kind != "text":
            out = (F if out is None else out).when(part["kind"] == kind, what(visitor))
    return what(by_kind["text"]) if out is None else out.otherwise(what(by_kind["text"]))


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    empty = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), empty.alias("ref"), F.lit(None).cast("long").alias("units")))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
                 by_kind: dict[str, Visitor] | None = None) -> DataFrame:
    """(conv_id, turn, role, opening, body, closing, attachments, expanded_tokens) for each turn; nothing is shuffled."""
    by_kind = by_kind or visitors()
    role = F.coalesce(F.col(role_col), F.lit(""))
    parts = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    body = F.array_join(F.transform(parts, lambda p: visit(p, by_kind, lambda v: v.render(p))), NEXT)
    attached = F.filter(parts, lambda p: visit(p, by_kind, lambda v: F.lit(v.attached)))
    tokens = F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total + visit(p, by_kind, lambda v: v.tokens(p)))
    opening, closing = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (left, right) in MARKERS.items():
        opening = F.when(role == name, F.lit(left)).otherwise(opening)
        closing = F.when(role == name, F.lit(right)).otherwise(closing)
    return turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), opening.alias("opening"), body.alias("body"),
        closing.alias("closing"), F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"))).alias("attachments"),
        tokens.alias("expanded_tokens"),
    )


def format_conversations(formatted_turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens), one row per conversation.

    `loss_spans` are [begin, end) characters of `formatted`: the content of each assistant turn.
    Positions are running sums over the turns; they and the text come from one shuffle by conversation.
    """
    t = formatted_turns.withColumns({"_head": F.length("opening"), "_body": F.length("body"), "_tail": F.length("closing")})
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_end", F.sum(F.col("_head") + F.col("_body") + F.col("_tail")).over(w) + len(BEGIN))
    t = t.withColumn("_to", F.col("_end") - F.col("_tail"))
    row = F.struct("_end", F.concat("opening", "body", "closing").alias("text"), (F.col("_to") - F.col("_body")).alias("begin"),
                   F.col("_to").alias("end"), (F.col("role") == "assistant").alias("loss"), "attachments")
    grouped = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("expanded_tokens").alias("expanded_tokens"))
    return grouped.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("rows", lambda r: r["text"]), "")).alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(r["begin"].alias("begin"), r["end"].alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: r["attachments"])).alias("attachments"),
        "expanded_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; parts stay joined by `[NEXT]`."""
    starts = "|".join(left.replace("[", r"\[").replace("]", r"\]") for left in [*(m[0] for m in MARKERS.values()), OTHER[0]])
    pieces = F.filter(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), f"(?={starts})"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        mark = F.instr(piece, OTHER[1])
        role = unescape(F.substr(piece, F.lit(len(OTHER[0]) + 1), mark - len(OTHER[0]) - 1))
        begin, size = mark + len(OTHER[1]), F.length(piece) - (mark + len(OTHER[1]) - 1) - len(OTHER[2])
        for name, (left, right) in MARKERS.items():
            here = F.startswith(piece, F.lit(left))
            role = F.when(here, F.lit(name)).otherwise(role)
            begin = F.when(here, F.lit(len(left) + 1)).otherwise(begin)
            size = F.when(here, F.length(piece) - len(left) - len(right)).otherwise(size)
        return F.struct(role.alias("role"), unescape(F.substr(piece, begin, size)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["begin"] + 1, s["end"] - s["begin"]))), "")
