"""Chat formatting with typed content parts.

A turn's content is a list of parts.  A visitor per kind renders each: text is escaped, an image, audio clip or document
becomes a numbered placeholder, its reference is recorded, and so is the number of tokens the placeholder stands for.
The template marks turns with control strings; one backslash is put into whatever looks like a control string inside a
text, so texts cannot break out of their turn and every text can be read back exactly.

All of it is column expressions on a row per turn; a conversation is the turns' segments in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
SEGMENT = r"(?s)\A<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\z"
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"


def escaped(text: Column) -> Column:
    """`<`, any backslashes, `|` get one more backslash; so no `<|` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role is one line: its line breaks are written %0A and its percent signs %25."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


@dataclass(frozen=True)
class Kind:
    """How a kind of attachment is shown: tokens is what one unit of it stands for (an image's unit is a patch, a clip's a second, a document's a page)."""

    name: str
    tokens: float

    def render(self, part: Column, nth: Column) -> Column:
        return F.concat(F.lit(f"<|{self.name}_"), nth.cast("string"), F.lit("|>"))

    def expanded(self, part: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(part["units"], F.lit(1.0)), F.lit(0.0)) * self.tokens).cast("long")


@dataclass(frozen=True)
class Visitor:
    """Renders parts by kind.  Parts of other kinds are taken as text; a null part is empty text."""

    kinds: tuple[Kind, ...] = field(default=(Kind("image", 1.0), Kind("audio", 25.0), Kind("document", 600.0)))

    def _visit(self, part: Column, attachment: Callable[[Kind], Column], text: Column) -> Column:
        out = text
        for kind in self.kinds:
            out = F.when(F.lower(part["kind"]) == kind.name, attachment(kind)).otherwise(out)
        return out

    def is_attachment(self, part: Column) -> Column:
        return F.coalesce(F.lower(part["kind"]).isin(*[k.name for k in self.kinds]), F.lit(False))

    def content(self, parts: Column) -> Column:
        """Struct of the rendered text and the attachments: number, kind, reference, tokens, in order."""
        attached = F.filter(parts, self.is_attachment)
        attachments = F.transform(
            attached,
            lambda p, i: F.struct(i.alias("nth"), F.lower(p["kind"]).alias("kind"), p["ref"].alias("ref"), self._visit(p, lambda k: k.expanded(p), F.lit(0).cast("long")).alias("tokens")),
        )
        before = lambda i: F.size(F.filter(F.slice(parts, 1, i), self.is_attachment))
        shown = F.transform(parts, lambda p, i: self._visit(p, lambda k: k.render(p, before(i)), escaped(F.coalesce(p["text"], F.lit("")))))
        return F.struct(F.array_join(shown, "").alias("text"), attachments.alias("attachments"))


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def formatted_turns(turns: DataFrame, parts: Column | None = None, visitor: Visitor | None = None, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text, or parts of type PARTS instead of the text).

    Returns conv_id, nth (place in the conversation), start (code points of the conversation before it), segment,
    loss_start and loss_end (code points of the segment under the loss mask, empty where nothing is learnt), attachments,
    and n_attached_tokens.  Turns stand by turn, then role and text; null turns first.  A null role or text is empty, a
    null list of parts has none.  Rows with a null conv_id are one conversation.  Repeated rows are turns of their own.
    """
    visitor = visitor or Visitor()
    given = text_parts(F.col("text")) if parts is None else F.coalesce(parts, F.expr(f"cast(array() as {PARTS})"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), given.alias("parts")).withColumn("content", visitor.content(F.col("parts")))
    head = F.concat(F.lit(TURN_START), escaped_role(F.col("role")), F.lit("\n"))
    learnt = F.col("role").isin(*learn_from)
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.col("content.text").alias("text"),
        F.concat(head, F.col("content.text"), F.lit(f"{TURN_END}\n")).alias("segment"),
        F.length(head).cast("long").alias("loss_start"),
        (F.length(head) + F.when(learnt, F.length("content.text")).otherwise(0)).cast("long").alias("loss_end"),
        F.col("content.attachments").alias("attachments"),
        F.aggregate("content.attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("n_attached_tokens"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("nth"),
        F.coalesce(before, F.lit(0)).cast("long").alias("start"),
        "segment",
        "loss_start",
        "loss_end",
        "attachments",
        "n_attached_tokens",
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """From segments alone: conv_id, nth, role, text, loss_text (what the mask covers, unescaped), chars of the segment."""
    return formatted.select(
        "conv_id",
        "nth",
        unescaped_role(F.regexp_extract("segment", SEGMENT, 1)).alias("role"),
        unescaped(F.regexp_extract("segment", SEGMENT, 2)).alias("text"),
        unescaped(F.substring(F.col("segment"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))).alias("loss_text"),
        F.length("segment").cast("long").alias("chars"),
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (code points of the whole): each conversation as one text, which one row then holds."""
    turn = F.struct("nth", "segment", (F.col("start") + F.col("loss_start")).alias("from"), (F.col("start") + F.col("loss_end")).alias("to"))
    rows = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["to"] > t["from"]), lambda t: F.struct(t["from"].alias("start"), t["to"].alias("end")))
    return rows.select("conv_id", F.array_join(F.col("turns.segment"), "").alias("formatted"), spans.alias("loss_spans"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What reading the segments back gives for each conversation; a digest needs a conversation's turns in one row."""
    turn = F.struct("nth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), "loss_text")
    rows = (
        read_turns(formatted)
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("n_turns"),
            F.array_sort(F.collect_list(turn)).alias("turns"),
            F.sum(F.length("loss_text")).cast("long").alias("loss_chars"),
            F.sum("chars").alias("formatted_chars"),
        )
    )
    digest = lambda field: F.sha2(F.array_join(F.col(f"turns.{field}"), ""), 256)
    return rows.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), "loss_chars", digest("loss_text").alias("loss_sha256"), "formatted_chars")
