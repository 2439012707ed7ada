"""Chat formatting: a role state machine and a declarative template, all in Spark expressions.

A template marks each turn, ``start role \\n text end``.  Control strings cannot
occur inside a formatted text: every character that begins one is followed by an
inserted backslash, backslashes are doubled first, and both steps undo exactly.

Defined results: null text and null role are empty; turns with equal numbers go
by role, then text; null turns come first; empty tables give no rows.  A
conversation that breaks the turn order is formatted all the same, with
``valid`` false and ``bad_turn`` the position of the first offending turn.  Repeated
turns are turns; texts of any length are formatted whole; turns with a null conv_id are
one conversation; only conv_id, turn, role and text are read, whatever other columns are
called.  A conversation is one value, as its formatted text is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``moves`` maps a state to the roles that may follow; states are the last role, or ``begin``."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    final_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "begin": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )

    @property
    def first(self) -> list[str]:
        """The characters that control strings begin with."""
        return sorted({c[0] for c in (*self.controls, self.start, self.end)})


def escape(text: Column, template: Template, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.first:
        text = F.replace(text, F.lit(c), F.lit(c + "\\"))
    # a role ends at the first line break: one inside it becomes the first control character and "n"
    return F.replace(text, F.lit("\n"), F.lit(template.first[0] + "n")) if role else text


def unescape(text: Column, template: Template, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit(template.first[0] + "n"), F.lit("\n"))
    for c in template.first:
        text = F.replace(text, F.lit(c + "\\"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, bad_turn, segments (text, loss) and the formatted text.

    A conversation is one value of the result, so its turns meet in one row; nothing larger does.
    """
    t = template or Template()
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    known = F.create_map(*[F.lit(x) for s, roles in t.moves.items() for r in roles for x in (f"{s}>{r}", r)])
    begin = F.struct(F.lit("begin").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(s: Column, turn: Column) -> Column:
        to = known[F.concat(s["state"], F.lit(">"), turn["role"])]
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (s["at"] + 1).alias("at"),
            F.when((s["bad"] < 0) & to.isNull(), s["at"]).otherwise(s["bad"]).alias("bad"),
        )

    def cut(turn: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(t.start), escape(turn["role"], t, role=True), F.lit("\n")), F.lit(False)),
            piece(escape(turn["text"], t), turn["role"].isin(*t.loss_roles)),
            piece(F.lit(t.end), F.lit(False)),
        )

    rows = rows.withColumns({"_end": F.aggregate("turns", begin, step), "segments": F.flatten(F.transform("turns", cut))})
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        ((F.col("_end.bad") < 0) & F.col("_end.state").isin(*t.final_roles)).alias("valid"),
        F.col("_end.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parse_chats(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted text."""
    t = template or Template()
    quoted = "".join("\\" + c if not c.isalnum() and c not in "\n_" else c for c in t.start)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(t.end))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape(role, t, role=True).alias("role"), unescape(text, t).alias("text"))

    parts = F.split(formatted, quoted)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """The unescaped text of the segments under the loss mask."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
