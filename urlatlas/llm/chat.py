"""Chat formatting: a finite-state machine over roles checks the order of turns; a declarative template turns a
conversation into text segments that carry a loss flag each. DataFrame functions only.

Marks may be any strings that can be told apart from what they enclose: the template derives escapes from them, so that no
mark is left inside a text or a role, and raises an error on marks for which that can't be.

Cases: null text and null role count as empty; empty and very long texts are formatted whole; an empty table gives no rows;
extra columns are not looked at; rows of one conversation are ordered by (turn, role, text), nulls first, and
repeated rows are turns of their own; a null conv_id is a conversation like others; conversations that the machine does not
accept are formatted all the same, with `valid` false. The formatted text of a conversation is one value, so one
conversation has to fit in a task; nothing else grows with a group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles whose texts bear loss, and the machine: (state, role) -> state."""

    head: str = "### "
    colon: str = ": "
    tail: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })

    def __post_init__(self):
        if not (self.colon and self.tail) or any("\\" in m for m in (self.head, self.colon, self.tail)):
            raise ValueError("colon and tail can't be empty, and no mark can have a backslash")
        # a tail is looked for from the left: none may begin in a mark before a text, or before the end of a text, and go on
        begun = any(x.endswith(self.tail[:k]) for x in (self.head, self.colon, self.tail) for k in range(1, len(self.tail)))
        if begun or self.tail in self.head or self.tail in self.colon:
            raise ValueError("a tail could begin within a mark")
        if any(self.colon.startswith(self.tail[k:]) or self.tail[k:].startswith(self.colon) for k in range(1, len(self.tail))):
            raise ValueError("a tail could begin in a role and go on in the colon")
        if any(self.colon.endswith(self.colon[:k]) for k in range(1, len(self.colon))):
            raise ValueError("a colon could begin before the end of a role")
        self.escapes  # noqa: B018

    @property
    def escapes(self) -> tuple[tuple[str, str], ...]:
        """What is replaced inside texts and roles, the backslash first, and its codes: of each mark the part without outer
        white space, or all of it if that has under two characters. A code's letter is in no mark, so that no new mark comes
        about, and what is replaced first is what holds another."""
        marks = [m for m in (self.head, self.tail, self.colon) if m]
        letters = [x for x in "hecabdfgijklmnopqrstuvwxyz0123456789" if not any(x in m for m in marks)]
        keys = dict.fromkeys(m.strip() if len(m.strip()) > 1 else m for m in marks)
        if len(letters) < len(keys):
            raise ValueError("marks leave no letter for escapes")
        return tuple(sorted(((k, f"\\{x}") for k, x in zip(keys, letters)), key=lambda e: -len(e[0])))


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    """Between two escaped backslashes every code stands for its control string."""

    def plain(part: Column) -> Column:
        for was, code in template.escapes:
            part = F.replace(part, F.lit(code), F.lit(was))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation: conv_id, valid, state, segments array<struct<text, loss>>."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    grouped = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, on), to in template.moves.items() for x in (f"{state}\n{on}", to)])
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), t["role"])), F.lit("error")))
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        part(F.concat(F.lit(template.head), escape(t["role"], template), F.lit(template.colon)), F.lit(False)),
        part(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
        part(F.lit(template.tail), F.lit(False)),
    )))
    return grouped.select("conv_id", state.isin(*template.accept).alias("valid"), state.alias("state"), segments.alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from formatted text."""
    parts = F.split(formatted, f"\\Q{template.tail}\\E", -1)
    body = lambda p: F.substring(p, len(template.head) + 1, 2**31 - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, template.colon)
        return F.struct(unescape(F.substring(p, F.lit(1), at - 1), template).alias("role"), unescape(F.substring(p, at + len(template.colon), F.lit(2**31 - 1)), template).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: turn(body(p)))


def chat_digest(turns: DataFrame, template: Template = Template()) -> DataFrame:
    done = format_chat(turns, template).withColumn("formatted", formatted_text(F.col("segments"))).withColumn("loss", loss_text(F.col("segments"), template)).withColumn("back", read_turns(F.col("formatted"), template))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
