"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative
template turns each conversation into text segments with a loss flag each.

Only DataFrame functions are used. Control strings inside texts are escaped reversibly: ``escape``
gives every character that can begin a control string a code of its own, so that no text can
contain a mark of the template.
"""

from collections.abc import Mapping
from dataclasses import dataclass, field
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = {"~": "~0", "[": "~1", "<": "~2"}
ROLE_ESCAPES = ESCAPES | {"]": "~3"}  # a role stands inside the brackets of its mark


@dataclass(frozen=True)
class Mark:
    """What stands before and after the text of a turn, and whether the text is learned."""

    tag: str
    end: str
    loss: bool = False

    @property
    def begin(self) -> str:
        return f"[{self.tag}] "


@dataclass(frozen=True)
class Template:
    """Marks by role, the mark of any other role, and the transitions of the state machine.

    A state is the name of the last accepted role; ``start`` precedes all turns. An order is valid
    if every turn has a transition, and complete if it also ends in one of ``final``."""

    marks: Mapping[str, Mark] = field(default_factory=lambda: {
        "system": Mark("SYS", " [/SYS]"),
        "user": Mark("INST", " [/INST]"),
        "assistant": Mark("ANS", "</s>", loss=True),
    })
    other: Mark = Mark("ROLE", " [/ROLE]")
    start: str = "start"
    transitions: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column, codes: Mapping[str, str] = ESCAPES) -> Column:
    for plain, code in codes.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: Mapping[str, str] = ESCAPES) -> Column:
    for plain, code in reversed(codes.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _choose(role: Column, template: Template, value) -> Column:
    """``value(mark)`` for the mark of a role."""
    chosen = F.when(F.lit(False), value(template.other))
    for name, mark in template.marks.items():
        chosen = chosen.when(role == name, value(mark))
    return chosen.otherwise(value(template.other))


def _segments(turn: Column, template: Template) -> Column:
    """Three segments of a turn: its opening mark, its escaped text and its closing mark."""
    role, text = turn["role"], turn["text"]
    named = _choose(role, template, lambda m: F.lit("" if m is template.other else m.begin))
    opening = F.when(named == "", F.concat(F.lit(f"[{template.other.tag} "), escape(role, ROLE_ESCAPES), F.lit("] "))).otherwise(named)
    closing = _choose(role, template, lambda m: F.lit(m.end))
    loss = _choose(role, template, lambda m: F.lit(m.loss))
    part = lambda value, learned: F.struct(value.alias("text"), learned.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(escape(text), loss), part(closing, F.lit(False)))


def _machine(roles: Column, template: Template) -> Column:
    """Runs the state machine: the last state, the turns accepted, and whether it still runs."""
    allowed = F.create_map(*[
        F.lit(x) for state, nexts in template.transitions.items() for name in nexts
        for x in (f"{state}>{name}", name)
    ])
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("accepted"), F.lit(True).alias("ok"))

    def step(now: Column, role: Column) -> Column:
        following = F.element_at(allowed, F.concat(now["state"], F.lit(">"), role))
        fine = now["ok"] & following.isNotNull()
        return F.struct(
            F.when(fine, following).otherwise(now["state"]).alias("state"),
            (now["accepted"] + F.when(fine, 1).otherwise(0)).alias("accepted"),
            fine.alias("ok"),
        )

    return F.aggregate(roles, first, step)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text; other columns are left out):
    conv_id, ``segments`` (text and loss flag, in order), ``formatted`` (the segments joined),
    ``valid``, ``complete``, ``end_state`` and ``bad_turn`` (place of the first turn that the state
    machine refuses, from 0; null if there is none).

    Turns are ordered by turn, role and text; repeated rows are turns of their own, a null turn
    comes first, rows with a null conv_id form one conversation. A null text or role is empty; an
    empty or unknown role is written with the mark of other roles and is not valid. No rows give no
    rows. A conversation becomes one row, as its text is the result; its size bounds the row."""
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = turns.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("turn")).alias("turns")
    )
    ran = _machine(F.transform("turns", lambda t: t["role"]), template)
    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    return whole.select("conv_id", segments.alias("segments"), ran.alias("ran")).select(
        "conv_id", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("ran.ok").alias("valid"),
        (F.col("ran.ok") & F.col("ran.state").isin(*template.final)).alias("complete"),
        F.col("ran.state").alias("end_state"),
        F.when(~F.col("ran.ok"), F.col("ran.accepted")).alias("bad_turn"),
    )


def parse_chats(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) read back from formatted text."""
    marks = [*template.marks.values(), template.other]
    tags = "|".join(re.escape(m.tag) for m in template.marks.values())
    ends = "|".join(re.escape(m.end) for m in marks)
    other = re.escape(template.other.tag)
    pattern = rf"\[({tags}|{other} [^\]]*)\] ([^\[<]*)(?:{ends})"
    found = lambda group: F.regexp_extract_all(formatted, F.lit(pattern), F.lit(group))
    role = F.create_map(*[F.lit(x) for name, m in template.marks.items() for x in (m.tag, name)])
    skip = len(template.other.tag) + 2

    def turn(tag: Column, text: Column) -> Column:
        named = F.coalesce(F.element_at(role, tag), unescape(F.substring(tag, skip, 1 << 30), ROLE_ESCAPES))
        return F.struct(named.alias("role"), unescape(text).alias("text"))

    return F.zip_with(found(1), found(2), turn)


def chat_digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what ``format_chats`` wrote: the turns parsed from the formatted text, and the
    text under the loss mask."""
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = chats.select(
        "conv_id", "formatted", "valid", "complete", "end_state", "bad_turn",
        parse_chats(F.col("formatted"), template).alias("turns"),
        F.array_join(learned, "").alias("learned"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", "complete", "end_state", "bad_turn",
    )
