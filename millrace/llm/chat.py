"""Chat formatting from a declarative template, with DataFrame functions only.

A template gives each role its opening and closing mark and whether its text counts for the loss,
and a finite-state machine over the roles that says which orders of turns are valid. The output is
a list of text segments with loss flags; joined they are the formatted conversation. Control strings
inside texts are escaped so that the output never holds one that isn't a mark, and `read_turns` gives
back the turns from the joined output.

A conversation is one row of the output, so its turns meet in one group; that is the size of one
training example and doesn't grow with the table.

Cases: null texts and null roles are empty; turns are ordered by turn (null first), then role, then
text, so ties and repeated rows have a fixed order and all rows stay. Roles that the template doesn't
know are written with their name, make the conversation invalid and never count for the loss. A null
conv_id is a conversation of its own. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
START, ERROR = "start", "error"


@dataclass(frozen=True)
class Turn:
    """How the turns of a role are written."""

    role: str
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks, loss flags and valid orders. Unknown roles: `other` opening, role, between, text, closing."""

    turns: tuple[Turn, ...]
    moves: dict[tuple[str, str], str]
    final: frozenset[str]
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [m.strip() for t in self.turns for m in (t.opening, t.closing)] + list(self.other)
        controls = tuple(dict.fromkeys(marks))
        object.__setattr__(self, "controls", controls)
        if len(controls) > 26 or any(not c or ESCAPE in c for c in controls):
            raise ValueError("control strings must be at most 26, not empty and without the escape character")
        if any(a != b and a in b for a in controls for b in controls):
            raise ValueError("no control string may be part of another")
        openings = [t.opening for t in self.turns] + list(self.other[:2])
        closings = [t.closing for t in self.turns] + list(self.other[1:])
        for control in controls:
            for i in range(1, len(control)):
                head, tail = control[:i], control[i:]
                if any(c.startswith(tail) or tail.startswith(c) for c in closings) or any(o.endswith(head) for o in openings):
                    raise ValueError(f"a text could complete {control!r} together with a mark")


#: Marks of a common instruction format; a system turn may come first, then user and assistant in turn.
INSTRUCT = Template(
    turns=(
        Turn("system", "<<SYS>>", "<</SYS>>"),
        Turn("user", "[INST] ", " [/INST]"),
        Turn("assistant", "<s>", "</s>", loss=True),
    ),
    moves={
        (START, "system"): "system",
        (START, "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    final=frozenset({"assistant"}),
)


def _codes(template: Template) -> list[tuple[str, str]]:
    return [(c, ESCAPE + chr(ord("a") + i)) for i, c in enumerate(template.controls)]


def escape(text: Column, template: Template) -> Column:
    """The text with no control string in it."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control, code in _codes(template):
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column, template: Template) -> Column:
    """The text before `escape`: doubled escapes part it, the codes are put back in each part."""

    def plain(part: Column) -> Column:
        for control, code in _codes(template):
            part = F.replace(part, F.lit(code), F.lit(control))
        return part

    parts = F.transform(F.split(text, re.escape(ESCAPE * 2), -1), plain)
    return F.when(F.contains(text, F.lit(ESCAPE)), F.array_join(parts, ESCAPE)).otherwise(text)


def _segment(text: Column, loss: bool, taken: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"), taken.alias("taken"))


def _segments(turn: Column, taken: Column, template: Template) -> Column:
    """The segments of one turn; `taken` says whether the machine took it."""
    text = escape(turn["text"], template)
    before, between, after = template.other
    out = F.array(
        _segment(F.concat(F.lit(before), escape(turn["role"], template), F.lit(between)), False, taken),
        _segment(text, False, taken),
        _segment(F.lit(after), False, taken),
    )
    for t in template.turns:
        own = F.array(
            _segment(F.lit(t.opening), False, taken), _segment(text, t.loss, taken), _segment(F.lit(t.closing), False, taken)
        )
        out = F.when(turn["role"] == t.role, own).otherwise(out)
    return out


def _walk(turns: Column, template: Template) -> Column:
    """The machine's last state, and the first turn it couldn't take."""
    moves = F.create_map(*chain.from_iterable((F.lit(f"{s}\n{r}"), F.lit(to)) for (s, r), to in template.moves.items()))

    def step(at: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), turn["role"])), F.lit(ERROR))
        bad = F.when(at["bad"].isNull() & (to == ERROR), at["n"]).otherwise(at["bad"])
        return F.struct(to.alias("state"), (at["n"] + 1).alias("n"), bad.alias("bad"))

    first = F.struct(F.lit(START).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return F.reduce(turns, first, step)


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """`conv_id`, `n_turns`, `valid`, `error_turn` and `segments` (text, loss, taken) of every conversation.

    `error_turn` is the first turn (from 0) out of order, or the number of turns if the conversation
    only ends too early; null if it is valid. A segment is `taken` if its turn comes before the first one out
    of order: what follows can't be an answer to what the machine knows, so a strict loss leaves it out.
    """
    row = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    walked = whole.withColumn("walk", _walk(F.col("turns"), template))
    valid = F.col("walk.state").isin(*template.final)
    n = F.size("turns")
    return walked.select(
        "conv_id",
        n.cast("long").alias("n_turns"),
        valid.alias("valid"),
        F.when(~valid, F.coalesce(F.col("walk.bad"), n)).alias("error_turn"),
        F.flatten(
            F.transform("turns", lambda t, i: _segments(t, i < F.coalesce(F.col("walk.bad"), F.size("turns")), template))
        ).alias("segments"),
    )


def joined(segments: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = INSTRUCT, strict: bool = False) -> Column:
    """All text under the loss mask, unescaped; strictly, only that of turns the machine took."""
    counted = F.filter(segments, lambda s: (s["loss"] & s["taken"]) if strict else s["loss"])
    return F.array_join(F.transform(counted, lambda s: unescape(s["text"], template)), "")


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    before, between, after = template.other
    whole = [re.escape(t.opening) + ".*?" + re.escape(t.closing) for t in template.turns]
    whole.append(".*?".join(map(re.escape, (before, between, after))))
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"(?:{w})" for w in whole)), F.lit(0))

    def turn(match: Column) -> Column:
        cut = F.instr(match, between)
        out = F.struct(
            unescape(match.substr(F.lit(len(before) + 1), cut - len(before) - 1), template).alias("role"),
            unescape(
                match.substr(cut + len(between), F.length(match) - len(after) - cut - len(between) + 1), template
            ).alias("text"),
        )
        for t in template.turns:
            inside = match.substr(F.lit(len(t.opening) + 1), F.length(match) - len(t.opening) - len(t.closing))
            own = F.struct(F.lit(t.role).alias("role"), unescape(inside, template).alias("text"))
            out = F.when(F.startswith(match, F.lit(t.opening)), own).otherwise(out)
        return out

    return F.transform(found, turn)
