"""Chat formatting: a finite-state machine over roles and a declarative template, as DataFrame expressions only.

The template names the control strings; a turn becomes ``start role text_mark text end``. Inside roles and texts every
backslash is doubled and each control string gets a backslash after its first character, so no control string of the
output comes from a text and the output can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    start: str = "<|start|>"
    text_mark: str = "<|text|>"
    end: str = "<|end|>"
    after_end: str = "\n"
    #: Control strings of other templates, which are not to appear either.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: Roles whose texts are learned from.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: The machine: from a state, the role that may come next; its name is the next state.
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("system", "user", "assistant")

    def __post_init__(self) -> None:
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")
        if any(a != b and a[1:].find(b[0]) >= 0 and b in a for a in self.controls for b in self.controls):
            raise ValueError("no control string may hold another")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.text_mark, self.end, *self.foreign)

    @property
    def control_pattern(self) -> str:
        """Group 1 is a control string's first character, group 2 the others; valid for Java, RE2 and Python."""
        tails: dict[str, list[str]] = {}
        for c in sorted(self.controls, key=len, reverse=True):
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        if len(tails) == 1:
            return "|".join(f"({re.escape(h)})({'|'.join(t)})" for h, t in tails.items())
        return f"([{''.join(re.escape(h) for h in tails)}])({'|'.join(x for t in tails.values() for x in t)})"


def escaped(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), template.control_pattern, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_chats(rows: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, valid, bad_turn.

    ``segments`` are (text, loss) in order; joined they are ``formatted``. ``valid`` says whether the machine accepts the
    roles; ``bad_turn`` is the index of the first row that it refuses (null if none, or if only the end is refused).
    Turns stand in the order of turn (null first), role, text; repeated rows are turns of their own. Null roles and
    texts count as empty; an empty role is refused by the machine but still formatted. A null conv_id is a conversation
    like any other. Other columns are not read; an empty table gives an empty result. A conversation is one output
    string, so its size is bounded by what one training example can hold.
    """
    t = template or ChatTemplate()
    role, text = F.col("turns_role"), F.col("turns_text")
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("turns_role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("turns_text"),
    )
    parts = F.array(
        F.struct(F.concat(F.lit(t.start), escaped(role, t), F.lit(t.text_mark)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(text, t).alias("text"), role.isin(*t.loss_roles).alias("loss")),
        F.struct(F.lit(t.end + t.after_end).alias("text"), F.lit(False).alias("loss")),
    )
    one = F.struct("turn", role.alias("role"), text.alias("text"), parts.alias("parts"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in t.turns.items() for b in after])
    walk = F.aggregate(
        "turns",
        F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: F.struct(
            x["role"].alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNull() & ~F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), x["role"])), acc["at"])
            .otherwise(acc["bad"])
            .alias("bad"),
        ),
    )
    return grouped.select("conv_id", F.flatten(F.transform("turns", lambda x: x["parts"])).alias("segments"), walk.alias("walk")).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("walk.bad").isNull() & F.col("walk.state").isin(*t.final)).alias("valid"),
        F.col("walk.bad").alias("bad_turn"),
    )


def read_back(formatted: str | Column, template: ChatTemplate | None = None) -> Column:
    """The (role, text) turns of a formatted string."""
    t = template or ChatTemplate()
    col = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.filter(F.split(col, re.escape(t.start)), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, t.text_mark, 1)
        rest = F.substring(x, F.length(role) + F.lit(len(t.text_mark) + 1), F.length(x))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring_index(rest, t.end, 1)).alias("text"))

    return F.transform(pieces, turn)
