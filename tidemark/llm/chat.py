"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Control strings inside texts are escaped by one backslash after their first character; a string that already has
backslashes there gets one more, so that taking one away again is exact. An escaped text holds no control string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles' texts are learned, and which role may follow which."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    after_role: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    # Strings that a model or template may read as control.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; what isn't named leads to error, which nothing leaves.
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })

    def __post_init__(self):
        # what marks turns is a control string too, or a text that holds it couldn't be read back
        object.__setattr__(self, "controls", tuple(dict.fromkeys((*self.controls, *(x for x in (self.open, self.close) if x and not any(c in x for c in self.controls))))))
        if not self.close or not self.after_role or any(self.close.endswith(self.close[:i]) for i in range(1, len(self.close))):
            raise ValueError("a turn's end must not be empty or begin as it ends, and something must stand between role and text")
        if any(len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more, since an escape goes between")


def _swap(text: Column, template: Template, take: bool) -> Column:
    for head in sorted({c[0] for c in template.controls}):
        rest = "|".join(re.escape(c[1:]).replace("\\ ", " ") for c in template.controls if c[0] == head)
        have = f"({re.escape(head)}){chr(92) * 2 if take else ''}({chr(92) * 2}*(?:{rest}))"
        text = F.regexp_replace(text, have, "$1$2" if take else "$1" + "\\\\" + "$2")
    return text


def escape(text: Column, template: Template) -> Column:
    return _swap(text, template, False)


def unescape(text: Column, template: Template) -> Column:
    return _swap(text, template, True)


def _role_out(role: Column, template: Template) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(template.after_role), F.lit("\\n")), template)


def _role_in(role: Column, template: Template) -> Column:
    # between doubled backslashes, so that \\n isn't read as what follows a role
    parts = F.split(unescape(role, template), "\\\\\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit(template.after_role))), "\\")


def format_chat(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, valid (the turn order is one that the machine accepts), segments and formatted.

    segments is an array of text, loss and kind (open, body or close) whose texts make up formatted. Turns are ordered by turn, ties by role and text; nulls come
    first. Null roles and texts are empty. A conversation out of order is formatted all the same, with valid false. Repeated rows are
    turns of their own. A row without a conversation id belongs to no other: each is a conversation of its own, with a null id, so they never meet. A conversation is the unit of output, one string, so its turns
    meet in one row; different conversations share nothing. Texts of any length are taken whole. Other columns don't matter, whatever their names.
    """
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id())
    rows = df.select(F.col(conv).alias("conv"), alone.alias("alone"), own.alias("own"))
    turns = rows.groupBy("conv", "alone").agg(F.array_sort(F.collect_list("own")).alias("turns")).select(F.col("conv").alias(conv), "turns")
    moves = F.create_map(*[F.lit(x) for state, to in template.moves.items() for r, after in to.items() for x in (f"{state}>{r}", after)])
    step = lambda state, t: F.coalesce(F.element_at(moves, F.concat(state, F.lit(">"), t["role"])), F.lit("error"))
    valid = F.aggregate("turns", F.lit(template.start), step).isin(*template.accept)
    segment = lambda x, loss, kind: F.struct(x.alias("text"), loss.alias("loss"), F.lit(kind).alias("kind"))
    no = F.lit(False)
    parts = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(template.open), _role_out(t["role"], template), F.lit(template.after_role)), no, "open"),
        segment(escape(t["text"], template), t["role"].isin(*template.loss_roles), "body"),
        segment(F.lit(template.close), no, "close"),
    )))
    out = turns.select(conv, valid.alias("valid"), parts.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chat(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation as an array of role and text."""
    pieces = F.filter(F.split(formatted, re.escape(template.close).replace("\\\n", "\n")), lambda p: p != "")
    head = len(template.open)
    body = F.transform(pieces, lambda p: F.substring(p, F.lit(head + 1), F.length(p)))
    at = lambda b: F.instr(b, template.after_role)
    return F.transform(body, lambda b: F.struct(
        _role_in(F.substring(b, F.lit(1), at(b) - 1), template).alias("role"),
        unescape(F.substring(b, at(b) + len(template.after_role), F.length(b)), template).alias("text"),
    ))


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
