"""Chat formatting: role rows to one formatted text with loss spans, in DataFrame expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A chat template as data.

    turns: per role, the control strings that open and close a turn. Roles not listed get `other`: opening, separator between
    the role's name and the text, closing. loss: roles whose text counts for the loss. follows: per state the roles that may
    come next; the state is the role read last, or "" before the first turn. final: states in which a conversation may end.

    No control string may hold the escape character, hold another one, or end as one begins; then a text in which all of them are
    escaped holds none, nor do its borders with what stands around it, and the formatted text can be read back.
    """

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: tuple[str, ...]
    follows: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        flat = sorted({x for pair in [*self.turns.values(), self.other] for x in pair}, key=lambda x: (-len(x), x))
        for x in flat:
            if not x or self.escape in x or any(x[-k:] == y[:k] for y in flat for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"not a usable control string: {x!r}")
            if any(x != y and x in y for y in flat):
                raise ValueError(f"a control string holds another: {x!r}")
        if len(self.escape) != 1 or len(flat) > 26:
            raise ValueError("one escape character and 26 control strings at most")
        object.__setattr__(self, "controls", tuple(flat))

    def escaped(self, c: Column) -> Column:
        """Reversible: the escape character and each control string become the escape character and a letter."""
        c = F.replace(c, F.lit(self.escape), F.lit(self.escape + "_"))
        for k, x in enumerate(self.controls):
            c = F.replace(c, F.lit(x), F.lit(self.escape + chr(97 + k)))
        return c

    def unescaped(self, c: Column) -> Column:
        for k, x in enumerate(self.controls):
            c = F.replace(c, F.lit(self.escape + chr(97 + k)), F.lit(x))
        return F.replace(c, F.lit(self.escape + "_"), F.lit(self.escape))

    @property
    def pattern(self) -> str:
        """A turn; groups: per role its text, then another role's name and text."""
        q = lambda x: re.sub(r"([^A-Za-z0-9])", r"\\\1", x)
        one = [f"{q(a)}(.*?){q(b)}" for a, b in self.turns.values()]
        a, m, b = self.other
        return "(?s)" + "|".join([*one, f"{q(a)}(.*?){q(m)}(.*?){q(b)}"])


INSTRUCT = Template(
    turns={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[ROLE]", "[TEXT]", "[/ROLE]"),
    loss=("assistant",),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("user", "assistant"),
)


def format_chats(turns: DataFrame, template: Template = INSTRUCT, *, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text); other columns are ignored.

    Returns conv_id, n_turns, valid (the state machine accepts the order of roles), segments (array of text, loss; their
    texts concatenated are the formatted text) and formatted.

    Turns go by number, then role, then text, nulls first; repeated rows are turns of their own. Null role or text: empty. An
    order that the state machine rejects is formatted all the same, with valid = false. A null id is a conversation of its
    own. A conversation is one output row, so its turns must meet in one task; its size, not the table's, bounds that.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    ordered = turns.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")))).alias("t"))
    state = F.aggregate("t", F.lit("").cast("string"), lambda s, x: F.when(s == "!", s).when(_allowed(template, s, x["role"]), x["role"]).otherwise("!"))

    def segments(x: Column) -> Column:
        opened, closed = F.lit(None), F.lit(None)
        other = template.other
        opened = F.concat(F.lit(other[0]), template.escaped(x["role"]), F.lit(other[1]))
        closed = F.lit(other[2])
        for r, (a, b) in template.turns.items():
            opened, closed = F.when(x["role"] == r, F.lit(a)).otherwise(opened), F.when(x["role"] == r, F.lit(b)).otherwise(closed)
        part = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(part(opened, F.lit(False)), part(template.escaped(x["text"]), x["role"].isin(*template.loss)), part(closed, F.lit(False)))

    out = ordered.select(F.col(id_col), F.size("t").cast("long").alias("n_turns"), state.alias("state"), F.flatten(F.transform("t", segments)).alias("segments"))
    return out.select(id_col, "n_turns", F.col("state").isin(*template.final).alias("valid"), "segments", F.concat_ws("", F.col("segments.text")).alias("formatted"))


def _allowed(template: Template, state: Column, role: Column) -> Column:
    out = F.lit(False)
    for s, roles in template.follows.items():
        out = F.when(state == s, role.isin(*roles)).otherwise(out)
    return out


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """Array of (role, text) read back from a formatted text."""
    found = F.regexp_extract_all(formatted, F.lit(template.pattern), F.lit(0))

    def turn(x: Column) -> Column:
        a, m, b = template.other
        inner = lambda opened, closed: F.substring(x, F.lit(len(opened) + 1), F.length(x) - len(opened) - len(closed))
        at = F.instr(x, m)
        role = template.unescaped(F.substring(x, F.lit(len(a) + 1), at - len(a) - 1))
        text = F.substring(x, at + len(m), F.length(x) - at - len(m) + 1 - len(b))
        for r, (o, c) in template.turns.items():
            role, text = F.when(x.startswith(o), F.lit(r)).otherwise(role), F.when(x.startswith(o), inner(o, c)).otherwise(text)
        return F.struct(role.alias("role"), template.unescaped(text).alias("text"))

    return F.transform(found, turn)


def masked_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: template.unescaped(x["text"])))
