"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

A template says, for each role, what opens and closes a turn, whether its text is learned, and which roles may follow.
Control strings inside texts get an escape character behind their first character, so none but the template's own is
left, and taking one escape away gives the text back. Main path: DataFrame functions alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns (by number) that a block spans: what one row of ``segments`` holds.
BLOCK = 256
ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """How the turns of one role look. ``opens`` may hold ``{role}``, for roles the template does not name."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, roles that may begin, follow each other and end, and what stands around a conversation.

    ``controls`` are the strings that texts must not hold: each begins with a character that none holds again.
    Exactly one role may open with text that holds no control string; it is read last.
    """

    turns: dict[str, Turn]
    other: Turn
    controls: tuple[str, ...]
    begins: str
    follows: dict[str, tuple[str, ...]]
    first: tuple[str, ...]
    last: tuple[str, ...]
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "states", ("", *self.turns))
        heads = {c[0] for c in self.controls}
        if any(len(c) < 2 or heads & set(c[1:]) or ESCAPE in c for c in self.controls):
            raise ValueError("a control string has its first character once, no other's first one, and no escape")


INSTRUCT = Template(
    turns={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", "</s>", loss=True),
    },
    other=Turn("[ROLE] {role} [SAYS] ", " [/SAYS]"),
    controls=("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/SAYS]", "<s>", "</s>"),
    begins="<s>",
    follows={"system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    first=("system", "user"),
    last=("assistant",),
)


def _rests(t: Template) -> list[tuple[str, str]]:
    """(first character, pattern of what may follow it) for the control strings."""
    heads: dict[str, list[str]] = {}
    for c in t.controls:
        heads.setdefault(c[0], []).append(_quoted(c[1:]))
    return [(_quoted(h), "|".join(rests)) for h, rests in heads.items()]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def escaped(text: Column, t: Template = INSTRUCT) -> Column:
    """``text`` with one more escape behind the first character of whatever is, but for escapes, a control string."""
    pattern = "|".join(rf"{h}(?=\\*(?:{rest}))" for h, rest in _rests(t))
    return F.regexp_replace(text, pattern, r"$0\\")


def unescaped(text: Column, t: Template = INSTRUCT) -> Column:
    """The text that ``escaped`` was given."""
    pattern = "|".join(rf"(?<={h})\\(?=\\*(?:{rest}))" for h, rest in _rests(t))
    return F.regexp_replace(text, pattern, "")


def _by_role(role: Column, t: Template, value) -> Column:
    out = None
    for name, turn in t.turns.items():
        out = F.when(role == name, value(turn)) if out is None else out.when(role == name, value(turn))
    return out.otherwise(value(t.other))


def _opening(turn: Turn, role: Column, t: Template) -> Column:
    head, slot, tail = turn.opens.partition("{role}")
    return F.concat(F.lit(head), escaped(role, t), F.lit(tail)) if slot else F.lit(head)


def _step(t: Template, state: int, role: Column) -> Column:
    """The state after a turn: states count the roles from 1, 0 is the beginning, -1 an order that broke."""
    allowed = t.first if state == 0 else t.follows.get(t.states[state], ())
    out = F.lit(-1)
    for name in allowed:
        out = F.when(role == name, F.lit(t.states.index(name))).otherwise(out)
    return out


def _walk(roles: Column, t: Template, start: int) -> Column:
    """(state, turns that kept the order) after all ``roles``, from ``start``."""

    def step(acc: Column, role: Column) -> Column:
        after = F.lit(-1)
        for s in range(len(t.states)):
            after = F.when(acc["state"] == s, _step(t, s, role)).otherwise(after)
        return F.struct(after.cast("int").alias("state"), (acc["kept"] + (after >= 0).cast("long")).alias("kept"))

    return F.aggregate(roles, F.struct(F.lit(start).cast("int").alias("state"), F.lit(0).cast("long").alias("kept")), step)


def segments(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, block, n_turns, segments, steps): a row for up to ``BLOCK`` turn numbers of a conversation.

    ``segments`` are (text, loss) in order: what opens a turn, its text, what closes it. ``steps`` has, for each state
    the machine may be in before the block, (state after it, turns until the order broke): blocks compose, so a
    conversation of any length is formatted in parts, and no task holds it whole.

    Defined results: a null text is empty, a null role is a role of no letters; roles the template does not name keep
    their name in the opening and break the order. Turns go by number, null first, ties by role and text; repeated
    rows are turns of their own (those of one number share a block). A null conv_id is a conversation. An empty table
    gives no rows. Other columns are not read.
    """
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.floor(turn / BLOCK), F.lit(-(1 << 62))).cast("long").alias("block"),
        F.struct(turn.isNotNull().alias("numbered"), turn.alias("turn"), role.alias("role"), text.alias("text")).alias("t"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def of_turn(x: Column) -> Column:
        return F.array(
            F.struct(_by_role(x["role"], t, lambda k: _opening(k, x["role"], t)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"], t).alias("text"), _by_role(x["role"], t, lambda k: F.lit(k.loss)).alias("loss")),
            F.struct(_by_role(x["role"], t, lambda k: F.lit(k.closes)).alias("text"), F.lit(False).alias("loss")),
        )

    return blocks.select(
        "conv_id",
        "block",
        F.size("t").cast("long").alias("n_turns"),
        F.flatten(F.transform("t", of_turn)).alias("segments"),
        F.array(*[_walk(F.col("t.role"), t, s) for s in range(len(t.states))]).alias("steps"),
    )


def conversations_of(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, formatted, learned, valid, kept_turns): one string for each conversation, put together from its blocks.

    ``learned`` lists the segments under the loss mask as they stand in ``formatted``. ``valid`` holds where all turns keep the
    order and the last may end a conversation; ``kept_turns`` counts those before the first that does not.
    A conversation is one training text, so its row is as long as the conversation; blocks arrive as finished strings.
    """
    t = template
    joined = lambda what: F.array_join(F.transform(what, lambda s: s["text"]), "")
    ready = segments.select(
        "conv_id",
        F.struct(
            "block",
            joined(F.col("segments")).alias("text"),
            F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]).alias("learned"),
            F.col("steps"),
        ).alias("b"),
    )
    whole = ready.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"))

    def compose(acc: Column, steps: Column) -> Column:
        told = F.when(acc["state"] < 0, F.struct(F.lit(-1).cast("int").alias("state"), F.lit(0).cast("long").alias("kept")))
        told = told.otherwise(F.get(steps, acc["state"]))
        return F.struct(told["state"].alias("state"), (acc["kept"] + told["kept"]).alias("kept"))

    start = F.struct(F.lit(0).cast("int").alias("state"), F.lit(0).cast("long").alias("kept"))
    ends = [t.states.index(r) for r in t.last]
    return whole.select(
        "conv_id",
        F.concat(F.lit(t.begins), F.array_join(F.col("b.text"), "")).alias("formatted"),
        F.flatten(F.col("b.learned")).alias("learned"),
        F.aggregate(F.col("b.steps"), start, compose).alias("end"),
    ).select("conv_id", "formatted", "learned", F.col("end.state").isin(ends).alias("valid"), F.col("end.kept").alias("kept_turns"))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted conversation holds, read from its control strings alone."""
    t = template
    plain = [k for k in t.turns.values() if not any(c in k.opens for c in t.controls)]
    if len(plain) > 1:
        raise ValueError("only one role may open without a control string")
    marked = [(r, k) for r, k in t.turns.items() if k not in plain]
    pattern = "|".join(
        [rf"{_quoted(k.opens)}.*?{_quoted(k.closes)}" for _, k in marked]
        + [rf"{_quoted(t.other.opens).replace(_quoted('{role}'), '.*?')}.*?{_quoted(t.other.closes)}"]
        + [rf"{_quoted(k.opens)}.*?{_quoted(k.closes)}" for k in plain]
    )
    head, _, tail = t.other.opens.partition("{role}")

    def cut(x: Column, k: Turn) -> Column:
        return F.substr(x, F.lit(len(k.opens) + 1), F.length(x) - (len(k.opens) + len(k.closes)))

    def turn(x: Column) -> Column:
        said = F.substr(x, F.lit(len(head) + 1), F.length(x) - (len(head) + len(t.other.closes)))
        at = F.locate(tail, said)  # roles hold no control string, so the first is the template's
        out = F.when(x.startswith(head), F.struct(F.substr(said, F.lit(1), at - 1).alias("role"), F.substr(said, at + len(tail)).alias("text")))
        for r, k in marked:
            out = out.when(x.startswith(k.opens), F.struct(F.lit(r).alias("role"), cut(x, k).alias("text")))
        for r, k in t.turns.items():
            if k in plain:
                out = out.otherwise(F.struct(F.lit(r).alias("role"), cut(x, k).alias("text")))
        return F.struct(unescaped(out["role"], t).alias("role"), unescaped(out["text"], t).alias("text"))

    body = F.substr(formatted, F.lit(len(t.begins) + 1))
    return F.transform(F.regexp_extract_all(body, F.lit(f"(?s){pattern}"), F.lit(0)), turn)


def digest(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the formatted conversations say when they are read back: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, valid, kept_turns). Nothing here is taken from the rows that were formatted."""
    loss = F.array_join(F.transform("learned", lambda x: unescaped(x, template)), "")
    read = conversations.withColumn("turns", read_back(F.col("formatted"), template)).withColumn("loss", loss)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "kept_turns",
    )
