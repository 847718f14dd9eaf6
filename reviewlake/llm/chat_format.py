"""Chat formatting with a finite-state machine over roles (DataFrame functions only).

``format_chat`` turns rows ``(conv_id, turn, role, text)`` into text segments
with a loss flag each, from a declarative :class:`ChatTemplate`:

* a turn gives three segments: opening (marker, role, line end), the escaped
  text, closing marker; only the text segment of a loss role carries the flag;
* control strings inside roles and texts are escaped reversibly (``<|`` gets a
  backslash between its two characters, one more if some are there already),
  so every marker in the output is one that the template wrote;
* turn order is validated by a finite-state machine.  A turn is a map from
  each state to the next one; maps compose, so a long conversation is folded
  in blocks of ``block_turns`` turn numbers and the blocks' maps are composed
  afterwards: no task needs a whole conversation to validate or to format it.

Defined results: null text or role is the empty string; an unknown role leads
to the absorbing state ``reject``; rows order by (turn, role, text), nulls
first, and repeated rows are turns of their own; an empty table gives no rows;
further columns are ignored.  ``conv_id`` null is a conversation like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, loss roles and the machine: (state, role, next state)."""

    opening: str = "<|im_start|>"
    header_end: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    machine: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )

    @property
    def states(self) -> list[str]:
        seen = [self.start, *(s for a, _, b in self.machine for s in (a, b)), "reject"]
        return list(dict.fromkeys(seen))


DEFAULT = ChatTemplate()


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role stands on the header line: its line ends are escaped too."""
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _next_states(role: Column, t: ChatTemplate) -> Column:
    """For a role, the array of next states (as indices) by current state."""
    at = {s: i for i, s in enumerate(t.states)}
    reject = at["reject"]
    out = F.array(*[F.lit(reject)] * len(at))
    for r in dict.fromkeys(r for _, r, _ in t.machine):
        to = [reject] * len(at)
        for a, role_, b in t.machine:
            if role_ == r:
                to[at[a]] = at[b]
        out = F.when(role == r, F.array(*map(F.lit, to))).otherwise(out)
    return out


def compose(maps: Column, t: ChatTemplate) -> Column:
    """Left-to-right composition of an array of state maps."""
    identity = F.array(*map(F.lit, range(len(t.states))))
    return F.aggregate(maps, identity, lambda acc, m: F.transform(acc, lambda s: F.get(m, s)))


def format_chat(rows: DataFrame, template: ChatTemplate = DEFAULT, block_turns: int = 64) -> DataFrame:
    """``(conv_id, block, segments array<struct<text, loss>>, state_map)`` per block of turns."""
    t = template
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.select(
        "conv_id", F.floor(F.col("turn") / block_turns).alias("block"),
        F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segments(x: Column) -> Column:
        opening = F.concat(F.lit(t.opening), escape_role(x["role"]), F.lit(t.header_end))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")))

    return blocks.select(
        "conv_id", "block", F.flatten(F.transform("ts", segments)).alias("segments"),
        compose(F.transform("ts", lambda x: _next_states(x["role"], t)), t).alias("state_map"))


def read_back(blocks: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Parse formatted blocks: turns (role, text), loss texts, formatted length."""
    t = template
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    pieces = F.filter(F.split(whole, rf"\Q{t.opening}\E"), lambda _, i: i > 0)

    def turn(p: Column) -> Column:
        head = F.instr(p, t.header_end)
        body = F.substr(p, head + F.lit(1), F.length(p) - head - F.lit(len(t.closing)))
        return F.struct(unescape_role(F.substr(p, F.lit(1), head - F.lit(1))).alias("role"),
                        unescape(body).alias("text"))

    losses = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return blocks.select("conv_id", "block", "state_map", F.transform(pieces, turn).alias("turns"),
                         losses.alias("losses"), F.length(whole).cast("long").alias("chars"))


def digests(parsed: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row per conversation.  A digest needs its texts in order, so the
    blocks' strings of one conversation meet here (in one row each)."""
    t = template
    rejected = F.lit(t.states.index("reject"))
    per_block = parsed.select(
        "conv_id", "chars", F.size("turns").cast("long").alias("n"),
        F.struct("block", F.array_join(F.transform("turns", lambda x: F.concat(
            x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("losses", "").alias("loss"), "state_map").alias("b"))
    per_conv = per_block.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("b")).alias("bs"))
    joined = per_conv.select(
        "conv_id", "n_turns", "formatted_chars",
        F.array_join(F.transform("bs", lambda b: b["turns"]), "").alias("turns"),
        F.array_join(F.transform("bs", lambda b: b["loss"]), "").alias("loss"),
        F.get(compose(F.transform("bs", lambda b: b["state_map"]), t), F.lit(0)).alias("state"))
    return joined.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", (F.col("state") != rejected).alias("valid_order"))
