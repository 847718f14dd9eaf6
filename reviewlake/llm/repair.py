"""Conversation structure repair: the cheapest edits by iterative-deepening A*.

The rows of a conversation, ordered by turn, are edited until their roles read
``(s?(ua)+)?`` (initials of system, user, assistant).  Keep costs 0, Rerole to
user or assistant 1, Delete 2, Insert of an empty user or assistant turn 5; a
truncated row that stays adds 5; blank and duplicate rows have to go.  Of the
cheapest edit strings the ASCII-least (D < I < K < R) is the answer.

**Search.**  A state is (next row, role machine's state).  A depth-first search
tries edits in ASCII order under a cost bound, which starts at an admissible
estimate and rises to the least cost that any cut path would have needed; a
table keeps, per failed state, the proven least cost from there, so a state is
not searched again under a bound that cannot succeed.  As the bound never
passes the optimum, the first accepting path is the ASCII-least cheapest one.

**Scale.**  Rows are dealt out by ranges of (conversation, turn, role, text)
and sorted; every task cuts its rows into segments of at most ``segment_rows``
rows and ``segment_chars`` characters.  The four states make a segment a
4 by 4 matrix of least costs; for conversations of more than one segment the
matrices compose (min, +) from the end, which gives each segment the exact cost
of what follows.  Segments are then searched independently, from every state
they can be entered in, and the answers chained.  Two paths of one segment
consume the same rows and end with a row's edit, so neither is a prefix of the
other, and the least path of the whole is the chain of the segments' least
paths.  Only the digest, which a hash has to read in order, passes a whole
conversation through one task, as a stream of segments that holds one at a
time.  Matrices of a conversation (16 numbers a segment) meet in one row, as
does its audit, which is a result.

Defined results: null role, text (and null parts of the damage key) are one
space; rows order by (turn, role, text), nulls first; repeated rows are rows of
their own, the later ones duplicates; an unknown or empty role can only be
reroled or deleted; a null conv_id is a conversation like others; an empty
table gives no rows; further columns are ignored; texts of any length are
whole, and a segment holds at least one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: The machine: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEEDS = "uuau"  # the role that an inserted or reroled turn must have, by state
AFTER = (USER, USER, ASSISTANT, USER)
#: What closing the conversation costs in each state, and the turns it inserts.
CLOSING = (0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0)
CLOSING_TURNS = ("", "UA", "A", "")
INF = float("inf")
ROLES = {"u": "user", "a": "assistant"}

SEGMENT = ("conv_id long, part int, k int, codes string, roles array<string>, texts array<string>, "
           "first_turn long, last_turn long, n_turns long, matrix array<double>")
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``, modulo 20."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", ""))
            .otherwise(filled("text")))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
                        kind.alias("kind"), copies.alias("copies"))
            .where("kind != 0").select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"))
            .drop("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their code: the role's initial (``-`` if no s, u, a) and the
    first fault (b, d, t, or ``.``), but for equal rows of one turn, which
    :func:`cut` sees as neighbours.  What a conversation says more than once is
    found by an aggregate over digests, which needs no group in one task; only
    those few digests are joined back."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("digest", digest)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = (rows.groupBy(F.col("conv_id").alias("conv_id_"), F.col("digest").alias("digest_"))
            .agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    return (rows.join(said, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("digest") == F.col("digest_")), "left")
            .select("conv_id", "turn", "role", "text", F.concat(
                F.when(initial.isin("s", "u", "a"), initial).otherwise("-"),
                F.when(trimmed == "", "b").when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place), "d")
                .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "t").otherwise(".")).alias("code")))


def steps(code: str, state: int) -> list[tuple[str, float, int]]:
    """What may become of a row in a state, in ASCII order of the edits and
    without the insertions: (plan letter, cost, next state)."""
    out = [("D", DELETE, state)]
    role, fault = code
    if fault in "bd":
        return out
    stay = TRUNCATED if fault == "t" else 0
    if role == NEEDS[state]:
        out.append(("K", stay, AFTER[state]))
    elif role == "s" and state == START:
        out.append(("K", stay, SYSTEM))
        out.append(("u", stay + REROLE, USER))
    else:
        out.append((NEEDS[state], stay + REROLE, AFTER[state]))
    return out


def search(codes: list[str], entry: int, tail: tuple[float, ...]) -> tuple[str, int]:
    """Iterative-deepening A* over one segment: (plan, last state).  ``tail``
    is the exact cost of what follows, by the segment's last state.  A plan
    has a letter per edit: D, K, u or a (rerole), U or A (insert)."""
    n = len(codes)
    least = [min(tail)] * (n + 1)
    for i in range(n - 1, -1, -1):  # a faulty row costs two at least, whatever is done
        least[i] = least[i + 1] + (codes[i][1] != ".") * min(DELETE, TRUNCATED)
    failed: dict[tuple[int, int], float] = {}
    path: list[str] = []
    end = [entry]

    def visit(i: int, state: int, budget: float) -> float | None:
        """None with ``path`` extended to the end, or a bound above ``budget`` on the cost from here."""
        known = failed.get((i, state), least[i])
        if known > budget:
            return known
        if i == n:
            if tail[state] <= budget:
                end[0] = state
                return None
            return tail[state]
        over = INF
        moves = [(letter, cost, i + 1, to) for letter, cost, to in steps(codes[i], state)]
        moves.insert(1, (NEEDS[state].upper(), INSERT, i, AFTER[state]))
        for letter, cost, at, to in moves:
            path.append(letter)
            rest = visit(at, to, budget - cost)
            if rest is None:
                return None
            path.pop()
            over = min(over, cost + rest)
        failed[i, state] = over
        return over

    bound = least[0]
    while (more := visit(0, entry, bound)) is not None:
        bound = more
    return "".join(path), end[0]


def costs_to(codes: list[str], tail: tuple[float, ...]) -> tuple[float, ...]:
    """The least cost of a segment and what follows, by the state it is entered in."""
    to_go = tail
    for code in reversed(codes):
        row = [min(cost + to_go[to] for _, cost, to in steps(code, s)) for s in STATES]
        for _ in range(2):  # insertions before the row; more than two only go in circles
            row = [min(row[s], INSERT + row[AFTER[s]]) for s in STATES]
        to_go = tuple(row)
    return to_go


def matrix(codes: list[str]) -> list[float]:
    """``m[4 * s + t]``: the least cost from state s before to state t after the segment."""
    columns = [costs_to(codes, tuple(0.0 if s == t else INF for s in STATES)) for t in STATES]
    return [columns[t][s] for s in STATES for t in STATES]


def cut(rows: DataFrame, segment_rows: int, segment_chars: int) -> DataFrame:
    """Sorted rows as segments, columns of SEGMENT.  Equal rows fall into one
    range, so the later ones are known by the row before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, k, chars, conv, before = [], 0, 0, None, None

        def flush() -> pa.RecordBatch:
            turns = [t for t, *_ in own if t is not None]
            codes = [c for *_, c in own]
            row = {"conv_id": conv, "part": part, "k": k, "codes": "".join(codes), "roles": [r for _, r, _, _ in own],
                   "texts": [x for _, _, x, _ in own], "first_turn": turns[0] if turns else None,
                   "last_turn": turns[-1] if turns else None, "n_turns": len(set(turns)),
                   "matrix": matrix(codes)}
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for c, turn, role, text, code in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                if own and (c != conv or len(own) >= segment_rows or chars + len(text) > segment_chars):
                    yield flush()
                    k, own, chars = k + 1, [], 0
                conv = c
                if before == (c, turn, role, text) and code[1] != "b":
                    code = code[0] + "d"
                before = (c, turn, role, text)
                own.append((turn, role, text, code))
                chars += len(text)
        if own:
            yield flush()

    names = ["conv_id", "turn", "role", "text", "code"]
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("codes", pa.string()),
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                        ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()),
                        ("matrix", pa.list_(pa.float64()))])
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).mapInArrow(run, SEGMENT))


def tails(segments: DataFrame) -> DataFrame:
    """(conv_id, part, k, first, tail): the cost of all that follows a segment, by
    its last state; ``first`` marks a conversation's first segment."""
    own = F.struct("part", "k", "matrix")
    listed = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, own in zip(b.column("conv_id").to_pylist(), b.column("own").to_pylist(), strict=True):
                tail = list(CLOSING)
                for j in range(len(own) - 1, -1, -1):
                    out.append((conv, own[j]["part"], own[j]["k"], j == 0, tail))
                    m = own[j]["matrix"]
                    tail = [min(m[4 * s + t] + tail[t] for t in STATES) for s in STATES]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else
                [pa.array([], f.type) for f in schema], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("first", pa.bool_()),
                        ("tail", pa.list_(pa.float64()))])
    return listed.mapInArrow(run, "conv_id long, part int, k int, first boolean, tail array<double>")


def plans(segments: DataFrame) -> DataFrame:
    """(conv_id, part, k, plans, ends) of every segment: plan and last state by
    the state it is entered in; a conversation's first segment has one entry."""
    t = tails(segments).select(*[F.col(c).alias(f"{c}_") for c in ("conv_id", "part", "k")], "first", "tail")
    narrow = segments.select("conv_id", "part", "k", "codes").join(
        t, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("part") == F.col("part_")) & (F.col("k") == F.col("k_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[str]] = []
            ends: list[list[int]] = []
            for codes, first, tail in zip(*(b.column(c).to_pylist() for c in ("codes", "first", "tail")), strict=True):
                each = [codes[j:j + 2] for j in range(0, len(codes), 2)]
                both = [search(each, s, tuple(tail)) for s in (STATES[:1] if first else STATES)]
                found.append([p for p, _ in both])
                ends.append([e for _, e in both])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("part"), b.column("k"), pa.array(found, pa.list_(pa.string())),
                 pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "part", "k", "plans", "ends"])

    return (narrow.select("conv_id", "part", "k", "codes", "first", "tail")
            .mapInArrow(run, "conv_id long, part int, k int, plans array<string>, ends array<int>"))


def apply_plan(plan: str, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The repaired turns of a segment as ``role:text``."""
    i = 0
    for letter in plan:
        if letter in "UA":
            yield ROLES[letter.lower()] + ":"
            continue
        if letter != "D":
            yield f"{ROLES.get(letter, roles[i])}:{texts[i]}"
        i += 1


def edit_cost(plan: str, codes: str) -> int:
    """The cost of a plan's edits, from the codes of its rows."""
    row = {"D": DELETE, "K": 0, "u": REROLE, "a": REROLE}
    edits = [x for x in plan if x not in "UA"]
    kept_truncated = sum(x != "D" and codes[2 * i + 1] == "t" for i, x in enumerate(edits))
    return INSERT * (len(plan) - len(edits)) + sum(map(row.__getitem__, edits)) + TRUNCATED * kept_truncated


AUDIT = str.maketrans("UAua", "IIRR")


class Chained:
    """One conversation's result while its segments stream by."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.state, self.sha, self.lines = conv, START, hashlib.sha256(), 0
        self.audit: list[str] = []
        self.n = dict.fromkeys("bdt", 0)
        self.illegal = self.cost = self.distinct = 0
        self.before = self.first = self.last = None
        self.plans: list[str] = []
        self.ends: list[int] = []

    def line(self, text: str) -> None:
        self.sha.update((f"\n{text}" if self.lines else text).encode("utf-8"))
        self.lines += 1

    def take(self, row: dict) -> None:
        codes = row["codes"]
        if codes is None:  # a segment's plans come just before its texts
            self.plans, self.ends = row["plans"], row["ends"]
            return
        plan = self.plans[self.state]
        self.cost += edit_cost(plan, codes)
        for x in apply_plan(plan, row["roles"], row["texts"]):
            self.line(x)
        self.audit.append(plan)
        self.state = self.ends[self.state]
        for fault in "bdt":
            self.n[fault] += codes[1::2].count(fault)
        for role in codes[::2]:
            self.illegal += self.before is not None and self.before + role not in ("su", "ua", "au")
            self.before = role
        if row["n_turns"]:
            self.distinct += row["n_turns"] - (self.last == row["first_turn"])
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]

    def result(self) -> tuple:
        closing = CLOSING_TURNS[self.state]
        for x in apply_plan(closing, [], []):
            self.line(x)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv, gaps, *self.n.values(), self.illegal, self.cost + INSERT * len(closing),
                "".join([*self.audit, closing]).translate(AUDIT), self.sha.hexdigest())


def repair(rows: DataFrame, all_ids: DataFrame | None = None, segment_rows: int = 128,
           segment_chars: int = 4_000_000) -> DataFrame:
    """Columns of RESULT for every conversation of ``rows`` (conv_id, turn, role,
    text; no nulls but in conv_id and turn), and for every further one of ``all_ids``."""
    segments = written(cut(faults(rows), segment_rows, segment_chars), "segments")
    stream = (segments.drop("matrix").withColumn("kind", F.lit(2))
              .unionByName(plans(segments).withColumn("kind", F.lit(1)), allowMissingColumns=True))
    if all_ids is not None:
        marks = all_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        stream = stream.unionByName(marks.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("k"),
                                                 F.lit(0).alias("kind")), allowMissingColumns=True)
    names = ["conv_id", "part", "k", "kind", "codes", "roles", "texts", "first_turn", "last_turn", "n_turns",
             "plans", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for j in range(b.num_rows):
                row = {c: b.column(c)[j].as_py() for c in names}
                if now is None or row["conv_id"] != now.conv:
                    if now is not None:
                        done.append(now.result())
                    now = Chained(row["conv_id"])
                if row["kind"]:
                    now.take(row)
            if done:
                yield batch(done)
                done = []
        if now is not None:
            yield batch([now.result()])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        types = [pa.string() if t == "string" else pa.int64() for _, t in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)],
                                          [n for n, _ in fields])

    fields = [c.split() for c in RESULT.split(", ")]
    return (stream.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "k", "kind")
            .mapInArrow(run, RESULT))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every original conversation, damaged as the contract says and repaired."""
    return repair(damage(conversations), conversations)
