"""Conversation repair against a plain shortest-path search over whole conversations."""

import hashlib
import random
import zlib

import pytest

from reviewlake.llm import repair

BLANK = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(rows):
    """Least (cost, audit) per role string's state, row by row, over all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def better(new, state, value):
        if state not in new or value[:2] < new[state][:2]:
            new[state] = value

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for s, (c, audit, turns) in list(out.items()):
                to = "a" if s == "u" else "u"
                better(out, to, (c + 5, audit + "I", (*turns, ("user:" if to == "u" else "assistant:"))))
        return out

    # every path is kept by its whole audit, so prefixes cannot mislead the comparison
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (c, audit, turns) in inserted(best).items():
            better(new, s, (c + 2, audit + "D", turns))
            if fault in ("b", "d"):
                continue
            extra = 5 if fault == "t" else 0
            if role[:1] and role[:1] in legal[s]:
                better(new, role[0], (c + extra, audit + "K", (*turns, f"{role}:{text}")))
            for to, full in (("u", "user"), ("a", "assistant")):
                if to in legal[s]:
                    better(new, to, (c + extra + 1, audit + "R", (*turns, f"{full}:{text}")))
        best = new
    ends = [v for s, v in inserted(best).items() if s in ("", "a")]
    cost, audit, turns = min(ends)
    known = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in "bdt"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest())


def made_up(seed, conversations, longest):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "sys"]
    texts = ["Hello there.", "yes!", "no stop", "", None, " \n", "What?", "é😀.", "x. \t\n", "cut off,"]
    rows = []
    for conv in [None, *range(conversations)]:
        for k in range(rnd.randrange(1, longest)):
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"Text {rnd.randrange(60)}."
            role = rnd.choice(roles) if rnd.random() < 0.5 else roles[k % 2]
            rows.append((conv, rnd.choice([None, k, k, k, k, 2 * k, 3]), role, text))
    return rows + rows[:5]


def got(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows],
                               "conv_id long, turn long, role string, text string, part int, codes string")
    found = repair.repair(repair.damage(df), df, **sizes).collect()
    assert len(found) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("seed, conversations, longest, sizes", [
    (1, 60, 14, {}), (2, 12, 60, {"segment_rows": 5}), (3, 4, 400, {"segment_rows": 16}), (4, 3, 90, {"segment_chars": 20}),
    (5, 1, 300, {})])
def test_against_brute_force(spark, seed, conversations, longest, sizes):
    rows = made_up(seed, conversations, longest)
    want = {c: brute_repair([r for r in brute_damage(rows) if r[0] == c]) for c in {r[0] for r in rows}}
    assert got(spark, rows, **sizes) == want


def test_search_alone_against_matrices():
    rnd = random.Random(9)
    for _ in range(200):
        codes = [rnd.choice("sua-") + rnd.choice("...tbd") for _ in range(rnd.randrange(0, 12))]
        for entry in repair.STATES:
            plan, end = repair.search(codes, entry, repair.CLOSING)
            cost = repair.edit_cost(plan, "".join(codes)) + repair.CLOSING[end]
            assert cost == repair.costs_to(codes, repair.CLOSING)[entry]
            m = repair.matrix(codes)
            assert cost == min(m[4 * entry + t] + repair.CLOSING[t] for t in repair.STATES)


def test_edges(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    whole = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    out = got(spark, [(dropped, 0, "user", "Gone."), (whole, 0, "user", "x" * 300_000 + ".")])
    assert out[dropped] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert out[whole][5:] == (2, "D", nothing)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_damaged(empty).collect() == []


def test_one_hot_conversation(spark):
    rows = [(7, k // 3, ("user", "assistant")[k % 2], f"Line {k % 1500}.") for k in range(3000)]
    rows += [(k, 0, "user", "Same first turn.") for k in range(200)]
    want = {c: brute_repair([r for r in brute_damage(rows) if r[0] == c]) for c in {r[0] for r in rows}}
    assert got(spark, rows) == want
