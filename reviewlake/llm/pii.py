"""Personal data in texts: fixed patterns plus a character BiLSTM with a CRF.

*Base spans* come from patterns (``base_spans``).  *Added spans* come from a
bidirectional LSTM over characters with CRF transitions, trained here in numpy
on labelled spans, which finds spellings that the patterns leave out ("name at
host dot org", a phone number without its plus sign, a card number with dots).
Overlapping windows of a text are decoded on their own; each position takes
the tag of the window in which it lies farther from the edge, and spans are
read from the whole text's tags, so a span across a seam is one span.  An
added span must pass its kind's digit rules and must not touch a base span.

Training data: at most ``Training.docs`` documents (the smallest hashes of
doc_id among those of at most ``Training.chars`` characters; a documented bound) give contexts and, by their base spans, labels;
generated examples of each kind, usual spellings and others, and look-alikes
labelled as nothing are put between their words.  Gates use the piecewise
linear sigmoid and tanh, in training as in use.

Defined results: null and empty texts have no spans; repeated rows are judged
alike; an empty table gives no rows (the model is then trained on generated
text alone); further columns are ignored by ``find`` and kept by ``redact``.
Texts of any length are read whole, in windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The kinds, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match can only begin where a run of digits does: linear on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card_digits(s: str) -> bool:
    d = NOT_DIGIT.sub("", s)
    return 12 <= len(d) <= 19 and luhn(d)


def phone_digits(s: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", s)) <= 15


def ip_parts(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind; leftmost and not overlapping per kind."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done, 0))
        at = text.find("@", done)
    out += [(*m.span(), 1) for m in IP.finditer(text) if ip_parts(m[0].split("."))]
    out += [(*m.span(), 2) for m in CARD.finditer(text) if card_digits(m[0])]
    out += [(*m.span(), 3) for m in PHONE.finditer(text) if phone_digits(m[0])]
    return sorted(out, key=lambda x: (x[0], x[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


# -- characters ------------------------------------------------------------

#: Classes: 0 is padding, then ASCII one by one, Latin letters, other letters, blanks, anything else.
ASCII = [chr(c) for c in range(32, 127)] + ["\n", "\t"]
N_CLASSES = 1 + len(ASCII) + 4


def _class_table() -> np.ndarray:
    table = np.full(65_537, N_CLASSES - 1, np.uint8)
    for k in range(65_536):
        c = chr(k)
        if c.isalpha():
            table[k] = N_CLASSES - 4 if k < 0x250 else N_CLASSES - 3
        elif c.isspace():
            table[k] = N_CLASSES - 2
    for i, c in enumerate(ASCII):
        table[ord(c)] = i + 1
    return table


CLASSES = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(points, 65_536)]


# -- the model --------------------------------------------------------------

TAGS = 1 + len(KINDS)
WINDOW, OVERLAP = 256, 32
STEP = WINDOW - OVERLAP


@dataclass(frozen=True)
class Training:
    docs: int = 300
    chars: int = 20_000
    windows: int = 1800
    length: int = 96
    hidden: int = 8
    epochs: int = 9
    batch: int = 50
    rate: float = 0.012
    seed: int = 7


class Tagger:
    """Weights: for each direction a table (class -> gates i, f, o, g) and a
    recurrent matrix; emissions; transitions."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        h = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.4, (N_CLASSES, 4 * h))
            self.p["x" + d][:, h:2 * h] += 1.0
            self.p["u" + d] = rng.normal(0, 0.4 / np.sqrt(h), (h, 4 * h))
        self.p["e"] = rng.normal(0, 0.4, (2 * h, TAGS))
        self.p["b"] = np.zeros(TAGS)
        self.p["a"] = np.zeros((TAGS, TAGS))
        self.h = h

    # training: everything in double precision on small batches

    def _lstm(self, x: np.ndarray, d: str):
        """x: (T, B) classes; states and what the backward pass needs."""
        n, b = x.shape
        h, keep = self.h, []
        hs, state, cell = np.zeros((n, b, h)), np.zeros((b, h)), np.zeros((b, h))
        real = (x > 0)[:, :, None]
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = self.p["x" + d][x[t]] + state @ self.p["u" + d]
            s = np.clip(0.25 * z[:, :3 * h] + 0.5, 0, 1) * real[t]
            g = np.clip(z[:, 3 * h:], -1, 1)
            new = s[:, h:2 * h] * cell + s[:, :h] * g
            flat = np.clip(new, -1, 1)
            keep.append((t, z, s, g, cell, new, flat, state))
            state, cell = s[:, 2 * h:] * flat, new
            hs[t] = state
        return hs, keep

    def _lstm_back(self, x, d, keep, dhs, grad) -> None:
        h = self.h
        dstate = np.zeros(dhs.shape[1:])
        dcell = np.zeros_like(dstate)
        for t, z, s, g, cell, new, flat, state in reversed(keep):
            dh = dhs[t] + dstate
            dnew = dcell + dh * s[:, 2 * h:] * (np.abs(new) < 1)
            ds = np.concatenate([dnew * g, dnew * cell, dh * flat], 1)
            dz = np.concatenate([ds * 0.25 * ((s > 0) & (s < 1)), dnew * s[:, :h] * (np.abs(z[:, 3 * h:]) < 1)], 1)
            np.add.at(grad["x" + d], x[t], dz)
            grad["u" + d] += state.T @ dz
            dstate, dcell = dz @ self.p["u" + d].T, dnew * s[:, h:2 * h]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of tags y (T, B) under the CRF, and its gradients."""
        n, b = x.shape
        hf, kf = self._lstm(x, "f")
        hb, kb = self._lstm(x, "b")
        hs = np.concatenate([hf, hb], 2)
        e = hs @ self.p["e"] + self.p["b"]
        a = self.p["a"]
        alpha = np.zeros((n, b, TAGS))
        beta = np.zeros((n, b, TAGS))
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha[0] = e[0]
        for t in range(1, n):
            alpha[t] = lse(alpha[t - 1][:, :, None] + a, 1) + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = lse(a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        prob = np.exp(alpha + beta - total[None, :, None])
        cols = np.arange(b)[None]
        rows = np.arange(n)[:, None]
        loss = total.sum() - e[rows, cols, y].sum() - a[y[:-1], y[1:]].sum()
        de = prob
        de[rows, cols, y] -= 1
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, n):
            pair = np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t])[:, None, :] - total[:, None, None])
            grad["a"] += pair.sum(0)
        np.add.at(grad["a"], (y[:-1].ravel(), y[1:].ravel()), -1.0)
        grad["e"] = np.einsum("tbh,tbk->hk", hs, de)
        grad["b"] = de.sum((0, 1))
        dhs = de @ self.p["e"].T
        self._lstm_back(x, "f", kf, dhs[:, :, :self.h], grad)
        self._lstm_back(x, "b", kb, dhs[:, :, self.h:], grad)
        return loss / b, {k: v / b for k, v in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, t: Training) -> float:
        """x, y: (windows, length).  Adam; returns the last epoch's mean loss."""
        rng = np.random.default_rng(t.seed)
        m, v, step, loss = {}, {}, 0, 0.0
        for epoch in range(t.epochs):
            losses = []
            rate = t.rate * (1.0 if epoch < t.epochs * 0.6 else 0.25)
            order = rng.permutation(len(x))
            for k in range(0, len(x), t.batch):
                own = order[k:k + t.batch]
                loss, grad = self.gradients(x[own].T, y[own].T)
                losses.append(loss)
                step += 1
                for name, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
            loss = float(np.mean(losses))
        return loss

    def frozen(self) -> dict:
        """Single-precision weights for use: the sigmoid's slope and offset are
        put into the tables, the padding class closes all gates."""
        h, out = self.h, {}
        for d in "fb":
            x, u = self.p["x" + d].copy(), self.p["u" + d].copy()
            x[:, :3 * h] = 0.25 * x[:, :3 * h] + 0.5
            u[:, :3 * h] *= 0.25
            x[0] = -1e6
            for k, gate in enumerate("ifog"):
                out["x" + gate + d] = np.ascontiguousarray(x[:, k * h:(k + 1) * h], np.float32)
                out["u" + gate + d] = np.ascontiguousarray(u[:, k * h:(k + 1) * h], np.float32)
        out |= {k: self.p[k].astype(np.float32) for k in "eba"}
        return out


def emissions(w: dict, x: np.ndarray) -> np.ndarray:
    """x: (N, T) classes -> (T, N, tags)."""
    n, t_len = x.shape
    idx = np.ascontiguousarray(x.T.astype(np.intp))
    h = w["uif"].shape[0]
    out = np.empty((t_len, n, TAGS), np.float32)
    states = np.empty((t_len, n, h), np.float32)
    i, f, o, g, z = (np.empty((n, h), np.float32) for _ in range(5))
    for d in "fb":
        tables = [(w["x" + k + d], w["u" + k + d], buf, lo) for k, buf, lo in
                  (("i", i, 0.0), ("f", f, 0.0), ("o", o, 0.0), ("g", g, -1.0))]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(t_len) if d == "f" else range(t_len - 1, -1, -1):
            at = idx[t]
            for table, u, buf, lo in tables:
                np.take(table, at, axis=0, out=buf, mode="clip")
                np.matmul(state, u, out=z)
                np.add(buf, z, out=buf)
                np.clip(buf, lo, 1.0, out=buf)
            np.multiply(cell, f, out=cell)
            np.multiply(i, g, out=i)
            np.add(cell, i, out=cell)
            np.clip(cell, -1.0, 1.0, out=z)
            state = states[t]
            np.multiply(o, z, out=state)
        part = w["e"][:h] if d == "f" else w["e"][h:]
        if d == "f":
            np.matmul(states.reshape(-1, h), part, out=out.reshape(-1, TAGS))
        else:
            out += (states.reshape(-1, h) @ part).reshape(out.shape)
    out += w["b"]
    return out


def viterbi(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """e: (T, N, tags) -> best tags (T, N)."""
    back = np.zeros(e.shape, np.uint8)
    score = e[0]
    for t in range(1, len(e)):
        total = score[:, :, None] + a
        back[t] = total.argmax(1)
        score = total.max(1) + e[t]
    tags = np.zeros(e.shape[:2], np.uint8)
    tags[-1] = score.argmax(1)
    rows = np.arange(e.shape[1])
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = back[t][rows, tags[t]]
    return tags


def decode(w: dict, x: np.ndarray) -> np.ndarray:
    """Best tags (N, T) of windows (N, T).  Where no tag of a window beats
    "nothing" by what transitions could give back, "nothing" throughout is the
    best path, without search."""
    e = emissions(w, x)
    gain = 2 * max(0.0, float((w["a"] - w["a"][0, 0]).max()))
    rival = e[:, :, 1]
    for k in range(2, TAGS):
        rival = np.maximum(rival, e[:, :, k])
    open_ = np.flatnonzero(((rival - e[:, :, 0]).max(0)) >= -gain)
    tags = np.zeros(x.shape, np.uint8)
    if len(open_):
        tags[open_] = viterbi(np.ascontiguousarray(e[:, open_]), w["a"]).T
    return tags


def windows(c: np.ndarray) -> np.ndarray:
    """The overlapping windows (n, WINDOW) of a text's classes."""
    n = max(1, -(-(len(c) - OVERLAP) // STEP))
    padded = np.zeros(n * STEP + OVERLAP, np.uint8)
    padded[:len(c)] = c
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def reconcile(tags: np.ndarray, n: int) -> np.ndarray:
    """One tag per position of a text of ``n`` characters from its windows' tags."""
    out = np.zeros(len(tags) * STEP + OVERLAP, np.uint8)
    half = OVERLAP // 2
    body = out[half:half + len(tags) * STEP].reshape(len(tags), STEP)
    body[:] = tags[:, half:half + STEP]
    out[:half] = tags[0, :half]
    out[half + len(tags) * STEP:] = tags[-1, half + STEP:]
    return out[:n]


PLAUSIBLE = {
    1: re.compile(r"[A-Za-z0-9._%+-]+(?:\s?@\s?|\s?[\[({]\s?(?:@|at|AT)\s?[\])}]\s?|\s(?:at|AT)\s)[A-Za-z0-9-]+"
                  r"(?:\s?\.\s?[A-Za-z0-9-]+|\s?[\[({]\s?(?:\.|dot|DOT)\s?[\])}]\s?[A-Za-z0-9-]+"
                  r"|\s(?:dot|DOT)\s[A-Za-z0-9-]+)+"),
    2: re.compile(r"[0-9]{1,3}(?:\s?[\[({]?[.,][\])}]?\s?[0-9]{1,3}){3}"),
    3: re.compile(r"[0-9](?:[\x20./-]{0,2}[0-9])+"),
    4: re.compile(r"[+(0-9][\x20()./0-9-]+[0-9]"),
}


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of a tag, trimmed, that pass their kind's rules and touch no base span."""
    out = []
    if not tags.any():
        return out
    edge = np.flatnonzero(np.r_[True, tags[1:] != tags[:-1]])
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(tags)], strict=True):
        kind = int(tags[a])
        if not kind:
            continue
        raw = text[a:b]
        a += len(raw) - len(raw.lstrip(" \t\n.,;:!?-"))
        b -= len(raw) - len(raw.rstrip(" \t\n.,;:!?-"))
        s = text[a:b]
        if a >= b or any(x < b and a < y for x, y, _ in base) or not PLAUSIBLE[kind].fullmatch(s):
            continue
        # a longer run of letters or digits outside means that the span is part of something else
        if (text[a - 1:a] if a else "").isalnum() or text[b:b + 1].isalnum():
            continue
        digits = NOT_DIGIT.sub(" ", s).split()
        if (kind == 1 or kind == 2 and ip_parts(digits) or kind == 3 and card_digits(s)
                or kind == 4 and phone_digits(s)):
            out.append((a, b, kind - 1))
    return out


# -- training data ------------------------------------------------------------


def examples(texts: list[str], t: Training) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows (classes, tags): slices of texts with their base spans,
    generated spans and look-alikes between their words."""
    rng = np.random.default_rng(t.seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda a, b: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(a, b))))

    def email():
        local = letters(2, 9) + pick("", "." + letters(2, 8), "." + num(2), "_" + num(1))
        host = [letters(3, 9) + pick("", num(1)), *([letters(3, 8)] if rng.random() < 0.4 else []),
                pick("com", "org", "net", "de", "example")]
        at, dot = pick(("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."))
        return local + at + dot.join(host)

    def ip():
        return pick(".", ".", " . ", ". ", "[.]").join(str(int(x)) for x in rng.integers(0, 256, 4))

    def card():
        d = pick("4", "5", "3", "6") + num(14)
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        return d if rng.random() < 0.4 else pick(" ", "-", ".", "/").join(d[k:k + 4] for k in range(0, 16, 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{pick('1', '44', '49')} ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
                    f"{a}.{b}.{c}", f"00{num(2)} {a} {b}{c}")

    def alike():
        return pick(f"20{num(2)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}", f"{num(1)}.{num(2)}.{num(1)}", num(int(rng.integers(1, 9))),
                    f"{num(3)},{num(2)}", f"{letters(3, 6)}@", "".join(pick(*"0123456789abcdef") for _ in range(40)), f"#{num(4)}",
                    f"{num(2)}:{num(2)}", f"at {letters(3, 8)} dot", f"({num(2)})", f"{letters(3, 7)}-{num(3)}", f"${num(3)}.{num(2)}")

    makers = (email, ip, card, phone)
    texts = [x for x in texts if len(x) > 40] or [" ".join(letters(1, 10) for _ in range(400)) + "." for _ in range(20)]
    spans = [base_spans(x) for x in texts]
    with_spans = [k for k, s in enumerate(spans) if s]
    xs, ys = np.zeros((t.windows, t.length), np.uint8), np.zeros((t.windows, t.length), np.uint8)
    for row in range(t.windows):
        k = int(rng.integers(len(texts)))
        if with_spans and rng.random() < 0.2:
            k = with_spans[int(rng.integers(len(with_spans)))]
            a, b, _ = spans[k][int(rng.integers(len(spans[k])))]
            start = max(0, a - int(rng.integers(0, t.length - 40)))
        else:
            start = int(rng.integers(0, max(1, len(texts[k]) - t.length)))
        text = texts[k][start:start + t.length]
        tags = np.zeros(len(text), np.uint8)
        for a, b, kind in spans[k]:
            tags[max(0, a - start):max(0, b - start)] = kind + 1
        for _ in range(int(rng.integers(0, 4))):
            blanks = [i for i, c in enumerate(text) if c == " " and not tags[i]]
            if not blanks:
                break
            at = blanks[int(rng.integers(len(blanks)))]
            kind = int(rng.integers(0, 6))
            new = makers[kind]() if kind < 4 else alike()
            mark = np.full(len(new), kind + 1 if kind < 4 else 0, np.uint8)
            tail = pick("", "", ".", ",")
            text = text[:at + 1] + new + tail + text[at:]
            tags = np.concatenate([tags[:at + 1], mark, np.zeros(len(tail), np.uint8), tags[at:]])
        cut = int(rng.integers(0, max(1, len(text) - t.length + 1)))
        text, tags = text[cut:cut + t.length], tags[cut:cut + t.length]
        xs[row, :len(text)], ys[row, :len(text)] = classes(text), tags
    return xs, ys


def train(docs: DataFrame, t: Training = Training()) -> dict:
    """Weights trained on at most ``t.docs`` documents of at most ``t.chars`` characters."""
    chosen = (docs.where(F.length("text") <= t.chars).select("doc_id")
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(t.docs))
    rows = (docs.where(F.length("text") <= t.chars).select("doc_id", "text")
            .join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").orderBy("doc_id", "text").limit(t.docs).collect())
    x, y = examples([r["text"] for r in rows], t)
    model = Tagger(t.hidden, t.seed)
    model.fit(x.astype(np.intp), y.astype(np.intp), t)
    return model.frozen()


# -- the operator ------------------------------------------------------------

SLICE = 2048  # windows decoded at a time


def tag_texts(w: dict, texts: list[str]) -> list[np.ndarray]:
    """The reconciled tags of texts, decoded together in slices of windows."""
    parts = [windows(classes(t)) for t in texts]
    sizes = [len(p) for p in parts]
    out = np.zeros((sum(sizes), WINDOW), np.uint8)
    held, n, done = [], 0, 0

    def flush() -> None:
        nonlocal held, n, done
        x = np.concatenate(held)
        for k in range(0, len(x), SLICE):
            out[done + k:done + min(k + SLICE, len(x))] = decode(w, x[k:k + SLICE])
        done, held, n = done + len(x), [], 0

    for p in parts:
        held.append(p)
        n += len(p)
        if n >= SLICE:
            flush()
    if held:
        flush()
    ends = np.cumsum(sizes)
    return [reconcile(out[e - k:e], len(t)) for e, k, t in zip(ends, sizes, texts, strict=True)]


def spans_of(w: dict, texts: list[str]) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of every text, about ``SLICE`` windows at a time."""
    group, chars = [], 0
    for k, t in enumerate(texts):
        group.append(t)
        chars += len(t)
        if chars >= SLICE * STEP or k == len(texts) - 1:
            for text, tags in zip(group, tag_texts(w, group), strict=True):
                base = base_spans(text)
                yield base, added_spans(text, tags, base)
            group, chars = [], 0


def find(docs: DataFrame, weights: dict) -> DataFrame:
    """The columns of SCHEMA for every document."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, added in spans_of(shared.value, b.column("text").to_pylist()):
                n = [sum(k == j for *_, k in base) for j in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))],
                    names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch of overlapping spans replaced by the kind of its first span."""
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict) -> DataFrame:
    """The rows of ``docs``, all columns, with every span in the text masked."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = spans_of(shared.value, [t or "" for t in texts])
            new = [t and masked(t, base + added) for t, (base, added) in zip(texts, found, strict=True)]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
