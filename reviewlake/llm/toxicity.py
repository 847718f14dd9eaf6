"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs.

A text is read as lower-case words (blanks and ASCII punctuation part them)
in overlapping windows of ``WINDOW`` words.  A word's input joins an embedding
of the word and the mean of the embeddings of its character n-grams, both
hashed.  A GRU runs over the window in both directions; attention weights the
positions, the pooled states and inputs give the window's score, and a text's
score is that of its highest window.  All windows of all texts are scored.

The network is trained in numpy on a bounded number of labelled texts
(``Training.docs``, a documented bound; the smallest hashes of doc_id among the
labelled ids that have a text of at most ``Training.chars`` characters; an id
with several such texts gives its least one).  Only
texts carry labels, so each round trains on the window of a text that scores
highest so far; the first coordinate of the embeddings starts as the log odds
of the word or n-gram between toxic and other training texts.

Defined results: null and empty texts are one window without words, scored
like others; repeated rows get equal scores; an empty table gives no rows;
without labels of both kinds every score is 0; further columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .decontaminate import words_of

WINDOW, STEP = 64, 48
WORDS, GRAMS, GRAM_SIZES = 1 << 15, 1 << 16, (3, 5, 7)
DIM = 8  # of either embedding
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_windows long"


@dataclass(frozen=True)
class Training:
    docs: int = 6000
    chars: int = 20_000
    hidden: int = 12
    attention: int = 12
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_bucket(w: bytes) -> int:
    return zlib.crc32(w) % WORDS


def gram_buckets(w: bytes) -> list[int]:
    w = b"<" + w + b">"
    return [zlib.crc32(w[k:k + n]) % GRAMS for n in GRAM_SIZES for k in range(len(w) - n + 1)] or [0]


def window_ids(ids: np.ndarray) -> np.ndarray:
    """(n, WINDOW) overlapping windows of word ids, 0 after the end."""
    n = max(1, -(-(len(ids) - WINDOW + STEP) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.int64)
    padded[:len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Vocabulary:
    """Distinct words with their buckets; 0 is the empty place."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.word, self.flat, self.sizes = array("i", [0]), array("i", [0]), array("i", [1])

    def ids(self, words: list[bytes]) -> np.ndarray:
        for w in set(words).difference(self.number):
            self.number[w] = len(self.word)
            self.word.append(word_bucket(w))
            self.flat.extend(g := gram_buckets(w))
            self.sizes.append(len(g))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def arrays(self) -> None:
        self.word, self.flat, self.sizes = (np.array(a) for a in (self.word, self.flat, self.sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, all gram buckets one after another, and the number of each."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.word[ids], self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])], sizes


def inputs(p: dict, word: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The input vectors of words."""
    sums = np.add.reduceat(p["grams"][grams], np.cumsum(sizes) - sizes, axis=0)
    return np.concatenate([p["words"][word], sums / sizes[:, None]], 1).astype(p["words"].dtype)


class Network:
    """Weights, their gradients for windows with labels, and training."""

    def __init__(self, t: Training):
        rng = np.random.default_rng(t.seed)
        h, a, d = t.hidden, t.attention, 2 * DIM
        self.t, self.h = t, h
        self.p = {"words": rng.normal(0, 0.05, (WORDS, DIM)).astype(np.float32),
                  "grams": rng.normal(0, 0.05, (GRAMS, DIM)).astype(np.float32)}
        for s in "fb":
            self.p |= {"w" + s: rng.normal(0, 0.25, (d, 3 * h)), "c" + s: np.zeros(3 * h),
                       "u" + s: rng.normal(0, 0.25, (h, 3 * h))}
        self.p |= {"k": rng.normal(0, 0.25, (2 * h + d, a)), "q": rng.normal(0, 0.25, a), "kc": np.zeros(a),
                   "o": rng.normal(0, 0.25, 2 * h + d), "oc": np.array([-1.0])}
        for k in ("k", "o"):  # attend to, and add up, the log odds at first
            self.p[k][2 * h], self.p[k][2 * h + DIM] = 1.0, 1.0
        self.p["q"][:] = np.abs(self.p["q"]) + 0.3

    def _gru(self, x, mask, s):
        n, b, h = x.shape[0], x.shape[1], self.h
        xs = x @ self.p["w" + s] + self.p["c" + s]
        u, state, out, keep = self.p["u" + s], np.zeros((b, h)), np.zeros((n, b, h)), []
        for t in range(n) if s == "f" else range(n - 1, -1, -1):
            r = state @ u
            zr = sigmoid(xs[t, :, :2 * h] + r[:, :2 * h])
            z, g = zr[:, :h], zr[:, h:]
            z = np.where(mask[t][:, None], z, 1.0)
            c = np.tanh(xs[t, :, 2 * h:] + g * r[:, 2 * h:])
            new = (1 - z) * c + z * state
            keep.append((t, z, g, c, r[:, 2 * h:], state))
            out[t] = state = new
        return out, keep

    def _gru_back(self, x, mask, s, keep, dout, grad):
        h, u = self.h, self.p["u" + s]
        dxs, dstate = np.zeros((*x.shape[:2], 3 * h)), np.zeros(dout.shape[1:])
        for t, z, g, c, rn, state in reversed(keep):
            dh = dout[t] + dstate
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (state - c) * z * (1 - z)
            dg = dc * rn * g * (1 - g)
            dr = np.concatenate([dz, dg, dc * g], 1)
            grad["u" + s] += state.T @ dr
            dxs[t] = np.concatenate([dz, dg, dc], 1)
            dstate = dh * z + dr @ u.T
        dxs *= mask[:, :, None]
        grad["w" + s] += np.einsum("tbd,tbk->dk", x, dxs)
        grad["c" + s] += dxs.sum((0, 1))
        return dxs @ self.p["w" + s].T

    def forward(self, x, mask):
        hf, kf = self._gru(x, mask, "f")
        hb, kb = self._gru(x, mask, "b")
        v = np.concatenate([hf, hb, x], 2)
        act = np.tanh(v @ self.p["k"] + self.p["kc"])
        score = np.where(mask, act @ self.p["q"], -1e9)
        e = np.exp(score - score.max(0)) * mask
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tb,tbv->bv", alpha, v)
        return pooled @ self.p["o"] + self.p["oc"][0], (kf, kb, v, act, alpha, pooled)

    def gradients(self, x, mask, y):
        """Cross-entropy of labels y (B) for windows x (T, B, inputs), its gradients, and those of x."""
        logit, (kf, kb, v, act, alpha, pooled) = self.forward(x, mask)
        p = sigmoid(logit)
        loss = -(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).sum()
        grad = {k: np.zeros_like(w) for k, w in self.p.items() if k not in ("words", "grams")}
        d = p - y
        grad["o"], grad["oc"] = pooled.T @ d, np.array([d.sum()])
        dpooled = d[:, None] * self.p["o"]
        dv = alpha[:, :, None] * dpooled
        da = np.einsum("tbv,bv->tb", v, dpooled)
        ds = alpha * (da - (alpha * da).sum(0))
        grad["q"] = np.einsum("tba,tb->a", act, ds)
        dact = ds[:, :, None] * self.p["q"] * (1 - act * act)
        grad["k"], grad["kc"] = np.einsum("tbv,tba->va", v, dact), dact.sum((0, 1))
        dv += dact @ self.p["k"].T
        h = self.h
        dx = dv[:, :, 2 * h:] * mask[:, :, None]
        dx = dx + self._gru_back(x, mask, "f", kf, dv[:, :, :h], grad)
        dx = dx + self._gru_back(x, mask, "b", kb, dv[:, :, h:2 * h], grad)
        return loss, grad, dx

    def start_from_odds(self, vocabulary: Vocabulary, docs: list[np.ndarray], labels: np.ndarray) -> None:
        counts = {"words": np.zeros((2, WORDS)), "grams": np.zeros((2, GRAMS))}
        for ids, y in zip(docs, labels, strict=True):
            if len(ids):
                w, g, _ = vocabulary.of(np.unique(ids))
                counts["words"][int(y), np.unique(w)] += 1
                counts["grams"][int(y), np.unique(g)] += 1
        n = np.bincount(labels.astype(int), minlength=2)
        for k, c in counts.items():
            odds = np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2))
            seen = c.sum(0)
            self.p[k][:, 0] = 0.4 * np.clip(odds, -3, 3) * seen / (seen + 5)

    def fit(self, docs: Iterable[list[bytes]], labels: np.ndarray) -> None:
        t, rng = self.t, np.random.default_rng(self.t.seed)
        vocabulary = Vocabulary()
        ids = [vocabulary.ids(d) for d in docs]
        vocabulary.arrays()
        self.start_from_odds(vocabulary, ids, labels)
        wins = [window_ids(i) for i in ids]
        first = np.cumsum([len(w) for w in wins]) - [len(w) for w in wins]
        owner = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
        wins = np.concatenate(wins)
        m, v, step = {}, {}, 0
        square = {k: np.full(len(self.p[k]), 1e-6, np.float32) for k in ("words", "grams")}
        for epoch in range(t.epochs):
            frozen = self.frozen()
            every = np.arange(len(vocabulary.word))
            table = np.concatenate([inputs(frozen, *vocabulary.of(every[k:k + 10_000])) for k in every[::10_000]])
            table[0] = 0
            if epoch:
                score = score_windows(frozen, projected(frozen, table), wins)
            else:
                score = (table[:, 0] + table[:, DIM])[wins].max(1)
            score = score + rng.random(len(score)) * 1e-6
            top = np.maximum.reduceat(score, first)
            best = np.flatnonzero(score == top[owner])
            other = first + (rng.random(len(first)) * np.bincount(owner)).astype(int)
            rows = np.unique(np.concatenate([best, other[labels == 0]]))
            rows = rng.permutation(rows)
            rate = t.rate * (1.0 if epoch < t.epochs - 3 else 0.3)
            for k in range(0, len(rows), t.batch):
                own = rows[k:k + t.batch]
                words, at = np.unique(wins[own], return_inverse=True)
                w, g, sizes = vocabulary.of(words)
                x = inputs(self.p, w, g, sizes).astype(float)
                x[words == 0] = 0
                at = at.reshape(len(own), WINDOW).T
                _, grad, dx = self.gradients(x[at], wins[own].T > 0, labels[owner[own]])
                b = len(own)
                step += 1
                for name, d in grad.items():
                    d = np.clip(d / b, -1, 1)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * d * d
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
                dwords = np.zeros((len(words), 2 * DIM))
                np.add.at(dwords, at.ravel(), dx.reshape(-1, 2 * DIM) / b)
                dgram = np.repeat(dwords[:, DIM:] / sizes[:, None], sizes, axis=0)
                for name, rows_, d in (("words", w, dwords[:, :DIM]), ("grams", g, dgram)):
                    u, inv = np.unique(rows_, return_inverse=True)
                    s = np.zeros((len(u), DIM))
                    np.add.at(s, inv, d)
                    square[name][u] += (s * s).mean(1)
                    self.p[name][u] -= (rate * 5 * s / np.sqrt(square[name][u])[:, None] * 0.2).astype(np.float32)

    def frozen(self) -> dict:
        return {k: np.asarray(w, np.float32) for k, w in self.p.items()}


def projected(w: dict, x: np.ndarray) -> dict:
    """Per input vector the gates' parts that do not depend on the state; row
    0 (the empty place) keeps the state as it is."""
    h = w["uf"].shape[0]
    out = {"x": x}
    for s in "fb":
        gates = x @ w["w" + s] + w["c" + s]
        for k, gate in enumerate("zrn"):
            out[gate + s] = np.ascontiguousarray(gates[:, k * h:(k + 1) * h])
        out["z" + s][0] = 60.0
    return out


def score_windows(w: dict, t: dict, wins: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Logits of windows of word ids; ``t`` are the words' projections."""
    out = np.empty(len(wins), np.float32)
    for k in range(0, len(wins), batch):
        own = wins[k:k + batch]
        used = max(1, int((own > 0).sum(1).max()))
        out[k:k + batch] = _score(w, t, np.ascontiguousarray(own[:, :used].T))
    return out


def _score(w: dict, t: dict, idx: np.ndarray) -> np.ndarray:
    n_t, n = idx.shape
    h = w["uf"].shape[0]
    v = np.empty((n_t, n, 2 * h + 2 * DIM), np.float32)
    v[:, :, 2 * h:] = t["x"][idx]
    z, r, c, tmp = (np.empty((n, h), np.float32) for _ in range(4))
    for j, s in enumerate("fb"):
        us = [np.ascontiguousarray(w["u" + s][:, k * h:(k + 1) * h]) for k in range(3)]
        state = np.zeros((n, h), np.float32)
        for step in range(n_t) if s == "f" else range(n_t - 1, -1, -1):
            at = idx[step]
            for gate, u, buf in (("z", us[0], z), ("r", us[1], r)):
                np.take(t[gate + s], at, axis=0, out=buf, mode="clip")
                np.matmul(state, u, out=tmp)
                buf += tmp
                buf *= 0.5
                np.tanh(buf, out=buf)
                buf *= 0.5
                buf += 0.5
            np.take(t["n" + s], at, axis=0, out=c, mode="clip")
            np.matmul(state, us[2], out=tmp)
            tmp *= r
            c += tmp
            np.tanh(c, out=c)
            state -= c
            state *= z
            state += c  # (1 - z) c + z state
            v[step, :, j * h:(j + 1) * h] = state
    act = np.tanh(v.reshape(-1, v.shape[2]) @ w["k"] + w["kc"])
    score = np.where(idx > 0, (act @ w["q"]).reshape(idx.shape), np.float32(-1e9))
    e = np.exp(score - score.max(0)) * (idx > 0)
    alpha = e / np.maximum(e.sum(0), 1e-9)
    return ((v @ w["o"]) * alpha).sum(0) + w["oc"][0]


class Scorer:
    """Scores texts; keeps the projections of about ``most`` words."""

    def __init__(self, w: dict, most: int = 150_000):
        self.w, self.most = w, most
        self.clear()

    def clear(self) -> None:
        zero = projected(self.w, np.zeros((1, 2 * DIM), np.float32))
        self.number: dict[bytes, int] = {}
        self.n, self.t = 1, {k: np.concatenate([v, np.zeros((1 << 14, v.shape[1]), np.float32)]) for k, v in zero.items()}

    def ids(self, words: list[bytes]) -> np.ndarray:
        if new := list(set(words).difference(self.number)):
            grams = [gram_buckets(x) for x in new]
            sizes = np.array([len(g) for g in grams])
            x = inputs(self.w, np.array([word_bucket(x) for x in new]), np.array([g for own in grams for g in own]), sizes)
            zero = np.zeros((1, x.shape[1]), np.float32)
            rows = projected(self.w, np.concatenate([zero, x]))
            while len(self.t["x"]) < self.n + len(new):
                self.t = {k: np.concatenate([v, np.zeros_like(v)]) for k, v in self.t.items()}
            for k, v in rows.items():
                self.t[k][self.n:self.n + len(new)] = v[1:]
            self.number.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit and the number of windows, per text."""
        if self.n > self.most:
            self.clear()
        wins = [window_ids(self.ids(words_of(x))) for x in texts]
        sizes = np.array([len(x) for x in wins])
        flat = np.concatenate(wins)
        order = np.argsort((flat > 0).sum(1), kind="stable")  # short windows together
        score = np.empty(len(flat), np.float32)
        score[order] = score_windows(self.w, self.t, flat[order])
        return np.maximum.reduceat(score, np.cumsum(sizes) - sizes), sizes


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> dict | None:
    """Weights learnt from the labelled rows outside the held-out fold, at
    most ``t.docs`` of them, of at most ``t.chars`` characters; None without
    labels of both kinds."""
    known = (labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    short = docs.where(F.length("text") <= t.chars).select("doc_id", "text")
    chosen = (known.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(t.docs))
    rows = (short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
            .toArrow().sort_by("doc_id"))
    y = np.array(rows["toxic"], float)
    if len(set(y.tolist())) < 2:
        return None
    net = Network(t)
    net.fit((words_of(x.as_py()) for x in rows["text"]), y)
    return net.frozen()


def score(docs: DataFrame, weights: dict | None) -> DataFrame:
    """The columns of SCHEMA for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       text_of().alias("text"))
    if weights is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                           F.lit(0).cast("long").alias("n_windows"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for b in batches:
            scorer = scorer or Scorer(shared.value)
            texts, logits, sizes, group, chars = b.column("text").to_pylist(), [], [], [], 0
            for k, x in enumerate(texts):
                group.append(x)
                chars += len(x)
                if chars > 1_000_000 or k == len(texts) - 1:
                    found = scorer.logits(group)
                    logits.append(found[0])
                    sizes.append(found[1])
                    group, chars = [], 0
            if not texts:
                continue
            p = np.round(sigmoid(np.concatenate(logits).astype(float)), 6)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array(np.concatenate(sizes))], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
