"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are cut into units of at most ``unit_words`` words; an inverted
index holds, for each pair of adjacent words, the units with that pair and
their BM25 impact as a share of the unit's own best score (so a passage that
holds a whole unit scores 1).  Posting lists are cut into blocks with the
largest impact of each.

Every training passage (``passage_words`` words, starting every half passage,
so any unit lies whole in one) is a query.  If the largest impacts of its
terms cannot reach ``min_score`` the search ends before it begins; the others
run block-max WAND, which returns every unit at or above ``min_score``.
A document leaks an item if one of its units is found and the whole document
holds at least ``min_overlap`` of the word triples of the item's question and
of its answer: the item's last sentence is its answer, the rest its question
(of a single sentence, the last third is the answer).

An item is a distinct text; an item_id may have several texts and a text
several item_ids, null among them.  Each text is searched and verified on its
own; ``find_leaks`` gives the best leaking text of each item_id (by score, then
overlaps, then passages).

The index is built on the driver and sent to the executors, for about as many
texts at a time as hold ``index_chars`` characters together (cut by the text's
hash); more texts are taken in further passes.  Words are lower case, split at blanks and ASCII punctuation.

Defined results: null and empty texts leak nothing and items of fewer than
``MIN_ITEM_WORDS`` words are too short to show a leak; items without an id are
searched like others and reported under a null item_id, as one id; repeated rows are judged
alike; an empty benchmark leaves all documents, an empty table gives no rows;
further columns are kept by ``drop_leaks`` and ignored by ``find_leaks``.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
MIN_ITEM_WORDS = 5
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"


@dataclass(frozen=True)
class Search:
    passage_words: int = 128
    unit_words: int = 64
    min_score: float = 0.5
    min_overlap: float = 0.6
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    index_chars: int = 20_000_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").translate(PUNCTUATION).split()


def triples(words: list[bytes]) -> set[tuple]:
    n = min(3, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if n else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer."""
    sentences = [s for s in SENTENCE_END.split(text.strip()) if words_of(s)]
    if len(sentences) > 1:
        return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])
    words = words_of(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


class Postings:
    """A cursor over one term's posting list and its blocks."""

    __slots__ = ("units", "impacts", "block_max", "top", "at", "block")

    def __init__(self, units, impacts, block_max, block):
        self.units, self.impacts, self.block_max, self.block = units, impacts, block_max, block
        self.top, self.at = max(block_max), 0

    def next_from(self, unit: int) -> None:
        """To the first posting at or after ``unit``, over whole blocks first."""
        units, at, n = self.units, self.at, len(self.units)
        while (end := (at // self.block + 1) * self.block) < n and units[end - 1] < unit:
            at = end
        while at < n and units[at] < unit:
            at += 1
        self.at = at


class Index:
    """The inverted index of a set of items."""

    def __init__(self, items: Iterable[tuple[int | None, str]], s: Search):
        self.search, self.vocabulary = s, {}
        self.parts, self.ids, self.owner, unit_pairs = [], [], [], []
        by_text: dict[str, list[int | None]] = {}
        for item_id, text in items:
            by_text.setdefault(text, []).append(item_id)
        for text, item_ids in by_text.items():
            words = words_of(text)
            if len(words) < MIN_ITEM_WORDS:
                continue
            number = len(self.parts)
            self.ids.append(item_ids)
            self.parts.append(tuple(triples(p) for p in question_answer(text)))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            n_units = -(-len(ids) // s.unit_words)
            for k in range(n_units):
                own = ids[k * len(ids) // n_units:(k + 1) * len(ids) // n_units]
                unit_pairs.append(Counter(zip(own, own[1:], strict=False)))
                self.owner.append(number)
        self.size = len(self.vocabulary)
        held = Counter(p for c in unit_pairs for p in c)
        lens = [sum(c.values()) for c in unit_pairs]
        mean = sum(lens) / max(1, len(lens))
        lists: dict[int, list[tuple[int, float]]] = {}
        for u, c in enumerate(unit_pairs):
            impact = {p: math.log(1 + (len(lens) - held[p] + 0.5) / (held[p] + 0.5)) * tf * (s.k1 + 1)
                      / (tf + s.k1 * (1 - s.b + s.b * lens[u] / mean)) for p, tf in c.items()}
            own = sum(impact.values())
            for (x, y), v in impact.items():
                lists.setdefault(x * self.size + y, []).append((u, v / own))
        self.pairs = np.array(sorted(lists), np.int64)
        self.lists = []
        for key in self.pairs.tolist():
            units, impacts = map(list, zip(*lists[key], strict=True))
            self.lists.append((units, impacts, [max(impacts[k:k + s.block]) for k in range(0, len(units), s.block)]))
        self.top = np.array([max(x[2]) for x in self.lists] + [0.0])

    def terms(self, words: list[bytes]) -> np.ndarray:
        """Per word pair its term, or the one past the last if no unit has it."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        out = np.full(max(0, len(ids) - 1), len(self.pairs))
        known = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(known) and len(self.pairs):
            keys = ids[known] * self.size + ids[known + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = self.pairs[at] == keys
            out[known[hit]] = at[hit]
        return out

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every unit whose score reaches ``min_score``."""
        need, out = self.search.min_score - 1e-9, []
        cursors = [Postings(*self.lists[t], self.search.block) for t in terms]
        while True:
            cursors = [c for c in cursors if c.at < len(c.units)]
            cursors.sort(key=lambda c: c.units[c.at])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c.top
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                return out
            unit = cursors[pivot].units[cursors[pivot].at]
            while pivot + 1 < len(cursors) and cursors[pivot + 1].units[cursors[pivot + 1].at] == unit:
                pivot += 1
            bound, skip = 0.0, math.inf
            for c in cursors[:pivot + 1]:  # the blocks that hold the pivot, without opening them
                b = c.at // c.block
                while (end := min((b + 1) * c.block, len(c.units))) < len(c.units) and c.units[end - 1] < unit:
                    b += 1
                if c.units[end - 1] >= unit:
                    bound += c.block_max[b]
                    skip = min(skip, c.units[end - 1] + 1)
            if pivot + 1 < len(cursors):
                skip = min(skip, cursors[pivot + 1].units[cursors[pivot + 1].at])
            if bound < need:
                to = max(skip, unit + 1) if skip < math.inf else unit + 1
                for c in cursors[:pivot + 1]:
                    c.next_from(to)
                continue
            score = 0.0
            for c in cursors[:pivot + 1]:
                c.next_from(unit)
                if c.at < len(c.units) and c.units[c.at] == unit:
                    score += c.impacts[c.at]
                    c.at += 1
            if score >= need:
                out.append((unit, score))

    def leaks(self, text: str) -> list[tuple[int | None, float, float, float, int]]:
        """(item_id, best score, question overlap, answer overlap, passages) of a
        document: per item_id those of its best leaking text."""
        s = self.search
        words = words_of(text)
        terms = self.terms(words)
        bounds = np.r_[0.0, np.cumsum(self.top[terms])]
        half = s.passage_words // 2
        starts = np.arange(0, max(1, len(words) - half), half)
        ends = np.minimum(starts + s.passage_words - 1, len(terms))
        found: dict[int, list] = {}
        for k in np.flatnonzero(bounds[ends] - bounds[np.minimum(starts, len(terms))] >= s.min_score - 1e-6):
            own = np.unique(terms[starts[k]:ends[k]])
            own = own[own < len(self.pairs)]
            if self.top[own].sum() >= s.min_score - 1e-6:
                best: dict[int, float] = {}
                for unit, score in self.retrieve(own.tolist()):
                    item = self.owner[unit]
                    best[item] = max(score, best.get(item, 0.0))
                for item, score in best.items():
                    f = found.setdefault(item, [0.0, 0])
                    f[0], f[1] = max(f[0], score), f[1] + 1
        if not found:
            return []
        have, out = triples(words), {}
        if len(words) > 3:
            short = {t for p in (self.parts[i] for i in found) for part in p for t in part if len(t) < 3}
            have |= {t for n in {len(t) for t in short} for t in zip(*(words[j:] for j in range(n)))}
        for item, (score, n) in found.items():
            q, a = (len(part & have) / len(part) if part else 1.0 for part in self.parts[item])
            if q >= s.min_overlap and a >= s.min_overlap:
                for item_id in self.ids[item]:
                    out[item_id] = max((score, q, a, n), out.get(item_id, (0.0, 0.0, 0.0, 0)))
        return [(i, *out[i]) for i in sorted(out, key=lambda i: (i is not None, i or 0))]


def indexes(items: DataFrame, s: Search) -> Iterator:
    """Broadcast indexes, each of texts with ``index_chars`` characters or about so."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // s.index_chars)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text")
        yield items.sparkSession.sparkContext.broadcast(Index(((r["item_id"], r["text"]) for r in part.collect()), s))


def find_leaks(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """One row per document and item_id that it leaks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = [rows.mapInArrow(_finder(shared), f"{SCHEMA}, text_sha string") for shared in indexes(items, search)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    if not found:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    if len(found) == 1:
        return found[0].select(*names)
    # an item_id's texts may lie in several passes: each pass gives a row for every repeat of a document
    best, key = F.struct(*names[2:]), ["doc_id", "text_sha", "item_id"]
    out = None
    for f in found:
        own = f.groupBy(*key, best.alias("best")).agg(F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return (out.groupBy(*key).agg(F.max("best").alias("best"), F.max("n").alias("n"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
            .select("doc_id", "item_id", "best.*"))


def _finder(shared):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in SCHEMA.split(", ")]
    names, kinds = [*names, "text_sha"], [*kinds, pa.string()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i.as_py(), *x, hashlib.sha256(t.as_py().encode()).hexdigest())
                    for i, t in zip(b.column("doc_id"), b.column("text"), strict=True)
                    for x in shared.value.leaks(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return find


def drop_leaks(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """The documents (all columns) that leak no item."""
    for shared in indexes(items, search):
        docs = docs.mapInArrow(_dropper(shared), docs.schema)
    return docs


def _dropper(shared):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not shared.value.leaks(t.as_py() or "") for t in b.column("text")], pa.bool_()))

    return drop
