"""Similarity join on word n-grams by chosen paths.

Texts are sets of shingles (five words in a row); two texts are linked if the
Jaccard similarity of their sets is 0.8 or more.

1. Every text gives the digest of its set and a sketch of ``T`` minhash
   tokens.  Texts with equal sets are one set from here on (``copies``).
2. *Chosen paths*: a node of the tree (a path) chooses a few sketch positions
   at random, on average one over the threshold; a set goes to the child of
   each chosen position, named by the set's token there, so sets that share
   the token meet.  Nodes of one set end; nodes of at most ``small`` sets are
   leaves; larger ones split again, up to ``depth`` times.  Independent runs
   repeat until a pair at the threshold meets with probability ``recall``.
3. In a leaf all sketches are compared by brute force (a leaf that is still
   large at full depth joins its sets without comparison), which gives
   candidate groups: components of the pairs that look similar enough.
4. Inside a candidate group all pairs are counted exactly on whole shingle
   sets, in blocks of at most ``block`` by ``block`` sets per task, so neither
   a hot group nor its pairs ever meet in one task; only counts of links and a
   spanning forest of them leave a task, never pairs.
5. Classes are the components of the exact links.

Defined results: words are runs other than blank and ASCII white space, as
written; a text of one to four words has one shingle, all its words; null and
empty texts have none, are their own class and have no links; rows with equal
sets are linked, rows that repeat included; a null doc_id is never a class id
unless the class has no other; an empty table gives no rows; further columns
are ignored by ``link`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import text_of, written
from .components import components

WIDTH = 5
T = 128
U64 = np.uint64


@dataclass(frozen=True)
class Join:
    #: Similarity of 4/5 or more, as a fraction so that it is exact.
    over: tuple[int, int] = (4, 5)
    recall: float = 0.9999
    depth: int = 3
    small: int = 100
    block: int = 512
    slack: float = 0.18
    seed: int = 11

    @property
    def threshold(self) -> float:
        return self.over[0] / self.over[1]

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold has met in a leaf at full
        depth with probability ``recall``."""
        j, more = self.threshold, 1 / self.threshold - 1
        meet = 1.0
        for _ in range(self.depth):
            meet = (1 - more) * j * meet + more * (1 - (1 - j * meet) ** 2)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - meet))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Sets of shingle hashes; keeps the hashes of up to ``most`` words."""

    def __init__(self, most: int = 400_000):
        self.known, self.most = {}, most

    def hashes(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, sorted."""
        words = text.encode("utf-8").split()
        if not words:
            return np.zeros(0, U64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), U64, len(words))
        n = min(WIDTH, len(h))
        out = np.full(len(h) - n + 1, U64(n))
        for k in range(n):
            out = out * U64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
        return np.unique(mix(out))


def set_id(shingles: np.ndarray) -> bytes | None:
    """A digest of the whole set: equal for equal sets only."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def minhash(shingles: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, T).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 2**63, T).astype(U64)
    out = np.full(T, 2**32 - 1, np.uint32)
    for k in range(0, len(shingles), 2048):
        np.minimum(out, ((shingles[k:k + 2048, None] * a + b) >> U64(32)).min(0).astype(np.uint32), out=out)
    return out


def sketches(docs: DataFrame, j: Join) -> DataFrame:
    """(doc_id, sid, sketch): the set's digest and its ``T`` minhash tokens; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            sets = [shingler.hashes(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([set_id(s) for s in sets], pa.binary()),
                 pa.array([minhash(s, j.seed).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "sid", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")) \
        .mapInArrow(run, "doc_id long, sid binary, sketch binary")


def chosen(paths: np.ndarray, j: Join) -> list[tuple[np.ndarray, np.ndarray]]:
    """The positions that nodes choose: one, and with probability 1/threshold - 1
    another; as (which nodes, position of each)."""
    h = mix(paths ^ U64(j.seed))
    more = (mix(h + U64(2)) >> U64(11)).astype(float) * 2.0**-53 < 1 / j.threshold - 1
    first = (mix(h + U64(1)) % U64(T)).astype(np.int64)
    other = (first + 1 + (mix(h + U64(3)) % U64(T - 1)).astype(np.int64)) % T
    return [(np.arange(len(paths)), first), (np.flatnonzero(more), other[more])]


def children(rows: DataFrame, j: Join) -> DataFrame:
    """(path, sid) of the children to which the sets of rows (path, sid, sketch) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_numpy().astype(np.int64).view(U64)
            tokens = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u4").reshape(-1, T)
            for rows_, at in chosen(paths, j):
                to = mix(mix(paths[rows_] + at.astype(U64)) ^ tokens[rows_, at].astype(U64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.view(np.int64)), b.column("sid").take(pa.array(rows_))], ["path", "sid"])

    return rows.select("path", "sid", "sketch").mapInArrow(run, "path long, sid binary")


def grouped(keys: int, work: Callable[[tuple, list[tuple]], list[tuple]], names: list[str], types: list):
    """A task function over rows sorted by their first ``keys`` columns: calls
    ``work`` with each key and its rows, which may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:keys] != key:
                    if held:
                        out += work(key, held)
                    key, held = row[:keys], []
                    if len(out) >= 5000:
                        yield pack(out)
                        out = []
                held.append(row[keys:])
        if held:
            out += work(key, held)
        if out:
            yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(linked[u] & left)
            left[new] = False
            out += [(u, int(v)) for v in new]
            queue += new.tolist()
    return out


def alike(members: list[tuple], j: Join) -> list[tuple]:
    """Spanning pairs of sets of a leaf whose sketches agree well enough."""
    s = np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(len(members), T)
    same = (s[:, None, :] == s[None, :, :]).sum(2) / T
    linked = (same - 1 / 256) / (1 - 1 / 256) >= j.threshold - j.slack
    return [(members[x][0], members[y][0]) for x, y in forest(linked)]


def candidates(sets: DataFrame, j: Join) -> DataFrame:
    """Edges (a, b) between sets (sid, sketch) that may be similar."""
    roots = F.array(*(F.lit(r).cast("long") for r in range(1, j.runs + 1)))
    nodes = written(children(sets.select("sid", "sketch", F.explode(roots).alias("path")), j), "paths")
    # one byte of each token is enough to compare
    short = F.unhex(F.regexp_replace(F.hex("sketch"), "(..)......", "$1"))
    edges = None
    for level in range(1, j.depth + 1):
        # written, so that the join can split a path that very many sets take
        sizes = written(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("least"))
                        .where("n > 1"), "sizes")
        alive = nodes.join(sizes, "path")
        leaves = alive.where(F.col("n") <= j.small).select("path", "sid").join(sets, "sid") \
            .select("path", "sid", short.alias("short"))
        found = leaves.repartition("path").sortWithinPartitions("path").mapInArrow(
            grouped(1, lambda _, rows: alike(rows, j), ["a", "b"], [pa.binary(), pa.binary()]), "a binary, b binary").distinct()
        edges = found if edges is None else edges.unionByName(found)
        large = alive.where(F.col("n") > j.small)
        if level == j.depth:
            edges = edges.unionByName(large.where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b")))
        else:
            nodes = written(children(large.select("path", "sid").join(sets, "sid"), j), "paths")
    return edges


def exact_counts(key: tuple, members: list[tuple], j: Join) -> list[tuple]:
    """Links among the sets of a block (or between two blocks): rows (sid,
    links weighted by copies, null) and a spanning forest (sid, 0, other)."""
    _, lo, hi = key
    sets = [np.frombuffer(m[3], "<u8") for m in members]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], column[several]
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        step = max(1, 8_000_000 // len(sets))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1, step))
        for k, a in enumerate(cuts):
            z = cuts[k + 1] if k + 1 < len(cuts) else len(column)
            m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - k * step)), np.float32)
            m[owner[a:z], column[a:z] - k * step] = 1
            both += m @ m.T
    over, under = j.over
    total = sizes[:, None] + sizes[None, :]
    linked = (over + under) * both.astype(np.int64) >= over * total
    np.fill_diagonal(linked, False)
    if lo != hi:
        block = np.array([m[1] for m in members])
        linked &= block[:, None] != block[None, :]
    copies = np.array([m[2] for m in members])
    links = linked @ copies
    return [(members[k][0], int(links[k]), None) for k in np.flatnonzero(links)] + \
        [(members[x][0], 0, members[y][0]) for x, y in forest(linked)]


def with_set_id(docs: DataFrame, name: str = "sid") -> DataFrame:
    """``docs``, all columns, and the digest of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            ids = [set_id(shingler.hashes(t.as_py() or "")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, sid, ...; doc_id may be null) with the shingle sets
    read from the texts of those rows, one row per sid."""
    names = [c for c in wanted.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            sets = [shingler.hashes(t.as_py()).astype("<u8").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sets, pa.binary())],
                                             [*names, "shingles"])

    rows = with_set_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["sid"] == wanted["sid"])
    found = rows.join(wanted, same).select(*(wanted[n] for n in names), "text")
    schema = StructType([*(wanted.schema[n] for n in names), StructField("shingles", BinaryType())])
    return found.mapInArrow(run, schema).dropDuplicates(["sid"])


def link(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, sid, root) for every row of
    ``docs``; sid and root (of the class) are digests, null for empty sets."""
    sketched = written(sketches(docs, j), "sketches")
    filled = sketched.where("sid IS NOT NULL")
    sets = written(filled.groupBy("sid").agg(F.first("sketch").alias("sketch")), "sets")
    counts = filled.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    groups = written(components(candidates(sets, j), "candidates"), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / j.block).cast("int")
    members = groups.join(sizes, "root").select(
        F.col("node").alias("sid"), "root", blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")).join(counts, "sid")
    found = shingle_sets(docs, members).select(
        "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", "sid", "copies", "shingles")
    pairs = found.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "sid",
                         "own", "copies", "shingles")
    counted = written(
        pairs.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(
            grouped(3, lambda key, rows: exact_counts(key, rows, j), ["sid", "links", "other"],
                    [pa.binary(), pa.int64(), pa.binary()]), "sid binary, links long, other binary"), "links")
    roots = components(counted.where("other IS NOT NULL").select(F.col("sid").alias("a"), F.col("other").alias("b")), "classes")
    links = counted.where("other IS NULL").groupBy("sid").agg(F.sum("links").alias("links"))
    info = counts.join(links, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sid").alias("root"))
    info = written(info, "set-info")
    least = info.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    info = info.join(least, "root").select("sid", "class_id", "copies", "links", "root")
    return sketched.select("doc_id", "sid").join(info, "sid", "left").select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), "sid", "root")


def one_of_each(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """The rows of ``docs``, all columns, one of each class: a row with the
    least doc_id (of rows with that id and an equal set, one).  Rows without
    shingles all stay."""
    sid = "__set_id__"
    while sid in docs.columns:
        sid += "_"

    marked = with_set_id(docs, sid)
    classes = link(docs, j).where("sid IS NOT NULL")
    keep = (classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root", "class_id")
            .agg(F.min("sid").alias(sid)).select(F.col("class_id").alias("__keep__"), sid))
    same = marked["doc_id"].eqNullSafe(keep["__keep__"]) & (marked[sid] == keep[sid])
    kept = marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", sid])
    return kept.unionByName(marked.where(F.col(sid).isNull())).drop(sid)
