"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte of a document goes if it lies in a string of ``LENGTH`` bytes that also
starts in a document with a smaller doc_id.  All are judged on the input.

*Which suffixes.*  Every ``LENGTH``-byte string holds ``REACH`` grams of
``GRAM`` bytes; its anchor is the gram of least hash, the leftmost of equals,
so equal strings have their anchors at the same place.  The strings of a
document that share an anchor start at consecutive positions, and one suffix,
from the anchor on, with the few bytes before it, stands for all of them.

1. *Sorted runs.*  Each task sorts the suffixes of about ``run_bytes`` of text
   by bucket (hash of the anchor gram) and bytes.  Entries that agree in all
   bytes are one, with the list of their places, so copies in a run are sent
   once.  A run's part for a bucket is front-coded (bytes shared with the entry
   before, then the rest), compressed, and sent.
2. *Merge.*  The runs of a bucket meet in a loser tree that keeps for each
   loser how many bytes it shares with the winner that beat it: a longer known
   prefix decides at once, and equal ones are compared only from there on.
3. *Covered strings.*  In merged order shared lengths tell, for each distance
   from the anchor, which suffixes agree on the bytes after it; with the bytes
   before it they give the classes of equal strings, and each class its least
   doc_id.  What lies in a document with a larger one is covered.
4. The covered ranges go back to their documents, which are then cut.

Defined results: null and empty texts have no bytes; a null doc_id is neither
smaller nor larger than another, so such rows keep and remove nothing; rows
with equal doc_id do not remove bytes from each other, whether their texts are
equal or not; an empty table gives no rows; further columns are ignored; texts
of any length are read whole (one text is held by one task).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1
U64 = np.uint64
POSITION_BITS = 26
RIGHT, LEFT = 56, 40  # widths of the padded matrices, in bytes
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


@dataclass(frozen=True)
class Sizes:
    """Bytes of text per sorted run, per bucket of suffixes, and per group of documents at the end."""

    run_bytes: int = 8_000_000
    hash_bytes: int = 1_500_000
    bucket_bytes: int = 3_000_000
    group_bytes: int = 8_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(29))


def anchors(buf: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
    """Of documents that lie one after another in ``buf``: per anchor its
    document, position, first and last string start, and hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),)
    if len(buf) < LENGTH:
        return none
    h, factor, span = buf.astype(U64) + U64(1), 0xD6E8FEB86659FD93, 1
    while span < GRAM:
        h = h[:-span] + U64(factor) * h[span:]
        factor, span = factor * factor % 2**64, 2 * span
    h = mix(h)
    low = U64((1 << POSITION_BITS) - 1)
    best, span = (h & ~low) | np.arange(len(h), dtype=U64), 1
    while 2 * span <= REACH:
        best, span = np.minimum(best[:-span], best[span:]), 2 * span
    if span < REACH:
        best = np.minimum(best[:span - REACH], best[REACH - span:])
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[:len(best)]
    starts = np.flatnonzero(np.arange(LENGTH, len(best) + LENGTH) <= ends[doc])
    if not len(starts):
        return none
    at, own = (best[starts] & low).astype(np.int64), doc[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    return own[new].astype(np.int64), at[new], starts[new], starts[last], h[at[new]]


def planes(a: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well."""
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(data: memoryview, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def encode_run(buf: np.ndarray, records: tuple, doc_id: np.ndarray, part: np.ndarray, base: np.ndarray,
               n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """The run's sorted, front-coded parts: (bucket, bytes).

    ``buf`` has LEFT bytes before the texts and RIGHT after them; ``base`` is
    where each document starts in it."""
    doc, at, first, last, h = records
    n = len(at)
    n_left, n_right = at - first, last + LENGTH - at
    right = np.zeros((n, RIGHT), np.uint8)
    right[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[at]
    right += 1  # no byte of UTF-8 is 255, so 0 is free for "after the end"
    right[np.arange(RIGHT) >= n_right[:, None]] = 0
    left = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, LEFT)[at - LEFT][:, ::-1])
    left += 1
    left[np.arange(LEFT) >= n_left[:, None]] = 0
    columns = [c.astype(U64) for c in (*right.view(">u8").T, *left.view(">u8").T)]
    bucket = (mix(h + U64(7)) % U64(n_buckets)).astype(np.int64)
    order = np.lexsort((columns[0], bucket))
    b, c = bucket[order], columns[0][order]
    same = np.r_[False, (b[1:] == b[:-1]) & (c[1:] == c[:-1])]
    tied = np.flatnonzero(same | np.r_[same[1:], False])
    if len(tied):
        sub, group = order[tied], np.cumsum(~same)[tied]
        order[tied] = sub[np.lexsort([*(x[sub] for x in reversed(columns[1:])), group])]
    bucket, right, left = bucket[order], right[order], left[order]
    equal = right[1:] == right[:-1]
    shared = np.where(equal.all(1), RIGHT, equal.argmin(1))
    new = np.r_[True, (shared < RIGHT) | (bucket[1:] != bucket[:-1]) | (left[1:] != left[:-1]).any(1)]
    entry = np.flatnonzero(new)
    counts = np.diff(np.r_[entry, n])
    shared = np.r_[0, shared][entry]
    n_right, n_left = n_right[order][entry], n_left[order][entry]
    bucket, right, left = bucket[entry], right[entry], left[entry]
    shared = np.minimum(shared, np.minimum(n_right, np.r_[0, n_right[:-1]]))
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    shared[cuts] = 0
    place = order  # records in entry order
    where = at[place] - base[doc[place]]
    ids, parts = doc_id[doc[place]], part[doc[place]]
    post_end = np.cumsum(counts)
    packer = zstandard.ZstdCompressor(level=3)  # a few per cent less on disk than level 1
    cols = np.arange(RIGHT)
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(entry)], strict=True):
        lo, hi = int(post_end[a] - counts[a]), int(post_end[z - 1])
        r, s = right[a:z], shared[a:z]
        data = b"".join((
            np.array([z - a, hi - lo], "<i8").tobytes(), s.astype(np.uint8).tobytes(), n_right[a:z].astype(np.uint8).tobytes(),
            n_left[a:z].astype(np.uint8).tobytes(), planes(counts[a:z].astype("<u4")), planes(ids[lo:hi].astype("<i8")),
            planes(parts[lo:hi].astype("<i8")), planes(where[lo:hi].astype("<i8")),
            r[(cols >= s[:, None]) & (cols < n_right[a:z, None])].tobytes(), left[a:z][left[a:z] > 0].tobytes()))
        yield int(bucket[a]), packer.compress(data)


def decode_run(data: bytes) -> dict:
    """A part of a run: suffix bytes (front-coding undone) and its arrays."""
    data = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    at = 16
    shared, n_right, n_left = (np.frombuffer(data, np.uint8, n, at + k * n) for k in range(3))
    at += 3 * n
    counts = from_planes(data[at:], n, "<u4").astype(np.int64)
    at += 4 * n
    ids, parts, where = (from_planes(data[at + 8 * m * k:], m, "<i8") for k in range(3))
    at += 24 * m
    ends = at + np.cumsum(n_right.astype(np.int64) - shared)
    keys, key, start, raw = [], b"", at, bytes(data)
    for s, e in zip(shared.tolist(), ends.tolist(), strict=True):
        key = key[:s] + raw[start:e]
        keys.append(key)
        start = e
    left = np.zeros((n, LEFT), np.uint8)
    left[np.arange(LEFT) < n_left[:, None]] = np.frombuffer(data, np.uint8, offset=int(ends[-1]) if n else at)
    return {"keys": keys, "shared": shared.tolist(), "n_right": n_right.astype(np.int64), "left": left,
            "n_left": n_left.astype(np.int64), "counts": counts, "ids": ids, "parts": parts, "where": where}


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs (keys, bytes shared with the key before) with a loser
    tree: the source run of each output, and the bytes it shares with the
    output before.  ``known[r]`` is what run r's key shares with the last
    winner on its path; -1 marks a run at its end."""
    k = len(runs)
    source, lengths = [], []
    if k == 1:
        return [0] * len(runs[0][0]), list(runs[0][1])
    keys, shares = [r[0] for r in runs], [r[1] for r in runs]
    sizes = [len(x) for x in keys]
    at, known = [0] * k, [0 if n else -1 for n in sizes]
    current = [x[0] if x else b"" for x in keys]

    def duel(a: int, b: int) -> int:
        """The winner of two keys that share the same known prefix; the loser's
        known length grows to where they part."""
        x, y, h = current[a], current[b], known[a]
        if x == y:
            known[b] = len(x)
            return a
        m = min(len(x), len(y))
        while h + 8 <= m and x[h:h + 8] == y[h:h + 8]:
            h += 8
        while h < m and x[h] == y[h]:
            h += 1
        if x < y:
            known[b] = h
            return a
        known[a] = h
        return b

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if known[a] == known[b] >= 0:
            w = duel(a, b)
        else:
            w = a if known[a] > known[b] else b
        losers[node] = b if w == a else a
        return w

    losers = [0] * k
    w = play(1)
    while known[w] >= 0:
        source.append(w)
        lengths.append(known[w])
        i = at[w] = at[w] + 1
        if i < sizes[w]:
            current[w] = keys[w][i]
            mine = known[w] = shares[w][i]
        else:
            mine = known[w] = -1
        node = (w + k) >> 1
        while node:
            other = losers[node]
            theirs = known[other]
            if theirs > mine:
                losers[node], w, mine = w, other, theirs
            elif theirs == mine and mine >= 0:
                v = duel(w, other)
                if v != w:
                    losers[node], w = w, other
                    mine = known[w]
            node >>= 1
    return source, lengths


def covered(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc_id, part, start, end) ranges that one bucket's runs show as covered."""
    runs = [decode_run(b) for b in blobs]
    source, lengths = merge([(r["keys"], r["shared"]) for r in runs])
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    source = np.array(source)
    # entries of all runs, in merged order
    sizes = np.array([len(r["keys"]) for r in runs])
    to = np.argsort(source, kind="stable")  # merged places of run 0's entries, then of run 1's
    take = np.empty(len(source), np.int64)
    take[to] = np.arange(len(source))
    n_right, n_left, counts, left = (np.concatenate([r[c] for r in runs])[take] for c in ("n_right", "n_left", "counts", "left"))
    ids, parts, where = (np.concatenate([r[c] for r in runs]) for c in ("ids", "parts", "where"))
    raw_counts = np.concatenate([r["counts"] for r in runs])
    begin = (np.cumsum(raw_counts) - raw_counts)[take]
    del runs, sizes
    shared = np.minimum(np.array(lengths), np.minimum(n_right, np.r_[0, n_right[:-1]]))
    # clusters: neighbours that share a gram; alone, an entry matters only if it has several places
    chain = np.cumsum(shared < GRAM)
    busy = np.bincount(chain, weights=counts)[chain] > 1
    rows = np.flatnonzero(busy)
    if not len(rows):
        return none
    n_right, n_left, counts, left, begin, shared = (x[rows] for x in (n_right, n_left, counts, left, begin, shared))
    fresh = np.r_[True, np.diff(chain[rows]) != 0]
    shared = np.where(fresh, 0, shared)
    owner = np.repeat(np.arange(len(rows)), counts)
    ends = np.cumsum(counts)
    posts = np.repeat(begin - ends + counts, counts) + np.arange(ends[-1])
    ids, parts, where = ids[posts], parts[posts], where[posts]
    least = np.minimum.reduceat(ids, ends - counts)
    # per distance from the anchor: classes of equal strings and their least doc_id
    hit = np.zeros((len(ids), REACH), bool)
    hashed = np.zeros(len(rows), U64)
    for d in range(REACH):
        if d:
            hashed = mix(hashed * U64(0xD6E8FEB86659FD93) + left[:, d - 1].astype(U64) + U64(d))
        have = np.flatnonzero((n_left >= d) & (n_right >= LENGTH - d))
        if not len(have):
            continue
        klass = np.cumsum(shared < LENGTH - d)[have]
        order = np.lexsort((hashed[have], klass))
        o = have[order]
        new = np.r_[True, (klass[order][1:] != klass[order][:-1]) | (hashed[o][1:] != hashed[o][:-1])]
        first = np.minimum.reduceat(least[o], np.flatnonzero(new))
        low = np.full(len(rows), np.iinfo(np.int64).max)
        low[o] = first[np.cumsum(new) - 1]
        hit[:, d] = ids > low[owner]
    any_ = np.flatnonzero(hit.any(1))
    if not len(any_):
        return none
    edge = np.diff(np.pad(hit[any_].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    p = any_[row]
    return ids[p], parts[p], where[p] - hi, where[p] - lo + LENGTH


def group_number(doc_id, groups: int):
    """The group of a document (doc_id ^ part); for columns and for arrays alike."""
    if isinstance(doc_id, Column):
        return F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 7)).bitwiseXOR(F.shiftright(doc_id, 19)), F.lit(groups).cast("long"))
    return (doc_id ^ (doc_id >> 7) ^ (doc_id >> 19)) % groups


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text): ``part`` tells apart the texts of a repeated doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").limit(1).count()
    return rows.select("doc_id", (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("part"), "text")


def sorted_runs(rows: DataFrame, n_buckets: int, s: Sizes) -> DataFrame:
    """(bucket, blob) of all documents with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, parts, size = [], [], [], 0
        for b in batches:
            for i, part, text in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("text"), strict=True):
                data = text.as_buffer()
                if len(data) < LENGTH:
                    continue
                texts.append(np.frombuffer(data, np.uint8).copy())
                ids.append(i)
                parts.append(part)
                size += len(data)
                if size >= s.run_bytes:
                    yield from flush(texts, ids, parts)
                    texts, ids, parts, size = [], [], [], 0
        if texts:
            yield from flush(texts, ids, parts)

    def flush(texts, ids, parts) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes + LEFT
        buf = np.concatenate([np.zeros(LEFT, np.uint8), *texts, np.zeros(RIGHT, np.uint8)])
        found, k = [], 0
        while k < len(texts):  # hash some documents at a time
            z = max(k + 1, int(np.searchsorted(base + sizes, base[k] + s.hash_bytes)))
            found += [(d + k, *(x + p for x in (a, f, g)), h)
                      for p, d, a, f, g, h in strips(buf, int(base[k]), sizes[k:z])]
            k = z
        records = tuple(np.concatenate(x) for x in zip(*found, strict=True))
        if len(records[0]):
            out = encode_run(buf, records, np.array(ids, np.int64), np.array(parts, np.int64), base, n_buckets)
            for row in out:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([row[0]], pa.int64()), "blob": pa.array([row[1]], pa.binary())})

    def strips(buf, start: int, sizes: np.ndarray):
        """Anchors of consecutive documents; a long document in strips that
        overlap by a string less one byte (its anchors at seams come twice,
        each for its own string starts)."""
        total, most = int(sizes.sum()), 1 << (POSITION_BITS - 2)
        if len(sizes) > 1 or total <= most:
            yield (start, *anchors(buf[start:start + total], np.cumsum(sizes), sizes))
            return
        for p in range(0, total - LENGTH + 1, most):
            n = min(most + LENGTH - 1, total - p)
            yield (start + p, *anchors(buf[start + p:start + p + n], np.array([n]), np.array([n])))

    return rows.where("doc_id IS NOT NULL").mapInArrow(run, "bucket long, blob binary")


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def ranges(runs: DataFrame, groups: int) -> DataFrame:
    """(grp, blob): the covered ranges found in all buckets, packed by document group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, held, n = None, [], [], 0
        for key, blob in by_key(batches):
            if key != bucket and blobs:
                held.append(covered(blobs))
                n += len(held[-1][0])
                blobs = []
                if n > 1_000_000:
                    yield from flush(held)
                    held, n = [], 0
            bucket = key
            blobs.append(blob)
        if blobs:
            held.append(covered(blobs))
        if held:
            yield from flush(held)

    def flush(held) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        group = group_number(cols[0] ^ cols[1], groups)
        order = np.argsort(group, kind="stable")
        group, cols = group[order], [c[order] for c in cols]
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        packer = zstandard.ZstdCompressor(level=1)
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)], strict=True):
            data = np.array([z - a], "<i8").tobytes() + b"".join(planes(c[a:z].astype("<i8")) for c in cols)
            yield pa.RecordBatch.from_pydict({"grp": pa.array([int(group[a])], pa.int64()),
                                              "blob": pa.array([packer.compress(data)], pa.binary())})

    dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "grp long, blob binary")


def unpack_ranges(blobs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The ranges (starts, ends) of each (doc_id, part), sorted by start."""
    cols: list[list] = [[], [], [], []]
    for b in blobs:
        data = memoryview(zstandard.ZstdDecompressor().decompress(b))
        n = int(np.frombuffer(data, "<i8", 1)[0])
        for k in range(4):
            cols[k].append(from_planes(data[8 + 8 * n * k:], n, "<i8"))
    if not blobs:
        return {}
    ids, parts, start, end = map(np.concatenate, cols)
    order = np.lexsort((start, parts, ids))
    ids, parts, start, end = (x[order] for x in (ids, parts, start, end))
    cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])])
    return {(int(ids[a]), int(parts[a])): (start[a:z], end[a:z])
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True)}


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges joined where they overlap or touch."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[new], reach[np.r_[new[1:], len(start)] - 1]


def cut(data: bytes, found: tuple | None) -> tuple:
    """(n_bytes, n_removed, n_spans, kept_sha256, spans) of one document."""
    if found is None:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), []
    start, end = union(*found)
    digest, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        digest.update(data[at:a])
        at = b
    digest.update(data[at:])
    return (len(data), int((end - start).sum()), len(start), digest.hexdigest(),
            np.stack([start, end], 1).ravel().tolist())


def packed(rows: DataFrame) -> DataFrame:
    """(grp, doc_id, part, text) with each text's bytes compressed (``data``): they are only moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data = pa.array([packer.compress(t.as_buffer()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "doc_id", "part")), data], ["grp", "doc_id", "part", "data"])

    return rows.mapInArrow(run, "grp long, doc_id long, part long, data binary")


def dedup(docs: DataFrame, s: Sizes = Sizes()) -> DataFrame:
    """The columns of SCHEMA for every row; ``spans`` are the removed byte
    ranges: start, end, start, end, ..."""
    rows = identified(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // s.group_bytes))
    runs = sorted_runs(rows, max(1, -(-total // s.bucket_bytes)), s)
    found = written(ranges(runs, groups), "ranges")
    null = F.lit(None)
    own = group_number(F.col("doc_id").bitwiseXOR(F.col("part")), groups)
    own = F.coalesce(own, F.pmod(F.xxhash64("text"), F.lit(groups)))  # rows without an id go anywhere
    texts = packed(rows.select(own.alias("grp"), "doc_id", "part", "text")).select(
        "grp", F.lit(1).alias("kind"), null.cast("binary").alias("blob"), "doc_id", "part", "data")
    blobs = found.select("grp", F.lit(0).alias("kind"), "blob", null.cast("long").alias("doc_id"),
                         null.cast("long").alias("part"), null.cast("binary").alias("data"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, known = None, [], {}
        packer = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for grp, kind, blob, doc_id, part, data in by_key([b]):
                if grp != group:
                    group, held, known = grp, [], None
                if kind == 0:
                    held.append(blob)
                    continue
                if known is None:
                    known, held = unpack_ranges(held), []
                out.append((doc_id, *cut(packer.decompress(data), known.get((doc_id, part)))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return blobs.unionByName(texts).repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(run, SCHEMA)
