"""Phrase collocation mining by SON partitioning.

Texts are lower-cased (A to Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
those into words ``[^\\x20\\x09]+``.  Per language, phrases of two or three words
that occur ``support`` times or more inside pieces are scored by how often they
occur against what their parts do.

1. **Shards.**  Documents are dealt to ``shards`` logical shards by the hash of
   their id.  A shard that holds the share w of a language's words mines it
   completely at local support ``ceil(w * support)``: a phrase that is frequent
   globally is so in at least one shard.  The support is a fixed count, so with
   ten shards or more the local support would be one and nothing would be
   pruned; a shard is therefore not a task but a share of the table that many
   tasks mine together, by an aggregate with map-side sums over 64-bit hashes.
   It is mined level by level: three words are counted only where both pairs
   in them are candidates.
2. **Union.**  What some shard reports is a candidate if its counts there and
   one less than the local support in every other shard can reach the support.
   Candidates' hashes are set in a bitmap of ``2 ** bits`` bits (a fixed size,
   which is what bounds the broadcast).  A collision, or a bitmap that fills
   up, only adds candidates.
3. **Exact counts.**  A last pass counts words and all candidates by their
   strings, over all documents; what has less than the support goes.

Scores are exact decimals.  Nothing is capped but the report of the first
``top`` phrases of each language.

Defined results: a null language is ``und``, a null text is empty; repeated
rows count each; rows without an id share a shard (no result depends on the
shards); texts of any length are read whole, several of them in a block; an empty table gives no rows; only doc_id, lang and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.plans.strategy import grouped_prefix_sum

from .common import written

BREAKS = b".,;:!?\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
#: Breaks become full stops, tabs blanks, capitals small letters.
FOLDED = bytes.maketrans(BREAKS + b"\t" + CAPITALS, b"." * len(BREAKS) + b" " + CAPITALS.lower())
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"


@dataclass(frozen=True)
class Mining:
    """Support, logical shards, bits of the bitmap, bytes of a block, and the report."""

    support: int = 10
    shards: int = 3
    bits: int = 26
    block_bytes: int = 10_000_000
    containment: int = 50  # per cent of a phrase's occurrences inside one longer candidate
    top: int = 2000


#: Fixed odd multipliers: the hashes of words, and a phrase's hash by place of its words.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LONG_WORD = 64


class Scan:
    """The words of a folded text as arrays: byte ranges, pieces and hashes."""

    def __init__(self, text: bytes) -> None:
        self.text = text
        self.bytes = np.frombuffer(text, np.uint8)
        inside = np.zeros(len(text) + 2, np.int8)
        inside[1:-1] = (self.bytes != 32) & (self.bytes != 46)
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(self.bytes == 46, dtype=np.int32)[self.starts]

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, salt: int) -> np.ndarray:
        """64-bit hashes of the words, byte by byte for all words at once; very
        long words, which would make many rounds, are hashed one by one."""
        out = np.full(len(self), salt & (1 << 64) - 1, np.uint64)
        size = self.ends - self.starts
        at = np.flatnonzero(size <= LONG_WORD)
        for k in range(int(size[at].max(initial=0))):
            at = at[size[at] > k]
            h = (out[at] ^ self.bytes[self.starts[at] + k]) * MIX[0]
            out[at] = h ^ (h >> np.uint64(29))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(self.word(i), salt & (1 << 64) - 1)
        return out

    def word(self, i: int) -> bytes:
        return self.text[self.starts[i]:self.ends[i]]

    def windows(self, width: int) -> np.ndarray:
        """Where windows of ``width`` words start that lie in one piece."""
        n = len(self) - width + 1
        if n < 1:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:n] == self.piece[width - 1:])


def phrase_hashes(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows at ``at`` from the hashes of their words."""
    out = np.full(len(at), width, np.uint64)
    for k in range(width):
        out = (out ^ (words[at + k] * MIX[k])) * MIX[0]
        out ^= out >> np.uint64(29)
    return out


def member(bitmap: np.ndarray | None, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys are set (all, without a bitmap)."""
    if bitmap is None:
        return np.ones(len(keys), bool)
    low = keys & np.uint64((1 << bits) - 1)
    return (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[tuple[str, int], Scan]]:
    """Texts by (language, its shard), in blocks of at least ``size`` bytes in all."""
    held: dict[tuple[str, int], list[bytes]] = {}
    n = 0

    def scans() -> dict[tuple[str, int], Scan]:
        return {k: Scan(b".".join(v).translate(FOLDED)) for k, v in held.items()}

    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for lang, grp, text in zip(b.column("lang").to_pylist(), b.column("grp").to_pylist(), texts, strict=True):
            own = text.as_py()
            held.setdefault((lang, grp), []).append(own)
            n += len(own)
            if n >= size:
                yield scans()
                held.clear()
                n = 0
    if held:
        yield scans()


def texts_of(docs: DataFrame, m: Mining) -> DataFrame:
    """(lang, grp, text): ``grp`` is a hash of the language with the shard in its last byte."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(m.shards))
    return docs.select(lang.alias("lang"), F.shiftleft(F.shiftright(F.xxhash64(lang), 8), 8).bitwiseOR(shard).alias("grp"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def locally_frequent(texts: DataFrame, totals: DataFrame, m: Mining, width: int, pairs=None) -> DataFrame:
    """Hashes of the candidates of ``width`` words.  With the bitmap ``pairs``,
    only windows whose pairs of words are in it are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if pairs is None else pairs.value
        for block in blocks(batches, m.block_bytes):
            for (_, grp), scan in block.items():
                words, at = scan.hashes(grp >> 8), scan.windows(width)
                if known is not None:
                    at = at[member(known, phrase_hashes(words, at, 2), m.bits)]
                    at = at[member(known, phrase_hashes(words, at + 1, 2), m.bits)]
                keys, counts = np.unique(phrase_hashes(words, at, width), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), grp)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                    ["grp", "key", "n"])

    found = texts.mapInArrow(run, "grp long, key long, n long").groupBy("grp", "key").agg(F.sum("n").alias("n"))
    reported = found.join(totals.select("grp", "local", "slack"), "grp").where("n >= local")
    most = F.sum(F.col("n") - F.col("local") + 1) + F.max("slack")
    return reported.groupBy(F.shiftright("grp", 8).alias("lang"), "key").agg(most.alias("most")) \
        .where(F.col("most") >= m.support).select("key")


def bitmap(keys: DataFrame, m: Mining):
    """A broadcast bitmap of hashes.  Its words of 64 bits are made by an
    aggregate; at most ``2 ** bits / 64`` of them come to the driver."""
    mask = (1 << m.bits) - 1
    low = F.col("key").bitwiseAND(F.lit(mask))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    rows = (keys.select(F.shiftright(low, 6).alias("word"), bit.alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << (m.bits - 6), np.uint64)
    out[np.asarray(rows["word"])] = np.asarray(rows["bit"]).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def shard_totals(texts: DataFrame, m: Mining) -> DataFrame:
    """Per (lang, shard): its words, those of the language, the local support, and
    what shards that report nothing may hide of a phrase in all."""
    own = texts.groupBy("lang", "grp").agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("words"))
    both = own.join(own.groupBy("lang").agg(F.sum("words").alias("all_words")), "lang")
    local = F.expr(f"(words * {m.support} + all_words - 1) div all_words")
    rows = both.where("words > 0").withColumn("local", F.greatest(local, F.lit(1)))
    return rows.join(rows.groupBy("lang").agg(F.sum(F.col("local") - 1).alias("slack")), "lang")


def exact_counts(texts: DataFrame, m: Mining, candidates) -> DataFrame:
    """(lang, phrase, f, width) of all words and all phrases in the bitmap
    ``candidates`` that have the support."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = candidates.value
        for block in blocks(batches, m.block_bytes):
            for (lang, grp), scan in block.items():
                words, again = scan.hashes(grp >> 8), scan.hashes(~grp)
                for width in (1, 2, 3):
                    at = scan.windows(width)
                    keys = phrase_hashes(words, at, width)
                    if width > 1:
                        keep = member(known, keys, m.bits)
                        at, keys = at[keep], keys[keep]
                    # equal phrases are neighbours in the order of their hashes; a run ends where one of
                    # two independent hashes of a word differs (parted runs are summed by their strings)
                    at = at[np.argsort(keys, kind="stable")]
                    new = np.zeros(max(len(at) - 1, 0), bool)
                    for k in range(width):
                        for h in (words, again):
                            new |= h[at[1:] + k] != h[at[:-1] + k]
                    starts = np.flatnonzero(np.append(True, new)[:len(at)])
                    counts = np.diff(np.append(starts, len(at)))
                    first = at[starts].tolist()
                    phrases = [b" ".join([scan.word(i + k) for k in range(width)]) for i in first]
                    n = len(phrases)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                         pa.array(counts.astype(np.int64)), pa.array(np.full(n, width, np.int32))],
                        ["lang", "phrase", "f", "width"])

    return (texts.mapInArrow(run, "lang string, phrase string, f long, width int")
            .groupBy("lang", "phrase", "width").agg(F.sum("f").alias("f")).where(F.col("f") >= m.support))


def cuts(counts: DataFrame) -> DataFrame:
    """Each candidate with its lowest-scoring cut: (lang, phrase, a, k, l, r, score).
    A part of a frequent phrase is as frequent at least, so ``counts`` holds all parts."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    words = F.split("phrase", " ")
    each = (counts.where("width > 1").withColumn("words", words)
            .select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
                    F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right")))
    part = counts.select(F.col("lang"), F.col("phrase"), F.col("f"))
    both = (each.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    top = F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")).cast("decimal(31,0)")
    scored = both.withColumn("top", top.cast("decimal(38,0)")).withColumn("low", (exact("l") * exact("r")).cast("decimal(38,0)"))
    return (scored.withColumn("score", F.expr("top div low"))
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.*"))


def inside_longer(counts: DataFrame, m: Mining) -> DataFrame:
    """(lang, phrase) of the pairs that occur mostly inside one longer candidate."""
    longer = counts.where("width = 3").withColumn("words", F.split("phrase", " "))
    pair = [F.array_join(F.slice("words", k, 2), " ") for k in (1, 2)]
    most = (longer.select("lang", "f", F.explode(F.array(*pair)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("f").alias("longest")))
    return (counts.where("width = 2").join(most, ["lang", "phrase"])
            .where(100 * F.col("longest") >= m.containment * F.col("f")).select("lang", "phrase"))


def candidates_of(docs: DataFrame, m: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """(all exact counts with the support, written; words of each language)."""
    texts = texts_of(docs, m)
    totals = written(shard_totals(texts, m), "totals")
    pairs = written(locally_frequent(texts, totals, m, 2), "pairs")
    first = bitmap(pairs, m)
    triples = written(locally_frequent(texts, totals, m, 3, first), "triples")
    both = bitmap(pairs.unionByName(triples), m)
    counts = written(exact_counts(texts, m, both), "counts")
    return counts, totals.select("lang", F.col("all_words").alias("n")).distinct()


def mine(docs: DataFrame, m: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``m.top`` phrases."""
    counts, totals = candidates_of(docs, m)
    kept = cuts(counts).join(inside_longer(counts, m), ["lang", "phrase"], "left_anti")
    ranked = kept.withColumns({"down": -F.col("score"), "fewer": -F.col("a"), "one": F.lit(1).cast("long")})
    # ranks as prefix sums over range partitions: no language is sorted in one task
    first = grouped_prefix_sum(ranked, ["lang"], "down", "one", "rank", tie=["fewer", "phrase"]).where(F.col("rank") <= m.top)
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
        F.col("score").cast("long").alias("score"))
