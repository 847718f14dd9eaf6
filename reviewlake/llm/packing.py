"""Packing into length buckets of least padding.

A document's tokens (with the end id) are cut into sequences of at most
``max_len``.  The histogram of sequence lengths over all documents has at most
``max_len`` rows; on it dynamic programming finds the ``n_buckets`` bucket
lengths with the least padding in total.  In each bucket sequences fill batches
of ``token_budget // bucket length`` rows: token counts alone in (doc_id, seq_no)
order, sequences with their ids in the order in which they were written, so
that no id is shuffled.  ``token_sequences`` gives the sequences with their ids
as bytes (16 bits an id where that holds them, else 32), ``place`` carries them
along to bucket, batch and slot, ``unpacked`` makes arrays of them,
``padded_batches`` has a row per batch with the ids of its slots padded to the
bucket's length.

A sequence's place in its bucket is its rank inside its partition plus the
counts of the partitions before: no task sorts or numbers a whole bucket.

Defined results: null and empty texts are one sequence of one token (the end
id); rows that repeat are packed as often as they come; null doc_id comes
first; an empty table gives no rows; further columns are ignored; long texts
give several sequences, nothing is cut off or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import text_of, written
from .tokens import END_ID, word_encoder

MAX_LEN, N_BUCKETS, TOKEN_BUDGET = 2048, 8, 65_536
BATCH_IDS = 1 << 20  # ids of an Arrow batch, about


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens) of whole texts, the end id included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for b in batches:
            n = [encoder.count(t.as_py()) + 1 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")) \
        .mapInArrow(count, "doc_id long, n_tokens long")


def sequences(counts: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, seq_no, n_tokens): documents cut at multiples of ``max_len``."""
    last = F.floor((F.col("n_tokens") - 1) / max_len)
    return counts.withColumn("seq_no", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "seq_no",
        F.least(F.lit(max_len).cast("long"), F.col("n_tokens") - F.col("seq_no") * max_len).alias("n_tokens"))


def token_sequences(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, seq_no, n_tokens, packed): the ids of whole texts, the end id
    included, cut at multiples of ``max_len``, as little-endian unsigned bytes."""
    names = ["doc_id", "seq_no", "n_tokens", "packed"]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        doc_ids, numbers, sizes, ids = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.int64()),
                                           pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n = word_encoder(tokenizer_path), [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                own = np.append(encoder.encode(text.as_py()), np.uint32(END_ID))
                for no, k in enumerate(range(0, len(own), max_len)):
                    part = own[k:k + max_len]
                    held.append((doc_id, no, len(part), part.astype("<u2" if part.max() < 1 << 16 else "<u4").tobytes()))
                    n += len(part)
                    if n >= BATCH_IDS:
                        yield batch(held)
                        held, n = [], 0
        if held:
            yield batch(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")) \
        .mapInArrow(encode, "doc_id long, seq_no long, n_tokens long, packed binary")


def unpacked(seqs: DataFrame) -> DataFrame:
    """Sequences with ``ids`` as array<int> in place of ``packed``."""
    names = [("ids" if c == "packed" else c) for c in seqs.columns]
    at = seqs.columns.index("packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, own = b.column("n_tokens").to_pylist(), []
            for n, x in zip(sizes, b.column("packed").to_pylist(), strict=True):
                own.append(np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.int32))
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*own, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([ids if k == at else c for k, c in enumerate(b.columns)], names)

    fields = [StructField("ids", ArrayType(IntegerType())) if f.name == "packed" else f for f in seqs.schema.fields]
    return seqs.mapInArrow(run, StructType(fields))


def best_buckets(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """The bucket lengths (ascending, the longest length last) that minimise
    the sum over lengths of count * (bucket length - length)."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    n = len(lengths)
    far = np.iinfo(np.int64).max // 4
    # cost[i, j]: lengths i..j-1 padded to lengths[j-1]
    cost = np.r_[0, lengths][None, :] * (rows[None, :] - rows[:, None]) - (tokens[None, :] - tokens[:, None])
    cost[np.tril_indices(n + 1)] = far
    best, back = np.full(n + 1, far), []
    best[0] = 0
    for _ in range(min(n_buckets, n)):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    out, j = [], n
    for b in reversed(back):
        out.append(int(lengths[j - 1]))
        j = int(b[j])
    return out[::-1]


def pack(counts: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS,
         token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, seq_no, n_tokens, bucket_len, batch_no, slot) of documents' token counts."""
    return place(sequences(counts, max_len), max_len, n_buckets, token_budget)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS,
                   token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, seq_no, n_tokens, ids, bucket_len, batch_no, slot): the documents' packed sequences."""
    return unpacked(pack_bytes(docs, tokenizer_path, max_len, n_buckets, token_budget))


def pack_bytes(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS,
               token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """:func:`pack_documents` with the ids as bytes (``packed``)."""
    seqs = written(token_sequences(docs, tokenizer_path, max_len), "token-sequences")
    return place(seqs, max_len, n_buckets, token_budget)


def digests(packed: DataFrame) -> DataFrame:
    """Packed sequences with the number and the hash of their ids in place of the ids."""
    ids, n = ("packed", F.col("n_tokens")) if "packed" in packed.columns else ("ids", F.size("ids").cast("long"))
    return packed.select("doc_id", "seq_no", n.alias("n_tokens"), "bucket_len", "batch_no", "slot",
                         F.xxhash64(ids).alias("ids_hash"))


def padded_batches(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """(bucket_len, batch_no, lengths, ids): a row per batch, its slots' ids in
    order, each padded to ``bucket_len``; no batch holds over the token budget."""
    pad = F.array_repeat(F.lit(pad_id), (F.col("bucket_len") - F.size("ids")).cast("int"))
    row = F.struct("slot", F.size("ids").cast("long").alias("length"), F.concat("ids", pad).alias("ids"))
    return (packed.groupBy("bucket_len", "batch_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))
            .select("bucket_len", "batch_no", F.col("rows.length").alias("lengths"), F.col("rows.ids").alias("ids")))


def place(seqs: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS,
          token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Sequences (doc_id, seq_no, n_tokens and perhaps ``packed``) with their
    bucket_len, batch_no and slot.  Those with ids stay in the partitions in
    which they are read; counts alone are dealt out in their order first."""
    keys = ["doc_id", "seq_no", "n_tokens"]
    histogram = {r["n_tokens"]: r["n"] for r in
                 seqs.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most
    bounds = best_buckets(histogram, n_buckets)
    bucket = F.lit(bounds[-1] if bounds else max_len).cast("long")
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            got = np.array(b.column("bucket_len"))
            place = np.zeros(len(got), np.int64)
            for k in np.unique(got).tolist():
                m = got == k
                place[m] = seen.get(k, 0) + np.arange(m.sum())
                seen[k] = seen.get(k, 0) + int(m.sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(got), part, np.int64)), pa.array(place)],
                [*b.schema.names, "part", "place"])

    dealt = seqs.withColumn("bucket_len", bucket)
    if "packed" not in seqs.columns:
        dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranked = written(
        dealt.mapInArrow(rank, StructType(dealt.schema.fields + [StructField("part", LongType()), StructField("place", LongType())])),
        "packing")
    before = Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("bucket_len", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket_len", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    at = F.col("place") + F.col("offset")
    # a row per bucket and task: the join moves no sequence
    return ranked.join(F.broadcast(offsets), ["bucket_len", "part"]).select(
        *seqs.columns, "bucket_len", F.floor(at / rows).alias("batch_no"),
        (at % rows).alias("slot"))
