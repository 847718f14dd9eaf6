"""Token ids and their binary files in Simple-8b.

``WordEncoder`` gives the ids of whole texts under a public tokenizer whose
pre-tokenizer drops white space: the ids of a text are those of its words one
after another, so each distinct word is encoded once per worker and looked up
afterwards.  ``write_files`` writes the ids in ascending doc_id order, a file
per range of doc_ids; ``read_files`` decodes the files.

A file holds 64-bit little-endian words.  The top four bits of a word are its
selector, the other sixty hold as many ids as the selector says
(:data:`SELECTORS`: count, bits).  Selector 0 is the escape: the next word is
one raw 64-bit value, for values of over 60 bits.  Ids are coded in blocks of
``BLOCK``; every block begins with a new word, and the word offset of each
block is stored, so any run of blocks is decoded alone, all of its words at a
time in numpy.  After the words come the block offsets, the documents' (id,
number of ids) pairs, and a footer of six numbers.

A task attempt writes a file of its own name and only files that a finished
task returned are read, so lost executors and second attempts do no harm.

Defined results: a null text is empty; an empty text has the end id alone;
rows order by (doc_id, text), null doc_id first, and repeated rows are
documents of their own; an empty table gives no files and no rows; further
columns are ignored; texts are cut at white space into pieces of about 1 MB
for encoding, so their length is not bounded.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, scratch, text_of, written

#: Fixed values: (ids in a word, bits of each) by selector; 0 is the escape.
SELECTORS = ((1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10),
             (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNT = np.array([c for c, _ in SELECTORS])
BLOCK = 1024
MAGIC = 0x3842_3153
END_ID = 1
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Cut bytes at ASCII blanks or line ends into parts of about ``size``."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(b" ", at, at + size), data.rfind(b"\n", at, at + size))
        if cut <= at:
            ends = [x for x in (data.find(b" ", at + size), data.find(b"\n", at + size)) if x >= 0]
            cut = min(ends, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


#: Byte-level vocabularies write a byte as the Latin-1 character of its number
#: where that is printable, the others, in order, as the characters from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = dict(zip(sorted(set(range(256)) - PRINTABLE), range(256, 512), strict=False))


class Numbers(dict):
    """Numbers words as they are first looked up; ``new`` are those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Whole-text ids by looking up each word; about ``most`` words are kept.

    Before a text is split, two changes that leave its ids as they are make
    words recur more often: a blank between a letter or digit and a symbol
    (the pre-tokenizer parts them anyway), and ASCII capitals in lower case
    (the normalizer's own last step; not with combining marks in the text,
    which compose before it, nor with the opening of a special token).
    """

    #: Of a byte: 1 for an ASCII letter or digit, 2 for a symbol, else 0; and its lower case.
    KIND = np.array([2 if c in b".,!?%&$*#" else int(bytes([c]).isalnum()) for c in range(256)], np.uint8)
    LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share an executor's cores already
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: Its merges alone, for words that normalizer and pre-tokenizer leave whole.
        self.merge = self.tokenizer.model.tokenize
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.lens, self.offs, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), \
            np.zeros(1 << 18, np.uint32), 0

    def _learn(self, words: list[bytes]) -> None:
        """Encode the words that the table has numbered last."""
        ids, other = [], []
        for w in words:
            t = w.decode("utf-8")
            if t.isalpha() and t == t.lower() and is_normalized("NFC", t):
                ids.append([x.id for x in self.merge(t if t.isascii() else w.decode("latin-1").translate(BYTE_CHARS))])
            else:
                ids.append(None)
                other.append(t)
        encoded = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        ids = [next(encoded).ids if x is None else x for x in ids]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.number) - len(words), int(lens.sum())
        while len(self.lens) < n + len(ids):
            self.lens, self.offs = (np.concatenate([a, np.zeros_like(a)]) for a in (self.lens, self.offs))
        while len(self.pool) < self.used + total:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.lens[n:n + len(ids)] = lens
        self.offs[n:n + len(ids)] = self.used + np.cumsum(lens) - lens
        self.pool[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total

    def numbers(self, text: bytes) -> np.ndarray:
        """The words' numbers in the table."""
        data = np.frombuffer(text, np.uint8)
        kind = self.KIND[data]
        if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
            data = self.LOWER[data]
        text = np.insert(data, np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1, 32).tobytes()
        if len(self.number) > self.most:
            self.clear()
        words = text.split()
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        return found

    def count(self, text: str) -> int:
        total = 0
        for p in pieces(text.encode("utf-8")):
            numbers = self.numbers(p)  # may replace the table
            total += int(self.lens[numbers].sum())
        return total

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([self._ids(p) for p in pieces(text.encode("utf-8"))])

    def _ids(self, piece: bytes) -> np.ndarray:
        numbers = self.numbers(piece)
        lens = self.lens[numbers]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.offs[numbers] - ends + lens, lens) + np.arange(total)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """A worker's encoder: its table of words serves one task after another."""
    return WordEncoder(path)


WIDTHS = np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.uint8)


def bit_widths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if v.max(initial=0) < len(WIDTHS):
        return WIDTHS[v]
    v = v.astype(np.uint64)
    out = WIDTHS[v & np.uint64(0xFFFF)]
    for k in (16, 32, 48):
        high = (v >> np.uint64(k)) & np.uint64(0xFFFF)
        if not high.any() and not (v >> np.uint64(k)).any():
            break
        out = np.where(high > 0, WIDTHS[high] + np.uint8(k), out)
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ids, and the first word of every block of ``BLOCK`` ids."""
    n = len(ids)
    rows = -(-n // BLOCK)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = BLOCK + int(COUNT.max())
    v, widest = np.zeros((rows, width), np.uint64), np.zeros((rows, width), np.uint8)
    for to, own in ((v, ids), (widest, bit_widths(ids))):
        to[:n // BLOCK, :BLOCK] = own[:n // BLOCK * BLOCK].reshape(-1, BLOCK)
        to[-1, :n - (rows - 1) * BLOCK] = own[(rows - 1) * BLOCK:]
    size = np.full(rows, BLOCK)
    size[-1] = n - (rows - 1) * BLOCK
    best = np.zeros((rows, BLOCK), np.int8)
    reach = 1  # widest: the most bits of the next ``reach`` values (none past the block)
    for sel in range(len(SELECTORS) - 1, 0, -1):  # from the fewest values a word to the most: the last that fits wins
        count, bits = SELECTORS[sel]
        while reach < count:
            step = min(reach, count - reach)
            widest[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            reach += step
        best[widest[:, :BLOCK] <= bits] = sel
    r, cur, out = np.arange(rows), np.zeros(rows, np.int64), []
    while len(r):
        s = best[r, cur]
        out.append((r, cur, s))
        cur = cur + COUNT[s]
        live = cur < size[r]
        r, cur = r[live], cur[live]
    row, pos, sel = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    row, pos, sel = row[order], pos[order], sel[order].astype(np.int64)
    span = np.where(sel == 0, 2, 1)
    word_at = np.cumsum(span) - span
    words = np.zeros(int(span.sum()), np.uint64)
    base = row * width + pos
    flat = v.reshape(-1)
    for s in np.unique(sel):
        m = sel == s
        count, bits = SELECTORS[s]
        if s == 0:
            words[word_at[m] + 1] = flat[base[m]]
            continue
        packed = np.full(int(m.sum()), np.uint64(s) << np.uint64(60))
        if bits:
            for k in range(count):
                packed |= flat[base[m] + k] << np.uint64(k * bits)
        words[word_at[m]] = packed
    first = np.zeros(rows, np.int64)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    first[row[starts]] = word_at[starts]
    return words, first


def decode_blocks(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of consecutive blocks whose words start at ``first``."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    code = np.ones(len(words), bool)
    last = -2
    for i in np.flatnonzero(sel == 0):
        if i != last + 1:  # else it is the value of the escape before it
            last = i
            code[i + 1] = False
    at = np.flatnonzero(code)
    s = sel[at]
    count = COUNT[s].copy()
    block = np.searchsorted(first, at, side="right") - 1
    size = np.full(len(first), BLOCK)
    size[-1] = n - (len(first) - 1) * BLOCK
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    count[np.r_[starts[1:], len(at)] - 1] -= np.add.reduceat(count, starts) - size
    to = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    for k in np.unique(s):
        m = s == k
        full, bits = SELECTORS[k]
        if k == 0:
            out[to[m]] = words[at[m] + 1]
        elif bits:
            mask, w, t, c = np.uint64((1 << bits) - 1), words[at[m]], to[m], count[m]
            for j in range(full):
                ok = c > j
                out[t[ok] + j] = (w[ok] >> np.uint64(j * bits)) & mask
    return out


def write_files(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Files in ascending doc_id order: rows (part, path, n_docs, n_ids, n_words)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fs, out = None, None, None
        held, n_held, words, ids, offsets, table = [], 0, 0, 0, [], []

        def flush(last: bool) -> None:
            nonlocal held, n_held, words, ids
            have = np.concatenate(held) if held else np.zeros(0, np.uint32)
            take = len(have) if last else len(have) // BLOCK * BLOCK
            w, first = encode_blocks(have[:take])
            out.write(w.astype("<u8").tobytes())
            offsets.append(first + words)
            words, ids, held, n_held = words + len(w), ids + take, [have[take:]], len(have) - take

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if out is None:
                    encoder = word_encoder(tokenizer_path)
                    fs, base = open_fs(folder)
                    fs.create_dir(base, recursive=True)
                    path = f"{base}/ids-{uuid.uuid4().hex}.s8b"
                    out = fs.open_output_stream(path, compression=None)
                own = np.append(encoder.encode(text.as_py()), np.uint32(END_ID))
                table.append((np.iinfo(np.int64).min if doc_id is None else doc_id, len(own)))
                held.append(own)
                n_held += len(own)
                if n_held >= 512 * BLOCK:
                    flush(False)
        if out is not None:
            flush(True)
            firsts = np.concatenate(offsets)
            out.write(firsts.astype("<i8").tobytes())
            out.write(np.array(table, "<i8").tobytes())
            out.write(np.array([words, len(firsts), len(table), ids, BLOCK, MAGIC], "<i8").tobytes())
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path],
                "n_docs": pa.array([len(table)], pa.int64()), "n_ids": pa.array([ids], pa.int64()),
                "n_words": pa.array([words], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    key = F.xxhash64("text")
    return (rows.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", "text")
            .mapInArrow(write, "part long, path string, n_docs long, n_ids long, n_words long"))


def with_starts(files: DataFrame) -> DataFrame:
    """Adds the number of ids in the files before (a manifest has one row a file)."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read_files(files: DataFrame, folder: str, blocks: int = 512) -> DataFrame:
    """Per document: doc_id, start, n_tokens, crc32 of its ids; decoded ``blocks`` blocks at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, _ = open_fs(folder)
                with fs.open_input_file(path) as f:
                    yield one(f, start)

    def one(f, start: int) -> pa.RecordBatch:
        f.seek(f.size() - 48)
        n_words, n_blocks, n_docs, n_ids, block, magic = (int(x) for x in np.frombuffer(f.read(48), "<i8"))
        if (block, magic) != (BLOCK, MAGIC):
            raise ValueError("not a file of token ids")
        f.seek(8 * n_words)
        firsts = np.frombuffer(f.read(8 * n_blocks), "<i8")
        table = np.frombuffer(f.read(16 * n_docs), "<i8").reshape(-1, 2)
        ends = np.cumsum(table[:, 1])
        crcs = np.zeros(n_docs, np.int64)
        doc = 0
        for k in range(0, n_blocks, blocks):
            a, z = int(firsts[k]), int(firsts[k + blocks]) if k + blocks < n_blocks else n_words
            f.seek(8 * a)
            lo, hi = k * BLOCK, min((k + blocks) * BLOCK, n_ids)
            ids = decode_blocks(np.frombuffer(f.read(8 * (z - a)), "<u8"), firsts[k:k + blocks] - a, hi - lo)
            data = memoryview(ids.astype("<u4").tobytes())
            at = lo
            while at < hi:
                to = min(hi, int(ends[doc]))
                crcs[doc] = zlib.crc32(data[4 * (at - lo):4 * (to - lo)], int(crcs[doc]))
                at = to
                if to == ends[doc]:
                    doc += 1
        null = table[:, 0] == np.iinfo(np.int64).min
        return pa.RecordBatch.from_arrays(
            [pa.array(table[:, 0], mask=null), pa.array(start + ends - table[:, 1]), pa.array(table[:, 1]),
             pa.array(crcs)], [c.split()[0] for c in READ_SCHEMA.split(", ")])

    return files.select("path", "start").mapInArrow(read, READ_SCHEMA)


def encode_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents' ids and read the files back."""
    folder = scratch(docs.sparkSession, "token-ids")
    files = written(write_files(docs, tokenizer_path, folder), "token-files")
    return read_files(with_starts(files).repartition(max(1, 2 * files.count()), "path"), folder)
