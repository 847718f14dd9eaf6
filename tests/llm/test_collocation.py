"""Phrase mining against a count of all windows, with tiny blocks, bitmaps and word tables."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from reviewlake.llm import collocation
from reviewlake.llm.collocation import Mining

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, containment=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for width in (1, 2, 3):
                f.update((lang, tuple(words[i:i + width])) for i in range(len(words) - width + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = []
    for (lang, ws), a in cand.items():
        score, k = min((int(Fraction(10 ** 6 * a * a, f[lang, ws[:k]] * f[lang, ws[k:]])), k) for k in range(1, len(ws)))
        longer = [b for (o, xs), b in cand.items() if o == lang and len(xs) > len(ws)
                  and any(xs[i:i + len(ws)] == ws for i in range(len(xs) - len(ws) + 1))]
        if not any(100 * b >= containment * a for b in longer):
            out.append((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(own[:top])]
    return sorted(ranked)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", 3, 1) for r in rows],
                                 "doc_id long, text string, lang string, key string, shard int, n long").repartition(3)


def made_up(seed, n):
    rnd = random.Random(seed)
    words = ["New", "York", "city", "É", "é", "a", "b", "of", "the", "x y", "\U0001f600", "ﬀ"]
    breaks = [" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", " ;: "]
    out = []
    for k in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(breaks) for _ in range(rnd.randrange(0, 60)))
        out.append((rnd.choice([None, k, k, 5]), rnd.choice([text, text, text, None, ""]), rnd.choice(["en", "fr", None, "und"])))
    return out + out[:9]


@pytest.mark.parametrize("m", [Mining(support=4), Mining(support=10, shards=7, bits=12, block_bytes=300),
                               Mining(support=2, shards=1, bits=6, top=5), Mining(support=3, shards=40, bits=16)])
def test_against_all_windows(spark, m):
    rows = made_up(m.support, 150)
    got = sorted(tuple(r) for r in collocation.mine(documents(spark, rows), m).collect())
    want = brute(rows, m.support, top=m.top)
    assert got == want and want


def test_one_hot_phrase_and_edges(spark):
    hot = "Click here now. " * 4000
    rows = [(1, hot, "en"), (2, hot, "en"), (3, "w " * 30_000, "de"), (4, "x" * 200_000, "en"), (None, None, None)]
    got = sorted(tuple(r) for r in collocation.mine(documents(spark, rows)).collect())
    assert got == brute(rows, 10)
    assert ("en", 1, "click here now", 8000, 8000, 8000, 24001, 10 ** 6) in got
    assert collocation.mine(documents(spark, [])).collect() == []


def test_local_support_loses_nothing(spark):
    """The union over shards holds every globally frequent pair, and fewer than all pairs."""
    rows = made_up(3, 200) + [(1000 + k, f"rare{k} pair{k}", "en") for k in range(50)]
    m = Mining(support=12, shards=3)
    texts = collocation.texts_of(documents(spark, rows), m)
    keys = {r.key for r in collocation.locally_frequent(texts, collocation.shard_totals(texts, m), m, 2).collect()}
    low = Mining(support=1, shards=3)
    every = {r.key for r in collocation.locally_frequent(texts, collocation.shard_totals(texts, low), low, 2).collect()}
    assert keys < every and len(keys) < len(every) / 2
    langs = {r.lang: r.grp >> 8 for r in texts.select("lang", "grp").distinct().collect()}
    for lang, _, phrase, *_ in brute(rows, 12, containment=1000):
        if len(phrase.split(" ")) == 2:
            words = collocation.Scan(phrase.encode()).hashes(langs[lang])
            assert int(collocation.phrase_hashes(words, np.array([0]), 2).view(np.int64)[0]) in keys


def test_scan():
    text = b"a bb.  ccc\td" + b"x" * 100 + b" bb bb..e"
    scan = collocation.Scan(text.translate(collocation.FOLDED))
    assert [scan.word(i) for i in range(len(scan))] == [b"a", b"bb", b"ccc", b"d" + b"x" * 100, b"bb", b"bb", b"e"]
    h = scan.hashes(5)
    assert h[1] == h[4] == h[5] and len(set(h.tolist())) == 5
    assert scan.windows(2).tolist() == [0, 2, 3, 4] and scan.windows(3).tolist() == [2, 3] and scan.windows(9).tolist() == []
    assert len(collocation.Scan(b"")) == 0 and len(collocation.Scan(b"..  .")) == 0


def test_products_beyond_64_bits(spark):
    a, l, r = 3 * 10 ** 9, 4 * 10 ** 12, 5 * 10 ** 11
    counts = spark.createDataFrame([("en", "x y", a, 2), ("en", "x", l, 1), ("en", "y", r, 1)],
                                   "lang string, phrase string, f long, width int")
    row = collocation.cuts(counts).collect()[0]
    assert (row.score, row.l, row.r) == (10 ** 6 * a * a // (l * r), l, r)
