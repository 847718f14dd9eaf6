"""Decontamination, similarity join and suffix dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from reviewlake.llm import decontaminate as dc
from reviewlake.llm import ngram_join as nj
from reviewlake.llm import suffix_dedup as sd
from reviewlake.llm.common import table

SF = "/root/testdata/sf0.001"


def prose(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def test_wand_equals_scoring_all():
    rnd = random.Random(1)
    items = [(k, prose(rnd, rnd.randint(3, 150), 60)) for k in range(80)]
    for least in (0.05, 0.3, 0.5):
        index = dc.Index(items, dc.Search(min_score=least, block=3))
        for _ in range(60):
            words = dc.words_of(prose(rnd, 60, 60) + " " + items[rnd.randrange(80)][1])
            terms = np.unique(index.terms(words))
            terms = terms[terms < len(index.pairs)].tolist()
            score = defaultdict(float)
            for t in terms:
                for u, v in zip(*index.lists[t][:2], strict=True):
                    score[u] += v
            assert {u for u, _ in index.retrieve(terms)} == {u for u, v in score.items() if v >= least - 1e-9}


def test_leaks(spark, documents):
    rnd = random.Random(2)
    items = [(k, prose(rnd, 30, 3000) + ". " + prose(rnd, 8, 3000) + ".") for k in range(6)]
    items += [(6, "Too short."), (7, None), (8, prose(rnd, 400, 3000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    half = " ".join(items[3][1].split()[:15])
    rows = [(1, prose(rnd, 300) + " " + items[0][1].upper() + " " + prose(rnd, 300)), (2, prose(rnd, 500)), (3, half),
            (4, None), (5, ""), (6, items[1][1] + " " + items[2][1]), (6, items[1][1] + " " + items[2][1]), (7, "Too short."),
            (8, prose(rnd, 90) + " " + items[8][1]), (9, prose(rnd, 30_000) + " " + items[4][1]), (None, items[5][1])]
    want = [(1, 0), (6, 1), (6, 1), (6, 2), (6, 2), (8, 8), (9, 4), (None, 5)]
    key = lambda x: (x[0] is None, x)
    for search in (dc.Search(), dc.Search(index_chars=900)):
        got = [(r.doc_id, r.item_id) for r in dc.find_leaks(documents(rows), bench, search).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        kept = dc.drop_leaks(documents(rows), bench, search)
        assert kept.columns == documents(rows).columns
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7]
    assert dc.find_leaks(documents(rows), bench.limit(0)).count() == 0
    assert dc.drop_leaks(documents(rows), bench.limit(0)).count() == len(rows)
    assert dc.find_leaks(documents([]), bench).count() == 0


def test_leaks_of_ids_with_several_texts(spark, documents):
    rnd = random.Random(7)
    text = [prose(rnd, 30, 3000) + ". " + prose(rnd, 8, 3000) + "." for _ in range(12)]
    items = [(1, text[0]), (1, text[1]), (1, text[0]), (None, text[2]), (None, text[3]), (2, text[4]), (3, text[4]), (None, text[4])]
    items += [(9, t) for t in text[5:]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wrap = lambda *t: " ".join([prose(rnd, 200), *t, prose(rnd, 200)])
    both = wrap(text[0], text[1])
    rows = [(0, prose(rnd, 300)), (1, wrap(text[0])), (2, wrap(text[1])), (3, wrap(text[2])), (4, wrap(text[3], text[2])),
            (5, wrap(text[4])), (6, both), (6, both), (6, wrap(text[1])), (None, wrap(text[3])), (7, wrap(text[7], text[10]))]
    want = [(1, 1), (2, 1), (3, None), (4, None), (5, 2), (5, 3), (5, None), (6, 1), (6, 1), (6, 1), (None, None), (7, 9)]
    seen = []
    for search in (dc.Search(), dc.Search(index_chars=400)):
        got = dc.find_leaks(documents(rows), bench, search).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(want, key=str)
        seen.append(sorted(((r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in got), key=str))
        assert [r.doc_id for r in dc.drop_leaks(documents(rows), bench, search).collect()] == [0]
    assert seen[0] == seen[1]
    hot = [x.value for x in dc.indexes(bench.where("item_id = 9"), dc.Search(index_chars=400))]
    assert len(hot) > 1 and max(len(x.parts) for x in hot) < 7 and sum(len(x.parts) for x in hot) == 7


def shingles(text):
    words = (text or "").encode().split()
    n = min(5, len(words))
    return frozenset(zip(*(words[k:] for k in range(n)), strict=False)) if n else frozenset()


def brute_links(rows):
    """Per row (doc_id, class id, links, class number); rows of empty sets are alone."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, least.get(find(k)), links[k], find(k)) for k, (i, _) in enumerate(rows)]


def near_rows():
    rnd = random.Random(5)
    base = [prose(rnd, 120, 5000) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(300):  # one large group of near copies, several small ones
        words = base[0 if k % 2 else rnd.randrange(25)].split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(600, None), (601, ""), (602, "a b"), (603, "a b"), (604, "b a"), (5, base[5]), (5, base[6]), (5, base[5]),
             (None, base[7]), (None, "lone " + prose(rnd, 90, 10**6)), (605, prose(rnd, 20_000, 10**6))]
    for k in (0, 1, 1):  # classes whose rows have no id at all
        near = prose(random.Random(90 + k), 100, 10**6)
        rows += [(None, near), (None, near + " end")]
    return rows


def test_chosen_paths_brute_force(documents):
    rows = near_rows()
    brute = brute_links(rows)
    want = sorted((w[:3] for w in brute), key=str)
    for j in (nj.Join(), nj.Join(small=10, block=40)):
        got = nj.link(documents(rows), j)
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str) == want
    kept = nj.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns
    one = {number: least for _, least, _, number in brute}  # two classes may have rows of one id
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(one.values(), key=str)
    assert nj.link(documents([])).count() == 0 and nj.one_of_each(documents([])).count() == 0
    assert nj.link(documents([(1, "only one text here")])).collect()[0].n_links == 0


def test_runs_reach_the_target():
    assert nj.Join().runs == 9
    assert nj.Join(recall=0.9).runs < nj.Join().runs < nj.Join(depth=6).runs


def brute_cut(rows):
    low = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, d in data:
        for s in range(len(d) - 49) if i is not None else ():
            low[d[s:s + 50]] = min(i, low.get(d[s:s + 50], i))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - 49) if i is not None else ():
            if low[d[s:s + 50]] < i:
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_brute_force(spark, documents):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh ijé") for _ in range(rnd.randint(0, 300))) for _ in range(25)]
    base += ["a" * 200, "ab" * 150, "\0" * 120, ""]
    rows = []
    for i in range(120):
        parts = [x[a:a + rnd.randint(20, 150)] for x in rnd.sample(base, 3) for a in [rnd.randint(0, len(x))]]
        rows.append((None if i % 17 == 0 else i, "".join(parts) if i % 11 else None))
    rows += [(5, base[0]), (5, base[0]), (5, base[1] + "zz"), (3, base[0]), (500, "q" * 30_000 + base[2])]
    want = brute_cut(rows)
    for s in (sd.Sizes(), sd.Sizes(3000, 900, 2000, 4000), sd.Sizes(200, 100, 1000, 500)):
        assert sorted((tuple(r)[:5] for r in sd.dedup(documents(rows), s).collect()), key=str) == want
    assert sd.dedup(documents([])).count() == 0
    one = sd.dedup(documents([(1, None), (2, "short")])).collect()
    assert sorted((r.doc_id, r.n_removed, r.spans) for r in one) == [(1, 0, []), (2, 0, [])]


def test_suffix_dedup_on_documents(spark):
    docs = table(spark, SF, "documents")
    got = sorted((tuple(r)[:5] for r in sd.dedup(docs, sd.Sizes(run_bytes=60_000)).collect()), key=str)
    assert got == brute_cut([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_loser_tree_merges():
    rnd = random.Random(8)
    for k in (1, 2, 3, 5, 8, 13):
        runs = []
        for _ in range(k):
            keys = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 30)))
            shares = [0] + [shared(a, b) for a, b in zip(keys, keys[1:], strict=False)]
            runs.append((keys, shares[:len(keys)]))
        source, lengths = sd.merge(runs)
        at, out = [0] * k, []
        for r in source:
            out.append(runs[r][0][at[r]])
            at[r] += 1
        assert out == sorted(x for r, _ in runs for x in r)
        assert lengths[1:] == [shared(a, b) for a, b in zip(out, out[1:], strict=False)]


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_texts_are_moved_compressed(spark):
    import zstandard
    texts = ["", "ü", "the same words " * 200]
    rows = spark.createDataFrame([(k, k, 0, t) for k, t in enumerate(texts)], "grp long, doc_id long, part long, text string")
    got = {r.doc_id: bytes(r.data) for r in sd.packed(rows).collect()}
    assert [zstandard.ZstdDecompressor().decompress(got[k]).decode() for k in range(3)] == texts
    assert len(got[2]) < 100
