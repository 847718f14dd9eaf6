"""Quality rules, chat formatting, WARC, token files and packing on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from reviewlake.llm import chat_format, packing, quality, tokens, warc

LINE = "The quick brown fox jumps over the lazy dog near the old river bank today."


def brute_repeats(words):
    seen = defaultdict(list)
    for k in range(len(words) - 4):
        seen[tuple(words[k:k + 5])].append(k)
    return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)})


def test_repeated_words_brute_force():
    rnd = random.Random(1)
    for n in (0, 3, 5, 6, 12, 80, 400):
        for alphabet in (1, 2, 3, 40):
            words = [b"w%d" % rnd.randrange(alphabet) for _ in range(n)]
            assert quality.repeated_words(words) == brute_repeats(words)


def test_quality_cases(spark, documents):
    varied = " ".join(f"word{k} and{k * 7}" for k in range(60)) + "."
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, f"{LINE} {varied}"), (4, f"{LINE} {varied}"), (None, varied),
            (5, "Home | About | Contact | Login | Help | Jobs | News | More | Last | End\n" * 3 + LINE),
            (6, "A%%% b$$$ c### d*** e&&& f%%% g%%% h$$$ i### j### k### l###"), (7, "spam " * 400),
            (8, f"{varied}\nLicensed under the Apache License, Version 2.0."), (9, "x" * 300_000)]
    got = {(r.doc_id, r.n_words): r for r in quality.assess(documents(rows)).collect()}
    assert len(quality.assess(documents(rows)).collect()) == len(rows)
    assert not got[(1, 0)].kept and got[(1, 0)].base_failed and got[(2, 0)].base_failed
    kept = {k[0] for k, r in got.items() if r.kept}
    assert kept == {4, None, 8}
    by = {k[0]: r for k, r in got.items()}
    assert by[8].n_failed_lines == 1 and by[7].n_repeat_words == 400 and by[9].word_chars == 300_000
    passed = quality.assess(documents(rows), keep_columns=True)
    assert passed.columns == documents(rows).columns
    texts = {r.doc_id: r.text for r in passed.collect()}
    assert texts[8] == varied and set(texts) == kept
    assert quality.assess(documents([])).count() == 0 and quality.assess(documents([]), keep_columns=True).count() == 0


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|a<\\\\|b<|", "", None, "é😀\n\n", "\\", "<", "|", "x" * 100_000]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(hard)]
    rows += [(2, 0, "assistant", "first"), (2, 1, "user", "then"), (3, 0, "user", "a"), (3, 0, "user", "a"),
             (4, 5, None, "n"), (5, 0, "us%0Aer\n<|im_start|>", "odd role"), (None, 0, "user", "no id")]
    rows += [(6, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(300)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows],
                               "conv_id long, turn long, role string, text string, block long, segments string")
    blocks = chat_format.format_chat(df)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.read_back(blocks)).collect()}
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        loss = "".join(t for _, a, t in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in got.items() if r.valid_order} == {1, 6, None}
    for row in blocks.collect():
        assert sum(s.text.count("<|im_start|>") for s in row.segments) == len(row.segments) // 3
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_warc(spark):
    big, other = "<p>" + "x" * 200, "<p>é" + "y" * 400_000
    rows = [(5, "http://a/\r\nX: 1", big), (3, None, big), (9, "ü", big), (1, "u", "small"), (2, "u", "small"),
            (4, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + big),
            (None, "u", big)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to long")
    got = sorted(tuple(r) for r in warc.archive_pages(df.repartition(3)).collect() if r.page_id is not None)
    want = sorted(
        (i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None)
        for i, _, h in rows if i is not None for b in [(h or "").encode()])
    assert got == want
    none = [r for r in warc.archive_pages(df).collect() if r.page_id is None]
    assert [(r.record_type, r.refers_to) for r in none] == [("revisit", 3)]
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_inflate_reads_members_and_cut_streams():
    import gzip
    import io

    recs = [warc.record(k, "u", b"a" * k * 1000, "0" * 64, None) for k in range(5)]
    for blob in (gzip.compress(b"".join(recs)), b"".join(map(gzip.compress, recs))):
        assert list(warc.records(warc.inflate(io.BytesIO(blob), 700))) == recs
    with pytest.raises(ValueError):
        list(warc.records(iter([recs[0][:-1]])))


def test_simple8b_round_trip():
    rnd = random.Random(4)
    for trial in range(120):
        n = rnd.choice([0, 1, 119, 120, 121, 1023, 1024, 1025, 3000])
        v = np.array([rnd.getrandbits(rnd.choice([0, 1, 2, 7, 16, 33, 60, 61, 64])) for _ in range(n)], np.uint64)
        if trial % 3 == 0:
            v = v * 0
        words, first = tokens.encode_blocks(v)
        assert (tokens.decode_blocks(words, first, n) == v).all()
        assert len(first) == -(-n // tokens.BLOCK)


def test_word_encoder_equals_library(tokenizer):
    rnd = random.Random(2)
    letters = "aAzZéÉßñ 's 're\n\t\x0b\x1c\x85 ΣσςİǅǺ̊H̱½²<|endoftext|>.,!?%&$*#|'日本😀"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["<|ENDOFTEXT|> x<|endoftext|>.", "", "word " * 400_000, "x" * 50_000]
    e = tokens.WordEncoder(tokenizer, most=500)
    for t, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.encode(t).tolist() == want.ids and e.count(t) == len(want.ids)


def test_token_files(documents, tokenizer):
    rows = [(7, "Hello, world"), (7, "Hello, world"), (3, None), (5, ""), (None, "null id"), (9, "w " * 20_000), (3, "again")]
    e = tokens.WordEncoder(tokenizer)
    got = sorted((tuple(r) for r in tokens.encode_and_read(documents(rows), tokenizer).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(e.encode(t or ""), np.uint32(1))
        want.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.encode_and_read(documents([]), tokenizer).count() == 0


def test_best_buckets_brute_force():
    rnd = random.Random(3)
    for _ in range(40):
        hist = {rnd.randint(1, 30): rnd.randint(1, 9) for _ in range(rnd.randint(1, 8))}
        lengths = sorted(hist)
        for k in (1, 2, 3, 9):
            cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist.items())
            best = min(cost((*c, lengths[-1])) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1], r))
            assert cost(packing.best_buckets(hist, k)) == best
    assert packing.best_buckets({}, 4) == []


def test_packing(spark, documents, tokenizer):
    rows = [(k, "word " * (k * 3)) for k in range(60)] + [(5, "word " * 15), (None, None), (70, "a b " * 3000)]
    counts = packing.token_counts(documents(rows), tokenizer)
    out = packing.pack(counts, max_len=500, n_buckets=4, token_budget=1000).collect()
    want = Counter(len((t or "").split()) + 1 for _, t in rows)
    whole = defaultdict(int)
    batches = defaultdict(list)
    for r in out:
        assert r.n_tokens <= r.bucket_len <= 500
        whole[r.doc_id] += r.n_tokens
        batches[(r.bucket_len, r.batch_no)].append(r.slot)
    assert whole[70] == 6001 and whole[None] == 1 and sum(whole.values()) == sum(n * c for n, c in want.items())
    for (length, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(1, 1000 // length)
    for length in {b for b, _ in batches}:
        sizes = [len(batches[(length, k)]) for k in range(sum(b == length for b, _ in batches))]
        assert all(s == max(1, 1000 // length) for s in sizes[:-1])
    assert packing.pack(counts.limit(0)).count() == 0


def test_packed_ids(documents, tokenizer):
    rows = [(k, f"word number{k} " * k) for k in range(40)] + [(5, "other text"), (5, "other text"), (None, None), (70, "a b " * 3000)]
    encoder = tokens.WordEncoder(tokenizer)
    want = Counter((i, tuple(np.append(encoder.encode(t or ""), tokens.END_ID).tolist())) for i, t in rows)
    packed = packing.pack_documents(documents(rows), tokenizer, max_len=500, n_buckets=4, token_budget=1000)
    got, by_doc = packed.collect(), defaultdict(list)
    for r in sorted(got, key=lambda r: r.seq_no):
        assert len(r.ids) == r.n_tokens <= r.bucket_len
        by_doc[r.doc_id].append(r.ids)
    for i in {i for i, _ in rows} - {5}:
        assert (i, tuple(x for ids in by_doc[i] for x in ids)) in want
    assert Counter(map(tuple, by_doc[5])) == Counter({ids: c for (i, ids), c in want.items() if i == 5})
    slots = {(r.bucket_len, r.batch_no, r.slot): r.ids for r in got}
    assert len(slots) == len(got)
    batches = packing.padded_batches(packed, pad_id=7).collect()
    assert sum(len(b.ids) for b in batches) == len(got)
    for b in batches:
        for k, (n, ids) in enumerate(zip(b.lengths, b.ids, strict=True)):
            own = slots[(b.bucket_len, b.batch_no, k)]
            assert n == len(own) and ids == own + [7] * (b.bucket_len - n)
    digest = packing.digests(packed)
    assert "ids" not in digest.columns and digest.agg({"n_tokens": "sum"}).first()[0] == sum(len(r.ids) for r in got)
    assert packing.pack_documents(documents([]), tokenizer).count() == 0
