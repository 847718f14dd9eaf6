"""The trained operators: gradients, exact decoding, held-out accuracy, edge cases."""

import random
import re
import zlib

import numpy as np

from reviewlake.llm import pii, toxicity
from reviewlake.llm.common import table

SF = "/root/testdata/sf0.1"
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = [c for c in m[0] if c.isdigit()]
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not pii.card_digits(m[0]) \
                    or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((*m.span(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_brute_force():
    rnd = random.Random(1)
    for _ in range(4000):
        t = "".join(rnd.choice("ab1290.@+-() %_\n4111 ") for _ in range(rnd.randint(0, 80)))
        assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []
    assert pii.listed(pii.base_spans("a@b.cd 1.2.3.4, 4111 1111 1111 1111, +1 (212) 555-1234")) == \
        "email:0:6,ip:7:14,card:16:35,phone:37:54"


def numeric(f, p, grad, rnd):
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[name][at]
        p[name][at] = old + 1e-5
        up = f()
        p[name][at] = old - 1e-5
        down = f()
        p[name][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at])), name


def test_gradients():
    rnd = np.random.default_rng(3)
    m = pii.Tagger(3, 1)
    x, y = rnd.integers(1, 60, (9, 2)), rnd.integers(0, pii.TAGS, (9, 2))
    numeric(lambda: m.gradients(x, y)[0], m.p, m.gradients(x, y)[1], rnd)
    n = toxicity.Network(toxicity.Training(hidden=3, attention=3))
    x, mask, y = rnd.normal(0, 1, (5, 3, 2 * toxicity.DIM)), np.ones((5, 3), bool), np.array([1.0, 0, 1])
    mask[3:, 1] = False
    x *= mask[:, :, None]
    numeric(lambda: n.gradients(x, mask, y)[0], n.p, n.gradients(x, mask, y)[1], rnd)


def test_shortcut_is_viterbi_and_seams_do_not_matter():
    t = pii.Training(windows=500, epochs=5)
    x, y = pii.examples([], t)
    m = pii.Tagger(t.hidden, t.seed)
    m.fit(x.astype(int), y.astype(int), t)
    w = m.frozen()
    wide = np.pad(x, ((0, 0), (0, pii.WINDOW - x.shape[1])))
    assert (pii.decode(w, wide) == pii.viterbi(pii.emissions(w, wide), w["a"]).T).all()
    span = "call (212) 555-1234 today"
    for lead in range(pii.STEP - 30, pii.STEP + 30, 7):  # a span across a window's end
        text = "lorem ipsum dolor " * 40
        text = text[:lead] + " " + span + " " + text
        base, added = next(pii.spans_of(w, [text]))
        assert len(pii.reconcile(np.zeros((len(pii.windows(pii.classes(text))), pii.WINDOW), np.uint8), len(text))) == len(text)
        assert all(a < b for a, b, _ in added) and not base


def test_pii_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.org now"), (3, "mail a.b@c.org now"), (None, "ip 10.0.0.1"), (4, "clean text only"),
            (5, "x" * 100_000 + " +1 (212) 555-1234 " + "y z " * 30_000), (6, "\U0001F600 4111111111111111")]
    w = pii.train(documents(rows), pii.Training(windows=600, epochs=4))
    got = {r.doc_id: r for r in pii.find(documents(rows), w).collect()}
    assert pii.find(documents(rows), w).count() == len(rows)
    for i, t in rows:
        base = plain(t or "")
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == j for *_, k in base) for j in range(4))
        assert set(pii.listed(base).split(",")) <= set(got[i].spans.split(","))
    assert got[4].spans == "" and got[6].spans == "card:2:18"
    masked = {r.doc_id: r.text for r in pii.redact(documents(rows), w).collect()}
    assert masked[3] == "mail [EMAIL] now" and masked[1] is None and masked[2] == "" and masked[4] == "clean text only"
    assert pii.redact(documents(rows), w).columns == documents(rows).columns
    empty = documents([])
    assert pii.find(empty, pii.train(empty, pii.Training(windows=60, epochs=1))).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    w = toxicity.train(docs, labels, toxicity.Training(docs=1500, epochs=6))
    got = toxicity.score(docs, w).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    hit = sum(r.toxic == 1 == r.predicted for r in got)
    assert hit / sum(r.predicted for r in got) > 0.85 and hit / sum(r.toxic for r in got) > 0.65


def test_toxicity_cases(spark, documents):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["fine", "good", "plain", "calm", "tree", "river", "stone", "cloud"])
    rows = [(k, " ".join(["vileword" if k % 3 == 0 and j == 40 else word() for j in range(90)])) for k in range(200)]
    rows += [(900, None), (901, ""), (902, "calm " * 30_000 + "vileword"), (900, None), (None, "calm tree")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)] + [(901, None)], "doc_id long, toxic int")
    w = toxicity.train(documents(rows), labels, toxicity.Training(epochs=5))
    got = {r.doc_id: r for r in toxicity.score(documents(rows), w).collect()}
    assert sum(got[k].predicted == int(k % 3 == 0) for k in range(200)) > 195
    assert got[902].predicted == 1 and got[901].predicted == got[900].predicted == 0 and got[None].held_out is False
    assert toxicity.score(documents(rows), w).count() == len(rows)
    assert toxicity.train(documents(rows), labels.limit(0)) is None
    assert toxicity.score(documents(rows), None).where("predicted = 0").count() == len(rows)
    assert toxicity.score(documents([]), w).count() == 0


def test_toxicity_training_rows(spark, documents, monkeypatch):
    got = []
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, docs, labels: got.append((sorted(b" ".join(d) for d in docs), len(labels))))
    t = toxicity.Training(docs=20, chars=50)
    assert toxicity.Training().docs == 6000
    ids = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5]
    labels = spark.createDataFrame([(k, k % 2) for k in ids] + [(k, 1) for k in range(1000, 1300)], "doc_id long, toxic int")
    rows = [(k, "long " * 40 if j % 4 else f"short text{k}") for j, k in enumerate(ids)]
    short = [(k, x) for k, x in rows if len(x) <= 50]
    assert len(short) > t.docs
    toxicity.train(documents(rows + [(k, f"a second{k}") for k, _ in short] * 3), labels, t)
    found, n = got[0]
    assert n == len(found) == t.docs and all(x.startswith(b"a second") for x in found)
