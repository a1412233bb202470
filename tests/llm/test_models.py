"""Classifiers: held-out accuracy, folds, ties and empty tables."""

import math
import random
import zlib

import numpy as np
import pytest

from routelab.llm import quality, textbytes as tb, toxicity
from tests.llm.cases import documents, edge_rows, labels, prose


def _held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def _corpus(n=600):
    r = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        text, toxic, good = prose(i, r.randint(30, 150)), 0, 1
        if i % 6 == 0:
            w = text.split(" ")
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "you fool"]))
            text, toxic = " ".join(w), 1
        if i % 5 == 1:
            text, good = " ".join(x.upper() + "!!" for x in text.split(" ")), 0
        rows.append((10_000 + i, text, "s"))
        marks.append((10_000 + i, good, toxic))
    return rows, marks


@pytest.mark.parametrize("module,label,score", [(toxicity, 2, toxicity.score_toxicity), (quality, 1, quality.score_quality)])
def test_held_out(spark, module, label, score):
    rows, marks = _corpus()
    docs, lab = documents(spark, rows + edge_rows()), labels(spark, marks + [(None, 1, 1), (10_000, 1, 1)])
    got = {}
    df = score(docs, lab).collect()
    assert len(df) == len(rows) + len(edge_rows())
    for r in df:
        assert r.held_out == _held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if label == 2 else 0.3))
        got[r.doc_id] = r
    test = [m for m in marks if _held(m[0])]
    assert np.mean([got[m[0]].predicted == m[label] for m in test]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    rows, marks = _corpus(200)
    docs = documents(spark, rows)
    turned = [(i, 1 - q, 1 - t) if _held(i) else (i, q, t) for i, q, t in marks]
    for score in (toxicity.score_toxicity, quality.score_quality):
        a, b = ({r.doc_id: r.score for r in score(docs, labels(spark, m)).collect()} for m in (marks, turned))
        assert a == b


def test_same_text_same_score(spark):
    rows, marks = _corpus(200)
    docs = documents(spark, rows + [(90_000 + i, t, None) for i, t, _ in rows[:50]])
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = {r.doc_id: r.score for r in score(docs, labels(spark, marks)).collect()}
        assert all(got[90_000 + i] == pytest.approx(got[i], abs=1e-9) for i, _, _ in rows[:50])


def test_without_labels_or_documents(spark):
    docs = documents(spark)
    for score in (toxicity.score_toxicity, quality.score_quality):
        assert {r.score for r in score(docs, labels(spark, [])).collect()} == {0.5}
        assert score(documents(spark, []), labels(spark, [(1, 1, 1)])).count() == 0
    assert quality.keep_good(docs, labels(spark, [])).count() == len(edge_rows())


def test_keep_good(spark):
    rows, marks = _corpus()
    docs, lab = documents(spark, rows), labels(spark, marks)
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_quality(docs, lab).collect() if r.predicted}


def test_risk_is_not_negative():
    """With the prior too high the plain unbiased risk would fall below zero; the bound keeps the fit sane."""
    r = np.random.default_rng(1)
    pos, neg = r.normal(1, 1, (400, 3)), r.normal(-1, 1, (400, 3))
    unl = np.concatenate([r.normal(1, 1, (600, 3)), neg])
    edges, w, b = quality.fit_nnpu(pos.astype(np.float32), unl.astype(np.float32), 0.6)
    score = lambda x: w[quality.binned(x.astype(np.float32), edges) + np.arange(3) * quality.BINS].sum(1) + b
    assert np.isfinite(w).all() and (score(pos) > 0).mean() > 0.85 and (score(neg) < 0).mean() > 0.85
    p = 1 / (1 + np.exp(-score(unl)))
    assert p.mean() == pytest.approx(0.6, abs=0.01)


def test_ftrl_is_sparse():
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        y = i % 4 == 0
        rows.append((np.concatenate([[0], np.unique(np.concatenate([r.integers(10, 1000, 30), [5] if y else [6]]))]), int(y)))
    w = toxicity.ftrl(rows, 10, 1.0, 1.0, 3.0, 1.0, 5)
    assert w[5] > 1 and w.get(6, 0) < 0 and len(w) < 300


def test_features_do_not_depend_on_the_batch():
    texts = [t.encode() for _, t, _ in _corpus(40)[0]] + [b"", b"a", "é\n\n".encode()]
    together = quality.features(texts)
    alone = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(together, alone)
    d, f = toxicity.feature_ids(texts)
    for i, t in enumerate(texts):
        assert sorted(f[d == i].tolist()) == sorted(toxicity.feature_ids([t])[1].tolist())


def test_span_hashes():
    buf, starts = tb.joined([b"abc abc", b"abc"])
    b, e, d = tb.word_spans(buf, starts, tb.white_words())
    h = tb.Sums(buf, tb.byte_values()).of(b, e)
    assert d.tolist() == [0, 0, 1] and len(set(h.tolist())) == 1
    assert len(set(tb.Sums(buf, tb.byte_values()).of(b, e - 1).tolist()) | set(h.tolist())) == 2


def test_ftrl_equals_plain_python():
    """Weights of the vectorised learner against a coordinate at a time."""
    r = np.random.default_rng(6)
    rows = [(np.concatenate([[0], np.unique(r.integers(1, 40, 8))]), int(r.random() < 0.4)) for _ in range(120)]
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.6, 0.5, 3
    z, n = {}, {}

    def weight(i, pull):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= pull else -(x - math.copysign(pull, x)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)
    for _ in range(epochs):
        for ids, y in rows:
            w = {int(i): weight(int(i), 0.0 if i == 0 else l1) for i in ids}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, x in w.items():
                new = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(new) - math.sqrt(n.get(i, 0.0))) / alpha * x
                n[i] = new
    want = {i: weight(i, 0.0 if i == 0 else l1) for i in z}
    want = {i: w for i, w in want.items() if w}
    got = toxicity.ftrl(rows, 8, alpha, beta, l1, l2, epochs)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want) and len(got) < 41


def test_descent_equals_plain_python():
    """Adam on the non-negative risk, a row at a time; the prior is high enough that both branches of the bound occur."""
    r = np.random.default_rng(7)
    at_p, at_u = r.integers(0, 3, (15, 2)) + np.array([0, 3]), r.integers(0, 3, (25, 2)) + np.array([0, 3])
    prior, steps, rate, l2, size = 0.8, 60, 0.3, 1e-3, 6
    sig = lambda x: 1 / (1 + math.exp(-x))
    w, b, m, v, branches = [0.0] * size, 0.0, [0.0] * (size + 1), [0.0] * (size + 1), set()
    for t in range(1, steps + 1):
        fp, fu = [sum(w[c] for c in row) + b for row in at_p], [sum(w[c] for c in row) + b for row in at_u]
        negative = sum(math.log1p(math.exp(f)) for f in fu) / len(fu) - prior * sum(math.log1p(math.exp(f)) for f in fp) / len(fp)
        branches.add(negative >= 0)
        g = [l2 * x for x in w] + [0.0]
        for rows, f, push in ((at_p, fp, lambda x: prior * (sig(x) - 1) - (prior * sig(x) if negative >= 0 else 0)), (at_u, fu, lambda x: sig(x) if negative >= 0 else 0.0)):
            for row, x in zip(rows, f):
                for c in [*row, size]:
                    g[c] += push(x) / len(rows)
        for c in range(size + 1):
            m[c], v[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * v[c] + 0.001 * g[c] ** 2
            step = rate * (m[c] / (1 - 0.9 ** t)) / (math.sqrt(v[c] / (1 - 0.999 ** t)) + 1e-9)
            if c < size:
                w[c] -= step
            else:
                b -= step
    got = quality.descend(at_p, at_u, size, prior, steps, rate, l2)
    assert branches == {True, False}
    assert got[0] == pytest.approx(w, abs=1e-6) and got[1] == pytest.approx(b, abs=1e-6)


def test_edges_cover_all_rows(spark):
    """Quantile edges from bucket counts, next to exact quantiles; negative values and zeros keep their order."""
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(0, 5, 4000), r.random(4000), np.repeat([0.0, 1.0], 2000)]).astype(np.float32)
    table = spark.createDataFrame([(row.tolist(),) for row in x], "x array<float>")
    got = quality.corpus_edges(table, 16)
    for i in range(2):
        at = np.searchsorted(np.sort(x[:, i]), got[i]) / 4000
        assert np.abs(at - np.arange(1, 16) / 16).max() < 0.02
    assert got[2][0] > 0 and got[2][0] <= 1 and got[2][-1] > 1
    b = quality._buckets(np.array([-3.0, -0.5, -0.0, 0.0, 1e-9, 2.0], dtype=np.float32))
    assert (np.diff(b) >= 0).all() and b[2] == b[3]
