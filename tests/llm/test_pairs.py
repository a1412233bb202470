"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from routelab.llm.components import components
from routelab.llm.jaccard import bands_for, drop_near_duplicates, link_counts, near_duplicates
from routelab.llm.repeats import cut_repeats
from tests.llm.cases import documents, edge_rows, prose


def _grams(t, n=5):
    w = [x for x in t.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _near(rows, threshold=0.8):
    least = -(1 << 63)
    copies = defaultdict(list)
    for i, t, *_ in rows:
        copies[t or ""].append(least if i is None else i)
    texts = list(copies)
    sets = [_grams(t) for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    group = defaultdict(lambda: 1 << 62)
    for k, t in enumerate(texts):
        group[find(k)] = min(group[find(k)], *copies[t])
    null = lambda x: None if x == least else x
    return sorted(((null(i), null(min(copies[t])), len(copies[t]), links[k], null(group[find(k)])) for k, t in enumerate(texts) for i in copies[t]), key=str)


def _varied(seed, n, edits):
    r = random.Random(seed)
    base = prose(seed, n).split(" ")
    for _ in range(edits):
        base[r.randrange(n)] = f"new{r.random()}"
    return " ".join(base)


def near_rows():
    r = random.Random(3)
    rows = edge_rows()
    for g in range(12):
        for k in range(r.randint(2, 6)):
            w = prose(50 + g, 150).split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(150)] = f"x{r.random()}"
            rows.append((1000 + 10 * g + k, " ".join(w), "s"))
    base = prose(99, 200).split(" ")
    for k in range(150):  # one hot group
        w = list(base)
        w[k] = f"hot{k}"
        rows.append((5000 + k, " ".join(w), "hot"))
    rows += [(6000 + k, base[0], "one word") for k in range(3)]
    return rows


@pytest.mark.parametrize("block_grams", [1 << 20, 2000])
def test_near_duplicates(spark, block_grams):
    """Small blocks cut the hot group into many block pairs."""
    rows = near_rows()
    got = near_duplicates(documents(spark, rows), block_grams=block_grams)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _near(rows)


def test_drop_near(spark):
    rows = near_rows()
    docs = documents(spark, rows)
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted({str(i) for i, _, _, _, g in _near(rows) if i == g})


def test_near_empty(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert drop_near_duplicates(documents(spark, [])).count() == 0


def test_bands():
    assert 1 - (1 - 0.8 ** 5) ** bands_for(0.8, 0.9995, 5) >= 0.9995 > 1 - (1 - 0.8 ** 5) ** (bands_for(0.8, 0.9995, 5) - 1)


def test_link_counts_tiles():
    """More classes than a tile and more grams than a column chunk."""
    r = np.random.default_rng(0)
    base = np.arange(9000)
    sets = [np.setdiff1d(base, r.integers(0, 9000, r.integers(0, 1500))) for _ in range(600)]
    cids, side = np.arange(600), np.arange(600) % 2
    m = np.zeros((600, 9000), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, s] = 1
    inter, n = m @ m.T, m.sum(1)
    ok = (inter >= 0.8 * (n[:, None] + n[None] - inter) - 1e-6) & ~np.eye(600, dtype=bool)
    assert (link_counts(cids, side, sets, 0.8, True)[0] == ok.sum(1)).all()
    assert (link_counts(cids, side, sets, 0.8, False)[0] == (ok & (side[:, None] != side[None])).sum(1)).all()


def test_link_counts_memory():
    """Many short near copies: the intersections of all pairs of classes are never held at once."""
    m = 5000
    sets = [np.concatenate([np.arange(60), [1000 + i]]) for i in range(m)]
    tracemalloc.start()
    links, root = link_counts(np.arange(m), np.zeros(m, dtype=int), sets, 0.8, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == m - 1).all() and (root == 0).all()
    assert peak < m * m / 2 * 4


def test_blocks_are_bounded_by_classes(spark):
    """The hot group of short texts is cut by its number of classes; the links stay whole."""
    rows = near_rows()
    got = near_duplicates(documents(spark, rows), block_classes=40)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _near(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, 103), (103, 101), (200, 200), (300, 299)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 101: 100, 103: 100, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _cut(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(xxhash.xxh3_128_intdigest(t[p:p + length]) for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone, end = bytearray(len(t)), 0
        for p in range(len(t) - length + 1):
            if seen[xxhash.xxh3_128_intdigest(t[p:p + length])] > 1:
                for j in range(max(end, p), p + length):
                    gone[j] = 1
                end = p + length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    """Passages of many lengths around the threshold, at document edges, overlapping, inside one document, and one in very many documents."""
    r = random.Random(8)
    shared = [prose(200 + k, 200).encode().decode() for k in range(6)]
    rows = []
    for k in range(60):
        parts = [prose(300 + k, r.randint(0, 60))]
        for _ in range(r.randint(1, 3)):
            s = r.choice(shared)
            a, n = r.randint(0, 300), r.choice([60, 399, 400, 401, 500, 640])
            parts += [s[a:a + n], prose(1000 + 7 * k, r.randint(0, 30))]
        rows.append((20_000 + k, " ".join(parts), "s"))
    twice = prose(77, 120)
    return rows + [(1, twice + " mid " + twice, "self"), (2, "ab" * 600, "period"), (3, prose(5, 61)[:400], "edge"), (4, prose(5, 61)[:400], "edge"), (5, "é" * 250, "utf"), (6, "xé" + "é" * 230, "utf")]


@pytest.mark.parametrize("length,gram,block", [(400, 100, 32), (64, 16, 8)])
def test_cut_repeats(spark, length, gram, block):
    rows = repeat_rows() + [x for x in edge_rows() if x[0] not in (8, 9)]
    got = cut_repeats(documents(spark, rows), length=length, gram=gram, block=block)
    found = [tuple(r) for r in got.collect()]
    assert sorted((g[:5] for g in found), key=str) == _cut(rows, length)
    assert all(sum(s.end - s.start for s in g[5]) == g[2] for g in found)


def test_cut_long_text(spark):
    long = prose(1, 30_000)
    got = {r.doc_id: r.n_removed for r in cut_repeats(documents(spark, [(1, long, "a"), (2, long[5000:9000], "a"), (3, "own " + prose(9, 300), "b")])).collect()}
    assert got == {1: 4000, 2: 4000, 3: 0}


def test_cut_empty(spark):
    assert cut_repeats(documents(spark, [])).count() == 0
