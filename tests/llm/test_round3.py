"""WARC archives, filter audit and hard negatives against plain Python."""

import base64
import gzip
import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from routelab.llm import audit, negatives, warc
from tests.llm.cases import edge_rows, labels, prose


# WARC

def _pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, k string, shard int")


PAGES = [(i, f"http://x/{i % 7} a", prose(i % 5, 40)) for i in range(30)] + [(100, None, None), (101, "", ""), (102, "http://é\r\nX: y", "日本"), (None, "u", prose(1, 40)), (None, None, "only null"), (None, "z", "only null"),
                                                                            (7, "http://x/0 a", prose(2, 40)), (2**60 + 1, "u", "big"), (2**60 + 2, "u", "big"), (-5, "v", "y" * 300_000)]


def _expect(rows, least=0):
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(i)
    out, seen = [], Counter()
    for i, _, t in rows:
        data = (t or "").encode()
        last = max((x for x in groups[t or ""] if x is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        seen[i, t or ""] += 1
        first = len(data) < least or (i == last and seen[i, t or ""] == 1)
        out.append((i, len(data), digest, "response" if first else "revisit", None if first else last))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,file_bytes", [(0, 1 << 20), (10, 400), (10**6, 1)])
def test_archives_read_back(spark, tmp_path, least, file_bytes):
    path = f"{tmp_path}/w"
    manifest = warc.write_archives(_pages(spark, PAGES), path, min_revisit=least, shard_bytes=4000, file_bytes=file_bytes)
    rows = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == _expect(PAGES, least)
    texts = Counter((i, (t or "").encode()) for i, _, t in PAGES)
    assert all(texts[r.page_id, bytes(r.payload)] for r in rows if r.record_type == "response")
    files = sorted(manifest.collect())
    assert sum(f.records for f in files) == len(PAGES)
    assert {f.file for f in files} == {f for f in os.listdir(path) if f.startswith("shard")} and not os.path.exists(f"{path}/_temporary")
    for f in files:
        data = open(f"{path}/{f.file}", "rb").read()
        assert len(data) == f.bytes and hashlib.sha256(data).hexdigest() == f.sha256 and (f.records == 1 or len(data) <= file_bytes)
        records = list(warc.parse_records(gzip.open(f"{path}/{f.file}")))
        assert records[0][0]["warc-type"] == "warcinfo" and len(records) == f.records + 1
        assert all({"warc-record-id", "warc-date", "content-length"} <= h.keys() for h, _ in records)
    with pytest.raises(FileExistsError):
        warc.write_archives(_pages(spark, PAGES), path)


def test_archives_do_not_depend_on_the_cluster(spark, tmp_path):
    """Shuffled rows, other partitions: the same files, byte for byte."""
    mixed = random.Random(3).sample(PAGES, len(PAGES))
    a = warc.write_archives(_pages(spark, PAGES), f"{tmp_path}/a", shard_bytes=3000, file_bytes=900)
    b = warc.write_archives(_pages(spark, mixed).repartition(7), f"{tmp_path}/b", shard_bytes=3000, file_bytes=900)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 5


def test_damage_is_seen(spark, tmp_path):
    path = f"{tmp_path}/w"
    name = warc.write_archives(_pages(spark, PAGES[:5]), path).first().file
    with gzip.open(f"{path}/{name}") as f:
        data = f.read()
    with gzip.open(f"{path}/{name}", "wb") as f:
        f.write(data.replace(b"the", b"eht", 1))
    with pytest.raises(Exception, match="digest|manifest|record"):
        warc.read_archives(spark, path).collect()


def test_record_references(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(_pages(spark, PAGES), path)
    heads = [h for f in os.listdir(path) if f.startswith("shard") for h, _ in warc.parse_records(gzip.open(f"{path}/{f}"))]
    ids = Counter(h["warc-record-id"] for h in heads)
    assert set(ids.values()) == {1}
    responses = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    for h in heads:
        if h["warc-type"] == "revisit":
            assert responses[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"] and h["warc-profile"] == warc.PROFILE


def test_archives_of_no_pages(spark, tmp_path):
    assert warc.write_archives(_pages(spark, []), f"{tmp_path}/w").count() == 0
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0


# filter audit

def _audit(rows, marks):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    known = defaultdict(lambda: [0, 0])
    for i, q, t in marks:
        if i is not None:
            known[i] = [known[i][0] or int(q == 1), known[i][1] or int(t == 1)]
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", key(i)), key(i))
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = words(t)
        bad = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), key(i) > least[t]]
        fails.append((part or "", bad, *(known[i] if i is not None else (0, 0))))
    out = []
    for part in {f[0] for f in fails}:
        mine, lines, total = [f for f in fails if f[0] == part], [], Counter()
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                kept = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                lines.append((f, [part, "".join("ABCDE"[x] for x in order), step, len(kept), len(gone), sum(x[1][f] for x in mine) - len(gone),
                                  sum(x[1] == [k == f for k in range(5)] for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]))
                left = kept
        out += [(*line, total[f]) for f, line in lines]
    return sorted(out)


def _filter_docs(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "c") for r in rows], "doc_id bigint, text string, lang string, h string, fails int, copied string")


def test_audit(spark):
    r = random.Random(5)
    texts = [prose(i, r.choice([20, 99, 100, 150])) + r.choice(["", " #", " $x"]) for i in range(40)] + [t.upper() for t in (prose(1, 120), prose(2, 20))] + [" ".join(f"w{i}" for i in range(130)) + x for x in ("", "", " é|")]
    rows = [(i, t, r.choice(["en", "fr", None, ""])) for i, t in enumerate(texts + texts[:25])] + [(i, t, s) for i, t, s in edge_rows()]
    marks = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(50)] + [(3, 1, 1), (None, 1, 1), (5, None, None)]
    got = audit.audit_filters(_filter_docs(spark, rows), labels(spark, marks))
    assert sorted(tuple(x) for x in got.collect()) == _audit(rows, marks)
    assert got.count() == len({s or "" for _, _, s in rows}) * 600


def test_audit_empty(spark):
    assert audit.audit_filters(_filter_docs(spark, []), labels(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 4097])
def test_positional_popcount(n):
    w = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert audit.positional_popcount(w).tolist() == [int((w >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_shapley_adds_up():
    """Over all orders a filter's removals are its Shapley value times the number of orders; together they are all removals."""
    n = np.random.default_rng(0).integers(0, 50, 32)
    survivors = np.array([sum(int(n[m]) for m in range(32) if not m & s) for s in range(32)])
    rows = list(audit.report_rows("x", survivors, survivors, survivors))
    by = {r[1][r[2] - 1]: r[-1] for r in rows}
    assert sum(by.values()) == math.factorial(5) * int(survivors[0] - survivors[31])
    assert all(by[f] == sum(r[4] for r in rows if r[1][r[2] - 1] == f) for f in "ABCDE")


# hard negatives

def _mine(rows, scale=256.0, k=5, low=80, high=100):
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -2**63)
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in ok if i % 10 == 0}:
        scores = sorted((-dot(v, w), j, m) for j, m, w in ok if j != i)
        for s, j, _ in [x for x in scores if x[2] == lab][:k]:
            fit = [x for x in scores if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id bigint, label int, embedding array<double>, h int, cell string")


def _clusters(seed, n, size=8, copies=0.0):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (6, size))
    rows = [(i, int(r.integers(0, 3)), (middle[r.integers(0, 6)] + r.normal(0, 0.3, size)).round(3).tolist()) for i in range(n)]
    return [(i, lab, rows[3][2] if r.random() < copies else v) for i, lab, v in rows]


@pytest.mark.parametrize("rows,index", [(_clusters(1, 400), {"rows_per_cell": 50, "leaf": 8}), (_clusters(2, 300, copies=0.4), {"rows_per_cell": 40, "leaf": 4, "group_rows": 32}),
                                        (_clusters(3, 60), {"leaf": 200}), (_clusters(4, 200), {"rows_per_cell": 20, "leaf": 6, "sample": 16, "chunk": 5})])
def test_hard_negatives(spark, rows, index):
    rows = rows + [(None, 1, [1.0] * 8), (5000, None, [1.0] * 8), (5001, 1, None), (5002, 1, [1.0, None]), (5003, 1, [float("nan")] * 8), (5004, 2, [float("inf")]), (5010, 1, []), (5020, 2, [0.5]), (5030, 77, [1.0] * 8)]
    got = negatives.hard_negatives(_vectors(spark, rows), F.col("vec_id") % 10 == 0, **index)
    assert sorted(tuple(r) for r in got.collect()) == _mine(rows)


def test_hard_negatives_repeats_and_size(spark):
    """Repeated rows are candidates each; an equal anchor is one; scores beyond doubles are exact, those beyond 64 bits count as the end of the range."""
    rows = _clusters(5, 50) + _clusters(5, 50)[:20] + [(60, 1, [1e9] * 8), (61, 1, [1e9] * 8), (62, 2, [1e9] * 7 + [1e9 - 1 / 256]), (63, 2, [9e8] * 8), (70, 1, [-1e9] * 8), (71, 1, [3e6 + 1 / 256] * 8), (80, 2, [3e6] * 8)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(_vectors(spark, rows), F.col("vec_id") % 10 == 0, rows_per_cell=20, leaf=8).collect())
    assert got == _mine(rows)


def test_hard_negatives_without_pairs(spark):
    always = F.lit(True)
    assert negatives.hard_negatives(_vectors(spark, []), always).count() == 0
    assert negatives.hard_negatives(_vectors(spark, [(1, 1, [1.0])]), always).count() == 0
    assert negatives.hard_negatives(_vectors(spark, [(1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [-1.0])]), always).count() == 0


def test_anchors_travel_per_bundle_and_some_at_a_time(spark, monkeypatch):
    """Where no bound excludes a cell, an anchor's copies count bundles of cells, and no frame holds more than some anchors' copies."""
    r = np.random.default_rng(11)
    x = r.normal(0, 1, (1500, 24))
    rows = [(i, int(r.integers(0, 4)), v) for i, v in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).round(4).tolist())]
    got = negatives.hard_negatives(_vectors(spark, rows), F.col("vec_id") % 10 == 0, rows_per_cell=8, leaf=8, chunk=60)
    assert sorted(tuple(g) for g in got.collect()) == _mine(rows)
    forest = negatives.Forest(negatives.usable_rows(_vectors(spark, rows), "vec_id", "label", "embedding"), 256.0, rows_per_cell=8)
    trees = forest.trees.count()
    assert (forest.radius >= 0).sum() >= 150 and 16 <= trees <= 50
    anchors = pd.DataFrame([(i, 0, lab, np.array(v), np.array([-(1 << 63)]), np.array([(1 << 63) - 1])) for i, lab, v in rows[::5]], columns=["anchor_id", "h", "label", "v", "lows", "highs"])
    monkeypatch.setattr(negatives, "COPIES", 2000)
    sent = {near: list(forest.router(near)(iter([anchors]))) for near in (True, False, None)}
    assert all(len(b) <= 2000 for frames in sent.values() for b in frames)
    copies = {near: [k for b in frames for k in zip(b["anchor_id"].tolist(), b["bundle"].tolist())] for near, frames in sent.items()}
    assert sorted(copies[None]) == sorted(copies[True] + copies[False]) == [(i, b) for i in range(0, 1500, 5) for b in range(trees)]


def test_bounds_hold():
    """Every inner product below a node lies inside its interval; radii cover."""
    r = np.random.default_rng(9)
    x = np.floor(256 * r.normal(0, 1, (700, 6)))
    t = negatives.Tree.load(negatives.Tree.build(x, np.arange(700), r.integers(0, 4, 700), leaf=9).dump())
    a = np.floor(256 * r.normal(0, 1, (5, 6)))
    low, high = t.bounds(a)
    spans = {}
    for node in reversed(range(len(t.radius))):
        first, last = t.child[node]
        spans[node] = t.row[node] if first == last else [min(spans[c][0] for c in range(first, last)), max(spans[c][1] for c in range(first, last))]
        if first == last:
            s = a @ t.points[spans[node][0]:spans[node][1]].T
            assert (s.min(1) >= low[:, node]).all() and (s.max(1) <= high[:, node]).all()
        else:
            assert all((high[:, c] <= high[:, node] + 1e12).all() for c in range(first, last))
    assert sorted(t.ids.tolist()) == list(range(700))
