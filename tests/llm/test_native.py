"""Exact dedup, URL rules and mixing against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from routelab.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from routelab.llm.mixing import mix, mixed_documents, source_targets
from routelab.llm.url_rules import RULES, judge_urls
from tests.llm.cases import documents, edge_rows, prose


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _dedup(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[_norm(t)].append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[_norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(_norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hash_fn", [None, lambda t: F.length(t).cast("string").cast("binary"), lambda t: F.lit(b"same")])
def test_exact_duplicates(spark, hash_fn):
    """Also with hashes that collide: bytes decide."""
    df = exact_duplicates(documents(spark), rows_per_salt=2, **({"hash_fn": hash_fn} if hash_fn else {}))
    assert sorted((tuple(r) for r in df.collect()), key=str) == _dedup(edge_rows())
    assert "Python" not in _plan(df) and "Arrow" not in _plan(df)


def test_exact_empty(spark):
    assert exact_duplicates(documents(spark, [])).count() == 0
    assert drop_exact_duplicates(documents(spark, [])).count() == 0


def test_drop_exact(spark):
    docs = documents(spark)
    got = drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, _norm(r.text)) for r in got.collect())
    assert set(kept.values()) == {1}
    assert sorted(kept, key=str) == sorted({(i, _norm(t)) for (i, t, _), d in zip(edge_rows(), [None] * 99) if i == min((j for j, u, _ in edge_rows() if _norm(u) == _norm(t) and j is not None), default=None)}, key=str)


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/a", "https://www.example.com/en/x?q=1#f", "https://sub.www.example.com/en/", "http://example.com/de/", "http://a.example.com/en/?x",
        "http://notexample.com/en/x", "http://x.net/es/1", "http://net/fr/", "http://x.net", "http://x.net/", "http://foo.com", "http://foo.com?x/y", "http://user@www.example.com:80/en/", "x://y://z/",
        "http://É.COM/p", "http://.com/", "http://a..com/q", "http://example.com/en", "http://x.net/es/1", "http://" + ".".join("a" * 60) + ".com/" + "p" * 3000, "http://x.com/a\nb?c"]


def _judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [RULES, [], [("com", "/", "block"), ("com", "/a", "allow"), ("com", "/ab", "block"), ("x.com", "/", "allow"), ("x.com", "/aa/", "block"), ("net", "", "block"),
                                              ("net", "/es/1", "allow"), ("", "/en", "block")]])
def test_url_rules(spark, rules):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(0, None, "h", "p")], "page_id bigint, url string, host string, path string")
    df = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = sorted([(i, *_judge(u, rules)) for i, u in enumerate(URLS)] + [(0, *_judge(None, rules))], key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want
    assert "Python" not in _plan(df) and "Arrow" not in _plan(df)


def test_url_rules_random(spark):
    import random
    r = random.Random(5)
    seg = lambda n: "".join("/" + r.choice("ab") for _ in range(r.randint(0, n)))
    host = lambda: ".".join(r.choice("xyz") for _ in range(r.randint(1, 4)))
    rules = list({(host(), seg(3)): r.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host()}{seg(5)}" for _ in range(600)]
    df = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(tuple(x) for x in df.collect()) == sorted((i, *_judge(u, rules)) for i, u in enumerate(urls))


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, live = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and live:
        total = sum(w[s] for s in live)
        for s in live:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(live):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                live.discard(s)
    return target


def test_targets(spark):
    sizes = {None: 50, "a": 1000, "b": 3, "c": 0, "é": 400, "z": 77, "Z": 5000}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()}
    assert got == pytest.approx(_targets(sizes))


def _size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("fan_in", [3, 64])
def test_mix(spark, fan_in):
    rows = edge_rows() + [(100 + i, prose(i, 1 + (i * 37) % 200), f"s{i % 5}" if i % 3 else "hot") for i in range(400)]
    docs = documents(spark, rows)
    df = mix(docs, fan_in=fan_in)
    assert "Python" not in _plan(df) and "Arrow" not in _plan(df)
    got = [tuple(r) for r in df.collect()]
    assert sorted((g[0], g[3]) for g in got if g[0] is not None) == sorted((i, _size(t)) for i, t, _ in rows if i is not None)
    sizes, taken, cut = Counter(), Counter(), Counter()
    for _, _, source, size, source_size, target, n in got:
        sizes[source] += size
        taken[source] += n
        cut[source] += bool(size and n % size)
        assert 0 <= n <= 2 * size
    want = _targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 and cut[s] <= 1
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in mix(docs.repartition(7), fan_in=fan_in).collect())


def test_mix_is_unbiased(spark):
    """Over seeds, a document's mean share is that of its source."""
    docs = documents(spark, [(i, prose(i, 10 + i), "a" if i % 2 else "b") for i in range(24)])
    total = Counter()
    for seed in range(6):
        for r in mix(docs, seed=seed, fan_in=4).collect():
            total[r.source] += (r.taken / r.size - r.target / r.source_size) / (6 * 12)
    assert all(abs(x) < 0.1 for x in total.values())


def test_mixed_documents(spark):
    docs = documents(spark)
    marks = Counter()
    for r in mix(docs).collect():
        marks[r.doc_id, r.source] += r.taken
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r.doc_id, r.source] += _size(r.text)
    assert words == Counter({k: v for k, v in marks.items() if v})


def test_mix_empty(spark):
    assert mix(documents(spark, [])).count() == 0
    assert mixed_documents(documents(spark, [])).count() == 0
    assert {r.taken for r in mix(documents(spark, [(1, None, None), (2, " ", "a")])).collect()} == {0}
