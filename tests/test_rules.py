"""Rules that the large queries do not pin down: small fixtures, brute force, invariants and plans."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelab import scale
from routelab.operators import cascade, decisions, neighbors, pool, routers, shapes, splits, stats, tradeoffs, training
from routelab.plans import views as V
from routelab.plans.summary import summary_table
from routelab.sources import prompts, runs

L = F.lit


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def plan(df):
    return df._jdf.queryExecution().toString()


# ranks

@pytest.mark.parametrize("parts", [1, 16])
def test_ordered_rank_does_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise("cold").alias("g"), ((F.col("id") * 7919) % 1000).alias("x"))
    got = scale.ordered_rank(df.repartition(parts), ["g"], ["x"]).collect()
    for g in ("hot", "cold"):
        r = sorted((x["x"], x["rn"]) for x in got if x["g"] == g)
        assert [n for _, n in r] == list(range(1, len(r) + 1))


@pytest.mark.parametrize("parts", [1, 16])
def test_shuffled_rank_is_a_permutation_and_keeps_null_groups(spark, parts):
    df = spark.range(500).select(F.when(F.col("id") < 300, "a").alias("g"), "id").repartition(parts)
    got = scale.shuffled_rank(df, ["g"], ["id"], 42).collect()
    assert sorted(r["rn"] for r in got if r["g"] == "a") == list(range(1, 301))
    assert sorted(r["rn"] for r in got if r["g"] is None) == list(range(1, 201))
    again = {(r["id"], r["rn"]) for r in scale.shuffled_rank(df.repartition(3), ["g"], ["id"], 42).collect()}
    assert again == {(r["id"], r["rn"]) for r in got}


def test_hot_group_is_not_sorted_in_one_task(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("g"), "id")
    r = scale.shuffled_rank(df, ["g"], ["id"], 1)
    sizes = r.groupBy(F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in sizes) < 60_000


# splits

@pytest.mark.parametrize("n,parts", [(60, (42, 6, 12)), (198, (138, 19, 41)), (500, (350, 50, 100)), (1055, (738, 105, 212))])
def test_sequential_split_sizes(spark, n, parts):
    e = spark.range(n).select(F.lit("t").alias("task_id"), F.col("id").alias("record_index"))
    c = {r["part"]: r["count"] for r in splits.split_sequential(e).groupBy("part").count().collect()}
    assert (c["train"], c["val"], c["test"]) == parts


def test_prompt_split_is_disjoint_covering_and_ood_is_test(spark):
    r = spark.range(200).select(F.when(F.col("id") % 2 == 0, "in").otherwise("ood").alias("dataset_id"), (F.col("id") % 50).cast("string").alias("prompt"), "id")
    s = splits.split_by_prompt(r, 0.7, 42, ["ood"])
    assert s.count() == 200
    per = s.groupBy("dataset_id", "prompt").agg(F.countDistinct("is_train").alias("k"), F.max("is_train").alias("t")).collect()
    assert all(x["k"] == 1 for x in per) and not any(x["t"] for x in per if x["dataset_id"] == "ood")
    assert sum(x["t"] for x in per if x["dataset_id"] == "in") == int(25 * 0.7)
    with pytest.raises(ValueError):
        splits.split_by_prompt(r, 1.0)


# statistics

def facts(spark, data):
    return spark.createDataFrame([(d, "test", m, i, f"{d}{i}", s, c, 1, 1) for d, m, i, s, c in data],
                                 "dataset_id string, split string, model_name string, record_index long, prompt string, score double, cost double, prompt_tokens long, completion_tokens long")


def test_summary_rules_for_max_expert(spark):
    r = facts(spark, [("d1", "a", 1, 1.0, 2.0), ("d1", "b", 1, 0.0, 1.0), ("d2", "a", 1, 0.0, 2.0), ("d2", "b", 1, 1.0, 1.0), ("d2", "ref", 1, 1.0, 9.0)])
    perf, cost = summary_table(r, ood_datasets=["d2"], reference_models=["ref"])
    p = {x["row_name"]: x for x in perf.collect()}
    c = {x["row_name"]: x for x in cost.collect()}
    assert list(p) == ["a", "b", "AVG", "Random Router", "Max Expert", "Oracle", "ref"]
    assert p["Max Expert"]["Dataset-Avg"] == 1.0 and p["AVG"]["Dataset-Avg"] == 0.5
    assert c["Max Expert"]["Dataset-Sum"] == 4.0 and c["Oracle"]["Dataset-Sum"] == 3.0
    assert p["ref"]["In-Dist-Avg"] is None and p["ref"]["OOD-Avg"] == 1.0 and p["ref"]["In-Dist-Sample-Avg"] == 0.0


def test_bounds_hold(spark, sf):
    r = V.dense(spark, sf)
    o = {x["dataset_id"]: x["oracle_accuracy"] for x in stats.oracle_accuracy(r).collect()}
    b = {x["dataset_id"]: x["avg_score"] for x in stats.best_model_per_dataset(r).collect()}
    assert all(o[d] >= b[d] for d in b)


def test_one_scan_is_jvm_only_and_pruned(spark, sf):
    text = plan(stats.stats_by_dataset_model(V.recs(spark, sf)))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "l_partkey" not in text.split("== Physical Plan ==")[1]


def test_quantiles_match_numpy(spark):
    rng = random.Random(1)
    xs = [rng.randint(0, 50) / 10 for _ in range(333)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["prob"]: r["quantile"] for r in stats.exact_quantiles(df, [], "x", [0.0, 0.25, 0.333, 1.0]).collect()}
    assert all(abs(got[p] - np.quantile(xs, p)) < 1e-12 for p in got) and len(got) == 4


# joins

def test_pareto_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(g, i, float(rng.randint(0, 12)), float(rng.randint(0, 12))) for g in "xy" for i in range(60)]
    df = spark.createDataFrame(pts, "g string, id long, cost double, acc double")
    want = sorted((g, i) for g, i, c, a in pts if not any(
        h == g and b >= a and e <= c and (b > a or e < c) for h, _, e, b in pts))
    assert rows(tradeoffs.pareto_join(df, "cost", "acc", ["g"]), "g", "id") == want


@pytest.mark.parametrize("pivots,block,chunk", [(1, 1000, 1000), (8, 16, 7), (40, 4, 50)])
def test_knn_equals_brute_force_with_a_third_of_copies(spark, pivots, block, chunk):
    rng = np.random.default_rng(5)
    tr = rng.normal(size=(120, 6))
    tr[:40] = tr[0]
    te = np.vstack([rng.normal(size=(20, 6)), tr[:2]])
    a = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(te)], "test_id long, embedding array<double>")
    b = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(tr)], "train_id long, embedding array<double>")
    got = rows(neighbors.knn_join(a, b, 9, pivots=pivots, block=block, chunk=chunk), "test_id", "rank", "train_id")
    want = []
    for i, q in enumerate(te):
        d = np.sqrt(((tr - q) ** 2).sum(1))
        want += [(i, k + 1, int(j)) for k, j in enumerate(np.argsort(d, kind="stable")[:9])]
    assert got == sorted(want)


@pytest.mark.parametrize("spread,block,bundle", [(1.0, 50, 300), (0.01, 50, 300), (1.0, 4096, 16384), (0.01, 7, 20)])
def test_knn_queries_travel_once_per_bundle(spark, monkeypatch, spread, block, bundle):
    """Where no bound excludes a cell a query is sent once per bundle of cells, and the partitions follow the rows."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 16))
    tr, te = (middle[rng.integers(0, 12, n)] * (spread < 1) + spread * rng.normal(size=(n, 16)) for n in (900, 60))
    a = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(te)], "test_id long, embedding array<double>")
    b = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(tr)], "train_id long, embedding array<double>")
    sent, keep = [], neighbors.stable
    monkeypatch.setattr(neighbors, "stable", lambda df: (sent.append(out := keep(df)), out)[1])
    monkeypatch.setattr(neighbors, "TASK_BYTES", 4096, raising=False)
    got = neighbors.knn_join(a, b, 5, block=block, bundle=bundle)
    want = []
    for i, q in enumerate(te):
        d = np.sqrt(((tr - q) ** 2).sum(1))
        want += [(i, k + 1, int(j)) for k, j in enumerate(np.argsort(d, kind="stable")[:5])]
    assert rows(got, "test_id", "rank", "train_id") == sorted(want)
    visits = next(x for x in sent if "test_id" in x.columns).count()
    assert visits <= 60 * (90 if bundle == 20 else 10)
    asked = [int(x.split(")")[0].split(",")[-1]) for x in plan(got).split("hashpartitioning(")[1:] if "REPARTITION_BY_NUM" in x.split("\n")[0]]
    assert asked and min(asked) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_knn_with_fewer_rows_than_k(spark):
    a = spark.createDataFrame([(1, [0.0, 0.0])], "test_id long, embedding array<double>")
    b = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "train_id long, embedding array<double>")
    assert rows(neighbors.knn_join(a, b, 131), "train_id", "rank") == [(1, 1), (2, 2)]


def test_grid_keeps_the_last_of_repeated_rows(spark):
    r = facts(spark, [("d", "a", 1, 0.0, 1.0), ("d", "b", 2, 1.0, 3.0)]).withColumn("run_no", F.lit(1))
    r = r.unionByName(facts(spark, [("d", "a", 1, 1.0, 2.0)]).withColumn("run_no", F.lit(2)))
    g = shapes.complete_grid(r, order=["record_index", "run_no"])
    assert rows(g, "prompt", "model_name", "score", "cost", "filled") == [
        ("d1", "a", 1.0, 2.0, False), ("d1", "b", 0.0, 0.0, True), ("d2", "a", 0.0, 0.0, True), ("d2", "b", 1.0, 3.0, False)]
    assert "CartesianProduct" not in plan(g) and "NestedLoop" not in plan(g)


def test_missing_candidates_and_descriptions_raise(spark):
    c = spark.createDataFrame([(1, [("a", "greedy")])], "id long, candidates array<struct<model:string,decoding_method:string>>")
    with pytest.raises(Exception, match="candidates missing"):
        shapes.filter_candidates(c, ["a", "b"]).collect()
    with pytest.raises(ValueError, match="no description"):
        shapes.lookup_descriptions(spark.createDataFrame([("x",)], "task_id string"), spark.createDataFrame([("y", "t")], "task_id string, task_description string"), "task_id")


# training sets

@pytest.mark.parametrize("top_k", [3, 10, 64])
def test_negatives_are_complete_and_distinct(spark, top_k):
    p = spark.createDataFrame([("d", f"p{i}", i, [0.0, 0.5, 1.0, 1.0, 1.0][i % 5]) for i in range(30)] + [("e", "only", 1, 0.5)],
                              "dataset_id string, prompt string, record_index long, accuracy double")
    acc = {r["prompt"]: r["accuracy"] for r in p.collect()}
    got = training.stratified_negatives(p, p, top_k).collect()
    for a in (x for x in acc if x != "only"):
        mine = [r["negative"] for r in got if r["anchor"] == a]
        others = [x for x in acc if x != "only" and acc[x] != acc[a]]
        assert len(mine) == len(set(mine)) == min(top_k, len(others))
        assert all(acc[m] != acc[a] for m in mine)
    assert not any(r["anchor"] == "only" for r in got)


def test_positive_pairs_per_group(spark):
    p = spark.createDataFrame([("d", f"p{i}", i, 0.5) for i in range(10)], "dataset_id string, prompt string, record_index long, accuracy double")
    assert training.positive_pairs(p, 3).count() == sum(min(3, 9 - i) for i in range(10))
    assert training.positive_pairs(p, 0).count() == 0


# decisions

def test_pairwise_report_reproduces_published_counts(spark):
    # published totals: 3858 pairs, 1058 decisive, 728 routed right, 757 decisive and 2326 all selected right
    ties = [("tie", 1.0)] * (2326 - 757) + [("tie", 0.0)] * (2800 - (2326 - 757))
    data = [("d", "tie", s, s, 0.9) for _, s in ties]
    data += [("d", "model_a", 1.0, 0.0, 0.9)] * 728 + [("d", "model_b", 0.5, 1.0, 0.9)] * 29 + [("d", "model_b", 0.0, 1.0, 0.9)] * 301
    df = spark.createDataFrame(data, "dataset_id string, winner string, score_model_a double, score_model_b double, winrate double").withColumns(
        {"cost_model_a": F.lit(0.1), "cost_model_b": F.lit(0.01)})
    r = decisions.pairwise_report(df).where("level = 'all'").first()
    assert (r["n"], r["n_decisive"], r["n_ties"]) == (3858, 1058, 2800)
    assert abs(r["selection_accuracy"] - 2326 / 3858) < 1e-12 and abs(r["routing_accuracy"] - 728 / 1058) < 1e-12
    assert abs(r["selection_accuracy_decisive"] - 757 / 1058) < 1e-12 and r["winrate_std"] < 1e-6


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int")
    assert decisions.auc(df, "p", "y").first()["auc"] is None


# cascades

def cascade_rows(spark, n=60, models=("a", "b", "c")):
    rng = random.Random(11)
    return [("d", f"s{i}", m, rng.randint(0, 1), rng.randint(1, 99) / 100, (j + 1) / 100) for i in range(n) for j, m in enumerate(models)]


def test_cascade_search_equals_brute_force(spark):
    data = cascade_rows(spark)
    df = spark.createDataFrame(data, "dataset_id string, sample_id string, model_name string, label int, probability double, cost double")
    budget, grid = 0.035, 4
    qs = [1e-5 + (1 - 2e-5) * i / (grid - 1) for i in range(grid)]
    by = {}
    for _, s, m, y, p, c in data:
        by.setdefault(s, {})[m] = (y, 1 - p, c)
    best = -1
    for o in itertools.permutations("abc", 3):
        for q in itertools.product(qs, repeat=2):
            if q[0] > q[1]:
                continue
            left, thr = list(by.values()), []
            for st in range(2):
                ds = [x[o[st]][1] for x in left]
                thr.append(float(np.quantile(ds, 1 - q[st])) if ds else 1.0)
                left = [x for x in left if x[o[st]][1] >= thr[-1]]
            hit = cost = 0.0
            for x in by.values():
                paid = 0.0
                for m, t in zip(o, [*thr, 1.0]):
                    paid += x[m][2]
                    if x[m][1] < t:
                        hit, cost = hit + x[m][0], cost + paid
                        break
            if cost <= budget * len(by) and sum(x[o[0]][2] for x in by.values()) <= budget * len(by):
                best = max(best, hit / len(by))
    got = cascade.cascade_search(df, budget, 3, grid=grid)
    assert abs(got.accuracy - best) < 1e-12
    used = cascade.run_cascade(df, got).agg(F.sum("cum_cost")).first()[0]
    assert used <= budget * len(by) + 1e-9


def test_cascade_falls_back_to_the_last_available(spark):
    df = spark.createDataFrame([("d", "s", "a", 0, 0.1, 1.0), ("d", "s", "b", 1, 0.0, 2.0)], "dataset_id string, sample_id string, model_name string, label int, probability double, cost double")
    r = cascade.run_cascade(df, cascade.Strategy(["a", "b", "c"], [0.2, 0.2, 1.0])).first()
    assert (r["model_name"], r["label"], r["cum_cost"]) == ("b", 1, 3.0)
    assert cascade.cascade_search(df, 0.5, 1) is None


def test_cascade_searches_every_order(spark):
    """19 models at depth 3 have 5,814 orders; only one of them is good, and a sample without its last model is left out."""
    names = [f"m{i:02d}" for i in range(19)]
    rows = []
    for k in range(4):
        for m in names:
            good = m == {0: "m17", 1: "m03"}.get(k, "m11")
            rows.append(("d", f"s{k}", m, int(good), 0.9 if good else 0.1, 1.0))
    df = spark.createDataFrame(rows, "dataset_id string, sample_id string, model_name string, label int, probability double, cost double")
    assert cascade._routes(df, 3, None).select("order").distinct().count() == 19 * 18 * 17
    got = cascade.cascade_search(df, 100.0, 3, grid=2)
    assert sorted(got.order) == ["m03", "m11", "m17"] and got.accuracy == 1.0
    assert cascade.cascade_search(df, 100.0, 3, order=["m17", "nobody", "m03", "m11"], grid=2).order == ["m17", "m03", "m11"]


def test_upsampling_has_one_rule(spark):
    rows = [(i, i < 3, 3 <= i < 10) for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, a boolean, b boolean")
    for major, minor, n in (("a", "b", 3), ("b", "a", 7)):
        got = splits.upsample_minority(df, major, minor, "id")
        assert got.where(major).count() == n and got.where(minor).count() == n and got.count() == 2 * n
    assert splits.upsample_minority(df.where("not a"), "b", "a", "id").count() == 7


def test_fingerprint_tells_rows_apart(spark):
    make = lambda rows: runs.fingerprint(spark.createDataFrame([("d", "t", *r) for r in rows], "dataset_id string, split string, x string, y string")).first()["fingerprint"]
    prints = [make([r]) for r in (("a\u001fb", "c"), ("a", "b\u001fc"), (None, "c"), ("null", "c"), ("", "c"))]
    assert len(set(prints)) == 5
    assert make([("a", "b"), ("c", "d")]) == make([("c", "d"), ("a", "b")])


def test_latest_run_keeps_null_keys(spark):
    df = spark.createDataFrame([("d", None, "m", 1, "p"), ("d", None, "m", 2, "q"), ("d", "t", "m", 1, "r")], "dataset_id string, split string, model_name string, run_ts bigint, path string")
    assert sorted(r["path"] for r in runs.keep_latest_run(df).collect()) == ["q", "r"]


def test_writer_file_count(spark, tmp_path):
    df = spark.range(4000).repartition(16).selectExpr("id", "cast(id % 3 as string) g", "map('a', id) m")
    prompts.write_training_sets(df, str(tmp_path / "x"), "parquet", by=["g"])
    for g in range(3):
        assert len(list((tmp_path / "x" / f"g={g}").glob("*.parquet"))) <= runs.SALTS


# routers

def test_cluster_routing_beats_every_single_model(spark, sf):
    r, v = V.dense(spark, sf), V.prompt_vectors(spark, sf).drop("cluster_id")
    m = routers.fit_cluster_router(r, v, n_clusters=10, n_init=2)
    d = routers.route_by_cluster(v, m)
    assert d.count() == v.count()
    got = decisions.evaluate_selection(d, r).where("level = 'all'").first()["pooled_accuracy"]
    best = r.groupBy("model_name").agg(F.avg("score").alias("a")).agg(F.max("a")).first()[0]
    assert got > best * 100


# sources

def write_run(folder, name, payload):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(payload if isinstance(payload, str) else json.dumps(payload))


def run_doc(model="m", demo=False, score=1.0, **kw):
    return {"performance": 1.0, "cost": 0.1, "model_name": model, "dataset_name": "d", "split": "test", "demo": demo, "records": [
        {"index": 1, "prompt": "p", "origin_query": None, "prediction": ["x", 1], "score": score, "cost": None, "prompt_tokens": 3}], **kw}


def test_run_files(spark, tmp_path):
    write_run(tmp_path, "d/test/m/d-test-m-20250101_000000.json", run_doc(score=0.0))
    write_run(tmp_path, "d/test/m/d-test-m-20250301_000000.json", run_doc(score=None))
    write_run(tmp_path, "d/test/m/result.json", run_doc(score=0.5))
    write_run(tmp_path, "d/test/x/d-test-x-20250101_000000.json", run_doc("x", demo=True))
    write_run(tmp_path, "d/test/y/broken.json", "{not json")
    docs = runs.read_run_files(spark, str(tmp_path))
    assert docs.count() == 4
    live = runs.keep_latest_run(runs.filter_runs(docs))
    r = runs.normalize_records(runs.explode_records(live)).collect()
    assert len(r) == 1 and r[0]["run_ts"] == 20250301000000
    assert (r[0]["score"], r[0]["cost"], r[0]["completion_tokens"], r[0]["origin_query"]) == (0.0, 0.0, 0, "")
    assert json.loads(r[0]["prediction"]) == ["x", 1]
    assert runs.filter_runs(docs, models=[]).count() == 0
    assert runs.read_cascade_records(spark, str(tmp_path)).count() == 0  # no cost anywhere
    with pytest.raises(ValueError):
        runs.validate_model_lists(["a"], ["a"])


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([("d", "t", i, "x") for i in range(50)], "dataset_id string, split string, i long, s string")
    f = lambda df: df.select("fingerprint").first()[0]
    assert f(runs.fingerprint(a)) == f(runs.fingerprint(a.repartition(7).orderBy(F.desc("i"))))
    assert f(runs.fingerprint(a)) != f(runs.fingerprint(a.where("i < 49"))) != f(runs.fingerprint(a.union(a.where("i = 0"))))


def test_wide_prompt_lines(spark, tmp_path):
    lines = ['{"query": "q", "dataset": "d", "index": 1, "records": {"a": null, "b": true, "c": 0.5}, "usages": {"b": {"cost": 0.1}}}',
             "not json", '{"query": "", "dataset": "d", "records": {"a": 1}}', '{"query": "r", "dataset": "d", "index": 2, "records": {"a": "text"}}']
    (tmp_path / "w.jsonl").write_text("\n".join(lines))
    w = prompts.read_wide_prompts(spark, str(tmp_path / "w.jsonl"))
    assert w.count() == 1 and w.first()["records"] == {"a": 0.0, "b": 1.0, "c": 0.5}
    assert rows(prompts.explode_wide_prompts(w, "t"), "sample_id", "model_name", "cost") == [("d::1", "b", 0.1)]


def test_token_cost_order(spark):
    df = spark.createDataFrame([("a", 1_000_000, 0, None), ("a", 1_000_000, 0, 7.0), ("z", 5, 5, None)], "model_name string, prompt_tokens long, completion_tokens long, provider_cost double")
    price = spark.createDataFrame([("a", 2.0, 0.0)], "model_name string, prompt_price double, completion_price double")
    assert sorted(r["cost"] for r in pool.token_cost(df, price).collect()) == [0.0, 2.0, 7.0]


def test_queries_without_a_vector_are_decided(spark):
    q = spark.createDataFrame([("d", 1, [1.0, 0.0]), ("d", 2, None), ("d", 3, [0.0, 1.0]), ("d", 4, [-1.0, -1.0])], "dataset_id string, record_index int, embedding array<double>")
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, -1.0])], "cluster_id int, center array<double>")
    ranking = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "c", 1), (1, "b", 2), (1, "a", 4)], "cluster_id int, model_name string, rank int")
    got = {r.record_index: r for r in routers.route_by_cluster(q, routers.RouterModel(centers, ranking)).collect()}
    assert {i: r.model_name for i, r in got.items()} == {1: "a", 2: "c", 3: "c", 4: "c"}  # 2 has no vector, 4 only an unranked cluster
    assert got[2].expert_score == got[4].expert_score == pytest.approx((1 / 3 + 1) / 2)
    near = sorted((r.record_index, r.place, r.cluster_id) for r in routers.assign_nearest_centroid(q, centers).collect())
    assert near == [(1, 1, 0), (2, 1, None), (3, 1, 1), (4, 1, 2)]


def test_unseen_models_and_missing_vectors_are_scored(spark):
    rng = random.Random(4)
    rows = [("d", f"p{i}", [rng.choice([-1.0, 1.0]), rng.random()]) for i in range(60)]
    vec = spark.createDataFrame(rows, "dataset_id string, prompt string, embedding array<double>")
    lab = spark.createDataFrame([(d, p, m, float((e[0] > 0) == (m == "b"))) for d, p, e in rows for m in "bc"], "dataset_id string, prompt string, model_name string, label double")
    m = routers.per_model_correctness(lab, vec)
    ask = spark.createDataFrame([("d", "x", [1.0, 0.5]), ("d", "none", None)], vec.schema)
    both = {r.prompt: r.model_name for r in routers.route_by_correctness(m, ask, ["b", "c", "new"]).collect()}
    assert both == {"x": "b", "none": "b"}
    assert {r.prompt: r.model_name for r in routers.route_by_correctness(m, ask, ["new"]).collect()} == {"x": "new", "none": "new"}


def test_digest_of_prompts_is_that_of_the_text(spark):
    """Missing rules, shots and questions included; long lists are never put into a row per item."""
    items = spark.createDataFrame([(i, i % 5 if i % 7 else None, None if i % 11 == 3 else f"q\u00e9 {i % 20}", {"a": i}) for i in range(60)], "item_id bigint, rule_id bigint, question string, extra map<string,bigint>")
    rules = spark.createDataFrame([(0, "zero"), (1, "one"), (2, None), (3, "three"), (3, "again"), (None, "none")], "rule_id bigint, rule_content string")
    shots = spark.createDataFrame([(r, n, f"ask {n}", None if n == 4 else f"\u00fc {n}") for r in (0, 2, 3, None) for n in (5, 3, 4, 1)], "rule_id bigint, shot_no bigint, question string, answer string")
    for most in (None, 2):
        want = rows(shapes.join_rule_and_fewshot(items, rules, shots, most), "item_id", "rule_id", F.md5("formatted"))
        assert rows(shapes.digest_rule_and_fewshot(items, rules, shots, most), "item_id", "rule_id", "formatted_md5") == want
    many = spark.range(20_000).select(F.lit(1).cast("bigint").alias("rule_id"), F.col("id").alias("shot_no"), F.repeat(F.lit("x"), 50).alias("question"), F.lit("y").alias("answer"))
    asked = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(1).cast("bigint").alias("rule_id"), F.col("id").cast("string").alias("question"))
    text = "one\n" + "\n".join(["x" * 50 + "\ny"] * 20_000) + "\n"
    got = {r.item_id: r.formatted_md5 for r in shapes.digest_rule_and_fewshot(asked, rules, many).collect()}
    assert len(got) == 20_000 and all(got[i] == hashlib.md5(f"{text}{i}".encode()).hexdigest() for i in (0, 7, 19_999))


def test_token_f1_shuffles_no_tokens(spark):
    """Repeats, blanks, missing sides and the words that must match exactly; the rows' tokens stay where the rows are."""
    from routelab.operators import scoring
    df = spark.createDataFrame([(1, "dog dog cat", "dog dog dog"), (2, "yes", "yes it is"), (3, None, "x"), (4, "", ""), (5, "The cat!", "a cat"), (6, "no", "No.")], "id bigint, output string, answer string")
    got = scoring.score_token_f1(df, "id")
    assert "Exchange" not in plan(got)
    assert [(r.id, round(r.f1, 6), round(r.precision, 6), round(r.recall, 6)) for r in got.orderBy("id").collect()] == [
        (1, 0.666667, 0.666667, 0.666667), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 1, 1, 1), (6, 1, 1, 1)]


def test_idea_graph_binds_its_steps(spark):
    """Each step of the comparison is worked out once: the expression stays short."""
    from routelab.operators import scoring
    df = spark.createDataFrame([({"1": "a b", "2": "c"}, {"1": "a b"})], "steps map<string,string>, ref_steps map<string,string>")
    got = scoring.score_idea_graph(df.withColumn("order", F.map_keys("steps")).withColumn("ref_order", F.map_keys("ref_steps")))
    assert got._jdf.queryExecution().analyzed().toString().count("map_keys(steps") <= 2


def test_pairs_read_their_records_once(spark):
    """The split and the index are ranks over one row per prompt: the records are grouped once for all three outputs."""
    r = spark.range(400).select((F.col("id") % 2).cast("string").alias("dataset_id"), F.concat(L("p"), F.col("id") % 100).alias("prompt"), (F.col("id") % 100).alias("record_index"),
                                F.when(F.col("id") % 4 < 2, "s").otherwise("w").alias("model_name"), (F.col("id") % 3 / 2).alias("score"), L(0.1).alias("cost"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    counted = r.mapInPandas(count, r.schema)
    train, test, index = shapes.to_pairs(counted, "s", "w", 0.7)
    n = train.count() + test.count()
    assert index.count() == n and seen.value == 400
    flag = {(x.dataset_id, x.prompt): x.is_train for x in splits.split_by_prompt(r, 0.7).collect()}
    assert all(flag[x.dataset_id, x.prompt] for x in train.collect()) and not any(flag[x.dataset_id, x.prompt] for x in test.collect())


def test_run_files_of_sparse_keys_are_few(spark, tmp_path, monkeypatch):
    """Order keys with wide gaps: a run is a few files of many records, not a file for each of its orders."""
    from routelab.plans import catalog, queries_runs
    catalog.load()
    o = spark.range(100).select((F.col("id") * 9_000).alias("o_orderkey"), L("1-URGENT").alias("o_orderpriority"), L("O").alias("o_orderstatus"))
    o.write.parquet(str(tmp_path / "orders.parquet"))
    o.select(F.col("o_orderkey").alias("l_orderkey"), L(8).cast("bigint").alias("l_suppkey"), L("2024-01-01").cast("date").alias("l_shipdate"), L(1).alias("l_linenumber"), L("N").alias("l_returnflag"),
             L(0.08).alias("l_discount"), L(0.01).alias("l_tax"), L(2.0).alias("l_quantity"), L(100.0).alias("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(queries_runs, "_dir", lambda spark, name: str(tmp_path / name))
    assert [(r.n, r.avg_score) for r in catalog.QUERIES["read_runs"](spark, str(tmp_path)).collect()] == [(100, 1.0)]
    assert len(list((tmp_path / "runfiles").glob("*.json"))) == 1


def test_text_files_are_compressed(spark, tmp_path):
    """Lines repeat their names; what is written is smaller than the text and reads back whole."""
    df = spark.range(2000).select(L("d").alias("dataset_id"), L("s").alias("split"), L("m").alias("model_name"), F.col("id").alias("record_index"), L(1.0).alias("score"),
                                  L(1).cast("bigint").alias("prompt_tokens"), L(1).cast("bigint").alias("completion_tokens"), L(0.1).alias("cost"))
    runs.write_runs(df, str(tmp_path / "r"), "20250101_000000")
    prompts.write_training_sets(df, str(tmp_path / "t"))
    for sub in ("r/records", "t"):
        files = [f for f in (tmp_path / sub).rglob("part-*") if f.is_file()]
        assert files and all(f.name.endswith(".json.gz") for f in files)
        assert spark.read.json(str(tmp_path / sub)).count() == 2000


def test_idea_graph_deals_its_rows(spark, sf):
    """One small file does not mean one task: the comparison runs wherever there are cores."""
    from routelab.plans import catalog
    catalog.load()
    got = catalog.QUERIES["score_idea_graph"](spark, sf).select(F.spark_partition_id().alias("p")).distinct()
    assert got.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_idea_graph_moves_its_rows_once(spark, sf):
    """Both sides are dealt by the key they meet on, and none passes whole through the driver."""
    from routelab.plans import catalog
    catalog.load()
    got = catalog.QUERIES["score_idea_graph"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in got and got.count("Exchange hashpartitioning") == 2


def test_idea_graph_orders_its_edges(spark):
    """Listed steps in any order, unknown and missing ones, named edges; edges follow the sorted keys."""
    from routelab.operators import scoring
    steps = "map('2', 'b', '10', 'c', '1', 'a')"
    rows = {"array('2', '1', '10')": ["1-10", "10-2"], "array('7', '2', '1')": ["1-2"], "array('1-2', '2-7', '1-2')": ["1-2"], "array('7')": ["1-10", "10-2"], "array()": ["1-10", "10-2"]}
    for order, want in rows.items():
        got = spark.sql(f"select {steps} as steps, cast({order} as array<string>) as o").select(scoring._edges(F.col("steps"), F.col("o")).alias("e")).first().e
        assert got == want, order
    null = spark.sql(f"select {steps} as steps, array('2', null, '1') as o").select(scoring._edges(F.col("steps"), F.col("o")).alias("e")).first().e
    assert null == ["1-10", "10-2"]


def test_models_keep_their_base_rates(spark):
    """Vectors that say nothing: the model that is right more often is chosen, whatever the vector."""
    rng = random.Random(8)
    rows = [("d", f"p{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    vec = spark.createDataFrame(rows, "dataset_id string, prompt string, embedding array<double>")
    lab = spark.createDataFrame([(d, p, m, float(rng.random() < r)) for d, p, _ in rows for m, r in (("a", 0.1), ("b", 0.9))], "dataset_id string, prompt string, model_name string, label double")
    m = routers.per_model_correctness(lab, vec)
    assert {r.model_name for r in routers.route_by_correctness(m, vec, ["a", "b"]).collect()} == {"b"}


def test_cascade_trie_equals_the_search_by_orders(spark):
    """Full pools go through the trie; the search by orders, which keeps a row per order and sample, gives the same answer at every budget."""
    for seed, models, grid, budget, depth in ((1, "abcd", 5, 0.06, 3), (2, "abc", 6, 0.02, 2), (3, "abcde", 3, 0.02, 1), (3, "abcde", 3, 0.5, 3)):
        rng = random.Random(seed)
        rows = [("d", f"s{i}", m, int(rng.random() < 0.3 + 0.1 * j), rng.randint(0, 20) / 20, (j + 1) ** 2 / 100) for i in range(40) for j, m in enumerate(models)]
        df = spark.createDataFrame(rows, "dataset_id string, sample_id string, model_name string, label int, probability double, cost double")
        got, want = cascade.cascade_search(df, budget, depth, grid=grid), cascade._search_orders(df, budget, depth, None, grid)
        assert (got.order, got.quantiles, got.accuracy) == (want.order, want.quantiles, pytest.approx(want.accuracy)) and got.thresholds == pytest.approx(want.thresholds)
    assert cascade.cascade_search(df, 0.001, 2, grid=3) is None
    got, want = (f(df, 0.5, 3, order=list("edc"), grid=3) for f in (cascade.cascade_search, lambda d, b, k, order, grid: cascade._search_orders(d, b, k, order, grid)))
    assert (got.order, got.quantiles) == (want.order, want.quantiles) == (list("edc"), got.quantiles)


def test_cascade_of_33_models(spark):
    """The size of a full pool at depth 3: 32,736 orders, no table with a row for each of them and each sample."""
    rng = random.Random(5)
    rows = [("d", f"s{i}", f"m{j:02d}", int(rng.random() < 0.4 + 0.01 * j), rng.randint(1, 99) / 100, (j + 1) / 1000) for i in range(60) for j in range(33)]
    df = spark.createDataFrame(rows, "dataset_id string, sample_id string, model_name string, label int, probability double, cost double")
    got = cascade.cascade_search(df, 0.02, 3, grid=3)
    run = cascade.run_cascade(df, got).agg(F.avg("label"), F.avg("cum_cost")).first()
    assert len(got.order) == 3 and run[1] <= 0.02 + 1e-9 and got.accuracy > 0.6
    alone = max(sum(y for _, _, m, y, _, _ in rows if m == f"m{j:02d}") / 60 for j in range(20))
    assert got.accuracy >= alone


def test_merge_levels_is_ward(spark):
    """Every level equals merging by the least growth of squared distances, recomputed from the points."""
    rng = np.random.default_rng(3)
    c, n = rng.normal(0, 1, (9, 3)), rng.integers(1, 20, 9)
    df = spark.createDataFrame([(i, c[i].tolist(), int(n[i])) for i in range(9)], "cluster_id int, center array<double>, n bigint")
    ks = spark.createDataFrame([(k,) for k in (1, 2, 4, 9, 50)], "n_clusters int")
    got = {}
    for r in tradeoffs.merge_levels(df, ks).collect():
        got.setdefault(r.n_clusters, {}).setdefault(r.cluster_id, set()).add(r.fine_id)
    groups, want = [{i} for i in range(9)], {}
    within = lambda g: sum(n[i] * ((c[i] - np.average(c[list(g)], axis=0, weights=n[list(g)])) ** 2).sum() for i in g)
    while True:
        want[len(groups)] = sorted(map(sorted, groups))
        if len(groups) == 1:
            break
        a, b = min(itertools.combinations(groups, 2), key=lambda p: within(p[0] | p[1]) - within(p[0]) - within(p[1]))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
    for k in (1, 2, 4, 9):
        assert sorted(map(sorted, got[k].values())) == want[k] and all(min(v) == key for key, v in got[k].items())
    assert got[50] == got[9]


def test_router_versions(spark, tmp_path):
    """Versions add up, the last published one is loaded, damage is seen and a half-written one is not."""
    path = str(tmp_path / "router")
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id int, center array<double>")
    a = spark.createDataFrame([(i % 2, m, float((i + j) % 3 == 0), 0.001 * (j + 1)) for i in range(12) for j, m in enumerate("xyz")], "cluster_id int, model_name string, score double, cost double")
    with pytest.raises(FileNotFoundError):
        routers.load_router(spark, path)
    one, two = routers.balance_router(centers, a, 0.9, 0.1, top_k=2, max_router=2), routers.balance_router(centers, a, 0.1, 0.9)
    assert (routers.export_router(one, path), routers.export_router(two, path)) == (1, 2)
    q = spark.createDataFrame([("d", i, [float(i), 3.0 - i]) for i in range(4)] + [("d", 9, None)], "dataset_id string, record_index int, embedding array<double>")
    for version, model in ((1, one), (2, two), (None, two)):
        back = routers.load_router(spark, path, version)
        assert back.parameters == model.parameters and sorted(back.ranking.collect()) == sorted(model.ranking.collect())
        assert sorted(routers.route(q, back).collect()) == sorted(routers.route(q, model).collect())
    centers.write.parquet(f"{path}/version-lost/centers")
    assert routers.load_router(spark, path).parameters == two.parameters
    folder = routers.router_versions(spark, path).where("version = 2").first().folder
    one.ranking.limit(1).write.mode("append").parquet(f"{path}/{folder}/ranking")
    with pytest.raises(ValueError, match="ranking"):
        routers.load_router(spark, path)


def test_rejected_run_files(spark, tmp_path):
    good = {"model_name": "m", "dataset_name": "d", "split": "test", "records": [{"index": 1, "score": 1.0}]}
    files = {"ok_20250101_000000.json": json.dumps(good), "none.json": json.dumps({**good, "records": []}), "cut.json": json.dumps(good)[:40], "text.json": "hello",
             "typed.json": json.dumps({**good, "records": "lost"}), "nomodel.json": json.dumps({**good, "model_name": " "}), "nodata.json": json.dumps({**good, "dataset_name": None}),
             "norec.json": json.dumps({k: v for k, v in good.items() if k != "records"}), "both.json": json.dumps({"records": None, "model_name": None})}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    scan = runs.scan_run_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in scan.rejects.collect()}
    assert got == {"cut.json": "unreadable", "text.json": "unreadable", "typed.json": "unreadable", "nomodel.json": "no_model", "nodata.json": "no_dataset", "norec.json": "no_records", "both.json": "no_model"}
    assert scan.counts == {"files": 9, "good": 2, "unreadable": 3, "no_model": 2, "no_dataset": 1, "no_records": 1}
    assert sorted(scan.runs.columns) == sorted(runs.read_run_files(spark, str(tmp_path)).columns)
    assert [r.record_index for r in runs.explode_records(scan.runs).collect()] == [1]


def test_scores_of_a_mixed_table(spark):
    """Payload as VARIANT, JSON text or absent; each row scores as its own scorer would alone; clashing columns stay."""
    from routelab.operators import scoring
    rows = [(1, "hle", "o", "a", '{"reply": "correct: YES"}', "x"), (2, "hle", "correct: yes", "a", None, "x"), (3, "humaneval", "", "", '{"tests": [{"pass": true}, {"pass": null}]}', "x"),
            (4, "arenahard", "", "", '{"round1": "[[B>A]]", "round2": "[[A=B]]"}', "x"), (5, "medqa", "Answer: C", "C", "[1", "x"), (6, None, "o", "a", None, "x"), (7, "sfe", "FINAL ANSWER: B", "B", '{"kind": "mcq", "reply": "12"}', "x"),
            (8, "frontierscience", None, None, '{"reply": null}', "x")]
    df = spark.createDataFrame(rows, "id int, dataset_id string, output string, answer string, payload string, rule_id string")
    want = {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0, 6: None, 7: 0.0, 8: 0.0}
    for d in (df, df.withColumn("payload", F.try_parse_json("payload"))):
        out = scoring.score_outputs(d)
        assert out.columns == [*df.columns, "prediction", "ground_truth", "score"]
        assert {r.id: r.score for r in out.collect()} == want
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.score for r in scoring.score_outputs(df.drop("payload")).where("id in (5, 6)").collect()} == {5: 1.0, 6: None}
    from_factory = {n for s in scoring.SCORERS for n in s.datasets}
    assert len(from_factory) == sum(len(s.datasets) for s in scoring.SCORERS) and len(from_factory) >= 32


def test_rank_needs_one_exchange(spark):
    """A rank moves its rows once; a split by prompt three times: to ranges, and both sides of the last join."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), F.concat(F.lit("p"), F.col("id") % 2).alias("dataset_id"), F.col("id").cast("string").alias("prompt"))
    seen = []
    keep = scale.stable
    try:
        scale.stable = lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d)
        ranked = scale.ordered_rank(df, ["g"], ["x"], total="n")
        split = splits.split_by_prompt(df, 0.8, 1)
    finally:
        scale.stable = keep
    plans = [*seen, *(d._jdf.queryExecution().executedPlan().toString() for d in (ranked, split))]
    per = [p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") for p in plans]
    assert per[0] == 1 and per[1] == 1 and per[2] == 0 and per[3] <= 2
    got = ranked.collect()
    assert all(r.rn == r.x // 3 + 1 and r.n == (334 if r.g == 0 else 333) for r in got)


def test_triplets_rank_once(spark):
    """Anchors, positives and negatives share one kept rank; the plan of the triplets stays small."""
    rows = [(f"d{i % 2}", f"p{i}", i, m, float((i * 7 + j) % 5 > 2)) for i in range(60) for j, m in enumerate("abcd")]
    df = spark.createDataFrame(rows, "dataset_id string, prompt string, record_index int, model_name string, score double").withColumns({"cost": F.lit(0.0), "split": F.lit("t"), "prompt_tokens": F.lit(1), "completion_tokens": F.lit(1)})
    out = training.to_triplets(shapes.to_prompt_models(df), 6, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 15
    for r in out.collect():
        assert r.messages[0].accuracy == r.positive_messages[0].accuracy and r.messages[0].content != r.positive_messages[0].content
        assert len(r.negative_messages) == 6 and all(x.accuracy != r.messages[0].accuracy for x in r.negative_messages) and len({x.content for x in r.negative_messages}) == 6


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_approximate_neighbours(spark, spread):
    """Clustered and even vectors, a hot one, ties and missing vectors: the recall that was asked for, exact distances, whole ranks; clusters meet few rows."""
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 1, (12, 8))
    point = lambda: [float(x) for x in middle[rng.integers(12)] + rng.normal(0, spread, 8)]
    train = [(i, point()) for i in range(1500)] + [(i, [1.0] * 8) for i in range(1500, 2000)] + [(5000, None)]
    test = [(i, point()) for i in range(60)] + [(60, [1.0] * 8), (61, None)]
    te, tr = spark.createDataFrame(test, "test_id int, embedding array<double>"), spark.createDataFrame(train, "train_id int, embedding array<double>")
    got = neighbors.approx_knn_join(te, tr, 10, 0.9, block=128, chunk=16).collect()
    x, q = np.array([v for _, v in train if v]), np.array([v for _, v in test if v])
    d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2))
    limit = np.sort(d, axis=1)[:, 9]
    hits = sum(r.distance <= limit[r.test_id] + 1e-9 for r in got)
    assert hits >= 0.9 * 10 * len(q) and all(abs(r.distance - d[r.test_id, r.train_id]) < 1e-9 for r in got)
    for i in range(len(q)):
        mine = sorted((r.rank, r.distance, r.train_id) for r in got if r.test_id == i)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda m: m[1:])
    known = x[rng.permutation(len(x))[:500]]
    p = neighbors.fit_projections(known, q, 10**6, 10, 0.9, 4096, 1)
    assert p.recall >= 0.9 and (p.share < 0.5 or spread > 1)
    empty = neighbors.approx_knn_join(te, tr.limit(0), 10)
    assert empty.count() == 0


def test_probes_are_the_nearest_buckets():
    rng = np.random.default_rng(2)
    for bits, probes in ((4, 5), (12, 20)):
        p = neighbors.Projections(rng.normal(0, 1, (2 * bits, 6)), np.zeros(6), bits, 2, probes, 0.0, 0.0)
        x = rng.normal(0, 1, (7, 6))
        m, looked = p.margins(x), p.probed(x)
        own = p.buckets(x)
        for i in range(7):
            for t in range(2):
                price = {int(own[i, t]) ^ int(f): sum(m[i, t, b] ** 2 for b in range(bits) if f >> b & 1) for f in neighbors._flips(bits)}
                assert set(looked[i, t].tolist()) == set(sorted(price, key=price.get)[:probes]) and own[i, t] in looked[i, t]


def _texts(spark, rows, fn):
    df = spark.createDataFrame([(i, *r[:-1], r[-1]) for i, r in enumerate(rows)], "i int, x string, want string" if len(rows[0]) == 2 else "i int, x string, y string, want string")
    return [(r.value, r.want) for r in df.withColumn("value", fn(df)).collect()]


@pytest.mark.parametrize("name,rows", [
    ("math_normalize", [("\\dfrac12", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("x = 3", "3"), ("\\text{ yes }", "yes"), ("\\sqrt3 + .5", "\\sqrt{3}+0.5"), ("90^\\circ", "90"), ("3/4", "\\frac{3}{4}"),
                        ("12\\%", "12"), ("\\left( 1, 2 \\right)", "(1,2)"), ("5 \\text{ cm}", "5"), ("\\frac1{72}", "\\frac{1}{72}"), ("1,000\\$", "1,000")]),
    ("number_normalize", [("1,234,567", "1234567"), ("$3", "3"), ("5 cm", "5"), ("2 million", "2*10^6"), ("7 3/4", "7+3/4"), ("3.0", "3"), ("\\frac{1}{2}", "1/2"), ("1 or 2", "1,2"), ("- 5", "-5"),
                          ("{12}", "12"), ("45^ \\circ", "45"), ("ABC", "abc")]),
    ("tuple_split", [("(1, 2,3)", "1|2|3"), ("[1,000, 5)", "1000|5"), ("12", "12"), ("(1),(2)", "(1),(2)")]),
    ("rounded_number", [("about 2.5 units", "2.0"), ("3.5", "4.0"), ("-1.6", "-2.0"), ("none", "none"), ("7 and 9", "7.0")]),
    ("fenced_code", [("```\nold\n```\ntext\n```python\na = 1\nb\n```\n", "a = 1\nb"), ("no code", ""), ("```\n```", "")]),
    ("dataset_from_file_name", [("/a/aime-experiment_claude-opus-20250814-085351.json", "aime-experiment"), ("arc-agi-v2_anthropic_claude.json", "arc-agi-v2"), ("gpqa_claude-x.json", "gpqa"),
                                ("tau2_airline_claude.json", "tau2_airline"), ("x5_y_z.json", "x5"), ("plain.json", "plain")])])
def test_text_rules(spark, name, rows):
    from routelab.functions import text
    fn = getattr(text, name)
    got = _texts(spark, rows, lambda df: F.array_join(fn(df["x"]), "|") if name == "tuple_split" else fn(df["x"]))
    assert [g for g, _ in got] == [w for _, w in got]


def test_choice_letter_of_every_form_with_a_short_text(spark, tmp_path):
    """A document of one or two characters: every form of the query gives what its SQL says, and the rule itself keeps answers of ten characters as they are."""
    import duckdb

    from routelab.functions import text
    from routelab.plans import catalog
    catalog.load()
    assert [g for g, _ in _texts(spark, [("A. nothing", "A. nothing"), (" C", "C")], lambda df: text.choice_letter(df["x"]))] == ["A. nothing", "C"]
    spark.createDataFrame([(i, "A." if i % 2 else "") for i in range(10)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["choice_letter"]).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["choice_letter"](spark, str(tmp_path)).collect()) == sorted(want)


def test_answers_names_and_judgements(spark):
    from routelab.functions import text
    from routelab.operators import scoring
    f1 = _texts(spark, [("The cat, the cat!", "a cat", "0.666667"), ("yes", "yes it is", "0.0"), ("no", "No.", "1.0"), ("dog 3", "3 dog", "1.0"), ("", "x", "0.0")], lambda df: text.token_f1(df["x"], df["y"])["f1"])
    assert [round(v, 6) for v, _ in f1] == [float(w) for _, w in f1]
    names = spark.createDataFrame([("gpt-5-medium",), ("gpt-5-chat",), ("qwen/m 1",)], "x string").select(text.canonical_model_name(F.col("x")).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in names] == [("gpt-5", "medium", "gpt-5-medium"), ("gpt-5-chat", None, "gpt-5-chat"), ("m 1", None, "qwen_m_1")]
    steps = ['steps: [{"judge": "correct"}, {"judge": "wrong"}] end', '[{"judge": "Correct"}, {"judge": "correct", "n": 1}]', "no list", "[]"]
    assert [r.score for r in scoring.score_step_judgements(spark.createDataFrame([(s,) for s in steps], "output string")).collect()] == [0.5, 1.0, 0.0, 0.0]
    ideas = [(["mix the dye", "heat it"], ["mix the dye", "heat it"], 1.0, 1.0), (["mix the dye", "heat it"], ["mix the dye", "cool it"], 1.0, 4 / 6), (["one 1", "two 1", "three"], ["one 1", "two 1"], 0.5, 0.75)]
    df = spark.createDataFrame([({str(i + 1): t for i, t in enumerate(a)}, {str(i + 1): t for i, t in enumerate(b)}, e, w) for a, b, e, w in ideas], "steps map<string,string>, ref_steps map<string,string>, e double, w double")
    for r in scoring.score_idea_graph(df.withColumn("order", F.map_keys("steps")).withColumn("ref_order", F.map_keys("ref_steps"))).collect():
        assert (r.edge_similarity, r.text_similarity) == (pytest.approx(r.e), pytest.approx(r.w)) and r.score == pytest.approx(0.6 * r.e + 0.4 * r.w)


def test_kmeans_of_all_starts(spark):
    """Separated groups are found; the cost is that of the assignment; more starts never cost more; copies and missing vectors do no harm."""
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 10, (5, 4))
    rows = [(i, [float(v) for v in middle[i % 5] + rng.normal(0, 0.1, 4)]) for i in range(300)] + [(300, None)] + [(301 + i, [float(v) for v in middle[0]]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    one, ten = (routers.fit_kmeans(df, 5, n, 7) for n in (1, 10))
    assert ten.cost <= one.cost + 1e-9
    x = np.array([v for _, v in rows if v])
    d = ((x[:, None, :] - ten.centers[None, :, :]) ** 2).sum(2)
    assert ten.cost == pytest.approx(d.min(1).sum(), rel=1e-6)
    got = {r.id: r.cluster_id for r in ten.assign(df, "embedding").collect()}
    assert got[300] is None and [got[i] for i, v in rows if v] == d.argmin(1).tolist()
    assert all(len({got[i] for i in range(g, 300, 5)}) == 1 for g in range(5)) and len(set(got.values())) == 6
    assert len(routers.fit_kmeans(df.where("id > 300"), 5, 2).centers) == 1
