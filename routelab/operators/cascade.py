"""Cascades: models asked in order until one is trusted.

``scored``: (sample_id, dataset_id, model_name, label, probability, cost). Distances are 1 - probability; a
stage accepts where the distance is below its threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelab.functions.money import dollars, nano
from routelab.operators.stats import exact_quantiles
from routelab.scale import distinct_values, stable

L = F.lit
EPS = 1e-5


@dataclass
class Strategy:
    order: list[str]
    thresholds: list[float]
    quantiles: list[float] = field(default_factory=list)
    budget: float = math.inf
    accuracy: float = float("nan")


def cumulative_cascade_cost(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Running cost along the model order inside a sample (at most one row per model)."""
    pos = F.array_position(F.array(*[L(m) for m in order]), F.col("model_name"))
    d = df.where(F.col("model_name").isin(list(order))).withColumn("position", pos)
    w = Window.partitionBy("sample_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cum_cost", dollars(F.sum(nano("cost")).over(w)))


def _wide(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per sample with arrays along ``models``: labels, distances, costs in nano-dollars (null = absent)."""
    cell = scored.groupBy("sample_id").pivot("model_name", list(models)).agg(
        F.max(F.struct("label", (1 - F.col("probability")).alias("d"), nano("cost").alias("c"))))
    return cell.select("sample_id", *[F.col(f"`{m}`").alias(f"s{i}") for i, m in enumerate(models)])


def cascade_thresholds(scored: DataFrame, order: Sequence[str], quantiles: Sequence[float]) -> list[float]:
    """Threshold of a stage = the (1 - q) quantile of its distances among samples that earlier stages left.

    One job per stage but the last (whose threshold is 1); thresholds are the only values that reach the driver.
    """
    w = stable(_complete(_wide(scored, order), len(order)))
    out: list[float] = []
    for i in range(len(order) - 1):
        q = min(max(float(quantiles[i]), EPS), 1 - EPS)
        row = exact_quantiles(w.select(F.col(f"s{i}.d").alias("d")), [], "d", [1 - q]).first()
        out.append(1.0 if row is None else float(row["quantile"]))
        w = w.where(F.col(f"s{i}.d") >= out[-1]) if row is not None else w.limit(0)
    return [*out, 1.0]


def _complete(w: DataFrame, n: int) -> DataFrame:
    ok = L(True)
    for i in range(n):
        ok = ok & F.col(f"s{i}").isNotNull()
    return w.where(ok)


def _routes(scored: DataFrame, depth: int, order: Sequence[str] | None) -> DataFrame:
    """A row for each sample and order of ``depth`` of its models: order (array), path (array<struct<label, d, c>> along it).

    Orders grow a model at a time out of the models that the sample has, so a sample without a model takes no part in orders with it.
    """
    cells = scored.groupBy("sample_id", "model_name").agg(F.max(F.struct("label", (1 - F.col("probability")).alias("d"), nano("cost").alias("c"))).alias("cell"))
    rows = cells.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("model_name", "cell"))).alias("s")).withColumn(
        "order", F.array().cast("array<string>"))
    for i in range(depth):
        free = F.array_except(F.map_keys("s"), F.col("order"))
        if order:
            free = F.array_intersect(free, F.array(L(order[i])))
        rows = rows.select("s", "order", F.explode(free).alias("m")).select("s", F.concat("order", F.array("m")).alias("order"))
    return rows.select("order", F.transform("order", lambda m: F.element_at(F.col("s"), m)).alias("path"))


def cascade_search(scored: DataFrame, budget: float, max_depth: int = 2, order: Sequence[str] | None = None, grid: int = 15) -> Strategy | None:
    """Best (order, quantiles) of a grid by accuracy within the mean-cost budget; ties by model names, then the lower quantiles.

    Every order of ``max_depth`` models is searched (or the given one, cut to that depth), whatever their number. Where every sample has every
    model, as in a full evaluation, candidates form a trie of prefixes that share thresholds (``_search_trie``). Else the
    thresholds of an order come from the samples that have all of its models, so each order stands for itself (``_search_orders``).
    """
    models = distinct_values(scored, "model_name")
    if order:
        order = [m for m in order if m in models]
    depth = max(1, min(max_depth, len(order) if order else len(models))) if models else 0
    if not depth or order == []:
        return None
    used = list(order[:depth]) if order else models
    cells = stable(scored.where(F.col("model_name").isin(used)).groupBy("sample_id", "model_name").agg(F.max(F.struct("label", (1 - F.col("probability")).alias("d"), nano("cost").alias("c"))).alias("cell")))
    full = F.col("cell.label").isNotNull() & F.col("cell.d").isNotNull() & F.col("cell.c").isNotNull() & F.col("sample_id").isNotNull()
    n = cells.where(full).count()
    samples = cells.select("sample_id").distinct().count()
    if samples and n == samples * len(used):
        return _search_trie(cells, used, float(budget), depth, bool(order), grid, samples)
    return _search_orders(scored, float(budget), depth, order, grid)


@dataclass
class _Nodes:
    """Prefixes of candidates: models (numbers) and thresholds along each, and the quantiles behind the thresholds."""
    path: np.ndarray
    cut: np.ndarray
    q: np.ndarray

    def take(self, at: np.ndarray) -> _Nodes:
        return _Nodes(self.path[at], self.cut[at], self.q[at])


def _walk(nodes: _Nodes, label: np.ndarray, dist: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node and sample of a block: still unanswered, and paid so far; for each node: right answers and money of the answered samples."""
    n, rows = len(nodes.path), len(dist)
    alive, paid = np.ones((n, rows), dtype=bool), np.zeros((n, rows))
    hits, money = np.zeros(n), np.zeros(n)
    for j in range(nodes.path.shape[1]):
        m = nodes.path[:, j]
        done = alive & (dist.T[m] < nodes.cut[:, j:j + 1])
        paid += cost.T[m]
        hits += (done * label.T[m]).sum(1)
        money += (done * paid).sum(1)
        alive &= ~done
    return alive, paid, hits, money


_NODES_AT_ONCE, _SAMPLES_AT_ONCE = 256, 1024


def _search_trie(cells: DataFrame, models: list[str], budget: float, depth: int, fixed: bool, grid: int, samples: int) -> Strategy | None:
    """Search over prefixes: a node is an order of models with quantiles so far, and its thresholds serve every candidate that begins with it.

    Samples stay packed (three numbers per model and sample) and meet the nodes in blocks, as matrix products; no table has a row for
    each sample and order. The thresholds of a stage are quantiles over the samples that its prefix leaves. A prefix is dropped when the money
    already spent on answered and open samples exceeds the budget, or when its right answers so far plus the open samples that any unused model
    gets right stay below the best candidate found so far (the most promising prefixes are followed first to have one). The bounds only drop what cannot win.
    """
    m, limit = len(models), budget * 1e9 * samples
    index = F.array(*[L(x) for x in models])
    packed = stable(cells.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct((F.array_position(index, F.col("model_name")) - 1).alias("i"), "cell"))).alias("s")).select(
        *[F.col(f"s.cell.{k}").cast("array<double>").alias(k) for k in ("label", "d", "c")]))
    qs = np.array([EPS + (1 - 2 * EPS) * i / (grid - 1) for i in range(grid)])

    def blocks(it: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in it:
            for at in range(0, len(b), _SAMPLES_AT_ONCE):
                yield tuple(np.stack(b[c].iloc[at:at + _SAMPLES_AT_ONCE].to_numpy()).astype(float) for c in ("label", "d", "c"))

    def parts(nodes: _Nodes) -> Iterator[tuple[int, _Nodes]]:
        for at in range(0, len(nodes.path), _NODES_AT_ONCE):
            yield at, nodes.take(np.arange(at, min(at + _NODES_AT_ONCE, len(nodes.path))))

    def bounds(nodes: _Nodes) -> pd.DataFrame:
        """Per node: right answers so far, open samples that an unused model gets right, money spent so far."""
        used = np.zeros((len(nodes.path), m), dtype=bool)
        np.put_along_axis(used, nodes.path, True, axis=1)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(nodes.path), 3))
            for label, dist, cost in blocks(it):
                for at, some in parts(nodes):
                    alive, paid, hits, money = _walk(some, label, dist, cost)
                    free = ~used[at:at + len(hits)]
                    # the best label of an unused model: models that differ in a path are few, so by distinct sets
                    sets, which = np.unique(free, axis=0, return_inverse=True)
                    best = np.stack([np.where(f, label, 0).max(1) for f in sets])[which.ravel()]
                    out[at:at + len(hits)] += np.column_stack([hits, (alive * best).sum(1), money + (alive * paid).sum(1)])
            yield pd.DataFrame({"node": np.arange(len(out)), "hits": out[:, 0], "open": out[:, 1], "money": out[:, 2]})
        sums = packed.mapInPandas(run, "node bigint, hits double, open double, money double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("hits", "open", "money")])
        return sums.orderBy("node").toPandas()

    def finish(nodes: _Nodes) -> DataFrame:
        """Per node and last model (threshold 1): right answers and money."""
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(nodes.path), m, 2))
            for label, dist, cost in blocks(it):
                ok = (dist < 1).astype(float)
                for at, some in parts(nodes):
                    alive, paid, hits, money = _walk(some, label, dist, cost)
                    live = alive.astype(float)
                    out[at:at + len(hits), :, 0] += hits[:, None] + live @ (label * ok)
                    out[at:at + len(hits), :, 1] += money[:, None] + (live * paid) @ ok + live @ (cost * ok)
            node, last = (x.ravel() for x in np.indices(out.shape[:2]))
            yield pd.DataFrame({"node": node, "last": last.astype("int32"), "hits": out[:, :, 0].ravel(), "money": out[:, :, 1].ravel()})
        return packed.mapInPandas(run, "node bigint, last int, hits double, money double").groupBy("node", "last").agg(F.sum("hits").alias("hits"), F.sum("money").alias("money"))

    def following(path: Sequence[int]) -> list[int]:
        return [len(path)] if fixed else [i for i in range(m) if i not in path]

    def best_of(nodes: _Nodes) -> tuple | None:
        """(hits, order, quantiles, thresholds) of the best candidate among the completions of the nodes: one row comes back."""
        spark = cells.sparkSession
        rows = [(i, [models[j] for j in p], [int(j) for j in p], q, t) for i, (p, q, t) in enumerate(zip(nodes.path.tolist(), nodes.q.tolist(), nodes.cut.tolist()))]
        told = spark.createDataFrame(rows, "node bigint, names array<string>, path array<int>, q array<double>, t array<double>")
        done = finish(nodes).join(told, "node").where(F.col("money") <= limit)
        done = done.where(F.col("last") == len(nodes.path[0])) if fixed else done.where(~F.array_contains("path", F.col("last")))
        top = done.withColumn("order", F.concat("names", F.array(F.element_at(index, F.col("last") + 1)))).orderBy(F.desc("hits"), "order", "q").first()
        return (top["hits"], list(top["order"]), list(top["q"]), list(top["t"])) if top else None

    empty = np.zeros((1, 0))
    nodes = _Nodes(empty.astype(np.int64), empty, empty)
    first = packed.select(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(m)]).first()
    affordable = np.array([first[f"c{i}"] <= limit for i in range(m)])
    known = -1.0
    for stage in range(depth - 1):
        nexts = [[j for j in following(p) if stage or affordable[j]] for p in nodes.path.tolist()]
        here = np.array([(i, j) for i, js in enumerate(nexts) for j in js], dtype=np.int64).reshape(-1, 2)
        if not len(here):
            return None
        at_node = nodes

        def reach(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for label, dist, cost in blocks(it):
                for at, some in parts(at_node):
                    node, row = _walk(some, label, dist, cost)[0].nonzero()
                    if len(node):
                        yield pd.DataFrame({"node": node + at, "d": list(dist[row])})
        left = packed.mapInPandas(reach, "node bigint, d array<double>").select("node", F.posexplode("d").alias("next", "d"))
        cuts = exact_quantiles(left, ["node", "next"], "d", (1 - qs).tolist()).select("node", "next", "prob", "quantile").collect()
        of = {(r["node"], r["next"], round(r["prob"], 12)): r["quantile"] for r in cuts}
        path, cut, q = [], [], []
        for i, j in here.tolist():
            for x in qs:
                # without samples left a threshold accepts anything
                if stage == 0 or x >= nodes.q[i][-1]:
                    path.append([*nodes.path[i], j])
                    q.append([*nodes.q[i], x])
                    cut.append([*nodes.cut[i], of.get((i, j, round(1 - x, 12)), 1.0)])
        nodes = _Nodes(np.array(path, dtype=np.int64), np.array(cut), np.array(q))
        seen = bounds(nodes)
        reachable = (seen["hits"] + seen["open"]).to_numpy()
        keep = seen["money"].to_numpy() <= limit
        if stage == depth - 2 and keep.sum() > 4 * _NODES_AT_ONCE:
            tried = np.flatnonzero(keep)[np.argsort(-reachable[keep], kind="stable")[:_NODES_AT_ONCE]]
            some = best_of(nodes.take(np.sort(tried)))
            known = some[0] if some else -1.0
        nodes = nodes.take(np.flatnonzero(keep & (reachable >= known)))
        if not len(nodes.path):
            return None
    if depth == 1:
        # one model alone: it is asked and paid first
        sums = finish(nodes).where(F.col("money") <= limit).where(F.col("last").isin([int(i) for i in np.flatnonzero(affordable)][: 1 if fixed else None]))
        top = sums.withColumn("name", F.element_at(index, F.col("last") + 1)).orderBy(F.desc("hits"), "name").first()
        return Strategy([top["name"]], [1.0], [1.0], budget, top["hits"] / samples) if top else None
    top = best_of(nodes)
    return Strategy(top[1], [*top[3], 1.0], top[2], budget, top[0] / samples) if top else None


def _search_orders(scored: DataFrame, budget: float, depth: int, order: Sequence[str] | None, grid: int) -> Strategy | None:
    """Candidates as a table: each stage extends it by the quantiles that do not fall below the last one, with thresholds from the samples that
    reach the stage, and the last join adds each sample's outcome to sums per candidate that combine before the shuffle.
    """
    routes = stable(_routes(scored, depth, order).withColumn("key", F.array_join("order", "\u001f")))
    qs = [EPS + (1 - 2 * EPS) * i / (grid - 1) for i in range(grid)]
    none = F.array().cast("array<double>")
    cands = routes.select("key", "order").distinct().select("key", "order", none.alias("q"), none.alias("t"))
    for stage in range(depth - 1):
        here = F.col("path")[stage]["d"]
        passed = F.forall(F.arrays_zip(F.slice("path", 1, stage).alias("p"), F.col("t").alias("t")), lambda x: x["p"]["d"] >= x["t"]) if stage else L(True)
        cands = stable(cands.withColumn("cand", F.concat_ws("|", "key", F.array_join(F.transform("q", lambda x: x.cast("string")), "|"))))
        reach = routes.join(cands.select("key", "cand", "t"), "key").where(passed).select("cand", here.alias("d"))
        cuts = exact_quantiles(reach, ["cand"], "d", [1 - q for q in qs]).groupBy("cand").agg(F.collect_list(F.struct("prob", "quantile")).alias("cuts"))
        steps = F.array(*[F.struct(L(q).alias("q"), L(1 - q).alias("prob")) for q in qs])
        cands = cands.join(cuts, "cand", "left").withColumn("x", F.explode(steps)).where(
            (F.size("q") == 0) | (F.col("x.q") >= F.element_at("q", -1)) if stage else L(True))
        found = F.filter("cuts", lambda c: F.abs(c["prob"] - F.col("x.prob")) < 1e-12)
        cut = F.coalesce(F.try_element_at(F.transform(found, lambda c: c["quantile"]), L(1)), L(1.0))
        cands = cands.select("key", "order", F.concat("q", F.array("x.q")).alias("q"), F.concat("t", F.array(cut)).alias("t"))
    cands = stable(cands.withColumn("t", F.concat("t", F.array(L(1.0)))))
    # the first stage that accepts; a sample that none accepts counts 0 / 0
    hit = F.filter(F.sequence(L(1), L(depth)), lambda i: F.element_at("path", i)["d"] < F.element_at("t", i))
    at = F.try_element_at(hit, L(1))
    label = F.when(at.isNotNull(), F.element_at("path", F.coalesce(at, L(1)))["label"]).otherwise(0)
    paid = F.when(at.isNotNull(), F.aggregate(F.slice("path", L(1), F.coalesce(at, L(1))), L(0).cast("bigint"), lambda acc, p: acc + p["c"])).otherwise(0)
    res = routes.drop("order").join(cands, "key").select("order", "q", "t", label.alias("label"), paid.alias("c"), F.col("path")[0]["c"].alias("c0")).groupBy("order", "q", "t").agg(
        F.count("*").alias("n"), F.sum("label").alias("hits"), F.sum("c").alias("c"), F.sum("c0").alias("c0"))
    limit = L(float(budget) * 1e9) * F.col("n")
    top = res.where((F.col("c0") <= limit) & (F.col("c") <= limit)).withColumn("acc", F.col("hits") / F.col("n")).orderBy(F.desc("acc"), "order", "q").first()
    if top is None:
        return None
    return Strategy(list(top["order"]), list(top["t"]), list(top["q"]) or [1.0], float(budget), top["acc"])


def run_cascade(scored: DataFrame, strategy: Strategy, keys: Sequence[str] = ("dataset_id", "sample_id")) -> DataFrame:
    """First model in order with probability > 1 - threshold, else the last available; cost accumulates on the way."""
    names, thr = strategy.order, [*strategy.thresholds, *[1.0] * len(strategy.order)]
    pos = F.array_position(F.array(*[L(m) for m in names]), F.col("model_name"))
    limit = F.element_at(F.array(*[L(float(t)) for t in thr[:len(names)]]), F.col("p").cast("int"))
    d = scored.where(F.col("model_name").isin(names)).withColumn("p", pos)
    d = d.withColumn("ok", F.col("probability") > (1.0 - limit)).withColumn("n", F.coalesce(nano("cost"), L(0)))
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "ok", "n", "model_name", "label", "probability"))).alias("s"))
    stop = F.coalesce(F.nullif(F.array_position(F.transform("s", lambda x: x["ok"]), L(True)), L(0)), F.size("s").cast("bigint")).cast("int")
    g = g.withColumn("stop", stop)
    x = F.element_at("s", F.col("stop"))
    paid = F.aggregate(F.slice("s", L(1), F.col("stop")), L(0).cast("bigint"), lambda a, y: a + y["n"])
    return g.select(*keys, x["model_name"].alias("model_name"), x["label"].alias("label"), x["probability"].alias("probability"), dollars(paid).alias("cum_cost"))
