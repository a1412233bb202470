"""Learned selection rules: clusters of prompt vectors, utilities, linear models, and their persistence."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Interaction, OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routelab.functions.similarity import l2_normalize
from routelab.operators.splits import cost_percentile, rank_models_in_cluster, tie_labels
from routelab.operators.stats import best_first
from routelab.operators.tradeoffs import balance_score, cluster_metrics, pareto_join
from routelab.scale import stable

L = F.lit


@dataclass
class RouterModel:
    """``centers``: (cluster_id, center); ``ranking``: (cluster_id, model_name, mean_score, rank, ...); ``parameters``: how to route, and
    with what the router was made."""
    centers: DataFrame
    ranking: DataFrame
    parameters: dict = field(default_factory=dict)


def _unit(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_u", l2_normalize(F.col(vector)))


@dataclass
class Clusters:
    """``centers`` (k x dimensions) and the training cost: the sum of squared distances to the nearest centre."""
    centers: np.ndarray
    cost: float

    def assign(self, df: DataFrame, vector: str, out: str = "cluster_id") -> DataFrame:
        """Adds the nearest centre's number (ties: the smaller); null without a vector."""
        c = self.centers
        c2 = (c * c).sum(1)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            had = v.notna().to_numpy()
            found = pd.Series([None] * len(v), dtype="Int32")
            if had.any():
                x = np.stack(v[had].to_numpy()).astype(float)
                found[had] = (c2 - 2 * x @ c.T).argmin(1).astype("int32")
            return found
        return df.withColumn(out, nearest(F.col(vector)))


START_SAMPLE = 4096


def fit_kmeans(vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42, vector: str = "embedding", max_iter: int = 50, tolerance: float = 1e-6) -> Clusters:
    """Lloyd's iterations for ``n_init`` starts at once: a pass over the rows moves the centres of every start, so an iteration is one job however many starts.

    Starts are drawn by squared distance (k-means++) from a bounded sample of the rows, the smallest by hash. A task adds up counts, sums and costs by
    (start, centre); only those (starts x centres rows) reach the driver. A start that moved less than ``tolerance`` rests; a centre without rows stays where it is.
    The best start is that of least cost.
    """
    rows = stable(vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null"))
    n = rows.count()
    if not n:
        raise ValueError("no vectors to cluster")
    h = F.pmod(F.xxhash64("v"), L(1 << 40))
    part = rows.where(h < int(min(1.0, 2 * START_SAMPLE / n) * (1 << 40))) if n > 2 * START_SAMPLE else rows
    known = np.unique(np.array([r[0] for r in part.orderBy(h, "v").limit(START_SAMPLE).collect()], dtype=float), axis=0)
    k = max(1, min(k, len(known)))
    starts = np.stack([_plus_plus(known, k, np.random.default_rng(seed + i)) for i in range(n_init)])
    moving, cost = np.ones(n_init, dtype=bool), np.full(n_init, np.inf)

    def step(at: np.ndarray) -> pd.DataFrame:
        here = starts[at]

        def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count, sums, far = np.zeros((len(at), k)), np.zeros(here.shape), np.zeros((len(at), k))
            for b in it:
                x = np.stack(b["v"].to_numpy())
                x2 = (x * x).sum(1)
                for i, c in enumerate(here):
                    d = (c * c).sum(1)[None, :] - 2 * x @ c.T
                    own = d.argmin(1)
                    count[i] += np.bincount(own, minlength=k)
                    far[i] += np.bincount(own, weights=np.maximum(d[np.arange(len(x)), own] + x2, 0), minlength=k)
                    sums[i] += (own[None, :] == np.arange(k)[:, None]).astype(float) @ x
            yield pd.DataFrame({"start": np.repeat(at, k), "centre": np.tile(np.arange(k), len(at)), "n": count.ravel(), "far": far.ravel(), "total": list(sums.reshape(-1, here.shape[2]))})
        size = here.shape[2]
        got = rows.mapInPandas(add, "start bigint, centre bigint, n double, far double, total array<double>").groupBy("start", "centre").agg(
            F.sum("n").alias("n"), F.sum("far").alias("far"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
        return got.orderBy("start", "centre").toPandas()

    for _ in range(max_iter):
        at = np.flatnonzero(moving)
        if not len(at):
            break
        got = step(at)
        count = got["n"].to_numpy().reshape(len(at), k, 1)
        new = np.where(count > 0, np.stack(got["total"].to_numpy()).reshape(len(at), k, -1) / np.maximum(count, 1), starts[at])
        cost[at] = got["far"].to_numpy().reshape(len(at), k).sum(1)
        moving[at] = np.abs(new - starts[at]).max((1, 2)) > tolerance
        # the cost is that of the centres it was measured with, so a resting start keeps them
        starts[at[moving[at]]] = new[moving[at]]
    best = int(cost.argmin())
    return Clusters(starts[best], float(cost[best]))


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with a chance in proportion to its squared distance from those before."""
    picks = [int(rng.integers(len(x)))]
    best = ((x - x[picks[0]]) ** 2).sum(1)
    while len(picks) < k:
        picks.append(int(rng.choice(len(x), p=best / best.sum())) if best.sum() > 0 else int(rng.integers(len(x))))
        best = np.minimum(best, ((x - x[picks[-1]]) ** 2).sum(1))
    return x[picks]


def _centers(spark: SparkSession, model: Clusters) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.centers)], "cluster_id int, center array<double>")


def _nearest(centers: DataFrame, top_k: int, vector: str) -> Column:
    """array<struct<c: cluster id, d: distance 1 - q.c>> of the ``top_k`` nearest centres; ties by cluster id.

    Centres are model parameters and travel with the function: each Arrow batch of vectors is one matrix product,
    nothing is joined or multiplied out. A null vector gives null.
    """
    rows = centers.orderBy("cluster_id").collect()
    ids = np.array([int(r["cluster_id"]) for r in rows])
    c = np.array([r["center"] for r in rows], dtype=float).T

    @F.pandas_udf("array<struct<c:int,d:double>>")
    def nearest(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        had = np.flatnonzero(v.notna().to_numpy())
        if not len(had):
            return out
        x = np.stack(v.to_numpy()[had]).astype(float)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        d = 1.0 - (x / np.where(n == 0, 1.0, n)) @ c
        top = np.argsort(d, axis=1, kind="stable")[:, :top_k]
        near = np.take_along_axis(d, top, 1)
        for i, js, ys in zip(had.tolist(), top, near):
            out.iat[i] = [{"c": int(ids[j]), "d": float(y)} for j, y in zip(js, ys)]
        return out
    return nearest(F.col(vector))


def assign_nearest_centroid(vectors: DataFrame, centers: DataFrame, top_k: int = 1, vector: str = "embedding") -> DataFrame:
    """Adds (cluster_id, distance = 1 - q.c, place) for the ``top_k`` nearest centres; ties by cluster id.

    A row without a vector stays once, at place 1 with null cluster and distance.
    """
    return vectors.select(
        *vectors.columns, F.posexplode_outer(_nearest(centers, top_k, vector)).alias("place", "_x")).select(
        *vectors.columns, F.col("_x.c").alias("cluster_id"), F.col("_x.d").alias("distance"), (F.coalesce("place", L(0)) + 1).alias("place"))


def fit_cluster_router(train: DataFrame, vectors: DataFrame, n_clusters: int = 32, n_init: int = 10, seed: int = 42,
                       keys: Sequence[str] = ("dataset_id", "record_index")) -> RouterModel:
    """K-Means on unit vectors of the training prompts, then models ranked per cluster by mean score."""
    prompts = stable(_unit(vectors.join(train.select(*keys).distinct(), list(keys), "left_semi"), "embedding").select(*keys, "_u"))
    km = fit_kmeans(prompts, n_clusters, n_init, seed, "_u")
    centers = _centers(train.sparkSession, km)
    inside = stable(km.assign(prompts, "_u").select(*keys, "cluster_id"))
    return RouterModel(centers, rank_models_in_cluster(train.join(inside, list(keys))))


def route_by_cluster(queries: DataFrame, model: RouterModel, top_k: int = 1, beta: float = 9.0, max_router: int = 1,
                     keys: Sequence[str] = ("dataset_id", "record_index"), vector: str = "embedding") -> DataFrame:
    """Model score = sum over the nearest clusters of softmax(-beta d) / rank; the best ``max_router`` are selected.

    The ranking (clusters x models) is a parameter, so a query is scored in its own row, without a join or a shuffle. Weights are
    normalised over all nearest clusters before clusters without a ranking drop out. A query without a vector, or with none but unranked
    clusters near it, is decided as if it were equally far from all ranked clusters.
    """
    lists: dict[str, list[dict]] = {}
    for r in model.ranking.select("cluster_id", "model_name", "rank").collect():
        lists.setdefault(str(r["cluster_id"]), []).append({"m": r["model_name"], "r": r["rank"]})
    ranking = F.from_json(L(json.dumps(lists)), "map<string,array<struct<m:string,r:int>>>")
    near = queries.select(*keys, _nearest(model.centers, top_k, vector).alias("near"))
    first = F.element_at("near", 1)["d"]
    pull = F.transform("near", lambda x: F.struct(x["c"].cast("string").alias("c"), F.exp(-L(beta) * (x["d"] - first)).alias("w")))
    anywhere = F.from_json(L(json.dumps([{"c": c, "w": 1.0} for c in sorted(lists)])), "array<struct<c:string,w:double>>")
    pull = F.when(F.exists("near", lambda x: F.map_contains_key(ranking, x["c"].cast("string"))), pull).otherwise(anywhere)
    weighed = near.select(*keys, pull.alias("pull")).withColumn("total", F.aggregate("pull", L(0.0), lambda acc, x: acc + x["w"]))
    parts = F.flatten(F.transform("pull", lambda x: F.transform(F.coalesce(F.try_element_at(ranking, x["c"]), F.array()), lambda y: F.struct(
        y["m"].alias("m"), (x["w"] / F.col("total") / y["r"]).alias("s")))))
    scored = weighed.select(*keys, parts.alias("parts"))
    names = F.array_distinct(F.transform("parts", lambda x: x["m"]))
    sums = F.transform(names, lambda m: F.struct(
        (-F.round(F.aggregate(F.filter("parts", lambda x: x["m"] == m), L(0.0), lambda acc, x: acc + x["s"]), 12)).alias("s"), m.alias("m")))
    best = F.slice(F.array_sort(sums), 1, max_router)
    return scored.select(*keys, F.posexplode(best).alias("_at", "_b")).select(
        *keys, F.col("_b.m").alias("model_name"), (-F.col("_b.s")).alias("expert_score"), (F.col("_at") + 1).alias("rank"))


def fit_balance_router(assigned: DataFrame, performance_weight: float = 0.7, cost_sensitivity: float = 0.3,
                       min_accuracy: float = 0.0, cluster: str = "cluster_id") -> DataFrame:
    """Cluster metrics, balance score, rank, cost percentile and Pareto flag per (cluster, model)."""
    m = cluster_metrics(assigned, cluster)
    b = m.withColumn("balance", balance_score(L(performance_weight), L(cost_sensitivity), min_accuracy)).drop("_hi", "_lo", "_mc")
    w = Window.partitionBy(cluster).orderBy(F.desc(F.round("balance", 12)), "model_name")
    front = pareto_join(m, "avg_cost", "accuracy", [cluster]).select(cluster, "model_name", L(True).alias("pareto"))
    return b.withColumn("rank", F.row_number().over(w)).join(cost_percentile(assigned, cluster), [cluster, "model_name"]).join(
        front, [cluster, "model_name"], "left").withColumn("pareto", F.coalesce("pareto", L(False)))


def balance_router(centers: DataFrame, assigned: DataFrame, performance_weight: float = 0.7, cost_sensitivity: float = 0.3, min_accuracy: float = 0.0,
                   top_k: int = 1, beta: float = 9.0, max_router: int = 1, cluster: str = "cluster_id") -> RouterModel:
    """A router that ranks the models of a cluster by balance, with all its metrics and parameters."""
    made = {"performance_weight": performance_weight, "cost_sensitivity": cost_sensitivity, "min_accuracy": min_accuracy, "top_k": top_k, "beta": beta, "max_router": max_router}
    return RouterModel(centers, fit_balance_router(assigned, performance_weight, cost_sensitivity, min_accuracy, cluster), made)


def route(queries: DataFrame, model: RouterModel, keys: Sequence[str] = ("dataset_id", "record_index"), vector: str = "embedding") -> DataFrame:
    """``route_by_cluster`` with the router's own parameters."""
    own = {k: model.parameters[k] for k in ("top_k", "beta", "max_router") if k in model.parameters}
    return route_by_cluster(queries, model, keys=keys, vector=vector, **own)


def assign_clusters_global(train: DataFrame, test: DataFrame, n_clusters: int = 50, seed: int = 42,
                           vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """One K-Means over all training prompts; both sides get ``cluster_id`` (null without a vector)."""
    km = fit_kmeans(train, n_clusters, 1, seed, vector)
    return km.assign(train, vector), km.assign(test, vector)


# fixed values: (effect weight, cost weight) per scenario
SCENARIOS = {"Performance First": (1.0, 0.0), "Balance": (0.5, 0.5), "Cost First": (0.2, 0.8)}


def utility_router(edges: DataFrame, scenario: str = "Performance First", keys: Sequence[str] = ("task_id", "record_index")) -> DataFrame:
    """Edges with utility and tie labels, and the chosen model of each question."""
    a, b = SCENARIOS[scenario]
    e = tie_labels(edges.withColumn("utility", L(a) * F.col("effect") - L(b) * F.col("cost")), "utility", keys)
    best = e.groupBy(*keys).agg(F.min_by("llm", best_first("utility", "llm")).alias("chosen"))
    return e.join(best, list(keys))


def cost_threshold_sweep(candidates: DataFrame, steps: int = 20, keys: Sequence[str] = ("id",)) -> DataFrame:
    """For each margin threshold: the cheapest candidate with margin >= t, else the last; mean score, total cost.

    ``candidates``: (id, idx, margin, cost, score). A question is one packed row, the thresholds are exploded from
    it and summed before the shuffle.
    """
    from routelab.functions.money import dollars, nano
    q = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(nano("cost").alias("cost"), "idx", "margin", "score"))).alias("c"),
                                      F.max_by(F.struct(nano("cost").alias("cost"), "score"), "idx").alias("last"))
    span = candidates.agg(F.min("margin").alias("lo"), F.max("margin").alias("hi"), L(1).alias("_k"))
    t = q.withColumn("_k", L(1)).join(span, "_k").withColumn("step", F.explode(F.sequence(L(0), L(steps)))).withColumn(
        "t", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / L(float(steps)))
    hit = F.try_element_at(F.filter("c", lambda x: x["margin"] >= F.col("t")), L(1))
    cost, score = F.coalesce(hit["cost"], F.col("last.cost")), F.coalesce(hit["score"], F.col("last.score"))
    return t.groupBy("step").agg(F.first("t").alias("threshold"), F.avg(score).alias("mean_score"), dollars(F.sum(cost)).alias("total_cost"))


def linear_win_rate(pairs: DataFrame, vectors: DataFrame, seed: int = 42, keys: Sequence[str] = ("dataset_id", "prompt")) -> PipelineModel:
    """Logistic regression: probability that the strong model wins, from the prompt vector."""
    d = pairs.where("winner <> 'tie'").join(vectors.select(*keys, "embedding"), list(keys)).select(
        array_to_vector("embedding").alias("features"), (F.col("winner") == "model_a").cast("double").alias("label"))
    return Pipeline(stages=[LogisticRegression(maxIter=50, regParam=0.01)]).fit(d)


def win_rates(model: PipelineModel, prompts: DataFrame) -> DataFrame:
    d = model.transform(prompts.withColumn("features", array_to_vector("embedding")))
    return d.withColumn("winrate", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _with_one(vector: str) -> Column:
    return array_to_vector(F.concat(F.array(L(1.0)), F.col(vector).cast("array<double>")))


def per_model_correctness(labels: DataFrame, vectors: DataFrame, keys: Sequence[str] = ("dataset_id", "prompt")) -> PipelineModel:
    """Logistic regression on model one-hot x (1, prompt vector): one linear rule per model, with an offset of its own, in one fit. A model without labels has zero weights.

    Without the offsets every model has the same base rate, and prompts whose vectors say little are sent to poor models.
    """
    d = labels.join(vectors.select(*keys, "embedding"), list(keys)).withColumn("vec", _with_one("embedding"))
    size = 1 + len(vectors.select("embedding").where("embedding is not null").first()[0])
    stages = [VectorSizeHint(inputCol="vec", size=size, handleInvalid="error"), VectorAssembler(inputCols=["vec"], outputCol="va"),
              StringIndexer(inputCol="model_name", outputCol="mi", stringOrderType="alphabetAsc", handleInvalid="keep"),
              OneHotEncoder(inputCol="mi", outputCol="mo", dropLast=False), Interaction(inputCols=["mo", "va"], outputCol="features"),
              LogisticRegression(maxIter=50, regParam=0.01)]
    return Pipeline(stages=stages).fit(d)


def route_by_correctness(model: PipelineModel, prompts: DataFrame, models: Sequence[str], keys: Sequence[str] = ("dataset_id", "prompt")) -> DataFrame:
    """The model with the highest predicted correctness per prompt; every prompt gets one.

    The intercept alone scores a model that the fit has not seen, and every model of a prompt without a vector (so the first name wins).
    """
    none = array_to_vector(F.array_repeat(L(0.0), model.stages[0].getSize()))
    d = prompts.withColumn("model_name", F.explode(F.array(*[L(m) for m in models]))).withColumn("vec", F.when(F.col("embedding").isNull(), none).otherwise(_with_one("embedding")))
    p = model.transform(d).withColumn("p", vector_to_array("probability")[1])
    return p.groupBy(*keys).agg(F.min_by(F.struct("model_name", F.col("p").alias("probability")), best_first("p")).alias("b")).select(*keys, "b.*")


def _checksum(df: DataFrame) -> Column:
    """Rows and contents, whatever their order."""
    return F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), L(0).cast("decimal(38,0)")).cast("string"))


def export_router(model: RouterModel, path: str) -> int:
    """Saves a version of a router below ``path`` and returns its number (from 1).

    Centres, ranking (with every metric it has: scores, balance, cost percentile, Pareto flag) and parameters are written to a new folder; the
    row of the manifest that names the folder, the parameters and the checksums is appended last, so a half-written version is never loaded and
    earlier ones stay.
    """
    spark = model.centers.sparkSession
    folder = f"version-{uuid.uuid4().hex}"
    parts = {"centers": model.centers, "ranking": model.ranking}
    for name, df in parts.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    sums = {name: spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}").agg(_checksum(df)).first()[0] for name, df in parts.items()}
    version = 1 + max((r["version"] for r in router_versions(spark, path).collect()), default=0)
    row = (version, folder, json.dumps(model.parameters, sort_keys=True), sums["centers"], sums["ranking"], model.centers.schema.json(), model.ranking.schema.json())
    spark.createDataFrame([row], _MANIFEST).write.mode("append").json(f"{path}/manifest")
    return version


_MANIFEST = "version int, folder string, parameters string, centers_sum string, ranking_sum string, centers_schema string, ranking_schema string"


def router_versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: one row per published version; none if nothing was published."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def load_router(spark: SparkSession, path: str, version: int | None = None) -> RouterModel:
    """The latest published version, or the given one; a part whose checksum is not the manifest's raises."""
    rows = [r for r in router_versions(spark, path).collect() if version is None or r["version"] == version]
    if not rows:
        raise FileNotFoundError(f"no published router version at {path}")
    r = max(rows, key=lambda x: x["version"])
    parts = {}
    for name in ("centers", "ranking"):
        parts[name] = spark.read.schema(StructType.fromJson(json.loads(r[f"{name}_schema"]))).parquet(f"{path}/{r['folder']}/{name}")
        if parts[name].agg(_checksum(parts[name])).first()[0] != r[f"{name}_sum"]:
            raise ValueError(f"{name} of version {r['version']} is not what was exported")
    return RouterModel(parts["centers"], parts["ranking"], json.loads(r["parameters"]))


def project_embeddings(vectors: DataFrame, k: int = 2, vector: str = "embedding") -> DataFrame:
    d = vectors.withColumn("features", array_to_vector(F.col(vector)))
    m = PCA(k=k, inputCol="features", outputCol="projected").fit(d)
    return m.transform(d).withColumn("projection", vector_to_array("projected")).drop("features", "projected")
