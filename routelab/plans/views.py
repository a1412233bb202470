"""Evaluation facts derived from the driver's tables, as DataFrames and as the same views in SQL.

``runs``   one row per evaluation attempt: repeats, null scores, demo rows.
``recs``   ``runs`` with nulls filled (the normalised fact table), repeats kept.
``latest`` ``recs`` with one row per (dataset, split, question, model).
``dense``  every document x 8 models; each model is good on one label. A document without a vector takes its label from its id and has no embedding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Price per token in nano-dollars (input, output).
PRICES = {
    "m0": (90, 600), "m1": (180, 540), "m2": (250, 880), "m3": (270, 1000),
    "m4": (300, 2500), "m5": (500, 2150), "m6": (1250, 10000), "m7": (3000, 15000),
}
MODELS = sorted(PRICES)
RUN_KEYS = ["dataset_id", "split", "model_name"]
QUESTION = ["dataset_id", "split", "record_index"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    # a choice of the session, not of the size; off unless set
    deal = name in ("lineitem", "documents", "embeddings") and spark.conf.get("spark.routelab.dealInputs", "false") == "true"
    return df.repartition(df.columns[0]) if deal else df


def prices(spark: SparkSession) -> DataFrame:
    """Dollars per million tokens."""
    return spark.createDataFrame([(m, i / 1000.0, o / 1000.0) for m, (i, o) in PRICES.items()],
                                 "model_name string, prompt_price double, completion_price double")


def _nano(side: int) -> Column:
    pairs = [x for m in MODELS for x in (F.lit(m), F.lit(PRICES[m][side]).cast("bigint"))]
    return F.create_map(*pairs)[F.col("model_name")]


def _with_cost(df: DataFrame) -> DataFrame:
    nano = F.col("prompt_tokens") * _nano(0) + F.col("completion_tokens") * _nano(1)
    return df.withColumn("cost", nano.cast("double") / F.lit(1e9))


def runs(spark: SparkSession, d: str) -> DataFrame:
    tenths = F.floor(F.col("l_discount") * 100 + 0.5)
    base = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _with_cost(base.select(
        F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderstatus").alias("split"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("model_name"),
        F.col("l_orderkey").alias("record_index"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("prompt"),
        F.col("l_shipdate").alias("run_ts"), F.col("l_linenumber").cast("bigint").alias("run_no"),
        (F.col("l_returnflag") == "R").alias("demo"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
         .when(tenths >= 8, 1.0).when(tenths >= 5, 0.5).otherwise(0.0).alias("score"),
        F.floor(F.col("l_quantity") * 20).cast("bigint").alias("prompt_tokens"),
        F.floor(F.col("l_extendedprice") / 10).cast("bigint").alias("completion_tokens")))


def recs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).withColumn("score", F.coalesce("score", F.lit(0.0)))


def latest(spark: SparkSession, d: str) -> DataFrame:
    from routelab.operators.stats import keep_last
    return keep_last(recs(spark, d), [*QUESTION, "model_name"], ["run_ts", "run_no"])


def dense(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    base = docs.join(vecs, "doc_id", "left").withColumn("label", F.coalesce("label", (F.col("doc_id") % 10).cast("int"))).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(len(MODELS))])))
    hit = F.when(F.col("label") % 8 == m, 8).otherwise(2)
    return _with_cost(base.select(
        F.col("lang").alias("dataset_id"), F.lit("test").alias("split"),
        F.concat(F.lit("m"), m.cast("string")).alias("model_name"), F.col("doc_id").alias("record_index"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("prompt"),
        F.when((F.col("doc_id") * 7 + (m % 3) * 3) % 10 < hit, 1.0).otherwise(0.0).alias("score"),
        F.floor(F.col("n_chars") / 4).cast("bigint").alias("prompt_tokens"),
        (50 + (F.col("doc_id") * 11 + m * 29) % 400).cast("bigint").alias("completion_tokens"),
        F.col("label"), F.col("embedding")))


def prompt_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with a vector: (dataset_id, record_index, prompt, embedding, cluster_id)."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    vecs = table(spark, d, "embeddings")
    return docs.join(vecs, F.col("doc_id") == F.col("vec_id")).select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("record_index"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("prompt"), "embedding",
        (F.col("label") % 8).alias("cluster_id"))


_COST = "CAST(prompt_tokens * CASE model_name " + " ".join(
    f"WHEN '{m}' THEN {i}" for m, (i, _) in PRICES.items()) + " END + completion_tokens * CASE model_name " + " ".join(
    f"WHEN '{m}' THEN {o}" for m, (_, o) in PRICES.items()) + " END AS DOUBLE) / CAST(1e9 AS DOUBLE) AS cost"

SQL_VIEWS = {
    "runs": f"""runs AS (SELECT *, {_COST} FROM (
  SELECT o_orderpriority AS dataset_id, o_orderstatus AS split, 'm' || CAST(l_suppkey % 8 AS VARCHAR) AS model_name,
    l_orderkey AS record_index, 'order ' || CAST(l_orderkey AS VARCHAR) AS prompt, l_shipdate AS run_ts,
    CAST(l_linenumber AS BIGINT) AS run_no, l_returnflag = 'R' AS demo,
    CASE WHEN l_tax = 0 THEN NULL WHEN round(l_discount * 100) >= 8 THEN CAST(1.0 AS DOUBLE)
         WHEN round(l_discount * 100) >= 5 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score,
    CAST(floor(l_quantity * 20) AS BIGINT) AS prompt_tokens,
    CAST(floor(l_extendedprice / 10) AS BIGINT) AS completion_tokens
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    "recs": "recs AS (SELECT * REPLACE (coalesce(score, 0.0) AS score) FROM runs)",
    "latest": """latest AS (SELECT * FROM recs QUALIFY row_number() OVER (
  PARTITION BY dataset_id, split, record_index, model_name ORDER BY run_ts DESC, run_no DESC, prompt DESC,
  demo DESC, score DESC, prompt_tokens DESC, completion_tokens DESC, cost DESC) = 1)""",
    "dense": f"""dense AS (SELECT *, {_COST} FROM (
  SELECT d.lang AS dataset_id, 'test' AS split, 'm' || CAST(m.m AS VARCHAR) AS model_name, d.doc_id AS record_index,
    'doc ' || CAST(d.doc_id AS VARCHAR) AS prompt,
    CASE WHEN (d.doc_id * 7 + (m.m % 3) * 3) % 10 < CASE WHEN coalesce(e.label, d.doc_id % 10) % 8 = m.m THEN 8 ELSE 2 END
         THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score,
    CAST(floor(d.n_chars / 4) AS BIGINT) AS prompt_tokens,
    CAST(50 + (d.doc_id * 11 + m.m * 29) % 400 AS BIGINT) AS completion_tokens, CAST(coalesce(e.label, d.doc_id % 10) AS INT) AS label, e.embedding AS embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id CROSS JOIN (SELECT range AS m FROM range(8)) m))""",
    "prompt_vectors": """prompt_vectors AS (SELECT d.lang AS dataset_id, d.doc_id AS record_index,
    'doc ' || CAST(d.doc_id AS VARCHAR) AS prompt, e.embedding AS embedding, e.label % 8 AS cluster_id
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)""",
}
_NEEDS = {"recs": ["runs"], "latest": ["runs", "recs"]}


def with_views(views: str, body: str) -> str:
    """``body`` is a SELECT, or starts with a comma and further CTEs."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    body = body.strip()
    if not names:
        return body if not body.startswith(",") else "WITH " + body[1:].lstrip()
    head = "WITH " + ",\n".join(SQL_VIEWS[n] for n in names)
    return head + "\n" + body
