"""Queries over run files, filters, planning, exports, pools and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.operators import pool as P
from routelab.operators import shapes as G
from routelab.operators.stats import QUESTION
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded
from routelab.scale import shared_dir
from routelab.sources import prompts as Q
from routelab.sources import runs as R

L = F.lit
NANO = "CAST(round(cost * 1e9) AS BIGINT)"


def _dir(spark, name):
    return f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}"


def _with_path(spark, d):
    r = V.runs(spark, d).withColumn("path", F.concat_ws("/", "dataset_id", "split", "model_name", F.col("run_no").cast("string")))
    return r.withColumn("run_stamp", F.date_format("run_ts", "yyyyMMdd").cast("bigint"))


_WP = """, p AS (SELECT *, dataset_id || '/' || split || '/' || model_name || '/' || CAST(run_no AS VARCHAR) AS path, CAST(strftime(run_ts, '%Y%m%d') AS BIGINT) AS run_stamp FROM runs)"""


@query("read_runs", "runs", f"""SELECT dataset_id, split, model_name, count(*) AS n, round(avg(score), 9) AS avg_score, round(sum({NANO}) / 1e9, 9) AS cost FROM runs GROUP BY ALL""")
def _(spark, d):
    # a nested document per file, of 1,000,000 order keys of a run at most, so that the files are megabytes each: the exchange format, written and read back by the reader
    path = _dir(spark, "runfiles")
    rec = F.struct(F.col("record_index").alias("index"), F.col("prompt").alias("origin_query"), "prompt", "prompt_tokens", "completion_tokens", "cost", "score",
                   L("p").alias("prediction"), L("t").alias("ground_truth"))
    V.runs(spark, d).groupBy("dataset_id", "split", "model_name", F.floor(F.col("record_index") / 1_000_000)).agg(F.collect_list(rec).alias("records"), F.max("demo").alias("demo")).select(
        F.col("dataset_id").alias("dataset_name"), "split", "model_name", "demo", "records").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
    docs = R.read_runs(spark, path)
    from routelab.functions.money import sum_money
    return rounded(docs.groupBy("dataset_id", "split", "model_name").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), sum_money("cost").alias("cost")))


@query("scan_run_files", "", """, f AS (SELECT doc_id // 50 AS g, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1)
SELECT ['no_model', 'no_records', 'no_dataset', 'unreadable', 'good'][g % 5 + 1] AS reason, count(*) AS files, CAST(sum(CASE WHEN g % 5 = 4 THEN n END) AS BIGINT) AS records,
 CAST(sum(CASE WHEN g % 5 = 4 THEN chars END) AS BIGINT) AS chars FROM f GROUP BY 1""")
def _(spark, d):
    # a file of 50 documents each; four of five are broken in a way of their own
    docs = V.table(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 50).alias("g"))
    rec = F.struct(F.col("doc_id").alias("index"), F.col("text").alias("prompt"))
    kind = F.col("g") % 5
    files = docs.groupBy("g").agg(F.collect_list(rec).alias("records")).select(
        F.when(kind != 2, L("set")).alias("dataset_name"), L("test").alias("split"), F.when(kind != 0, L("m0")).alias("model_name"), F.when(kind != 1, F.col("records")).alias("records"), kind.alias("kind"))
    path = _dir(spark, "mixedfiles")
    files.where("kind <> 3").drop("kind").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
    files.where("kind = 3").drop("kind").withColumn("records", L("lost")).write.mode("append").option("maxRecordsPerFile", 1).json(path)
    scan = R.scan_run_files(spark, path)
    bad = scan.rejects.groupBy("reason").agg(F.count("*").alias("files"), L(None).cast("bigint").alias("records"), L(None).cast("bigint").alias("chars"))
    rows = R.explode_records(scan.runs).agg(F.count("*").alias("records"), F.sum(F.length("prompt")).alias("chars"))
    assert scan.counts["files"] == scan.counts["good"] + sum(scan.counts[r] for r in R.REASONS)
    return bad.unionByName(rows.select(L("good").alias("reason"), L(scan.counts["good"]).cast("bigint").alias("files"), "records", "chars").where("files > 0"))


@query("filter_runs", "runs", """SELECT dataset_id, split, model_name, count(*) AS n FROM runs WHERE NOT demo AND dataset_id IN ('1-URGENT', '5-LOW') AND model_name IN ('m1', 'm2', 'm7') AND split <> 'P' GROUP BY ALL""")
def _(spark, d):
    f = R.filter_runs(V.runs(spark, d), datasets=["1-URGENT", "5-LOW"], exclude_datasets=["5-LOW"], models=["m1", "m2"], exclude_splits=["P"],
                      reference_models=["m7"], include_reference=True)
    return f.groupBy("dataset_id", "split", "model_name").agg(F.count("*").alias("n"))


@query("keep_latest_run", "runs", _WP + """ SELECT dataset_id, split, model_name, run_stamp, path, count(*) AS n FROM p
 JOIN (SELECT dataset_id, split, model_name, max((run_stamp, path)) AS m FROM p GROUP BY ALL) b USING (dataset_id, split, model_name) WHERE (run_stamp, path) = m GROUP BY ALL""")
def _(spark, d):
    k = R.keep_latest_run(_with_path(spark, d), ts="run_stamp")
    return k.groupBy("dataset_id", "split", "model_name", "run_stamp", "path").agg(F.count("*").alias("n"))


@query("keep_last_record", "latest", "SELECT dataset_id, split, record_index, model_name, run_no, score, prompt_tokens FROM latest")
def _(spark, d):
    return V.latest(spark, d).select(*QUESTION, "model_name", "run_no", "score", "prompt_tokens")


@query("normalize_records", "runs", """SELECT model_name, count(*) AS n, count(*) FILTER (score IS NULL) AS n_missing, round(avg(coalesce(score, 0.0)), 9) AS avg_score, round(avg(score), 9) AS avg_known FROM runs GROUP BY 1""")
def _(spark, d):
    r = V.runs(spark, d)
    n = R.normalize_records(r.withColumn("known", F.col("score")))
    return rounded(n.groupBy("model_name").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("n_missing"), F.avg("score").alias("avg_score"),
                                               F.avg("known").alias("avg_known")))


@query("select_columns", "runs", "SELECT model_name, record_index, run_no FROM runs")
def _(spark, d):
    return R.select_columns(V.runs(spark, d), ["model_name", "absent", "record_index", "run_no"])


@query("validate_model_lists", "runs", "SELECT DISTINCT model_name FROM runs WHERE model_name IN ('m1', 'm7')")
def _(spark, d):
    R.validate_model_lists(["m1"], ["m7"])
    return R.filter_runs(V.runs(spark, d), skip_demo=False, models=["m1"], reference_models=["m7"], include_reference=True).select("model_name").distinct()


@query("cascade_records", "", """, r AS (SELECT doc_id, text, d.lang, quality FROM documents d LEFT JOIN labels USING (doc_id))
SELECT lang || '::' || CAST(doc_id AS VARCHAR) AS sample_id, lang AS dataset_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'Q: second ' || trim(text, ' ' || chr(10)) ELSE 'only ' || trim(text, ' ' || chr(10)) END) AS text_md5, CAST(quality AS DOUBLE) AS score FROM r WHERE quality IS NOT NULL""")
def _(spark, d):
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    r = docs.select(F.col("lang").alias("dataset_id"), L("test").alias("split"), L("m0").alias("model_name"), F.col("doc_id").alias("record_index"),
                    F.when(F.col("doc_id") % 2 == 0, "Q: first Q: second").otherwise("only").alias("prompt"), L("").alias("origin_query"), L("").alias("prediction"),
                    F.regexp_replace("text", r"^[ \n]+|[ \n]+$", "").alias("raw_output"), F.col("quality").cast("double").alias("score"), L(0.0).alias("cost"))
    path = _dir(spark, "cascade")
    rec = F.struct(F.col("record_index").alias("index"), "prompt", "origin_query", "prediction", "raw_output", "score", "cost")
    r.groupBy(F.col("dataset_id").alias("dataset_name"), "split", "model_name", F.floor(F.col("record_index") / 500)).agg(F.collect_list(rec).alias("records")).select(
        "dataset_name", "split", "model_name", "records").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
    return R.read_cascade_records(spark, path).select("sample_id", "dataset_id", F.md5("text").alias("text_md5"), "score")


@query("read_wide_prompts", "latest", """SELECT dataset_id AS dataset, record_index AS index, sum(score) AS total FROM latest GROUP BY ALL""")
def _(spark, d):
    path = _dir(spark, "wide")
    Q.write_training_sets(G.to_wide_prompts(V.latest(spark, d), V.MODELS), path)
    w = Q.read_wide_prompts(spark, path)
    return w.select("dataset", "index", F.aggregate(F.map_values("records"), L(0.0), lambda a, x: a + x).alias("total"))


@query("explode_wide_prompts", "dense", """SELECT dataset_id || '::' || CAST(record_index AS VARCHAR) AS sample_id, dataset_id, model_name, score, round(cost, 9) AS cost FROM dense""")
def _(spark, d):
    return rounded(Q.explode_wide_prompts(G.to_wide_prompts(V.dense(spark, d), V.MODELS), "test").select("sample_id", "dataset_id", "model_name", "score", "cost"))


@query("write_runs", "recs", f"SELECT dataset_id, split, model_name, count(*) AS n, round(sum(score), 9) AS s, round(sum({NANO}) / 1e9, 9) AS cost FROM recs GROUP BY ALL")
def _(spark, d):
    from routelab.functions.money import sum_money
    path = _dir(spark, "runs")
    r = V.recs(spark, d).drop("run_ts", "demo")
    R.write_runs(r, path, "20250101_000000", "overwrite")
    back = R.read_written_runs(spark, path, r.schema)
    return rounded(back.groupBy("dataset_id", "split", "model_name").agg(
        F.count("*").alias("n"), F.sum("score").alias("s"), sum_money("cost").alias("cost")))


@query("list_runs", "runs", _WP + f""", live AS (SELECT * FROM p WHERE NOT demo), b AS (SELECT dataset_id, split, model_name, max((run_stamp, path)) AS m FROM live GROUP BY ALL)
SELECT dataset_id, split, model_name, max(run_stamp) AS updated_at, count(*) AS counts, round(avg(score), 9) AS performance, round(sum({NANO}) / 1e9, 9) AS cost FROM live JOIN b USING (dataset_id, split, model_name)
WHERE (run_stamp, path) = m GROUP BY dataset_id, split, model_name""")
def _(spark, d):
    return rounded(R.list_runs(_with_path(spark, d).drop("run_ts").withColumnRenamed("run_stamp", "run_ts")))


_FP = """, h AS (SELECT lang AS dataset_id, 'test' AS split, sha256(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) || coalesce(length(source) || ':' || source, '-') || coalesce(length(text) || ':' || text, '-')) AS h FROM documents),
 f AS (SELECT dataset_id, split, count(*) AS n_items, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), """ + ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + ")) AS fingerprint FROM h GROUP BY ALL)"


def _fp(spark, d):
    items = V.table(spark, d, "documents").select(F.col("lang").alias("dataset_id"), L("test").alias("split"), "doc_id", "source", "text")
    return R.fingerprint(items)


@query("fingerprint", "", _FP + " SELECT dataset_id, split, n_items, fingerprint FROM f")
def _(spark, d):
    return _fp(spark, d)


@query("plan_runs", "", _FP + """ SELECT dataset_id, split, 'm' || CAST(i AS VARCHAR) AS model_name, dataset_id || '/test/m' || CAST(i AS VARCHAR) AS run_key FROM f, range(4) x(i)
 WHERE NOT (i = 0 OR i = 1)""")
def _(spark, d):
    fp = _fp(spark, d)
    # m0: done on this data; m1: done without a fingerprint; m2: done on other data; m3: never done
    done = fp.select("dataset_id", "split", F.explode(F.array(F.struct(L("m0").alias("m"), F.col("fingerprint").alias("f")), F.struct(L("m1").alias("m"), L("").alias("f")),
                                                              F.struct(L("m2").alias("m"), L("other").alias("f")))).alias("x")).select(
        "dataset_id", "split", F.col("x.m").alias("model_name"), F.col("x.f").alias("fingerprint"))
    return R.plan_runs(fp, ["m0", "m1", "m2", "m3"], done)


@query("write_training_sets", "dense", "SELECT dataset_id AS task_id, record_index, model_name AS llm, score AS effect FROM dense")
def _(spark, d):
    from routelab.plans.queries_splits import edges
    path = _dir(spark, "edges")
    Q.write_training_sets(edges(spark, d).select("task_id", "record_index", "llm", "effect"), path, "csv", ["task_id"])
    return spark.read.option("header", True).schema("record_index bigint, llm string, effect double, task_id string").csv(path)


@query("read_item_shards", "", "SELECT doc_id, lang, md5(text) AS h FROM documents")
def _(spark, d):
    path = _dir(spark, "shards")
    Q.write_training_sets(V.table(spark, d, "documents").select("doc_id", "lang", "text"), path, "json", ["lang"])
    langs = [r[0] for r in V.table(spark, d, "documents").select("lang").distinct().collect()]
    s = Q.read_item_shards(spark, [f"{path}/lang={x}" for x in langs], "doc_id bigint, text string")
    return s.select("doc_id", F.regexp_extract(F.col("_metadata.file_path"), "lang=([^/]+)", 1).alias("lang"), F.md5("text").alias("h"))


@query("unify_qa", "", """SELECT 'docs' AS task_id, md5(text) AS query, lang AS ground_truth, 'em' AS metric, 'language of a text' AS task_description FROM documents
UNION ALL SELECT 'events', event_type, CAST(value AS VARCHAR), 'f1', 'value of an event' FROM (SELECT * FROM events ORDER BY event_id LIMIT 60)""")
def _(spark, d):
    docs = V.table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    ev = V.table(spark, d, "events").withColumnRenamed("event_id", "id")
    a = Q.unify_qa([(docs, "docs", F.md5("text"), F.col("lang"), "em", "language of a text")], None)
    b = Q.unify_qa([(ev, "events", F.col("event_type"), F.col("value").cast("string"), "f1", "value of an event")], 60)
    return a.unionByName(b)


@query("summarize_external_run", "recs", f"""SELECT 'external_bench' AS dataset_id, 'test' AS split, 'mx' AS model_name, round(avg(CAST(score > 0 AS INT)), 9) AS performance, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
 CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum({NANO}) / 1e9, 9) AS cost, count(*) AS counts FROM recs""")
def _(spark, d):
    return rounded(R.summarize_external_run(V.recs(spark, d), "mx"))


# pools and prices

_POOL = """SELECT dataset_id, model_name, count(*) AS n FROM recs WHERE model_name <> 'm7' AND {} GROUP BY ALL"""


@query("filter_pool_hard", "recs", _POOL.format("dataset_id <> '5-LOW'"))
def _(spark, d):
    return P.filter_pool(V.recs(spark, d), ["m7"], ["5-LOW"]).groupBy("dataset_id", "model_name").agg(F.count("*").alias("n"))


@query("filter_pool_soft", "recs", _POOL.format("(dataset_id <> '5-LOW' OR run_no <= 4)"))
def _(spark, d):
    r = V.recs(spark, d).withColumn("is_train", F.col("run_no") <= 4)
    return P.filter_pool(r, ["m7"], ["5-LOW"], "soft").groupBy("dataset_id", "model_name").agg(F.count("*").alias("n"))


@query("mark_ood", "recs", "SELECT dataset_id, dataset_id IN ('1-URGENT', '2-HIGH') AS is_ood, count(*) AS n FROM recs GROUP BY ALL")
def _(spark, d):
    return P.mark_ood(V.recs(spark, d), ["1-URGENT", "2-HIGH"]).groupBy("dataset_id", "is_ood").agg(F.count("*").alias("n"))


@query("token_cost", "recs", "SELECT record_index, model_name, run_no, round(CASE WHEN run_no = 1 THEN 0.5 WHEN model_name = 'm0' THEN 0.0 ELSE cost END, 9) AS cost FROM recs")
def _(spark, d):
    r = V.recs(spark, d).withColumn("provider_cost", F.when(F.col("run_no") == 1, 0.5)).drop("cost")
    return rounded(P.token_cost(r, V.prices(spark).where("model_name <> 'm0'")).select("record_index", "model_name", "run_no", "cost"))


@query("reprice_zero_cost", "recs", "SELECT record_index, model_name, run_no, round(CASE WHEN run_no = 1 THEN 7.0 ELSE cost END, 9) AS cost FROM recs")
def _(spark, d):
    r = V.recs(spark, d).withColumn("cost", F.when(F.col("run_no") == 1, 7.0).otherwise(0.0))
    return rounded(P.reprice_zero_cost(r, V.prices(spark)).select("record_index", "model_name", "run_no", "cost"))
