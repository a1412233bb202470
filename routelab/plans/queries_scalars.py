"""Column functions over every text, vector and fact row."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.functions import money as M
from routelab.functions import similarity as S
from routelab.functions import text as T
from routelab.operators import pool as P
from routelab.operators.scoring import score_token_f1
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded
from routelab.plans.queries_scoring import golden

L = F.lit
TXT = {"value": "VARCHAR"}


def _one(fn):
    return lambda df: df.withColumn("value", fn(F.col("x")))


def twin(name: str, table: str, key: str, x: str, value: str, fn) -> None:
    """Registers a query whose input ``x`` is an expression over a table in words that both engines know; ``value`` says in SQL what must come out."""
    @query(name, "", f"SELECT {key}, {value} AS value FROM {table}")
    def _(spark, d):
        return V.table(spark, d, table).select(key, F.expr(x).alias("x")).select(key, fn(F.col("x")).alias("value"))


def _pick(key: str, *cases: str) -> str:
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


_A, _B = "CAST(p_size % 9 + 1 AS STRING)", "CAST(p_partkey % 7 + 2 AS STRING)"
_N = "CAST(floor(o_totalprice) AS BIGINT)"
_NT = f"CAST({_N} AS STRING)"
_COMMAS = f"CASE WHEN {_N} < 1000 THEN {_NT} ELSE CAST(CAST(floor({_N} / 1000.0) AS BIGINT) AS STRING) || ',' || lpad(CAST({_N} % 1000 AS STRING), 3, '0') END"
_PRICE = "CAST(o_totalprice AS DECIMAL(12, 2))"

twin("math_normalize", "part", "p_partkey",
     _pick("p_partkey", f"chr(92) || 'dfrac' || {_A} || {_B}", "'x = ' || CAST(p_size + 1 AS STRING) || '.5'", f"{_A} || '/' || {_B}", "chr(92) || 'text{ ' || p_brand || ' }'", f"'.' || {_A} || chr(92) || '%'"),
     _pick("p_partkey", f"chr(92) || 'frac{{' || {_A} || '}}{{' || {_B} || '}}'", "CAST(p_size + 1 AS STRING) || '.5'", f"chr(92) || 'frac{{' || {_A} || '}}{{' || {_B} || '}}'", "p_brand",
           f"CASE WHEN p_size % 9 + 1 = 5 THEN chr(92) || 'frac{{1}}{{2}}' ELSE '0.' || {_A} END"), T.math_normalize)
twin("number_normalize", "orders", "o_orderkey", _pick("o_orderkey", f"'$' || {_COMMAS}", f"{_NT} || ' cm'", f"{_NT} || ' million'", f"chr(92) || 'frac{{' || {_NT} || '}}{{7}}'", f"'{{' || {_NT} || '.0}}'"),
     _pick("o_orderkey", _NT, _NT, f"{_NT} || '*10^6'", f"{_NT} || '/7'", _NT), T.number_normalize)
twin("tuple_split", "orders", "o_orderkey", _pick("o_orderkey", f"'(' || CAST(o_orderkey AS STRING) || ', ' || {_COMMAS} || ', ' || o_orderstatus || ')'", _COMMAS, f"'[' || o_orderpriority || ', ' || {_COMMAS} || ')'"),
     _pick("o_orderkey", f"CAST(o_orderkey AS STRING) || '|' || {_NT} || '|' || o_orderstatus", _NT, f"o_orderpriority || '|' || {_NT}"), lambda c: F.array_join(T.tuple_split(c), "|"))
twin("rounded_number", "orders", "o_orderkey", _pick("o_orderkey", f"'about ' || CAST({_PRICE} AS STRING) || ' units'", "CAST(o_custkey AS STRING) || '.5'", f"'-' || CAST({_PRICE} AS STRING)", "'none'"),
     _pick("o_orderkey", f"CAST(CAST(round_even(CAST({_PRICE} AS DOUBLE), 0) AS BIGINT) AS STRING) || '.0'", "CAST(o_custkey + o_custkey % 2 AS STRING) || '.0'",
           f"'-' || CAST(CAST(round_even(CAST({_PRICE} AS DOUBLE), 0) AS BIGINT) AS STRING) || '.0'", "'none'"), T.rounded_number)
twin("fenced_code", "documents", "doc_id", _pick("doc_id", "text || chr(10) || '```' || chr(10) || source || chr(10) || 'lang = ' || lang || chr(10) || '```' || chr(10)", "text",
                                                "'```old' || chr(10) || lang || chr(10) || '```' || chr(10) || text || chr(10) || '```py' || chr(10) || lang || chr(10) || '```'"),
     _pick("doc_id", "source || chr(10) || 'lang = ' || lang", "''", "lang"), T.fenced_code)
twin("dataset_from_file_name", "documents", "doc_id", _pick("doc_id", "'/runs/' || lang || CAST(doc_id AS STRING) || '_anthropic_' || source || '.json'", "lang || '-experiment_' || source || '-2025.json'",
                                                            "'a/b/' || lang || CAST(doc_id AS STRING) || '.json'", "'tau2_' || lang || '_' || source || '.json'", "lang || '-v' || CAST(doc_id AS STRING) || '_gpt-' || source || '.json'"),
     _pick("doc_id", "lang || CAST(doc_id AS STRING)", "lang || '-experiment'", "lang || CAST(doc_id AS STRING)", "'tau2_' || lang", "lang || '-v' || CAST(doc_id AS STRING)"), T.dataset_from_file_name)


@query("token_f1_answer", "", """, n AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS t FROM part),
 s AS (SELECT n.p_partkey, len(n.t) AS np, len(m.t) AS nt, CAST(list_sum([least(len([1 for y in n.t if y = w]), len([1 for y in m.t if y = w])) for w in list_distinct(n.t)]) AS DOUBLE) AS same FROM n JOIN n m ON m.p_partkey = n.p_partkey + 1)
SELECT p_partkey, round(CASE WHEN same = 0 THEN 0 ELSE 2 * (same / np) * (same / nt) / (same / np + same / nt) END, 6) AS f1 FROM s""")
def _(spark, d):
    n = V.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    j = n.join(n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u")), "p_partkey")
    return rounded(j.select("p_partkey", T.token_f1(F.col("t"), F.col("u"))["f1"].alias("f1")), 6)


_MODEL = _pick("p_partkey", "'gpt-5-' || CASE WHEN p_size % 2 = 0 THEN 'medium' ELSE 'high' END", "p_type || '/' || p_name || ' ' || p_brand", "p_brand")


@query("canonical_model_name", "", f"""SELECT p_partkey, {_pick("p_partkey", "'gpt-5'", "p_name || ' ' || p_brand", "p_brand")} AS name,
 CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'medium' ELSE 'high' END END AS effort, replace(replace({_MODEL}, '/', '_'), ' ', '_') AS path_name FROM part""")
def _(spark, d):
    return V.table(spark, d, "part").select("p_partkey", T.canonical_model_name(F.expr(_MODEL)).alias("n")).select("p_partkey", "n.*")


_QA = r"""list_aggregate(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), 'string_agg', ' ')"""


@query("qa_normalize", "", f"SELECT doc_id, md5(coalesce({_QA}, '')) AS h FROM documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.qa_normalize(F.col("text"))).alias("h"))


_TOK = f""", n AS (SELECT doc_id, string_split(coalesce({_QA}, ''), ' ') AS t FROM documents),
 c AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(t) AS w FROM n) GROUP BY ALL),
 s AS (SELECT a.doc_id, sum(least(a.k, b.k)) AS same FROM c a JOIN c b ON b.doc_id = a.doc_id - 1 AND b.w = a.w GROUP BY 1)"""


def _neighbours(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


@query("token_f1", "", _TOK + """ SELECT n.doc_id, round(coalesce(2 * (same / len(n.t)) * (same / len(m.t)) / (same / len(n.t) + same / len(m.t)), 0.0), 6) AS f1,
 round(coalesce(same / len(n.t), 0.0), 6) AS precision, round(coalesce(same / len(m.t), 0.0), 6) AS recall FROM n JOIN n m ON m.doc_id = n.doc_id - 1 LEFT JOIN s ON s.doc_id = n.doc_id""")
def _(spark, d):
    return rounded(score_token_f1(_neighbours(spark, d), "doc_id", "text", "other"), 6)


@query("qa_exact", "", _TOK.split(",\n c AS")[0] + " SELECT n.doc_id, n.t = m.t AS same FROM n JOIN n m ON m.doc_id = n.doc_id - 1")
def _(spark, d):
    return _neighbours(spark, d).select("doc_id", T.qa_exact(F.col("text"), F.col("other")).alias("same"))


golden("qa_normalize_choice", ["x"], TXT, [("{t} (A) or (b)", "(b)"), ("plain text", "")], _one(lambda c: T.qa_normalize(c, "mc")))
golden("choice_letter", ["x"], TXT, [("{t}\nAnswer: B\nanswer:$C", "C"), ("{t}\nFinal Answer\n\n D", "D"), ("{t} \\boxed{A{v}}", "A{v}"), (" B", "B"), ("{t} names no letter", "")],
       _one(lambda c: T.choice_letter(c, "A-D")))
golden("boxed_last", ["x"], TXT, [("{t} \\boxed{1} \\boxed{a{b}{c{v}}} }", "a{b}{c{v}}"), ("{t} \\boxed{open", None), ("no box {v}", None), ("{t}\\boxed 5", None)], _one(T.boxed))
golden("boxed_first", ["x"], TXT, [("\\boxed{ x^{2} } {t} \\boxed{3}", "x^{2}"), ("{v} \\boxed{open", "open"), ("no box", "")], _one(lambda c: T.boxed(c, "first")))
golden("last_integer", ["x"], TXT, [("{t} 12 and 3{v}", "3{v}"), ("none", None), ("a1 7 b2", "7")], _one(T.last_integer))
golden("tagged_span", ["x"], TXT, [("{t}<answer>1</answer><answer> 2{v} </answer> x", "2{v}"), ("plain {v}", "plain {v}"), ("<answer>open", "open")], _one(T.tagged_span))
golden("parse_grid", ["x"], TXT, [("{t} [[1, 2], [{v}, 4]]", "1,2;{v},4"), ("[[1], [2, 3]]", None), ("{t} none", None)],
       _one(lambda c: F.array_join(F.transform(T.parse_grid(c), lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ";")))
golden("bracket_text", ["x"], {"basic": "VARCHAR", "clean": "VARCHAR", "logic": "VARCHAR", "math": "VARCHAR"}, [
    ("[[ a. b ]] {t}", "[[a. b]]", "[[a.b]]", "[[ab]]", "a. b"), ("$\\boxed{x = {v}}$", "[[x = {v}]]", "[[x={v}]]", "[[x={v}]]", " {v}"), ("none", "NULL", "NULL", "NULL", "NULL")],
    lambda df: df.withColumns({k: T.bracket_text(F.col("x"), k) for k in ("basic", "clean", "logic", "math")}))


@query("vector_math", "", """, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance, round(a.v[1] / sqrt(list_inner_product(a.v, a.v)), 6) AS unit_first
FROM e a JOIN e b ON b.vec_id = a.vec_id - 1""")
def _(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    a, b = F.col("embedding"), F.col("other")
    return rounded(j.select("vec_id", S.dot(a, b).alias("dot"), S.cosine(a, b).alias("cosine"), (1 - S.dot(S.l2_normalize(a), S.l2_normalize(b))).alias("distance"),
                            S.l2_normalize(a)[0].alias("unit_first")), 6)


@query("softmax", "", """, e AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS p, round(1 / (1 + exp(-x)), 6) AS s FROM e""")
def _(spark, d):
    v = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    z = F.zip_with(S.softmax(F.col("e")), "e", lambda p, x: F.struct(p.alias("p"), S.sigmoid(x).alias("s")))
    return rounded(v.select("vec_id", F.posexplode(z).alias("pos", "z")).select("vec_id", "pos", "z.p", "z.s"), 6)


@query("kendall_similarity", "", """, e AS (SELECT vec_id, i, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
 p AS (SELECT a.vec_id, a.i AS i, a.x AS x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id - 1 AND b.i = a.i)
SELECT p.vec_id, round(1 - count(*) FILTER ((p.x < q.x AND p.y > q.y) OR (p.x > q.x AND p.y < q.y)) / 2016.0, 6) AS tau FROM p JOIN p q ON q.vec_id = p.vec_id AND q.i > p.i GROUP BY 1""".replace("/ 2016.0", "/ CAST(2016 AS DOUBLE)"))
def _(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    j = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return rounded(j.select("vec_id", S.kendall_similarity(F.col("a"), F.col("b")).alias("tau")), 6)


@query("jaccard", "", r""", w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS s FROM documents)
SELECT a.doc_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS j FROM w a JOIN w b ON b.doc_id = a.doc_id - 1""")
def _(spark, d):
    return rounded(_neighbours(spark, d).select("doc_id", S.jaccard(S.words(F.col("text")), S.words(F.col("other"))).alias("j")), 6)


@query("length_penalty", "", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE CAST(least(10.0, greatest(length(text) - 700, 300 - length(text), 0) / 100.0) AS DOUBLE) END AS penalty FROM documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.length_penalty(F.col("text")).alias("penalty"))


@query("completeness", "", "SELECT doc_id, round((CAST(length(text) > 0 AS INT) + CAST(length(lang) > 0 AS INT)) * 10.0 / CAST(3 AS DOUBLE), 6) AS share FROM documents")
def _(spark, d):
    m = F.create_map(L("a"), F.col("text"), L("b"), F.col("lang"), L("c"), L(""))
    return rounded(V.table(spark, d, "documents").select("doc_id", S.completeness(m, ["a", "b", "c"]).alias("share")), 6)


# projections

@query("json_path_extract", "", """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS miss FROM events""")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", T.json_path_extract(F.col("props"), {"k": "k", "miss": "a.b[0].c"}).alias("x")).select("event_id", "x.*")


@query("format_prompts", "", """SELECT p_partkey, 'Item ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type || chr(10) || p_name || ' | ' || p_brand AS prompt FROM part""")
def _(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("choices"), F.array("p_brand", "p_type").alias("history"),
                                         F.array(F.array("p_name", "p_brand")).alias("rows"))
    return P.format_prompts(p, "Item {p_name}\n{choices}\n{history}\n{rows}", {"choices": "options", "history": "bullets", "rows": "table"}).select("p_partkey", "prompt")


golden("build_scorer_text", ["a", "b"], TXT, [("Q: one Q: two", "{v} {t}.", "Q: two {v} {t}."), ("plain", "{v}", "plain {v}"), ("", "x{v}", "x{v}")],
       lambda df: df.withColumn("value", T.build_scorer_text(F.col("a"), F.col("b"))))
golden("label_tasks", ["x"], TXT, [("Answer the following math {v} question: {t}", "math {v}"), ("{v}", None)], _one(T.label_tasks))


@query("request_key", "", """SELECT event_id, sha256('{' || '"event_type":"' || event_type || '"' || CASE WHEN user_id % 2 = 0 THEN ',"user_id":' || CAST(user_id AS VARCHAR) ELSE '' END || '}') AS request_key FROM events""")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user_id"))
    return e.select("event_id", T.request_key(["user_id", "event_type"]).alias("request_key"))


@query("clean_usage_cost", "", "SELECT event_id, CASE WHEN value - 10 >= 0 THEN round(value - 10, 9) ELSE 0.0 END AS cost FROM events")
def _(spark, d):
    return rounded(V.table(spark, d, "events").select("event_id", M.clean_usage_cost(F.col("value") - 10).alias("cost")))


@query("percent_to_fraction", "", "SELECT event_id, CASE WHEN value > 1.0 THEN round(value / 100.0, 9) ELSE value END AS fraction FROM events")
def _(spark, d):
    return rounded(V.table(spark, d, "events").select("event_id", M.percent_to_fraction("value").alias("fraction")))
