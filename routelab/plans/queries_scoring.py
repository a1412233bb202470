"""Scoring jobs over outputs that embed every document's whole text.

Each output is built from one of a few forms per document; the SQL side states the expected result of each form.
``{t}`` is the whole text, ``{v}`` is ``doc_id % 7``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from routelab.operators import scoring as G
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded

L = F.lit


def forms(spark, d, names: Sequence[str], rows: Sequence[tuple]):
    """Documents with text columns filled from the form that ``doc_id`` selects."""
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    out = [F.col("doc_id").alias("id")]
    for i, n in enumerate(names):
        pick = F.element_at(F.array(*[L(r[i]).cast("string") for r in rows]), (F.col("doc_id") % len(rows) + 1).cast("int"))
        out.append(F.replace(F.replace(pick, L("{t}"), F.col("text")), L("{v}"), (F.col("doc_id") % 7).cast("string")).alias(n))
    return docs.select(*out)


def expected(names: Sequence[str], rows: Sequence[tuple], kinds: Sequence[str]) -> str:
    """SQL with the expected value per form; text values may hold {t} and {v}."""
    cols = ["doc_id AS id"]
    for i, (n, k) in enumerate(zip(names, kinds)):
        vals = ", ".join("NULL" if r[i] is None else "'" + str(r[i]).replace("'", "''") + "'" for r in rows)
        e = f"list_extract([{vals}], doc_id % {len(rows)} + 1)"
        if k == "VARCHAR":
            cols.append(f"replace(replace({e}, '{{t}}', text), '{{v}}', CAST(doc_id % 7 AS VARCHAR)) AS {n}")
        else:
            cols.append(f"CAST({e} AS {k}) AS {n}")
    return "SELECT " + ", ".join(cols) + " FROM documents"


def golden(name: str, inputs: Sequence[str], outputs: dict[str, str], rows: Sequence[tuple], run, digits: int = 9):
    """Registers a query: the first columns of ``rows`` are inputs, the rest are expected outputs."""
    n = len(inputs)

    @query(name, "", expected(list(outputs), [r[n:] for r in rows], list(outputs.values())))
    def _(spark, d):
        return rounded(run(forms(spark, d, inputs, [r[:n] for r in rows])).select("id", *outputs), digits)


S = {"score": "DOUBLE"}
P = {"prediction": "VARCHAR", "score": "DOUBLE"}

golden("score_multiple_choice", ["dataset_id", "output", "answer"], P, [
    ("arcc", "{t}\nAnswer: B", "B", "B", 1), ("arcc", "{t}\nanswer: $c.", "C", "c", 0),
    ("mmlupro", "Answer: A {t}\nAnswer: J", "J", "J", 1), ("arcc", "{t} so \\boxed{D}", "D", "D", 1),
    ("winogrande", "{t}\nAnswer: A", "1", "A", 1), ("winogrande", "{t}\nAnswer: A", "2", "A", 0),
    ("arcc", "{t}\nAnswer: E", "E", "E", 1), ("brainteaser", "{t}\nAnswer: E", "E", "E", 1), ("truthfulqa", "{t}\nAnswer: E\nFinal Answer\n\n D", "D", "D", 1),
    ("arcc", "\n\tB", "B", "B", 1), ("arcc", "{t}\nAnswer: A", "1", "A", 0), ("gpqa", "B", "B", "B", 1), ("medqa", "{t}\nFinal Answer\n\n C", "C", "C", 1)], G.score_multiple_choice)

golden("score_math", ["output", "answer"], P, [
    ("{t} \\boxed{\\frac12}", "\\frac{1}{2}", "\\frac12", 1), ("{t} \\boxed{0.5}", "1/2", "0.5", 1),
    ("{t} \\boxed{1} then \\boxed{\\sqrt{2{v}}}", "\\sqrt{2{v}}", "\\sqrt{2{v}}", 1), ("{t} \\boxed{1,000}", "1000", "1,000", 1),
    ("{t} \\boxed{(1, 2)}", "(1,2.0)", "(1, 2)", 1), ("{t} \\boxed{(1.50, x)}", "(3/2,x)", "(1.50, x)", 1),
    ("{t}\nAnswer: 4{v} cm", "4{v}", "4{v} cm", 1), ("{t} \\boxed{x=5}", "5", "x=5", 1), ("{t} \\boxed{2/4}", "1/2", "2/4", 0)],
    G.score_math)

golden("score_outputs", ["dataset_id", "output", "answer", "payload"], {"prediction": "VARCHAR", "score": "DOUBLE"}, [
    ("arcc", "{t}\nAnswer: E", "E", None, "E", 1), ("medqa", "B", "B", "not json", "B", 1), ("winogrande", "{t}\nAnswer: A", "1", None, "A", 1), ("mmlupro", "{t}\nAnswer: J", "J", "{}", "J", 1),
    ("meld", "{t}\nAnswer: G", "F", None, "G", 0), ("math500", "{t} Final Answer: 4{v}", "4{v}", None, "4{v}", 1), ("math500", "{t} Answer: 4{v}", "4{v}", None, None, 0),
    ("aime2025", "{t} \\boxed{70}", "70", None, "70", 1), ("bbh", "42", "42", None, "42", 1), ("bbh", "{t}\nAnswer: valid", "valid", None, "valid", 1), ("finqa", "{t} \\boxed{12.3}", "12", None, "12.3", 1),
    ("kandk", "{t}\nCONCLUSION:\n(1) Ann is a knight", "(1) Ann is a knight", None, "(1) Ann is a knight", 1), ("arc-agi", "{t} [[1, 2], [3, 4]]", "[[[1,2],[3,4]]]", None, None, 1),
    ("korbench", "[[b a]] {t}", "[[a b]]", '{"question_type": "puzzle", "rule_id": "3", "idx": "1"}', "[[ba]]", 1), ("korbench", "[[b c]]", "[[a b]]", '{"question_type": "puzzle", "rule_id": "3", "idx": "1"}', "[[bc]]", 0),
    ("sgibench-deepresearch", "no tag {v}", "0.2{v}", '{"parsed": "0.2{v}"}', "no tag {v}", 1), ("sgibench-deepresearch", "<answer>{v}</answer> {t}", "0.25", None, "{v}", 0),
    ("humaneval", "{t}", "", '{"tests": [{"pass": true, "returncode": 0, "runtime": 0.1}, {"pass": true}]}', None, 1), ("mbpp", "{t}", "", '{"tests": [{"pass": true}, {"pass": false}]}', None, 0),
    ("livecodebench", "{t}", "", '{"tests": []}', None, 0), ("simpleqa", "{t}", "x", '{"reply": "A"}', "A", 1), ("simpleqa", "A {t}", "x", '{"reply": "B: wrong"}', "B", 0), ("simpleqa", "A", "x", None, "C", 0),
    ("hle", "{t}", "x", '{"reply": "correct: yes"}', None, 1), ("frontierscience", "{t}", "x", '{"reply": "<result><grade>CORRECT</grade></result>"}', None, 1),
    ("frontierscience-research", "{t}", "x", '{"reply": "I give 7 points"}', None, 0.7), ("arenahard", "{t}", "x", '{"round1": "[[B>>A]]", "round2": "[[A>B]]"}', None, 1),
    ("arenahard", "{t}", "x", '{"round1": "[[A=B]]"}', None, 0), ("sfe", "{t} FINAL ANSWER: B", "B", '{"kind": "mcq", "reply": "9"}', "B", 0.9), ("elsewhere", "{t}", "x", None, None, None)], G.score_outputs)

golden("score_numeric_qa", ["output", "answer"], P, [
    ("{t} \\boxed{12.3}", "12", "12.3", 1), ("{t} \\boxed{12.5%}", "12.1", "12.5%", 1), ("{t} \\boxed{-3.7}", "-4", "-3.7", 1),
    ("{t} \\boxed{3.5}", "3", "3.5", 0), ("no box at all", "3{v}", "", 0)], G.score_numeric_qa)

golden("score_logic_assignment", ["output", "answer"], {"ratio": "DOUBLE", "reason": "VARCHAR", "score": "DOUBLE"}, [
    ("{t}\nCONCLUSION:\n(1) Ann is a knight.\n(2) Bob is a knave.\n### Reason x", "(1) Ann is a knight\n(2) Bob is a knave", 1, "", 1),
    ("{t}\nCONCLUSION:\n(1) Ann is a Knight.\n(2) Bob is a knight.", "(1) Ann is a knight\n(2) Bob is a knave", 0.5, "wrong_identity", 0),
    ("{t}\nCONCLUSION:\n(1) Ann is a knight.\n(2) Bob is a knave.\n(3) Cy is a knave.", "(1) Ann is a knight\n(2) Bob is a knave", 0, "beyond_list", 0),
    ("{t}\nCONCLUSION:\nif (1) Ann is a knight", "(1) Ann is a knight\n(2) Bob is a knave", 0, "contain_if", 0),
    ("{t}\nCONCLUSION:\nnobody", "", 0, "wrong_identity", 0)], G.score_logic_assignment)


@query("vote_assignments", "", """SELECT source, CASE WHEN a >= b THEN 'Ann:knight;Bob:knave' ELSE 'Ann:knave;Bob:knave' END AS assignment, greatest(a, b) AS votes,
 round(greatest(a, b) / (a + b), 9) AS agreement FROM (SELECT source, count(*) FILTER (doc_id % 3 < 2) AS a, count(*) FILTER (doc_id % 3 = 2) AS b FROM documents GROUP BY 1)""".replace(
    "a >= b", "a > b"))
def _(spark, d):
    f = forms(spark, d, ["output"], [
        ("{t}\nCONCLUSION:\n(1) Ann: Knight\n(2) Bob: Knave",), ("{t}\nCONCLUSION:\n(1) **Ann** is a knight, (2) Bob is a knave",),
        ("{t}\nCONCLUSION:\nAnn is a knave\nBob is a knight\nBob is a knave",)])
    src = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return rounded(G.vote_assignments(f.join(src, "id"), ["source"]))


golden("score_rule_tasks", ["question_type", "rule_id", "idx", "output", "answer"], S, [
    ("logic", "5", "1", "[[b;a]] {t}", "a]];[[b", 1), ("logic", "1", "2", "[[ A.B ]] {t}", "[[AB]]", 1),
    ("operation", "3", "178", "[[x≥3, y ≤ 2]] {t}", "[[≤2, ≥3]]", 1), ("operation", "18", "4", "[[ba, c]] {t}", "[[abc]]", 1),
    ("operation", "23", "5", "[[3, 0{v}]] {t}", "[[3 {v}]]", 1), ("operation", "2", "6", "[[b or a]] {t}", "[[a or b]]", 1),
    ("operation", "2", "7", "[[4{v}]] {t}", "[[4{v}]]", 1), ("operation", "2", "9", "$\\boxed{7}$", "[[7]]", 1),
    ("puzzle", "1", "1", "[[AB 1c]] {t}", "[[abc]]", 1), ("puzzle", "2", "1", "[[Cat]] {t}", "[[dog,cat]]", 1),
    ("puzzle", "3", "1", "[[b, A]] {t}", "[[a b]]", 1), ("puzzle", "4", "1", "[[CA]] {t}", "[[cat]]", 1),
    ("puzzle", "5", "1", "[[2, 1]] {t}", "[[1,2]]", 1), ("puzzle", "9", "1", "[[1 + 2 × 3 = 7]] {t}", "[[4 + 1 * 3 = 7]]", 1),
    ("puzzle", "9", "1", "[[1 - 2 × 3 = 7]] {t}", "[[4 + 1 * 3 = 7]]", 0), ("puzzle", "10", "1", "[[4*6 = 24]] {t}", "[[6*4=24]]", 1),
    ("puzzle", "10", "1", "[[(5-1)*6=24]] {t}", "[[6*(5-1)=24]]", 1), ("puzzle", "10", "1", "[[6/(1-3/4)=24]] {t}", "[[6/(1-3/4)=24]]", 1), ("puzzle", "10", "1", "[[(5-1)*(6=24]]", "[[6*(5-1)=24]]", 0),
    ("puzzle", "9", "1", "[[((1+2) × 3)=9]] {t}", "[[4 + 1 * 3 = 9]]", 1), ("puzzle", "9", "1", "[[1+2*(3-6)=-5]]", "[[9 + 2 * 3 - 6 = -5]]", 1),
    ("puzzle", "18", "1", "[[1, 2]] {t}", "[[12]]", 1), ("puzzle", "20", "1", "[[x-y]] {t}", "[[x y]]", 1),
    ("cipher", "1", "1", "[[ HI ]] {t}", "[[HI]]", 1), ("cipher", "1", "1", "no brackets", "[[HI]]", 0)], G.score_rule_tasks)

golden("parse_letter_verdict", ["output"], P, [("a) verdict: A {t}", "A", 1), ("verdict: B {t}", "B", 0), ("none", "C", 0)], G.parse_letter_verdict)

golden("parse_judge_fields", ["output"], {"final_answer": "VARCHAR", "reasoning": "VARCHAR", "correct": "VARCHAR", "confidence": "BIGINT", "score": "DOUBLE"}, [
    ("extracted_final_answer: 4{v}\nreasoning: same value\ncorrect: YES\nconfidence: 9{v}% {t}", "4{v}", "same value", "yes", None, 1),
    ("nothing here", "None", "", "no", 0, 0), ("extracted_final_answer:  x \nreasoning: two\nlines\ncorrect: no\nconfidence: 10", "x", "two\nlines", "no", 10, 0)],
    lambda df: G.parse_judge_fields(df).withColumn("confidence", F.when(F.col("score") == 1, None).otherwise(F.col("confidence"))))

golden("score_pairwise_rounds", ["round1", "round2"], {"label1": "VARCHAR", "label2": "VARCHAR", "score": "DOUBLE"}, [
    ("{t} [[A>B]] so [[B>>A]]", "[[a>b]] {t}", "B>>A", "A>B", 1), ("{t} [[A=B]]", "[[B=A]]", "A=B", "B=A", 0.5),
    ("{t} [[A>>B]]", "[[A>B]]", "A>>B", "A>B", 0), ("{t} none", "[[A>B]]", None, "A>B", 0)], G.score_pairwise_rounds)

golden("parse_grade_xml", ["output"], {"grade": "VARCHAR", "confidence": "VARCHAR", "score": "DOUBLE"}, [
    ("{t}<result>\n<grade>CORRECT</grade>\n<confidence> HIGH </confidence></result>", "CORRECT", "HIGH", 1),
    ("{t}<result><grade>INCORRECT</grade></result>", "INCORRECT", "LOW", 0), ("{t} no xml", "INCORRECT", "LOW", 0)], G.parse_grade_xml)

golden("final_answer", ["output"], {"prediction": "VARCHAR"}, [
    ("{t}\n**FINAL ANSWER:** \\[ x + {v} \\] end", "x + {v}"), ("{t}\nFinal Answer: `4{v}`\n\nmore", "4{v}"),
    ("{t}\nso \\boxed{a{v}}", "a{v}"), ("{t}\n\n last {v} line' \n", "last {v} line")],
    lambda df: df.withColumn("prediction", G.final_answer(F.col("output"))))

golden("parse_ten_point", ["output"], S, [("score {v}x: 7 {t}", 0.7), ("10 {t}", 1.0), ("11 {t}", 0.0), ("none", 0.0)], G.parse_ten_point)

golden("typed_answer", ["kind", "output"], {"prediction": "VARCHAR"}, [
    ("mcq", "The answer: c {t}", "C"), ("mcq", "b. {t}", "B"), ("exact_match", "it is \\boxed{{v}.5} {t}", "{v}.5"),
    ("exact_match", "value -3.2e5 {t}", "-3.2e5"), ("open_ended", "Response: some text {v}", "some text {v}")],
    lambda df: df.withColumn("prediction", G.typed_answer(F.col("output"), F.col("kind"))))

golden("score_grids", ["output", "answer"], {"n_outputs": "INTEGER", "score": "DOUBLE"}, [
    ("{t} [[1, 2], [3, {v}]]", "[[[1,2],[3,{v}]]]", 1, 1), ("{t} [[1, 2], [3]]", "[[[1,2],[3,4]]]", 1, 0),
    ("{t} [[1]] and [[{v}, 2]]", "[[[1]],[[{v},2]]]", 2, 1), ("{t} none", "[[[1]]]", 1, 0)], G.score_grids)

@query("score_step_judgements", "", """SELECT l_orderkey AS id, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS score FROM lineitem GROUP BY 1
UNION ALL SELECT -1 - o_orderkey, 0.0 FROM orders WHERE o_orderkey % 2 = 0""")
def _(spark, d):
    # the lines of an order are its steps; half of the orders also come with an answer that has no list
    step = F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", "Correct").otherwise("wrong").alias("judge"))
    lines = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(L("steps: "), F.to_json(F.collect_list(step)), L(" end")).alias("output"))
    bare = V.table(spark, d, "orders").where("o_orderkey % 2 = 0").select((-1 - F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("output"))
    return rounded(G.score_step_judgements(lines.unionByName(bare)).select("id", "score"), 6)


golden("score_exact_or_parsed", ["output", "parsed", "answer"], P, [
    ("{t}<answer> 4{v} </answer>", "", "4{v}", "4{v}", 1), ("{t}<answer>5</answer>", "6", "6", "5", 1), ("{t}<answer>5</answer>", "5", "6", "5", 0)],
    G.score_exact_or_parsed)

_STEPS = "mix = <combine>(\n  a=x1,\n  b={v}\n)\nout = <heat>(\n  input=mix,\n  temp=\"9{v} C\"\n)\n"
golden("score_protocol_steps", ["output", "answer"], {"order_similarity": "DOUBLE", "parameter_acc": "DOUBLE", "score": "DOUBLE"}, [
    (_STEPS, _STEPS, 1, 1, 1), (_STEPS.replace("mix", "m2"), _STEPS, 1, 1, 1), (_STEPS.replace("=mix", "=x1"), _STEPS, 1, 0.5, 0.75),
    (_STEPS.split("out")[0], _STEPS, 0, 0.5, 0.25), (_STEPS.replace("<combine>", "<zap>"), _STEPS, 0, 0, 0), ("{t}", "none {v}", 1, 1, 1)],
    G.score_protocol_steps)

@query("score_idea_graph", "", """, g AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 3 ELSE 2 END AS n,
  list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || CASE WHEN p_size > 25 THEN ' ' || p_brand ELSE '' END), ' '), lambda x: x <> '')) AS w FROM part),
 s AS (SELECT a.id, (least(a.n, b.n) - 1) / CAST(greatest(a.n, b.n) - 1 AS DOUBLE) AS e, len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) AS t FROM g a JOIN g b ON b.id = a.id - 1)
SELECT id, round(e, 6) AS edge_similarity, round(t, 6) AS text_similarity, round(CAST(0.6 AS DOUBLE) * e + CAST(0.4 AS DOUBLE) * t, 6) AS score FROM s""")
def _(spark, d):
    # the comparison costs far more than the bytes of a row say, so the rows of few files are dealt to all tasks, by the key they meet on;
    # unpacked they are many times as large as their file, too large to pass through the driver
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size", "p_brand")
    texts = F.array("p_name", "p_type", F.when(F.col("p_size") > 25, F.col("p_brand")))
    steps = F.map_from_entries(F.filter(F.transform(texts, lambda v, i: F.struct((i + 1).cast("string").alias("k"), v.alias("v"))), lambda x: x["v"].isNotNull()))
    g = parts.repartition(n, "id").select("id", steps.alias("steps"))
    ref = parts.withColumn("id", F.col("id") + 1).repartition(n, "id").select("id", steps.alias("ref_steps"))
    j = g.join(ref.hint("merge"), "id").withColumn("order", F.map_keys("steps")).withColumn("ref_order", F.map_keys("ref_steps"))
    return rounded(G.score_idea_graph(j).select("id", "edge_similarity", "text_similarity", "score"), 6)


@query("score_idea_text", "", """, e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 p AS (SELECT d.doc_id AS id, d.text, a.v AS va, b.v AS vb FROM documents d JOIN e a ON a.id = d.doc_id JOIN e b ON b.id = d.doc_id - 1),
 s AS (SELECT id, 10.0 * 2 / 6 AS comp, CASE WHEN length(text) = 0 THEN 0.0 ELSE least(10.0, greatest(length(text) - 700, 300 - length(text), 0) / 100.0) END AS pen,
  list_cosine_similarity(va, vb) AS sim FROM p), r AS (SELECT *, least(10.0, greatest(0.0, (sim - 0.2) * 10)) AS rep FROM s),
 t AS (SELECT *, greatest(0.0, least(10.0, 0.2 * comp + 0.4 * (10 - rep) + 0.4 * (10 - pen))) AS det FROM r)
SELECT id, round(CAST(comp AS DOUBLE), 6) AS completeness, round(CAST(pen AS DOUBLE), 6) AS length_penalty, round(CAST(rep AS DOUBLE), 6) AS repetition_penalty,
 round(CAST(det AS DOUBLE), 6) AS detailedness, round(sim, 6) AS effectiveness, round(CAST(((det + 10 * sim + 10 * (1 - sim)) / 3 + 5) / 2 AS DOUBLE), 6) AS score FROM t""")
def _(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("idea_vector"))
    ref = e.select((F.col("id") + 1).alias("id"), F.col("idea_vector").alias("reference_vector"))
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("idea"))
    x = docs.join(e, "id").join(ref, "id").withColumn("sentence_vectors", F.array("idea_vector", "reference_vector")).withColumn(
        "sections", F.create_map(L("Idea"), F.col("idea"), L("Dataset"), L("d"), L("ExpectedOutcome"), L(""))).withColumn("subjective", L(5.0))
    return rounded(G.score_idea_text(x).select("id", "completeness", "length_penalty", "repetition_penalty", "detailedness", "effectiveness", "score"), 6)


_VOTE = "Effectiveness: [Win A] because\nNovelty: Win B as x\nDetailedness is hard, Win A\nFeasibility: [ Win B ]\n"
golden("parse_win_lose", ["sw", "output"], {"verdicts": "VARCHAR"}, [
    ("n", _VOTE + "Overall: [Win A] {t}", "win_A,win_B,win_A,win_B,win_A"), ("y", _VOTE + "Overall: [Win A] {t}", "win_B,win_A,win_B,win_A,win_B"),
    ("n", _VOTE, None)],
    lambda df: G.parse_win_lose(df.withColumn("swapped", F.col("sw") == "y")).withColumn("verdicts", F.when(
        F.col("judgments").isNotNull(), F.array_join(F.map_values("judgments"), ","))))


@query("summarize_unit_tests", "", """SELECT user_id AS item_id, CAST(count(*) FILTER (value > 10) >= 5 AS INT) AS pass_all, CAST(count(*) FILTER (value > 10) >= 3 AS INT) AS pass_3,
 CAST(count(*) FILTER (value > 10) >= 1 AS INT) AS pass_1, round(coalesce(avg(value) FILTER (event_type <> 'error'), -1.0), 6) AS mean_runtime,
 round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events GROUP BY 1""")
def _(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("returncode"),
                                           F.col("value").alias("runtime"), (F.col("value") > 10).alias("pass"))
    return rounded(G.summarize_unit_tests(e), 6)
