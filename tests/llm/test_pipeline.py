"""Stages and registered queries."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from routelab.llm import quality
from routelab.llm.exact_dedup import exact_duplicates
from routelab.llm.jaccard import near_duplicates
from routelab.llm.mixing import mix
from routelab.llm.queries import ORACLES, QUERIES
from tests.llm.cases import documents, edge_rows, labels
from tools.check import norm


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline"))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rows = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    kind = name.split("_")[0]
    n = {"op4": lambda: rows("pages").count(), "op11": lambda: rows("pages").count(), "op12": lambda: 600 * rows("documents").select("lang").distinct().count()}.get(kind, lambda: rows("documents").count())()
    if kind == "op13":  # some anchors have no row in their windows
        assert 0 < len(got) <= 25 * rows("embeddings").where("vec_id % 100 = 0").count()
    else:
        assert len(got) >= n if kind == "op6" else len(got) == n
    if name in ORACLES:
        con = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        cur = con.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_stages(spark, sf, tmp_path):
    """Each stage on what its predecessor kept, against the operator's own verdict on the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "quality":
            want = [r.doc_id for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()]
        elif name == "exact_dedup":
            want = [r.doc_id for r in exact_duplicates(docs).where("kept").collect()]
        elif name == "near_dedup":
            want = [r.doc_id for r in near_duplicates(docs).where("doc_id = group_id").collect()]
        elif name == "mix":
            want = [r.doc_id for r in mix(docs).collect() for _ in range(-(-r.taken // max(r.size, 1)))]
        else:
            want = [r.doc_id for r in docs.select("doc_id").collect() for _ in range(2)]
        assert ids == sorted(want)
        if name != "sentencepiece":
            assert out.columns == columns
        docs = out


def test_stages_on_edge_rows(spark, sf, tmp_path):
    for k, rows in enumerate((edge_rows(), [])):
        docs = documents(spark, rows)
        labels(spark, [(5, 1, 0), (6, 0, 0), (8, 1, 0)]).write.parquet(str(tmp_path / f"{k}" / "labels.parquet"))
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path / f"{k}")).write.parquet(str(tmp_path / f"{k}" / name))
            docs = spark.read.parquet(str(tmp_path / f"{k}" / name))
        assert (docs.count() > 0) == bool(rows)


def test_pipeline_query(spark, sf):
    out = QUERIES["pipeline"](spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "draw", "ids", "log_prob", "perturbed", "inclusion"]
