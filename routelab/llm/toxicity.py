"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: words (letters and digits, A-Z folded), pairs of neighbours and pairs with one word between, hashed to
2 ** ``bits``; a feature counts once per text. Training takes at most ``max_train_rows`` labelled rows (the smallest by id hash), so one
task can fit them in the order of that hash; with ``shards`` above 1 they are dealt out and the weights averaged. Features in fewer than
``min_rows`` of them are left out. L1 leaves a few thousand weights, so the model is small whatever the corpus; scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm import textbytes as tb
from routelab.llm.common import held_out, read_text_column

BITS = 22
MAX_TRAIN_ROWS = 24_000
SHARDS = 1


def feature_ids(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature id of each word, pair and skip pair; id 0 is left for the bias."""
    buf, starts = tb.joined(texts)
    begin, end, doc = tb.word_spans(buf, starts, tb.letter_words())
    h = tb.Sums(buf, tb.lower_values()).of(begin, end)
    ids, docs = [h], [doc]
    for gap, c in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        ids.append(tb.mix64(h[:-gap] * np.uint64(c) + h[gap:])[same])
        docs.append(doc[gap:][same])
    return np.concatenate(docs), (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64) % ((1 << bits) - 1) + 1


def distinct_pairs(doc: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.int64) << bits) | ids)
    return both >> bits, both & ((1 << bits) - 1)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> dict[int, float]:
    """FTRL-proximal with per-coordinate rates; rows are (feature ids, label). Only weights that L1 leaves are returned."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i: np.ndarray, pull: float) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) > pull, -(zi - np.sign(zi) * pull) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for ids, y in rows:
            w = weights(ids, l1)
            w[0] = weights(ids[:1], 0.0)[0]  # the bias is not pulled to zero
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            old = n[ids]
            n[ids] = new = old + g * g
            z[ids] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
    used = np.flatnonzero(np.abs(z) > l1)
    used = np.union1d([0], used)
    w = weights(used, l1)
    w[0] = weights(used[:1], 0.0)[0]
    return {int(i): float(x) for i, x in zip(used, w) if x}


def train_ids(labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` labelled rows that are not held out, the smallest by hash of the id: doc_id, y, rank hash. Repeated ids: the larger label."""
    rows = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return least_hashes(rows.withColumn("h", F.xxhash64("doc_id")), max_rows)


def least_hashes(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of least ``h`` (64 bits, even), then ``doc_id``. Hashes are cut at twice the wanted share first, so the one task that orders them gets
    about 2 * ``most`` rows whatever the table."""
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.col("h") < int(-(1 << 63) + (1 << 64) * (2 * most / n)))
    return rows.orderBy("h", "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
        max_train_rows: int = MAX_TRAIN_ROWS, shards: int = SHARDS, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0,
        epochs: int = 8, min_rows: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and weights. Without labelled rows the model is empty (all scores 0.5). Of rows with one id the least text is learnt."""
    # the id table has max_train_rows rows at most, whatever the corpus
    rows = read_text_column(docs, id_col, text_col).join(F.broadcast(train_ids(labels, label, max_train_rows, id_col)), "doc_id")
    rows = rows.groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
    dealt = rows.repartition(shards, F.pmod("h", F.lit(shards))).sortWithinPartitions("h", "doc_id").select("y", "text")

    def shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        for batch, texts in tb.batches(it):
            d, ids = distinct_pairs(*feature_ids(texts, bits), bits)
            cut = np.searchsorted(d, np.arange(len(texts) + 1))
            y = batch.column(0).to_pylist()
            held += [(ids[cut[i]:cut[i + 1]].astype(np.int32), y[i]) for i in range(len(texts))]
        if held:
            rows = np.zeros(1 << bits, dtype=np.int32)
            for ids, _ in held:
                rows[ids] += 1
            held = [(np.concatenate([[0], ids[rows[ids] >= min_rows]]), y) for ids, y in held]
            w = ftrl(held, bits, alpha, beta, l1, l2, epochs)
            yield pa.RecordBatch.from_pydict({"id": list(w), "w": [x * len(held) for x in w.values()], "n": [len(held) if i == 0 else 0 for i in w]})

    parts = dealt.mapInArrow(shard, "id bigint, w double, n bigint").groupBy("id").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in parts) or 1
    parts = sorted((r["id"], r["w"] / total) for r in parts)
    return np.array([i for i, _ in parts], dtype=np.int64), np.array([w for _, w in parts])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
          threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every text; an empty or null text gets the bias alone. Rows come out as they come in.

    A very long text is scored whole; repeated rows each get their row, a null id too; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    ids, weights = model

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits, dtype=np.float32)
        w[ids] = weights
        for batch, texts in tb.batches(it):
            d, f = feature_ids(texts, bits)
            hit = w[f] != 0
            d, f = distinct_pairs(d[hit], f[hit], bits)
            s = np.bincount(d, weights=w[f], minlength=len(texts)) + float(w[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], ["doc_id", "held_out", "score"])

    rows = read_text_column(docs, id_col, text_col).withColumn("held_out", held_out())
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
