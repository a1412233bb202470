"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good rows, the unlabelled set is the whole corpus, and the class prior is estimated as the share of
good rows among the labels. An additive logistic model over quantile bins of text statistics minimises the non-negative unbiased risk
pi * E_p[loss(f)] + max(0, E_u[loss(-f)] - pi * E_p[loss(-f)]). Labels of bad rows enter the prior only. As the
non-negative bound stops short of the risk's minimum, the bias is last moved so that the mean score of the corpus is the prior.

The positives are at most ``max_positives`` labelled rows (the smallest by id hash). Everything else covers all documents: the statistics are
computed once and written; bin edges come from histograms of all of them; shards of about ``shard_rows`` documents each minimise the risk
on their own and the weights are averaged by rows; the final shift comes from a histogram of all scores. Only histograms and weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm import textbytes as tb
from routelab.llm.common import held_out, text_of, written
from routelab.llm.simple8b import slices
from routelab.llm.toxicity import train_ids

MAX_POSITIVES = 20_000
SHARD_ROWS = 32_768
THRESHOLD = 0.3
BINS = 16


def _classes() -> np.ndarray:
    c = np.full(256, 9, dtype=np.int64)
    c[97:123], c[65:91], c[48:58], c[128:] = 0, 1, 2, 3
    c[[32, 9, 11, 12, 13]], c[10] = 4, 5
    c[[ord(x) for x in ".,;:"]], c[[ord(x) for x in "!?"]] = 6, 7
    c[[ord(x) for x in "'\"-()"]] = 8
    return c


_CLASS, _N_CLASS = _classes(), 10


def features(texts: list[bytes]) -> np.ndarray:
    """One row of statistics per text: byte classes, word shapes, repeats of words, pairs and lines. An empty text gives zeros."""
    buf, starts = tb.joined(texts)
    n = len(texts)
    size = np.diff(starts) - 1
    doc_of = np.repeat(np.arange(n), size + 1)
    cls = _CLASS[buf]
    share = np.bincount(doc_of * _N_CLASS + cls, minlength=n * _N_CLASS).reshape(n, _N_CLASS).astype(float)
    share[:, 5] -= 1  # the newline put after each text
    total = np.maximum(size, 1)
    begin, end, doc = tb.word_spans(buf, starts, tb.white_words())
    words = np.bincount(doc, minlength=n)
    per = np.maximum(words, 1)
    sums = tb.Sums(buf, tb.lower_values())
    h = sums.of(begin, end)

    def mean(x: np.ndarray, of: np.ndarray = doc, by: np.ndarray = per) -> np.ndarray:
        return np.bincount(of, weights=x, minlength=n) / by

    def repeats(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct keys, share of the most common key."""
        if not len(key):
            return np.ones(n), np.zeros(n)
        full = tb.mix64(key + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, count = np.unique(full, return_index=True, return_counts=True)
        d = of[at]
        most = np.zeros(n)
        np.maximum.at(most, d, count)
        had = np.bincount(of, minlength=n)
        return np.where(had, np.bincount(d, minlength=n) / np.maximum(had, 1), 1.0), most / np.maximum(had, 1)

    length = end - begin
    punct = np.concatenate([[0], np.cumsum((cls >= 6).astype(np.int32))])
    upper = np.concatenate([[0], np.cumsum((cls == 1).astype(np.int32))])
    odd = np.concatenate([[0], np.cumsum((cls == 9).astype(np.int32))])
    marks, caps, odds = punct[end] - punct[begin], upper[end] - upper[begin], odd[end] - odd[begin]
    same = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    pair = tb.mix64(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])[same] if len(h) else h
    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    full_line = line_end > line_start
    line_doc = (np.searchsorted(starts, line_start, side="right") - 1)[full_line]
    line_start, line_end = line_start[full_line], line_end[full_line]
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    mean_length = mean(length)
    cols = [np.log1p(size), np.log1p(words), *(share[:, i] / total for i in range(_N_CLASS)), mean_length, np.sqrt(np.maximum(mean(length.astype(float) ** 2) - mean_length ** 2, 0)),
            mean(caps > 0), mean((caps > 1) & (caps * 2 >= length)), mean(marks > 0), mean(marks > 1), mean(odds > 0), mean(marks == length), mean(length > 20), mean(length < 3),
            *repeats(h, doc), *repeats(pair, doc[1:][same]), mean((h[1:] == h[:-1]) & same, doc[1:]) if len(h) else np.zeros(n),
            *repeats(sums.of(line_start, line_end), line_doc), np.log1p(mean(line_end - line_start, line_doc, lines)), np.log1p(lines)]
    out = np.column_stack(cols).astype(np.float32)
    out[size == 0] = 0
    return out


def _slices(it: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about a megabyte of text, turned into Python bytes one slice at a time; memory that Arrow no longer uses goes back."""
    for batch in it:
        yield from ((b, [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]) for b in slices(batch, at, tb.CHUNK))
        pa.default_memory_pool().release_unused()


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, shard hash and statistics of every document, written below the shared folder."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(it, 3):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "held_out", "h", "x"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, h bigint, x array<float>"), "statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.float32)


def _buckets(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of each value, in an order that follows the values."""
    bits = (x + np.float32(0)).view(np.uint32)  # one zero
    return (np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)) >> np.uint32(16)).astype(np.int64)


def _bucket_start(bucket: np.ndarray) -> np.ndarray:
    bits = np.asarray(bucket, dtype=np.uint32) << np.uint32(16)
    return np.where(bits >> 31, bits & np.uint32((1 << 31) - 1), ~bits).astype(np.uint32).view(np.float32)


def corpus_edges(table: DataFrame, bins: int = BINS) -> np.ndarray:
    """Quantile edges (statistics x bins - 1) over all rows, from counts of 65,536 buckets a statistic: exact but for the width of a bucket, under 1 % of the value."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            x = _matrix(b.column(0))
            held = np.zeros((x.shape[1], 1 << 16), dtype=np.int64) if held is None else held
            np.add.at(held, (np.arange(x.shape[1])[None, :], _buckets(x)), 1)
        if held is not None:
            at = np.flatnonzero(held.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.ravel()[at])], ["at", "n"])
    got = table.select("x").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toPandas()
    at, n = got["at"].to_numpy(), got["n"].to_numpy()
    edges = []
    for i in range(int(at[-1] >> 16) + 1):
        mine = at >> 16 == i
        upto = np.cumsum(n[mine])
        need = np.arange(1, bins) * upto[-1] / bins
        edges.append(_bucket_start((at[mine] & 0xFFFF)[np.searchsorted(upto, need)] + 1))
    return np.array(edges, dtype=np.float32)


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, bins: int = BINS, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """Bin edges, weight of each bin and bias of the additive model with the least non-negative risk, for rows in memory."""
    edges = np.quantile(np.concatenate([pos, unl]), np.linspace(0, 1, bins + 1)[1:-1], axis=0).T.astype(np.float32)
    at_p, at_u = _cells(pos, edges), _cells(unl, edges)
    w, b = descend(at_p, at_u, len(edges) * bins, prior, **how)
    return edges, w, b + _shift(w[at_u].sum(1) + b, np.ones(len(unl)), prior)


def descend(at_p: np.ndarray, at_u: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias after ``steps`` of Adam on the non-negative risk; rows are the cells that they fall into."""
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    def push(g: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at.ravel(), weights=np.repeat(g, at.shape[1]), minlength=len(w))

    for t in range(1, steps + 1):
        fp, fu = w[at_p].sum(1) + b, w[at_u].sum(1) + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp = prior * (sigmoid(fp) - 1) / len(fp)
        gu = np.zeros(len(fu))
        if negative >= 0:
            gp, gu = gp - prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        g, gb = push(gp, at_p) + push(gu, at_u) + l2 * w, gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def _shift(f: np.ndarray, n: np.ndarray, prior: float) -> float:
    """What to add to the scores ``f``, each ``n`` times, so that their mean probability is the class prior."""
    low, high = -30.0, 30.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (n / (1 + np.exp(-np.clip(f + mid, -35, 35)))).sum() > prior * n.sum() else (mid, high)
    return (low + high) / 2


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)])


def _cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each statistic of each row, numbered through all statistics."""
    return binned(x, edges) + np.arange(len(edges)) * (edges.shape[1] + 1)


def _logits(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    edges, w, b = model
    return w[_cells(x, edges)].sum(1) + b


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", max_positives: int = MAX_POSITIVES, bins: int = BINS,
        shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model over a ``feature_table``, or None without trusted positives or without documents (all scores are then 0.5)."""
    known = labels.where(~held_out(id_col) & F.col(label).isin(0, 1))
    prior = known.agg(F.avg(label)).first()[0]
    positives = train_ids(labels.where(F.col(label) == 1), label, max_positives, id_col).select("doc_id")
    n = table.count()
    # the id table is bounded by its parameter; of rows with one id one is learnt
    trusted = table.join(F.broadcast(positives), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas() if n else []
    if not len(trusted):
        return None
    prior = min(max(prior, 0.01), 0.99)
    edges = corpus_edges(table, bins)
    at_p = _cells(np.stack(trusted["x"].to_numpy()).astype(np.float32), edges)
    size, unit = len(edges) * bins, float(1 << 20)

    def shard(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("x"))
        x = x[np.lexsort(x.T)]  # the sums must not depend on the order of arrival
        w, b = descend(at_p, _cells(x, edges), size, prior)
        # whole numbers add up alike in any order
        return pa.table({"at": pa.array(np.arange(size + 1), pa.int32()), "w": pa.array(np.rint(np.append(w, b) * unit).astype(np.int64) * len(x))})

    shards = max(1, round(n / shard_rows))
    # copies of a text have ids of their own; rows without an id are dealt by their place
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    dealt = table.select("x", F.pmod(F.xxhash64("doc_id", "h", place), F.lit(shards)).alias("shard"))
    got = dealt.groupBy("shard").applyInArrow(shard, "at int, w bigint").groupBy("at").agg(F.sum("w").alias("w")).orderBy("at").toPandas()
    mean = got["w"].to_numpy() / unit / n
    model = edges, mean[:-1], float(mean[-1])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(70 * 256 + 1, dtype=np.int64)
        for b in it:
            held += np.bincount(np.rint((np.clip(_logits(_matrix(b.column(0)), model), -35, 35) + 35) * 256).astype(np.int64), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["at", "n"])
    seen = table.select("x").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toPandas()
    return edges, model[1], model[2] + _shift(seen["at"].to_numpy() / 256 - 35, seen["n"].to_numpy(), prior)


def score_table(table: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of a ``feature_table``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = np.zeros(b.num_rows) if model is None else _logits(_matrix(b.column(2)), model)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], ["doc_id", "held_out", "score"])
    kind = table.schema["doc_id"].dataType.simpleString()
    scored = table.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every text; an empty or null text is scored on zero statistics.

    A very long text is read whole; repeated rows each get their row, a null id too (held out); equal texts score alike; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    table = feature_table(docs, id_col, text_col)
    return score_table(table, fit(table, labels, id_col=id_col, **options), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, all columns, in one pass: nothing is joined back.

    Without trusted positives all stay. Null and empty texts are scored on zero statistics, very long ones are read whole; repeated rows stay or go together; an
    empty table stays empty; other columns go along untouched.
    """
    model = fit(feature_table(docs, id_col, text_col), labels, id_col=id_col)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(it, at):
            if model is None:
                yield batch
                continue
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(_logits(features(texts), model), -35, 35))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
