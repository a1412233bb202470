"""Exact k nearest neighbours between two vector tables, without a cross join.

Train rows belong to the cell of their nearest pivot. A query knows its distance to every pivot, and so an upper
bound on its k-th neighbour's distance (from cell sizes and radii) and a lower bound on the distance to every
cell. Only cells within the bound can hold a neighbour; the query is sent to those by an equi join. Cells are
cut into pieces of bounded size and queries into chunks, so that a cell with most of the rows (copies of one
vector) still spreads over tasks. Pieces that lie near each other travel as a bundle of bounded size, and a query
goes once to a bundle, with the list of the pieces it needs there: where vectors are spread evenly no bound excludes
a cell, and what a query sends and gets back then counts bundles and not cells. Each (bundle, chunk) pair keeps its
k best; the last step merges them. Both steps get as many partitions as their rows need, so that a task's share does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelab.scale import seeded_hash, stable, written

L = F.lit
# what the rows of one task may take in a shuffle, in bytes
TASK_BYTES = 1 << 26


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * x @ p.T, 0.0))


def _best_pairs(left: pd.DataFrame, right: pd.DataFrame, k: int, test_id: str, train_id: str) -> pd.DataFrame:
    """The k nearest rows of ``right`` (vectors v) for each row of ``left`` (vectors q), ties by id.

    Rows of ``left`` that list the pieces they need meet only those of ``right``, and what else a neighbour in their slice needs.
    """
    cols = [test_id, train_id, "distance"]
    if left.empty or right.empty:
        return pd.DataFrame({c: [] for c in cols})
    right = right.sort_values(train_id, kind="stable")
    tv, tid = np.stack(right["v"].to_numpy()), right[train_id].to_numpy()
    listed = "pieces" in left
    if listed:
        left = left.iloc[sorted(range(len(left)), key=lambda i, p=left["pieces"].to_numpy(): p[i].tobytes())]
        piece, needed = right["piece"].to_numpy(), left["pieces"].to_numpy()
    qv, qid = np.stack(left["q"].to_numpy()), left[test_id].to_numpy()
    room = 1e-6 * (1 + np.sqrt(max((tv * tv).sum(1).max(), (qv * qv).sum(1).max())))
    found = []
    for at in range(0, len(qv), 256):
        # one product finds who can be among the k best; their distances are then taken exactly
        cols = np.isin(piece, np.unique(np.concatenate(needed[at:at + 256]))).nonzero()[0] if listed else np.arange(len(tv))
        rough = _distances(qv[at:at + 256], tv[cols] if len(cols) < len(tv) else tv)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * room if len(cols) > k else np.full(len(rough), np.inf)
        r, c = (rough <= limit[:, None]).nonzero()
        c = cols[c]
        # of copies all can be among them, so the pairs are taken some at a time
        d = np.concatenate([np.zeros(0), *[np.sqrt(((tv[c[i:i + 65536]] - qv[at + r[i:i + 65536]]) ** 2).sum(1)) for i in range(0, len(c), 65536)]])
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        mine = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((at + r[mine], c[mine], d[mine]))
    r, c, d = (np.concatenate([f[i] for f in found]) for i in range(3))
    return pd.DataFrame({test_id: qid[r], train_id: tid[c], "distance": d})


def _chain(p: np.ndarray) -> list[int]:
    """The rows of ``p`` from near to near, so that neighbours in the list lie close to each other."""
    d = _distances(p, p)
    walk, rest = [0], np.ones(len(p), dtype=bool)
    for _ in range(len(p) - 1):
        rest[walk[-1]] = False
        walk.append(int(np.where(rest, d[walk[-1]], np.inf).argmin()))
    return walk


def _bundles(sizes: np.ndarray, order: list[int], block: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each piece and its bundle: a cell of more than ``block`` rows has several pieces, a bundle takes pieces along ``order`` up to ``most`` rows."""
    cell, bundle, held, at = [], [], 0.0, 0
    for c in order:
        n = max(1, -(-int(sizes[c]) // block))
        for _ in range(n):
            if held and held + sizes[c] / n > most:
                at, held = at + 1, 0.0
            held += sizes[c] / n
            cell.append(c)
            bundle.append(at)
    return np.array(cell), np.array(bundle)


def knn_join(test: DataFrame, train: DataFrame, k: int = 131, test_id: str = "test_id", train_id: str = "train_id",
             vector: str = "embedding", pivots: int | None = None, block: int = 4096, chunk: int = 16384, bundle: int = 16384) -> DataFrame:
    """(test_id, train_id, distance, rank): the k nearest train rows by Euclidean distance, ties by id.

    The pivots (at most 256 vectors) and per-cell sizes and radii are the only data on the driver.
    """
    spark = test.sparkSession
    tr = train.select(train_id, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    te = test.select(test_id, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n_train, n_test = tr.count(), te.count()
    t_kind, q_kind = dict(tr.dtypes)[train_id], dict(te.dtypes)[test_id]
    if not n_train or not n_test:
        return spark.createDataFrame([], f"{test_id} {q_kind}, {train_id} {t_kind}, distance double, rank int")
    m = pivots or int(min(256, max(1, round(n_train ** 0.5))))
    piv = np.array([r[0] for r in tr.orderBy(seeded_hash("pivot", train_id), train_id).select("v").limit(m).collect()], dtype=float)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(np.stack(b["v"].to_numpy()), piv)
            yield b.assign(cell=d.argmin(1).astype("int32"), r=d.min(1))
    cells = stable(tr.mapInPandas(to_cells, f"{train_id} {t_kind}, v array<double>, cell int, r double"))
    info = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    ids = np.array([r["cell"] for r in info])
    n, lo, hi = (np.array([r[c] for r in info], dtype=float) for c in ("n", "lo", "hi"))
    used = piv[ids]
    # small tables are dealt to some tasks too
    cell_of, bundle_of = _bundles(n, _chain(used), block, max(block, min(bundle, n_train // 8)))
    n_chunks = max(-(-n_test // chunk), min(4, -(-n_test // 1024)))
    slack = 1e-9

    def to_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(np.stack(b["v"].to_numpy()), used)
            reach = d + hi
            order = reach.argsort(1)
            enough = n[order].cumsum(1) >= k
            pos = np.where(enough.any(1), enough.argmax(1), reach.shape[1] - 1)
            bound = np.where(enough.any(1), np.take_along_axis(reach, order, 1)[np.arange(len(b)), pos], np.inf)
            near = np.maximum(np.maximum(d - hi, lo - d), 0.0) <= (bound * (1 + slack) + slack)[:, None]
            # bundles rise with the pieces, so a query's pieces of one bundle stand together
            rows, pieces = near[:, cell_of].nonzero()
            first = np.flatnonzero(np.diff(rows * len(cell_of) + bundle_of[pieces], prepend=-1))
            yield pd.DataFrame({test_id: b[test_id].to_numpy()[rows[first]], "bundle": bundle_of[pieces[first]].astype("int32"),
                                "pieces": np.split(pieces.astype("int32"), first[1:])})
    # queries travel as ids until they meet their bundles
    visits = stable(te.mapInPandas(to_candidates, f"{test_id} {q_kind}, bundle int, pieces array<int>").withColumn("chunk", F.pmod(F.xxhash64(test_id), L(n_chunks)).cast("int")))
    n_visits = visits.count()

    def parts(rows: int, size: int) -> int:
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * size // TASK_BYTES))
    keys = ["bundle", "chunk"]
    met = parts(n_visits + n_train * n_chunks, 8 * piv.shape[1] + 64)
    q = visits.join(te.withColumnRenamed("v", "q"), test_id).repartition(met, *keys)
    # a train row goes only to the chunks that have a query for its bundle
    begin = {int(c): int((cell_of == c).argmax()) for c in range(len(ids))}
    place = {int(ids[c]): (begin[c], int((cell_of == c).sum())) for c in begin}
    at, many = (F.create_map(*[L(x) for c, p in place.items() for x in (c, p[i])])[F.col("cell")] for i in range(2))
    t = cells.withColumn("piece", (at + F.pmod(F.xxhash64(train_id), many.cast("bigint"))).cast("int")).withColumn(
        "bundle", F.get(F.array(*[L(int(x)) for x in bundle_of]), F.col("piece"))).select(train_id, "v", "piece", "bundle").join(
        stable(visits.select("bundle", (F.col("chunk") + 0).alias("chunk")).distinct()), "bundle").repartition(met, *keys)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best_pairs(left, right, k, test_id, train_id)
    cand = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(best, f"{test_id} {q_kind}, {train_id} {t_kind}, distance double")
    w = Window.partitionBy(test_id).orderBy("distance", train_id)
    return cand.repartition(parts(n_visits * k, 64), test_id).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Projections:
    """Sign projections: ``bits`` planes per table, ``tables`` tables, ``probes`` buckets looked up per table; what the sample promises of them."""
    planes: np.ndarray
    middle: np.ndarray
    bits: int
    tables: int
    probes: int
    recall: float
    share: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distance to every plane: rows x tables x bits."""
        return ((x - self.middle) @ self.planes[: self.tables * self.bits].T).reshape(len(x), self.tables, self.bits)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        return (self.margins(x) > 0) @ (1 << np.arange(self.bits))

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The buckets to look up, nearest first: rows x tables x probes. A bucket costs the squares of the margins of the planes it lies across."""
        m = self.margins(x)
        flips = _flips(self.bits)
        over = ((flips[:, None] >> np.arange(self.bits)) & 1).astype(float)
        price = (m * m) @ over.T
        own = (m > 0) @ (1 << np.arange(self.bits))
        near = np.argpartition(price, self.probes - 1, axis=2)[:, :, : self.probes] if self.probes < price.shape[2] else np.broadcast_to(np.arange(len(flips)), price.shape)
        return own[:, :, None] ^ flips[near]


def _flips(bits: int) -> np.ndarray:
    """The sets of planes that a probe may lie across: all of them for short hashes, up to three planes for longer ones."""
    masks = np.arange(1 << bits)
    return masks if bits <= 10 else masks[((masks[:, None] >> np.arange(bits)) & 1).sum(1) <= 3]


_MOST_BITS, _SHAPES = 18, [(t, p) for t in (1, 2, 3, 4, 6, 8) for p in (1, 2, 4, 8, 16, 32, 64, 128, 256)]


def fit_projections(train: np.ndarray, queries: np.ndarray, rows: int, k: int, recall: float, block: int, seed: int) -> Projections:
    """The cheapest shape that finds the ``k`` nearest of the sample with the wanted recall. Neighbours in a sample lie farther off than in all rows, and a standard error is taken off, so it errs on the safe side.

    Cheap is the share of the rows that a query meets plus what its copies and the tables' copies of the rows weigh in the shuffle.
    """
    rng = np.random.default_rng(seed)
    size, middle = train.shape[1], train.mean(0)
    bits = max(1, min(_MOST_BITS, int(np.log2(max(2, rows / block)))))
    planes = rng.normal(0, 1, (8 * bits, size))
    d = _distances(queries, train)
    kth = np.sort(d, axis=1)[:, min(k, d.shape[1]) - 1]
    near = d <= kth[:, None] + 1e-12
    best, fallback = None, None
    for tables, probes in _SHAPES:
        if probes > len(_flips(bits)):
            continue
        p = Projections(planes, middle, bits, tables, probes, 0.0, 0.0)
        of, looked = p.buckets(train), p.probed(queries)
        met = np.zeros_like(near)
        for t in range(tables):
            hit = np.zeros((len(queries), 1 << bits), dtype=bool)
            np.put_along_axis(hit, looked[:, t], True, axis=1)
            met |= hit[:, of[:, t]]
        # of rows at the same distance as the k-th any will do
        each = np.minimum((met & near).sum(1), k) / np.minimum(near.sum(1), k)
        got, share = float(each.mean() - each.std() / len(each) ** 0.5), float(met.mean())
        done = Projections(planes, middle, bits, tables, probes, got, share)
        cost = share + tables * probes / (1 << bits) / 8 + tables / 64
        if got >= recall and (best is None or cost < best[0]):
            best = cost, done
        if fallback is None or got > fallback.recall:
            fallback = done
    return best[1] if best else fallback


def approx_knn_join(test: DataFrame, train: DataFrame, k: int = 131, recall: float = 0.95, test_id: str = "test_id", train_id: str = "train_id", vector: str = "embedding",
                    block: int = 4096, chunk: int = 16384, sample: int = 4096, sample_queries: int = 256, seed: int = 42) -> DataFrame:
    """(test_id, train_id, distance, rank): nearest train rows among those that share a bucket with the query; distances are exact, a neighbour may be missed.

    Multi-probe random projections: every row lies in one bucket of each table, a query looks into the buckets nearest to it. Bits, tables and
    probes are chosen on a bounded sample for the wanted ``recall``; a train row is shuffled once per table and a query once per probe, so the shuffle
    grows with the rows and not with their product. Buckets get more as the rows do; a hot one is cut into blocks and its queries into chunks. Rows without a vector take no part. ``knn_join`` is the exact mode.
    """
    tr = train.select(train_id, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    te = test.select(test_id, F.col(vector).cast("array<double>").alias("q")).where("q is not null")
    t_kind, q_kind = dict(tr.dtypes)[train_id], dict(te.dtypes)[test_id]
    n_train, n_test = tr.count(), te.count()

    def some(df: DataFrame, n: int, key: str, col: str, most: int) -> np.ndarray:
        # cut by hash before ordering, so one task sees about twice the sample
        h = F.pmod(F.xxhash64(key, L(seed)), L(1 << 40))
        part = df.where(h < int(min(1.0, 2 * most / max(n, 1)) * (1 << 40))) if n > 2 * most else df
        return np.array([r[0] for r in part.orderBy(h, key).select(col).limit(most).collect()], dtype=float)
    if not n_train or not n_test:
        return test.sparkSession.createDataFrame([], f"{test_id} {q_kind}, {train_id} {t_kind}, distance double, rank int")
    known = some(tr, n_train, train_id, "v", sample)
    p = fit_projections(known, some(te, n_test, test_id, "q", sample_queries), n_train, max(1, round(k * len(known) / n_train)), recall, min(block, max(1, n_train // 64)), seed)

    def into(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = p.buckets(np.stack(b["v"].to_numpy()).astype(float))
            for t in range(p.tables):
                yield b.assign(tab=t, bucket=of[:, t].astype("int32"))
    placed = stable(tr.mapInPandas(into, f"{train_id} {t_kind}, v array<double>, tab int, bucket int"))
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            looked = p.probed(np.stack(b["q"].to_numpy()).astype(float))
            for t in range(p.tables):
                for j in range(looked.shape[2]):
                    yield b.assign(tab=t, bucket=looked[:, t, j].astype("int32"))
    visits = te.mapInPandas(look, f"{test_id} {q_kind}, q array<double>, tab int, bucket int")
    # blocks and chunks of each bucket that has rows and queries
    per = [x.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / n).cast("int").alias(c)) for x, n, c in ((placed, block, "n_blocks"), (visits, chunk, "n_chunks"))]
    info = written(per[0].join(per[1], ["tab", "bucket"]))
    again = info.select(*[(F.col(c) + 0).alias(c) for c in info.columns])  # the two sides of a cogroup must not share columns
    q = visits.join(info, ["tab", "bucket"]).withColumn("block", F.explode(F.sequence(L(0), F.col("n_blocks") - 1))).withColumn("chunk", F.pmod(F.xxhash64(test_id), F.col("n_chunks")).cast("int")).drop("n_blocks", "n_chunks")
    t = placed.join(again, ["tab", "bucket"]).withColumn("block", F.pmod(F.xxhash64(train_id), F.col("n_blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(L(0), F.col("n_chunks") - 1))).drop("n_blocks", "n_chunks")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best_pairs(left, right, k, test_id, train_id)
    keys = ["tab", "bucket", "block", "chunk"]
    cand = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(best, f"{test_id} {q_kind}, {train_id} {t_kind}, distance double")
    # a pair may meet in several tables
    once = cand.groupBy(test_id, train_id).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy(test_id).orderBy("distance", train_id)
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_router(test: DataFrame, train: DataFrame, test_labels: DataFrame, train_labels: DataFrame, k: int = 131,
               **names) -> DataFrame:
    """Majority of the neighbours' labels per model (a tie counts as 0): (test_id, model_name, label, predicted)."""
    tid, nid = names.get("test_id", "test_id"), names.get("train_id", "train_id")
    near = knn_join(test, train, k, **names).select(tid, nid)
    vote = near.join(train_labels.select(nid, "model_name", F.col("label").alias("v")), nid).groupBy(tid, "model_name").agg(
        (F.avg("v") > 0.5).cast("int").alias("predicted"))
    return vote.join(test_labels.select(tid, "model_name", "label"), [tid, "model_name"])


def knn_accuracy(routed: DataFrame) -> DataFrame:
    """Accuracy per model and their mean (row ALL)."""
    per = routed.groupBy("model_name").agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    both = per.withColumn("name", F.explode(F.array(F.col("model_name"), F.lit("ALL"))))
    return both.groupBy("name").agg(F.avg("accuracy").alias("accuracy"), F.sum("n").alias("n"))
