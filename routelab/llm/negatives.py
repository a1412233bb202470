"""Hard negatives by inner product from a forest of cover trees over norm-augmented vectors.

A candidate x gets one more coordinate sqrt(M^2 - |x|^2), an anchor a gets 0 there; then d(a, x)^2 = |a|^2 + M^2 - 2 a.x, so the largest inner
products are the nearest points. Every node of a tree has a centre (one of its rows) and a covering radius r, the largest distance to a row
below it; children split a node so that their radii shrink by half (or as far as ``FAN`` centres allow). With the distance d to the
centre, all inner products below the node lie between (|a|^2 + M^2 - (d + r)^2) / 2 and (|a|^2 + M^2 - max(0, d - r)^2) / 2.
A search descends best-first by the upper bound, skips nodes whose interval misses every window still open or whose labels cannot count, and
takes the exact integer products in the leaves it reaches.

The top level (at most ``CELLS`` centres from a bounded sample) deals all rows to cells, each with its own covering radius; a cell is cut into
pieces of bounded size (also when a third of all rows are one vector), pieces that lie near each other share a bundle of bounded size, and each bundle
becomes one tree, one row of a written index. An anchor travels once to each bundle with a cell that its bounds cannot exclude, first to that of the nearest
cell, then with the fifth-best score found there to the others: where vectors are spread evenly no bound excludes a cell, and an anchor's copies then count
bundles and not cells. Anchors are routed some at a time, so that a task never holds all copies at once. The index holds every row and the search is exact: recall is 1.
"""

from __future__ import annotations

import heapq
import io
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelab.llm.common import stable, written
from routelab.operators.neighbors import _bundles, _chain

LEAF, FAN = 192, 32
CELLS, ROWS_PER_CELL, SAMPLE = 1024, 2048, 4096
GROUP_ROWS, CHUNK = 65_536, 4096
# cells' rows of a bundle; distances and copies that a task holds at once; tasks of a visit
CELLS_PER_BUNDLE, DISTANCES, COPIES, TASKS = 8, 1 << 20, 1 << 16, 4096
EXACT = 2.0 ** 53
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def dots(x: np.ndarray, a: np.ndarray, exact: bool) -> np.ndarray:
    """Exact inner products of integer-valued rows: as doubles if those hold them exactly, else as 64-bit integers (the nearest one beyond)."""
    if exact:
        return x @ a
    whole = [int(v) for v in a]
    return np.array([max(min(sum(int(v) * w for v, w in zip(row, whole)), _HIGH), _LOW) for row in x], dtype=np.int64)


class Tree:
    """A cover tree in arrays: nodes breadth-first (children of a node side by side), rows in leaf order."""

    PARTS = ("x", "ids", "labels", "centre", "radius", "child", "row", "masks", "only", "top")

    def __init__(self, **parts: np.ndarray):
        for k in self.PARTS:
            setattr(self, k, parts[k])
        self.points = np.asarray(self.x, dtype=np.float64)
        self.most = np.abs(self.points).max(initial=0.0)
        c = self.points[self.centre]
        self.centres, self.norms = c, (c * c).sum(1)
        self.child, self.row = self.child.tolist(), self.row.tolist()

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
        by_id = np.argsort(ids, kind="stable")
        x, ids, labels = x[by_id], ids[by_id], labels[by_id]
        sq = (x * x).sum(1)
        top = float(sq.max())
        y = np.column_stack([x, np.sqrt(np.maximum(top - sq, 0))])
        y2 = (y * y).sum(1)

        def far(rows: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(np.maximum(y2[rows] + y2[c] - 2 * (y[rows] @ y[c]), 0))

        def middle(rows: np.ndarray) -> int:
            return int(rows[np.argmin(((y[rows] - y[rows].mean(0)) ** 2).sum(1))])
        todo = deque([np.arange(len(x))])
        centre, radius, child, row, masks, only, order, placed, made = [], [], [], [], [], [], [], 0, 1
        while todo:
            rows = todo.popleft()
            c = middle(rows)
            d = np.sqrt(((y[rows] - y[c]) ** 2).sum(1))
            r = float(d.max())
            kinds = np.unique(labels[rows])
            centre.append(c)
            radius.append(r)
            masks.append(np.bitwise_or.reduce(np.left_shift(np.uint64(1), (kinds % 64).astype(np.uint64))))
            only.append((kinds[0], len(kinds) == 1))
            if len(rows) <= leaf or r == 0:
                child.append((0, 0))
                row.append((placed, placed + len(rows)))
                order.append(rows)
                placed += len(rows)
                continue
            # half of the centres at a stride, so that dense places are cut, then the farthest rows until all are within half the radius
            near, best, used = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), np.inf), 0
            ways = min(fan, max(2, 2 * len(rows) // leaf))
            picks = rows[np.linspace(0, len(rows) - 1, ways // 2 + 1).astype(np.int64)]
            while used < ways:
                new = int(picks[used]) if used < len(picks) else int(rows[np.argmax(best)])
                d = far(rows, new)
                closer = d < best
                near[closer], best[closer] = used, d[closer]
                used += 1
                if used >= len(picks) and best.max() <= r / 2:
                    break
            parts = [rows[near == at] for at in range(used)]
            parts = [p for p in parts if len(p)]
            if len(parts) == 1:  # rounding alone tells these rows apart
                half = len(rows) // 2
                parts = [rows[:half], rows[half:]]
            child.append((made, made + len(parts)))
            row.append((0, 0))
            todo.extend(parts)
            made += len(parts)
        rank = np.concatenate(order)
        place = np.empty(len(rank), dtype=np.int64)
        place[rank] = np.arange(len(rank))
        x = x[rank]
        most = np.abs(x).max(initial=0.0)
        kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
        return cls(x=x.astype(kind), ids=ids[rank], labels=labels[rank], centre=place[np.array(centre)], radius=np.array(radius), child=np.array(child), row=np.array(row),
                   masks=np.array(masks, dtype=np.uint64), only=np.array(only, dtype=np.int64), top=np.array([top]))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.PARTS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            return cls(**{k: z[k] for k in cls.PARTS})

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product possible below each node, for each row of ``a``."""
        return interval(a, self.centres, self.norms, np.sqrt(np.maximum(self.top[0] - self.norms, 0)), self.radius, self.top[0])

    def search(self, a: np.ndarray, low: np.ndarray, high: np.ndarray, me: int, label: int, windows: list[tuple[int, int]], same: bool, k: int) -> list[list[tuple[int, int]]]:
        """The k best (score, id) of each window (least and largest score): largest score first, then smallest id.

        ``low`` and ``high`` are the bounds of this anchor's nodes; rows with the anchor's id never count, and only rows of the same
        (``same``) or of another label do.
        """
        usable = ((self.masks >> np.uint64(label % 64)) & np.uint64(1) > 0 if same else ~((self.only[:, 1] == 1) & (self.only[:, 0] == label))).tolist()
        exact = self.most * np.abs(a).sum() < EXACT
        low, high, child = low.tolist(), high.tolist(), self.child
        found: list[list[tuple]] = [[] for _ in windows]
        floor, roof = [w[0] for w in windows], [w[1] for w in windows]
        least, most = min(floor), max(roof)
        heap = [(-high[0], 0)] if usable[0] else []
        while heap:
            up, node = heapq.heappop(heap)
            if -up < least:
                break
            if low[node] > most or not any(-up >= f and low[node] <= r for f, r in zip(floor, roof)):
                continue
            first, last = child[node]
            if last > first:
                for c in range(first, last):
                    if usable[c] and high[c] >= least:
                        heapq.heappush(heap, (-high[c], c))
                continue
            first, last = self.row[node]
            scores = dots(self.points[first:last], a, exact)
            hit = (scores >= least).nonzero()[0]
            if not len(hit):
                continue
            scores, hit = scores[hit], hit + first
            pairs = sorted((-int(s), n) for s, n, of in zip(scores.tolist(), self.ids[hit].tolist(), self.labels[hit].tolist()) if s <= most and (of == label) == same and n != me)
            for i, got in enumerate(found):
                new = [p for p in pairs if floor[i] <= -p[0] <= roof[i]][:k]
                if new:
                    got += new
                    got.sort()
                    del got[k:]
                    if len(got) == k:
                        floor[i] = -got[-1][0]
            least = min(floor)
        return [[(-s, i) for s, i in got] for got in found]


def interval(a: np.ndarray, centres: np.ndarray, norms: np.ndarray, lift: np.ndarray, radius: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a.x for all x within ``radius`` of each centre in augmented space (``lift`` is the centre's extra coordinate); rounding is allowed for."""
    a2 = (a * a).sum(1)[:, None]
    d2 = a2 + norms[None, :] - 2 * (a @ centres.T) + (lift * lift)[None, :]
    room = 1e-9 * (a2 + top) + 1e-6
    d = np.sqrt(np.maximum(d2, 0))
    wide = np.sqrt(room)  # a difference of squares is off by more than a square
    low = (a2 + top - (d + radius[None, :] + wide) ** 2) / 2 - room
    high = (a2 + top - np.maximum(d - radius[None, :] - wide, 0) ** 2) / 2 + room
    # scores end at 64 bits; the largest double below that end
    return np.minimum(low, 2.0 ** 63 - 1024), np.maximum(high, -2.0 ** 63)


def slices(batches: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches cut to ``rows`` rows."""
    for b in batches:
        for at in range(0, len(b), max(1, rows)):
            yield b.iloc[at:at + max(1, rows)]


def scaled(values: pd.Series, scale: float, size: int) -> np.ndarray:
    """floor(scale * x) as whole doubles, shorter vectors filled up with zeros."""
    out = np.zeros((len(values), size))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def usable_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, v of rows that have all of them and only finite components."""
    finite = F.forall("v", lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)


class Forest:
    """The written index and the top level of the tree."""

    def __init__(self, rows: DataFrame, scale: float, group_rows: int = GROUP_ROWS, rows_per_cell: int = ROWS_PER_CELL, sample: int = SAMPLE, leaf: int = LEAF):
        self.scale = scale
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * scale) ** 2)
        got = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
        n, self.size, self.top = got[0], got[1] or 0, (got[2] or 0.0) * (1 + 1e-12)
        # a bounded sample: cut by hash before it is ordered, so that no task sees more than about twice as many rows
        h = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(1 << 40))
        part = rows.where(h < int(min(1.0, 2 * sample / max(n, 1)) * (1 << 40))) if n > 2 * sample else rows
        seen = part.select("v", h.alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).toPandas()
        self.centres = self._spread(scaled(seen["v"], scale, self.size), min(CELLS, max(1, n // rows_per_cell)))
        self.norms = (self.centres ** 2).sum(1)
        self.lift = np.sqrt(np.maximum(self.top - self.norms, 0))
        centres, norms, lift, top, size = self.centres, self.norms, self.lift, self.top, self.size

        def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in slices(it, DISTANCES // len(centres)):
                x = scaled(b["v"], scale, size)
                sq = (x * x).sum(1)
                d = np.sqrt(np.maximum(sq[:, None] + norms[None, :] - 2 * x @ centres.T, 0) + (np.sqrt(np.maximum(top - sq, 0))[:, None] - lift[None, :]) ** 2)
                yield b.assign(cell=d.argmin(1).astype("int32"), d=d.min(1))
        cells = written(rows.mapInPandas(deal, "vec_id bigint, label bigint, v array<double>, cell int, d double"), "cells")
        self.radius, sizes = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)
        for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():
            self.radius[r["cell"]], sizes[r["cell"]] = r["r"], r["n"]
        self.cell_of, self.bundle_of = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not n:
            return
        used = sizes.nonzero()[0]
        # small tables are dealt to some tasks too
        most = min(group_rows, max(rows_per_cell, min(CELLS_PER_BUNDLE * rows_per_cell, n // 16)))
        self.cell_of, self.bundle_of = _bundles(sizes[used], _chain(np.column_stack([centres, lift])[used]), group_rows, most)
        self.cell_of = used[self.cell_of]

        def plant(g: pd.DataFrame) -> pd.DataFrame:
            t = Tree.build(scaled(g["v"], scale, size), g["vec_id"].to_numpy(), g["label"].to_numpy(), leaf)
            return pd.DataFrame({"bundle": [g["bundle"].iloc[0]], "tree": [t.dump()]})
        begin, many = (F.create_map(*[F.lit(int(x)) for c in used for x in (c, of(self.cell_of == c))])[F.col("cell")] for of in (np.argmax, np.sum))
        piece = (begin + F.pmod(F.xxhash64("vec_id"), many.cast("bigint"))).cast("int")
        self.trees = written(cells.withColumn("bundle", F.get(F.array(*[F.lit(int(x)) for x in self.bundle_of]), piece)).groupBy("bundle").applyInPandas(plant, "bundle int, tree binary"), "cover-trees")

    @staticmethod
    def _spread(x: np.ndarray, k: int) -> np.ndarray:
        """k different rows of the sample, each the farthest from those before."""
        if not len(x):
            return np.zeros((1, x.shape[1]))
        picks, best = [0], ((x - x[0]) ** 2).sum(1)
        while len(picks) < k and best.max() > 0:
            picks.append(int(best.argmax()))
            best = np.minimum(best, ((x - x[picks[-1]]) ** 2).sum(1))
        return x[picks]

    def visit(self, anchors: DataFrame, same: bool, k: int, chunks: int, nearest: bool | None) -> DataFrame:
        """anchor, window, score, vec_id: the k best of every tree for every window (``lows`` and ``highs``) of the anchors.

        ``nearest`` True visits the bundles of the nearest cell only, False all others, None all; bundles whose cells' bounds miss every window are left out.
        """
        size, scale, kinds = self.size, self.scale, anchors.schema
        if not len(self.cell_of):
            return anchors.sparkSession.createDataFrame([], "anchor_id bigint, h bigint, at int, score bigint, vec_id bigint")
        spread = anchors.mapInPandas(self.router(nearest), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", bundle int")
        spread = spread.withColumn("chunk", F.pmod(F.xxhash64("anchor_id", "h"), F.lit(chunks)).cast("int"))
        trees = self.trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def look(trees: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
            out = [np.zeros((0, 5), dtype=np.int64)]
            for data in trees["tree"] if len(mine) else []:
                t = Tree.load(data)
                step = max(1, min(512, (1 << 22) // max(1, len(t.radius))))
                for block in slices([mine], step):
                    a = scaled(block["v"], scale, size)
                    low, high = t.bounds(a)
                    got = [(me, h, w, score, n) for i, (me, h, label, lo, hi) in enumerate(zip(block["anchor_id"], block["h"], block["label"], block["lows"], block["highs"]))
                           for w, best in enumerate(t.search(a[i], low[i], high[i], me, label, list(zip(lo.tolist(), hi.tolist())), same, k)) for score, n in best]
                    out.append(np.array(got, dtype=np.int64).reshape(-1, 5))
            return pd.DataFrame(np.concatenate(out), columns=["anchor_id", "h", "at", "score", "vec_id"])
        keys, tasks = ["bundle", "chunk"], min(TASKS, (int(self.bundle_of[-1]) + 1) * chunks)
        trees, spread = (side.repartition(tasks, *keys).groupBy(*keys) for side in (trees, spread))
        return trees.cogroup(spread).applyInPandas(look, "anchor_id bigint, h bigint, at int, score bigint, vec_id bigint")

    def router(self, nearest: bool | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """From anchors to a row for each bundle that they must visit, some anchors at a time."""
        centres, norms, lift, radius, top, size, scale, cell_of = self.centres, self.norms, self.lift, self.radius, self.top, self.size, self.scale, self.cell_of
        first = np.flatnonzero(np.diff(self.bundle_of, prepend=-1))

        def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in slices(it, COPIES // max(len(centres), len(first))):
                low, high = interval(scaled(b["v"], scale, size), centres, norms, lift, np.maximum(radius, 0), top)
                open_ = np.zeros(low.shape, dtype=bool)
                for i, (lo, hi) in enumerate(zip(b["lows"], b["highs"])):
                    for a, z in zip(lo, hi):
                        open_[i] |= (high[i] >= a) & (low[i] <= z)
                met = np.logical_or.reduceat(open_[:, cell_of], first, axis=1)
                if nearest is not None:
                    own = np.where(radius[None, :] >= 0, high, -np.inf).argmax(1)
                    met &= np.logical_or.reduceat(cell_of[None, :] == own[:, None], first, axis=1) == nearest
                at, bundle = met.nonzero()
                yield b.iloc[at].assign(bundle=bundle.astype("int32"))
        return route


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0, positives: int = 5,
                   negatives: int = 5, low_percent: int = 80, high_percent: int = 100, chunk: int = CHUNK, **index) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); a score is the integer inner product, larger ones first, ties by smaller id. An anchor's positives are its
    best rows of the same label and another id; each positive's negatives are the best rows of another label with a score from ``low_percent``
    to ``high_percent`` of the positive's. ``is_anchor`` is a condition on ``vec_id`` and ``label``.

    Rows without id, label or vector, or with a null or non-finite component, take no part. A shorter vector ends in zeros; an empty one scores 0. Repeated rows
    are candidates each by themselves; equal repeats of an anchor are one anchor. A score beyond 64 bits counts as the end of their range. An
    empty table, or one without pairs, gives no rows; other columns are ignored.
    """
    rows = usable_rows(vectors, id_col, label_col, vector_col)
    forest = Forest(rows, scale, **index)
    base = stable(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "v"]).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("h"), "label", "v"))
    chunks = max(1, -(-base.count() // chunk))
    me = ["anchor_id", "h"]
    any_score = base.withColumn("lows", F.array(F.lit(_LOW))).withColumn("highs", F.array(F.lit(_HIGH)))

    def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
        # at most k rows per tree and anchor come here
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    first = stable(forest.visit(any_score, True, positives, chunks, True))
    reached = best(first, me, positives).groupBy(*me).agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    again = any_score.join(reached, me, "left").withColumn("lows", F.array(F.coalesce("least", F.lit(_LOW)))).drop("least")
    chosen = stable(best(first.unionByName(forest.visit(again, True, positives, chunks, False)), me, positives).select(*me, "rank", "score", F.col("vec_id").alias("positive_id")))

    # whole numbers s with low * p <= 100 * s <= high * p, by position of the positive
    low, high = (F.col("score").cast("decimal(38,0)") * F.lit(p) / 100 for p in (low_percent, high_percent))
    windows = chosen.groupBy(*me).agg(F.array_sort(F.collect_list(F.struct("rank", F.ceil(low).cast("bigint").alias("lo"), F.floor(high).cast("bigint").alias("hi"), "score", "positive_id"))).alias("w"))
    open_ = base.join(windows, me).withColumn("lows", F.col("w.lo")).withColumn("highs", F.col("w.hi"))
    found = forest.visit(open_.select(*base.columns, "lows", "highs"), False, negatives, chunks, None)
    ranked = best(found, [*me, "at"], negatives)
    return ranked.join(chosen.select(*me, (F.col("rank") - 1).alias("at"), "positive_id", F.col("score").alias("positive_score")), [*me, "at"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
