"""Near duplicates: word n-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

1. One pass over the texts: a content hash and the band hashes of a MinHash signature. ``bands_for`` chooses the number of bands from the
   rows of a band so that a pair at the threshold is found with the target recall.
2. Equal texts form a class; only classes go on. Classes that share a band hash are candidates, linked to the bucket's smallest class only
   (a star, never all pairs), and connected into candidate clusters.
3. Clusters are cut into blocks of bounded n-gram volume and number of classes, and every pair of blocks is verified by itself: set
   intersections by matrix products, one pair of tiles at a time. A task emits one row per class (its number of links and its local root), never pairs.
4. Links are summed per class, roots are connected into groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm import textbytes as tb
from routelab.llm.common import read_text_column, renamed, stable
from routelab.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 5
BLOCK_GRAMS = 1 << 20
BLOCK_CLASSES = 1 << 12
_TILE, _COLUMNS = 512, 4096


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands with which a pair at the threshold shares one with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)))


def word_grams(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every word n-gram (words: runs of other than ASCII white space). Fewer words than n make one gram, no word none."""
    buf, starts = tb.joined(texts)
    begin, end, doc = tb.word_spans(buf, starts, tb.white_words())
    h = tb.Sums(buf, tb.byte_values()).of(begin, end)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    if len(h) >= n:
        g = h[: len(h) - n + 1]
        for j in range(1, n):
            g = tb.mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j])
        whole = doc[: len(h) - n + 1] == doc[n - 1:]
        g, d = g[whole], doc[: len(h) - n + 1][whole]
    else:
        g, d = h[:0], doc[:0]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for i in short.tolist():
            x = h[first[i]:first[i] + 1]
            for j in range(1, count[i]):
                x = tb.mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[first[i] + j:first[i] + j + 1])
            extra.append(x)
        g, d = np.concatenate([g, *extra]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        g, d = g[order], d[order]
    return d, g


def band_hashes(d: np.ndarray, g: np.ndarray, n_texts: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts that have grams, and their band hashes (texts x bands)."""
    had, start = np.unique(d, return_index=True)
    if not len(had):
        return had, np.zeros((0, bands), dtype=np.int64)
    x = (g >> np.uint64(32)).astype(np.uint32)
    seeds = tb.mix64(np.arange(2 * bands * rows, dtype=np.uint64) + np.uint64(12345))
    mult, shift = (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(had), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(had), b + 1, dtype=np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            low = np.minimum.reduceat((x ^ shift[r]) * mult[r], start)
            key = tb.mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + low)
        keys[:, b] = key
    return had, keys.view(np.int64)


def _sketch(rows: DataFrame, n: int, bands: int, band_rows: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.batches(it):
            d, g = word_grams(texts, n)
            had, keys = band_hashes(d, g, len(texts), bands, band_rows)
            counts = np.bincount(d, minlength=len(texts))
            off = np.zeros(len(texts) + 1, dtype=np.int32)
            has = np.zeros(len(texts), dtype=np.int32)
            has[had] = bands
            np.cumsum(has, out=off[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([md5(t).digest() for t in texts], pa.binary()), pa.array(counts),
                                              pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel()))], ["doc_id", "h", "grams", "bands"])
    return rows.mapInArrow(run, "doc_id bigint, h binary, grams bigint, bands array<bigint>")


def link_counts(cids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of links and local root of each class of a block pair. ``within``: one block against itself; otherwise side 0 against side 1."""
    m = len(cids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], place[column[use]]
    width = int(shared.sum())
    # entries by tile of classes and chunk of columns
    chunks = -(-width // _COLUMNS)
    part = owner // _TILE * chunks + column // _COLUMNS
    order = np.argsort(part, kind="stable")
    owner, column = owner[order] % _TILE, column[order] % _COLUMNS
    tiles = [np.arange(i, min(i + _TILE, m)) for i in range(0, m, _TILE)]
    cuts = np.searchsorted(part[order], np.arange(len(tiles) * chunks + 1))

    def matrix(t: int, k: int) -> np.ndarray | None:
        x, y = cuts[t * chunks + k], cuts[t * chunks + k + 1]
        if x == y:
            return None
        a = np.zeros((len(tiles[t]), min(_COLUMNS, width - k * _COLUMNS)), dtype=np.float32)
        a[owner[x:y], column[x:y]] = 1
        return a

    links = np.zeros(m, dtype=np.int64)
    joined = {}
    for i, j in ((i, j) for i in range(len(tiles)) for j in range(i, len(tiles))):
        a, b = tiles[i], tiles[j]
        inter = np.zeros((len(a), len(b)), dtype=np.float32)
        for k in range(chunks):
            left = matrix(i, k)
            right = left if i == j or left is None else matrix(j, k)
            if left is not None and right is not None:
                inter += left @ right.T
        ok = inter >= threshold * (sizes[a][:, None] + sizes[b][None, :] - inter) - 1e-6
        ok &= inter > 0
        ok &= cids[a][:, None] != cids[b][None, :]
        if not within:
            ok &= side[a][:, None] != side[b][None, :]
        links[a] += ok.sum(1)
        if i != j:
            links[b] += ok.sum(0)
        if ok.any():
            joined[i, j] = ok
    root = cids.copy()
    while joined:
        before = root.copy()
        for (i, j), ok in joined.items():
            a, b = tiles[i], tiles[j]
            big = np.iinfo(np.int64).max
            root[a] = np.minimum(root[a], np.where(ok, root[b][None, :], big).min(1))
            root[b] = np.minimum(root[b], np.where(ok, root[a][:, None], big).min(0))
        if (root == before).all():
            break
    return links, root


def _verify(blocks: DataFrame, threshold: float) -> DataFrame:
    def close(key: tuple, rows: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        cids = np.array(list(rows), dtype=np.int64)
        links, root = link_counts(cids, np.array([s for s, _ in rows.values()]), [x for _, x in rows.values()], threshold, key[1] == key[2])
        return pa.RecordBatch.from_arrays([pa.array(cids), pa.array(links), pa.array(root)], ["cid", "links", "root"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, {}
        for batch in it:
            grams = batch.column(5)
            off, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for r, (key, cid, side) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if key != held:
                    if rows:
                        yield close(held, rows)
                    held, rows = key, {}
                rows[cid] = (side, flat[off[r]:off[r + 1]].copy())
        if rows:
            yield close(held, rows)

    dealt = blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.select("cluster", "i", "j", "cid", "side", "grams").mapInArrow(run, "cid bigint, links bigint, root bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL,
                    rows: int = ROWS, block_grams: int = BLOCK_GRAMS, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """One row per document: doc_id, class_id (least id with the same text), class_size, links (other texts at least as similar as
    ``threshold``), group_id (least id of the connected group).

    Null is the empty text. Texts without a word are linked to nothing (equal ones are still one class); texts of fewer words than the
    n-gram are one gram. Repeated rows are copies. Null ids count as the least ids and stay null. A very long text is compared on all its n-grams, one row of its task.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    texts = read_text_column(docs, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    sketch = stable(_sketch(texts, words, bands_for(threshold, recall, rows), rows))
    classes = stable(sketch.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.max("grams").alias("grams"), F.first("bands").alias("bands"))
                     .withColumn("cid", F.monotonically_increasing_id()))
    keys = classes.select("cid", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("cid").alias("root"), F.max("cid").alias("top")).where("root < top").select("key", "root")
    clusters = components(keys.join(buckets, "key").where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")))

    found = stable(classes.join(clusters.withColumnRenamed("v", "cid"), "cid").select("cid", "h", "class_id", "grams", F.col("label").alias("cluster")))
    volume = found.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("grams") / block_grams, F.count("*") / block_classes)).cast("int").alias("n_blocks"))
    wanted = found.join(volume, "cluster").select("cid", F.col("h").alias("_h"), "class_id", "cluster", "n_blocks", F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int").alias("block"))
    hashed = texts.withColumn("h", F.unhex(F.md5("text")))
    picked = hashed.join(wanted, (hashed["h"] == wanted["_h"]) & (hashed["doc_id"] == wanted["class_id"])).select("cid", "text", "cluster", "n_blocks", "block")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in tb.batches(it):
            d, g = word_grams(some, words)
            cut = np.searchsorted(d, np.arange(len(some) + 1))
            own = [np.unique(g[a:b]).view(np.int64) for a, b in zip(cut, cut[1:])]
            off = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4)), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(own)))],
                                             ["cid", "cluster", "n_blocks", "block", "grams"])

    grams = picked.mapInArrow(sets, "cid bigint, cluster bigint, n_blocks int, block int, grams array<bigint>")
    # a block meets every block of its cluster once, itself included
    blocks = (grams.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
              .select("cluster", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "cid", (F.col("block") > F.col("_other")).cast("int").alias("side"), "grams"))
    verified = stable(_verify(blocks, threshold))
    links = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(verified.where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    least = groups.join(classes.select(F.col("cid").alias("v"), "class_id"), "v").groupBy("label").agg(F.min("class_id").alias("group_id"))
    placed = groups.join(least, "label").select(F.col("v").alias("cid"), "group_id")
    info = stable(classes.join(links, "cid", "left").join(placed, "cid", "left")
                  .select("h", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id")))
    named = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c)).alias(c)
    return sketch.select("doc_id", "h").join(info, "h").select(named("doc_id"), named("class_id"), "class_size", "links", named("group_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group stays, the one with the least id; all columns. Of rows that repeat an id and are all to stay, one stays."""
    rows, (i, t) = renamed(docs, id_col, text_col)
    kept = near_duplicates(rows, i, t, **options).where(F.col("doc_id").eqNullSafe(F.col("group_id")))
    marks = stable(kept.groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_rows")))
    hits = rows.join(marks, rows[i].cast("long").eqNullSafe(marks["_keep"]))
    once = hits.where("_rows = 1")
    if not marks.where("_rows > 1").isEmpty():
        once = once.unionByName(hits.where("_rows > 1").dropDuplicates(["_keep"]))
    return once.select(*rows.columns).toDF(*docs.columns)
