"""SentencePiece encoding: several distinct segmentations of each text, drawn without replacement, and decoding.

A segmentation (pieces whose bytes spell the text) has probability proportional to exp(alpha * sum of piece scores). The lattice of a text
is a chain of short ones, as no piece of the vocabulary goes on past the start of a word; distinct words of a batch are built once. Their
backward sums give the exact probability of each next piece.

Drawing is A* search with Gumbel noise (top-down Gumbel-max): the set of all segmentations gets a Gumbel value, which is that of its best
one, drawn by a forward walk. What is left is split by the first piece that differs; each part's value is a Gumbel of its mass, truncated at
its parent's. The part with the highest value gives the next draw, and so on, so the k draws are the k best perturbed segmentations,
distinct and in order. ``inclusion`` is the probability that a segmentation's value passes the (k+1)-th one, the weight to divide by when
draws are averaged. Noise is a hash of the row's id, the draw and the byte position: the same for every run and batch.

Text is encoded as bytes with a space in front, as the library does; characters without a piece become byte pieces, and so does the
character that stands for the space, so decoding gives the text back byte for byte.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from routelab.llm import textbytes as tb
from routelab.llm.common import read_text_column

DRAWS = 2
ALPHA = 0.001
SEED = 11
CHUNK = 1 << 20
_SPACE = "▁".encode()
_UNIT = re.compile(rb" *[^ \n]+|\n| +")
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Vocabulary:
    """Pieces of a model file as a byte trie."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = [b""] * size
        self.byte_id = np.full(256, model.unk_id(), dtype=np.int32)
        scores, children, at = np.zeros(size), [{}], {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = self.bytes[i] = piece.encode().replace(_SPACE, b" ")
                # scores of merges that the model never learned lie far below all others
                scores[i] = max(model.get_score(i), -float(size))
                node = 0
                for c in raw:
                    if c not in children[node]:
                        children[node][c] = len(children)
                        children.append({})
                    node = children[node][c]
                at[node] = i
        self.next = np.zeros((len(children), 256), dtype=np.uint16 if len(children) < 1 << 16 else np.int32)
        for n, c in enumerate(children):
            self.next[n, list(c)] = list(c.values())
        self.piece = np.full(len(children), -1, dtype=np.int32)
        self.piece[list(at)] = list(at.values())
        self.score = scores
        # words may be cut apart if spaces only begin pieces and no piece has a newline
        self.unit = _UNIT if not any(b"\n" in p or b" " in p.lstrip(b" ") for p in self.bytes if len(p) > 1) else re.compile(rb"(?s).+")


_known: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _known:
        _known[path] = Vocabulary(path)
    return _known[path]


class Lattice:
    """Lattices of a list of words, joined in one buffer with a free place after each."""

    def __init__(self, words: list[bytes], v: Vocabulary, alpha: float):
        buf = np.frombuffer(b"\n".join(words) + b"\n", dtype=np.uint8)
        size = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        end_of = np.repeat(self.end, size + 1)
        pos = np.flatnonzero(np.arange(len(buf)) < end_of)
        node, begin, depth = np.zeros(len(pos), dtype=v.next.dtype), pos, 0
        found = []
        while len(pos):
            depth += 1
            node = v.next[node, buf[begin + depth - 1]]
            alive = node > 0
            begin, node = begin[alive], node[alive]
            piece = v.piece[node]
            hit = piece >= 0
            found.append((begin[hit].astype(np.int32), np.full(int(hit.sum()), depth, dtype=np.int32), piece[hit]))
            more = begin + depth < end_of[begin]
            begin, node = begin[more], node[more]
            pos = begin
        place, length, piece = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int32) for i in range(3))
        # characters without a piece of their own go as bytes
        inside = np.arange(len(buf)) < end_of
        lead = inside & ((buf & 0xC0) != 0x80)
        chars = np.ones(len(buf), dtype=np.int64)
        for low, n in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            chars[buf >= low] = n
        has = np.zeros(len(buf), dtype=bool)
        has[place[length == chars[place]]] = True
        bare = np.flatnonzero(lead & ~has)
        extra = np.repeat(bare, chars[bare])
        extra = extra + np.arange(len(extra)) - np.repeat(np.cumsum(chars[bare]) - chars[bare], chars[bare])
        place = np.concatenate([place, extra.astype(np.int32)])
        length = np.concatenate([length, np.ones(len(extra), dtype=np.int32)])
        piece = np.concatenate([piece, v.byte_id[buf[extra]]])
        order = np.argsort(place, kind="stable")
        self.place, self.length, self.piece = place[order], length[order], piece[order]
        del place, length, piece, found, extra
        gain = alpha * v.score[self.piece]
        # sums of what follows, from the ends of the words backwards
        left = (end_of[self.place] - self.place).astype(np.uint16 if size.max() < 1 << 16 else np.int64)
        beta = np.full(len(buf), -np.inf)
        beta[self.end] = 0
        self.q = np.zeros(len(order))
        by = np.argsort(left, kind="stable")
        cuts = np.flatnonzero(np.diff(left[by].astype(np.int64), prepend=-1)) if len(by) else []
        for a, b in zip(cuts, [*cuts[1:], len(by)]):
            e = by[a:b]
            value = gain[e] + beta[self.place[e] + self.length[e]]
            head = np.flatnonzero(np.diff(self.place[e], prepend=-1))
            most = np.maximum.reduceat(value, head)
            some = np.repeat(most, np.diff(head, append=len(e)))
            with np.errstate(invalid="ignore"):
                total = most + np.log(np.add.reduceat(np.exp(value - some), head))
            total = np.where(np.isfinite(most), total, -np.inf)
            beta[self.place[e[head]]] = total
            back = np.repeat(total, np.diff(head, append=len(e)))
            self.q[e] = np.where(np.isfinite(back), value - np.where(np.isfinite(back), back, 0), -np.inf)
        self.q = np.minimum(self.q, 0.0)
        self.first = np.searchsorted(self.place, np.arange(len(buf) + 1))
        p = np.exp(self.q)
        del gain, beta, left, by, end_of
        run = np.concatenate([[0.0], np.cumsum(p)])
        self.upto = run[1:] - run[self.first[self.place]]
        # the last possible piece of a place takes what rounding leaves
        live = np.flatnonzero(p > 0)
        last = live[np.flatnonzero(np.diff(self.place[live], append=-1))]
        self.upto[last] = np.inf

    def pick(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place by its probability."""
        e = self.first[place].copy()
        todo = np.flatnonzero(self.upto[e] <= u)
        while len(todo):
            e[todo] += 1
            todo = todo[self.upto[e[todo]] <= u[todo]]
        return e

    def walk(self, place: np.ndarray, end: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a drawn path from each place to its word's end, one path after the other, and their counts. ``at`` is the place's position in the text."""
        steps, counts = [], np.zeros(len(place), dtype=np.int64)
        who = np.flatnonzero(place < end)
        cur, shift = place.copy(), at - place
        while len(who):
            e = self.pick(cur[who], uniform(key[who], cur[who] + shift[who]))
            steps.append((who, e))
            counts[who] += 1
            cur[who] += self.length[e]
            who = who[cur[who] < end[who]]
        out = np.zeros(int(counts.sum()), dtype=np.int64)
        offset = np.cumsum(counts) - counts
        for i, (w, e) in enumerate(steps):
            out[offset[w] + i] = e
        return out, counts


def uniform(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Above 0 and below 1, from a hash."""
    return ((tb.mix64(key + n.astype(np.uint64) * _C[0]) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _gumbel(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(key, n)))


class Draw:
    """One drawn segmentation of a text: lattice edges, log probability of each, byte position of each, perturbed value."""

    __slots__ = ("edges", "q", "value")

    def __init__(self, edges: np.ndarray, q: np.ndarray, value: float):
        self.edges, self.q, self.value = edges, q, value


def draw_segmentations(texts: list[bytes], keys: np.ndarray, v: Vocabulary, draws: int, alpha: float) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``draws`` of (piece ids, log probability, perturbed value, inclusion), best first; fewer where it has no more segmentations."""
    index: dict[bytes, int] = {}
    split = [[index.setdefault(w, len(index)) for w in v.unit.findall(b" " + t)] if t else [] for t in texts]
    words = np.fromiter((w for s in split for w in s), dtype=np.int64)
    if not len(words):
        return [[(np.zeros(0, np.int32), 0.0, float(_gumbel(keys[i:i + 1], np.zeros(1))[0]), 1.0)] for i in range(len(texts))]
    lat = Lattice(list(index), v, alpha)
    per = np.array([len(s) for s in split])
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(texts)), per)
    size = (lat.end - lat.start)[words]
    at = np.cumsum(size) - size
    at = at - np.repeat(at[np.minimum(first, len(at) - 1)], per)
    noise = [tb.mix64(keys + np.uint64((r + 1) * int(_C[1]) % (1 << 64))) for r in range(draws + 1)]

    def parts(d: Draw, key: np.uint64, since: int, cut: float, keep: int) -> list[tuple[float, int]]:
        """The best ``keep`` parts of what differs from a draw at piece ``since`` or later: (value, piece number)."""
        if not len(d.q):
            return []
        before = np.cumsum(d.q) - d.q
        with np.errstate(divide="ignore"):
            mass = (before + np.log(-np.expm1(d.q)))[since:]
        number = np.flatnonzero(np.isfinite(mass)) + since
        if not len(number):
            return []
        z = mass[number - since] + _gumbel(np.full(len(number), key), number)
        value = -np.logaddexp(-cut, -z)
        top = np.argsort(-value, kind="stable")[:keep] if len(value) <= keep else np.argpartition(-value, keep - 1)[:keep]
        return [(float(value[i]), int(number[i])) for i in top]

    edges, counts = lat.walk(lat.start[words], lat.end[words], noise[0][doc], at)
    per_doc = np.add.reduceat(np.concatenate([counts, [0]]), np.minimum(first, len(counts)))
    per_doc[per == 0] = 0
    ends = np.cumsum(per_doc)
    q = lat.q[edges]
    roots = _gumbel(noise[0], np.zeros(len(texts)))
    found: list[list[Draw]] = []
    heaps: list[list[tuple]] = []
    for i, (a, b) in enumerate(zip((ends - per_doc).tolist(), ends.tolist())):
        d = Draw(edges[a:b], q[a:b], float(roots[i]))
        found.append([d])
        # negative value, draw that gives the beginning, piece number that must differ, edges it may not be
        heaps.append([(-x, 0, n, ()) for x, n in parts(d, noise[0][i] ^ _C[1], 0, d.value, draws + 1)])
        heapq.heapify(heaps[i])

    for r in range(1, draws):
        jobs = []
        for i, heap in enumerate(heaps):
            if not heap:
                continue
            value, s, n, gone = heapq.heappop(heap)
            old = found[i][s]
            gone = (*gone, int(old.edges[n]))
            place = int(lat.place[old.edges[n]])
            options = np.arange(lat.first[place], lat.first[place + 1])
            options = options[~np.isin(options, gone)]
            p = np.exp(lat.q[options])
            u = float(uniform(noise[r][i:i + 1] ^ _C[0], np.array([n]))[0])
            e = int(options[min(int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")), len(options) - 1)])
            done = int(lat.length[old.edges[:n]].sum())
            word = first[i] + int(np.searchsorted(at[first[i]:first[i] + per[i]], done, side="right")) - 1
            jobs.append((i, -value, s, n, gone, e, p, word, place + int(lat.length[e]), done + int(lat.length[e])))
        if not jobs:
            break
        # the rest of the word that differs, then all later words
        tail = [np.arange(j[7], first[j[0]] + per[j[0]]) for j in jobs]
        occ = np.concatenate(tail)
        start, position = lat.start[words[occ]], at[occ].copy()
        heads = np.cumsum([0] + [len(t) for t in tail[:-1]])
        start[heads], position[heads] = [j[8] for j in jobs], [j[9] for j in jobs]
        edges, counts = lat.walk(start, lat.end[words[occ]], noise[r][doc[occ]], position)
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.append(heads, len(occ))].tolist()
        for (i, value, s, n, gone, e, p, *_), a, b in zip(jobs, bounds, bounds[1:]):
            old = found[i][s]
            new = np.concatenate([old.edges[:n], [e], edges[a:b]])
            d = Draw(new, lat.q[new], value)
            number = len(found[i])
            found[i].append(d)
            key = noise[r][i] ^ _C[1]
            other = float(p.sum() - np.exp(lat.q[e]))
            options_left = len(p) > 1 and other > 0
            if options_left:
                z = float(lat.q[old.edges[:n]].sum() + np.log(other)) + float(_gumbel(noise[r][i:i + 1], np.array([-n - 1]))[0])
                heapq.heappush(heaps[i], (float(np.logaddexp(-value, -z)), number, n, gone))
            for x, m in parts(d, key, n + 1, value, draws + 1):
                heapq.heappush(heaps[i], (-x, number, m, ()))

    out = []
    for ds, heap in zip(found, heaps):
        bar = -heap[0][0] if heap else -np.inf
        rows = []
        for d in ds:
            log_prob = float(d.q.sum())
            with np.errstate(over="ignore"):
                rows.append((lat.piece[d.edges].astype(np.int32), log_prob, d.value, float(-np.expm1(-np.exp(min(log_prob - bar, 700.0))))))
        out.append(rows)
    return out


def _drawn(it: Iterator[pa.RecordBatch], model_path: str, draws: int, alpha: float, seed: int) -> Iterator[tuple[list[pa.Array], list[np.ndarray]]]:
    """For each slice of the batches (doc_id, text): the columns doc_id, draw, log_prob, perturbed, inclusion, and the ids."""
    v = vocabulary(model_path)
    for batch, texts in tb.batches(it, most=CHUNK):
        i = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        keys = tb.mix64(i.view(np.uint64) + np.uint64(seed * int(_C[1]) % (1 << 64)))
        rows = [(k, n + 1, *d) for k, ds in enumerate(draw_segmentations(texts, keys, v, draws, alpha)) for n, d in enumerate(ds)]
        yield ([batch.column(0).take(pa.array([x[0] for x in rows])), pa.array([x[1] for x in rows], pa.int32()), *(pa.array([x[c] for x in rows], pa.float64()) for c in (3, 4, 5))],
               [x[2] for x in rows])


def sample_encodings(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", draws: int = DRAWS, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, draw (1 is the best), ids, log_prob, perturbed, inclusion: up to ``draws`` distinct segmentations of every whole text.

    An empty or null text has one, without pieces. What double precision cannot tell from impossible (a piece with less than 1e-16 of the
    chances at its place) is not drawn. Repeated rows draw alike; a null id draws as id 0. A very long text is one lattice, whose memory grows with its bytes.
    An empty table gives an empty result; other columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, draw, *scores), ids in _drawn(it, model_path, draws, alpha, seed):
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, draw, pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids))), *scores],
                                             ["doc_id", "draw", "ids", "log_prob", "perturbed", "inclusion"])

    rows = read_text_column(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, draw int, ids array<int>, log_prob double, perturbed double, inclusion double")


def decode_ids(v: Vocabulary, ids: list[int]) -> bytes:
    """The text of piece ids: their bytes, without the space in front."""
    return b"".join(map(v.bytes.__getitem__, ids))[1:]


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """``rows`` with ``text``, the decoded ``ids``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in it:
            at = batch.schema.get_field_index("ids")
            texts = pa.array([decode_ids(v, x) for x in batch.column(at).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, text string")


def encoding_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", draws: int = DRAWS, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The draws of ``sample_encodings``, decoded in the same pass: doc_id, draw, n_tokens, ids_crc32 (ids as little-endian 32-bit numbers),
    log_prob, perturbed, inclusion, decoded_sha256."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for (doc, draw, *scores), ids in _drawn(it, model_path, draws, alpha, seed):
            yield pa.RecordBatch.from_arrays([doc, draw, pa.array([len(x) for x in ids], pa.int32()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()), *scores,
                                              pa.array([sha256(decode_ids(v, x.tolist())).hexdigest() for x in ids])],
                                             ["doc_id", "draw", "n_tokens", "ids_crc32", "log_prob", "perturbed", "inclusion", "decoded_sha256"])

    rows = read_text_column(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, draw int, n_tokens int, ids_crc32 bigint, log_prob double, perturbed double, inclusion double, decoded_sha256 string")
