"""Fingerprints, token files and sampled segmentations: exact round trips and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from routelab.llm import merkle, segment, simple8b
from routelab.llm import textbytes as tb
from routelab.llm.common import scratch
from routelab.llm.vocabularies import vocabulary_path
from tests.llm.cases import documents, edge_rows, prose

WORD_BPE, PIECES = vocabulary_path("word_bpe_49k.json"), vocabulary_path("piece_bpe_32k.model")


# fingerprints

def _ordered(rows):
    return [(i, t or "") for i, t, *_ in rows]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_fingerprint_edits(spark, ranges):
    rows = [(i * 3, prose(i, 20 + 13 * i % 300) + ("\n" if i % 2 else "") + prose(i + 500, 50), "s") for i in range(60)] + [(200, None, "s"), (201, "", "s"), (202, "é", "s"), (203, prose(1, 30_000), "s"), (-5, "first " * 9, "s")]
    got = {r.doc_id: r for r in merkle.fingerprint_edits(documents(spark, rows), ranges=ranges).collect()}
    order = sorted(_ordered(rows))
    assert sorted(got) == [i for i, _ in order]
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        r, k = got[i], len(t) // 4
        edited = t[:len(t) - k] + n[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (merkle.fingerprint(x.encode()) for x in (t, edited, n))
        assert (r.fingerprint, r.edited_fingerprint) == (a[0], b[0])
        assert r.near_edited == merkle.likeness(a, b) and r.near_next == merkle.likeness(a, c)
        if len(t) > 1000:
            assert 0.5 < r.near_edited < 0.95


def test_fingerprint_edge_rows(spark):
    """Nulls, repeated rows and ties: every row once, null ids first."""
    for ranges in (1, 5):
        got = merkle.fingerprint_edits(documents(spark), ranges=ranges).collect()
        assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t, _ in edge_rows())
    assert merkle.fingerprint_edits(documents(spark, [])).count() == 0
    one = merkle.fingerprint_edits(documents(spark, [(7, "abcdefgh", "s")])).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    nulls = merkle.fingerprint_edits(documents(spark, [(None, "abcdefgh", "s"), (None, "abcdefgh", "s")])).collect()
    assert len(nulls) == 2


def test_tree():
    text = "\n".join(prose(i, 40) for i in range(30)).encode()
    tree = merkle.fingerprint(text)
    assert merkle.parse(tree[0]) == tree[1] and sum(tree[1].values()) == len(text)
    other = text.replace(text.split(b"\n")[19], b"changed", 1)
    assert merkle.fingerprint(other)[0][:32] != tree[0][:32]
    assert merkle.differing(tree[0], merkle.fingerprint(other)[0]) == [(19 // merkle.PARAGRAPHS, 19 % merkle.PARAGRAPHS)]
    assert merkle.differing(tree[0], tree[0]) == [] and merkle.likeness(tree, tree) == 1.0
    assert merkle.fingerprint(b"a\n\nb")[0] != merkle.fingerprint(b"a\nb\n")[0]


# Simple-8b

def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for k in range(60):
        n = int(r.integers(0, 3000))
        ids = r.integers(0, 2 ** int(r.integers(1, 63)), n, dtype=np.uint64) if k % 2 else (r.integers(0, 2, n) * (r.random(n) < 0.02) * 49_000).astype(np.uint64)
        if k % 7 == 0 and n:
            ids[r.integers(0, n, 3)] = 2 ** 64 - 1
        docs = [ids, ids[:5], ids[:0], ids[3:2000], ids[::-1]]
        packed = simple8b.pack_documents(docs)
        data = simple8b.write_segment([(i, len(x), w, s, raw.astype("<u8").tobytes()) for i, (x, (w, s, raw)) in enumerate(zip(docs, packed))])
        got = list(simple8b.read_segment(data))
        assert [i for i, _ in got] == list(range(5)) and all((x == y).all() and len(x) == len(y) for (_, x), y in zip(got, docs))
        if n > simple8b.BLOCK:
            assert (simple8b.read_block(data, 1) == ids[simple8b.BLOCK:2 * simple8b.BLOCK]).all()


def test_simple8b_is_dense():
    words, per = simple8b.encode(np.zeros(480), np.array([480]))
    assert len(words) == 2 and per.tolist() == [2]
    assert len(simple8b.encode(np.full(30, 40_000), np.array([30]))[0]) == 10


def test_word_ids_are_those_of_the_library():
    library, fast = Tokenizer.from_file(WORD_BPE), simple8b.WordIds(WORD_BPE)
    odd = ["", " ", "a\x1cb c\x85d e\xa0f g", "<|endoftext|> x<|startoftext|>y<|endoftext|>z", "ΑΣ ΣΑΣ. İ,", "é ́x é. é, é.,", "it's don't I'LL 12345. 3,4 ١٢ x² ½.", "\x00 ​ a.b,c", "日本語。🙂 ﬁ",
           "Hello, HELLO hello. hello.. hello,. hello", "ǅ. ͅa", *[t or "" for _, t, _ in edge_rows() if len(t or "") < 5000]]
    for _ in range(2):  # the second time from what it knows
        assert [x.tolist() for x in fast.encode(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_added_tokens_are_case_sensitive():
    texts = ["<|ENDOFTEXT|> Some, words", "a<|EndOfText|>B. C <|endoftext|>", "<|StartOfText|>, x", "\u4e00 <|ENDOFTEXT|>\u4e00 <|STARTOFTEXT|>.", "<|startoftext|> \u00c9t\u00c9, THE <|Other|> 5."]
    got = simple8b.WordIds(WORD_BPE).encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)]


def test_word_ids_forget(monkeypatch):
    monkeypatch.setattr(simple8b, "CACHE_WORDS", 20)
    library, fast = Tokenizer.from_file(WORD_BPE), simple8b.WordIds(WORD_BPE)
    for k in range(10):
        t = [prose(k, 30), prose(k + 50, 5)]
        assert [x.tolist() for x in fast.encode(t, 1)] == [library.encode(x, add_special_tokens=False).ids + [1] for x in t]


def test_token_files(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rows = edge_rows() + [(500 - i, prose(i, 40), "s") for i in range(200)]
    path = scratch(spark, "test-ids")
    simple8b.write_ids(documents(spark, rows), path, WORD_BPE, segment_ids=500)
    got = simple8b.document_index(spark, path).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 << 63 if i is None else i)
    assert spark.read.parquet(path).count() > 5
    read = Counter((r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in simple8b.read_ids(spark, path).collect())
    assert read == want


def test_token_files_empty(spark):
    path = scratch(spark, "test-ids")
    simple8b.write_ids(documents(spark, []), path, WORD_BPE)
    assert simple8b.document_index(spark, path).count() == 0


# SentencePiece

@pytest.fixture(scope="module")
def v():
    return segment.vocabulary(PIECES)


def _all(v, text, alpha):
    ids = {p: i for i, p in enumerate(v.bytes) if p and i >= 259}
    found = []

    def go(at, done):
        if at == len(text):
            found.append(tuple(done))
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in ids:
                go(end, done + [ids[text[at:end]]])
    go(0, [])
    w = np.array([alpha * sum(v.score[i] for i in s) for s in found])
    return dict(zip(found, np.exp(w - np.logaddexp.reduce(w))))


@pytest.mark.parametrize("text", [b"the cat", b"hello.", b"ab  c", b"a\nb"])
def test_draws_follow_the_lattice(v, text):
    """Against all segmentations: probabilities, order without replacement, inclusion weights."""
    alpha, n, draws = 0.0005, 20_000, 3
    p = _all(v, b" " + text, alpha) if b"\n" not in text else None
    keys = tb.mix64(np.arange(n, dtype=np.uint64) + np.uint64(99))
    got = segment.draw_segmentations([text] * n, keys, v, draws, alpha)
    for g in got:
        assert len({tuple(x[0]) for x in g}) == len(g) and all(a[2] > b[2] for a, b in zip(g, g[1:]))
    # each segmentation's probability over its chance to be drawn: one on average
    assert np.mean([sum(np.exp(x[1]) / x[3] for x in g) for g in got]) == pytest.approx(1, abs=0.03)
    if p is None:
        return
    assert len(got[0]) == min(draws, len(p))
    for g in got[:100]:
        assert np.exp(g[0][1]) == pytest.approx(p[tuple(g[0][0].tolist())])
    first = Counter(tuple(g[0][0].tolist()) for g in got)
    second = Counter((tuple(g[0][0].tolist()), tuple(g[1][0].tolist())) for g in got)
    for s, c in first.most_common(6):
        assert c / n == pytest.approx(p[s], abs=0.015)
    for (a, b), c in second.most_common(6):
        assert c / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.015)


def test_few_segmentations(v):
    got = segment.draw_segmentations([b"ab"], np.array([3], dtype=np.uint64), v, 50, 0.0001)[0]
    assert {tuple(x[0].tolist()) for x in got} == set(_all(v, b" ab", 0.0001)) and all(x[3] == 1.0 for x in got)


def test_round_trip(v):
    texts = [(t or "").encode() for _, t, _ in edge_rows()] + [x.encode() for x in ("  a  b\n c\t", "ﬁ ０ ▁x▁ ▁▁", "\n\n", "x" * 3000, "é" * 50 + " ñ", "\x00ÿ", "a" + " " * 70 + "b")]
    for text, draws in zip(texts, segment.draw_segmentations(texts, tb.mix64(np.arange(len(texts), dtype=np.uint64)), v, 4, 0.001)):
        assert draws and all(segment.decode_ids(v, d[0].tolist()) == text for d in draws)
        assert len({tuple(d[0]) for d in draws}) == len(draws)


def test_pieces_exist_in_the_library(v):
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=PIECES)
    text = "Plain words, é ñ and 12 numbers."
    for d in segment.draw_segmentations([text.encode()], np.array([5], dtype=np.uint64), v, 3, 0.001)[0]:
        assert model.decode(d[0].tolist()) == text


def test_sampled_encodings(spark, v):
    docs = documents(spark)
    rows = segment.sample_encodings(docs, PIECES, draws=3)
    got = rows.collect()
    assert Counter(r.doc_id for r in got if r.draw == 1) == Counter(i for i, _, _ in edge_rows())
    back = Counter((r.doc_id, r.text) for r in segment.decoded(rows, PIECES).where("draw = 1").collect())
    assert back == Counter((i, t or "") for i, t, _ in edge_rows())
    again = {(r.doc_id, r.draw, tuple(r.ids)) for r in segment.sample_encodings(docs.repartition(5), PIECES, draws=3).collect()}
    assert again == {(r.doc_id, r.draw, tuple(r.ids)) for r in got}
    digests = segment.encoding_digests(docs, PIECES, draws=3).collect()
    assert Counter((r.doc_id, r.draw, r.n_tokens, r.ids_crc32) for r in digests) == Counter((r.doc_id, r.draw, len(r.ids), zlib.crc32(np.array(r.ids, "<i4").tobytes())) for r in got)
    assert {(r.doc_id, r.decoded_sha256) for r in digests} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in edge_rows()}
    assert segment.sample_encodings(documents(spark, []), PIECES).count() == 0


def test_fingerprint_large_null_and_repeated_ids(spark):
    """Ids that doubles cannot tell apart, many null ids and repeated ids: every document has its row and its successor."""
    rows = [((1 << 60) + 1 + 3 * i, prose(i, 12), "s") for i in range(300)] + [(None, prose(i, 12), "s") for i in range(60)] + [(5, prose(i, 12), "s") for i in range(60)] + [(5, "same", "s")] * 3
    got = merkle.fingerprint_edits(documents(spark, rows), ranges=16).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1])))
    want = Counter()
    for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1]):
        want[i, hashlib.sha256((t[:len(t) - len(t) // 4] + n[:len(t) // 4]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h
