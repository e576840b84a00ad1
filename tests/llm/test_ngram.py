import math
import zlib
from collections import Counter

import numpy as np

from chronoreel.llm import names, ngram, queries

from .helpers import EDGE_DOCS, documents, edge_docs


def brute(rows):
    """With exact counts; the trie's codes are within half a step of log10."""
    split = [(d, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    train = [w for d, w in split if d is not None and not held(d)]
    one = Counter(x for w in train for x in w)
    two = Counter(p for w in train for p in zip(["<", *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    p1 = lambda x: (one[x] + 0.5) / (n + 0.5 * (v + 1))
    of = lambda u: one[None] if u == "<" else one[u]
    p2 = lambda u, x: two[u, x] / (of(u) + ngram.PRIOR) + ngram.PRIOR / (of(u) + ngram.PRIOR) * p1(x)
    for d, w in split:
        s2 = sum(math.log10(p2(u, x)) for u, x in zip(["<", *w[:-1]], w, strict=True))
        yield d, held(d), len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), s2


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[7] - w[6]) <= ngram.STEP / 2 * w[2] + 1e-6, (g, w)


def test_query_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(names, "CHUNK", 100_000)
    got = queries.QUERIES["op1_ngram_score"](spark, sf).collect()
    same(got, brute([d[:2] for d in documents(sf)]))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score2 for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark):
    same(ngram.score(edge_docs(spark)).collect(), brute([d[:2] for d in EDGE_DOCS]))
    assert ngram.score(edge_docs(spark, [])).count() == 0
    none = ngram.score(edge_docs(spark, EDGE_DOCS[:1]), trained="false").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in none] == [(1, 0, 0)]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (1, 5, 1000, 1 << 40, (1 << 64) - 1):
        for n in (0, 1, 2, 63, 64, 65, 3000):
            v = np.sort(rng.integers(0, top, n, np.uint64, endpoint=True))
            ef = ngram.EliasFano.of(v)
            assert (ef.get(np.arange(n)) == v).all()
            x = np.concatenate([rng.integers(0, top, 200, np.uint64, endpoint=True), v, np.array([0, top], np.uint64)])
            assert (ef.successor(x) == np.searchsorted(v, x)).all()


def test_trie_on_a_mapped_file():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0).astype(np.uint64)
    p = rng.random(len(pairs))
    trie = ngram.Trie.of(pairs[:, 0], pairs[:, 1], p).mapped()
    known = {tuple(x): c for x, c in zip(pairs.tolist(), ngram.quantise(p), strict=True)}
    ask = rng.integers(0, 70, (2000, 2)).astype(np.uint64)
    assert trie.lookup(ask[:, 0], ask[:, 1]).tolist() == [int(known.get(tuple(x), 0)) for x in ask.tolist()]
    assert np.abs(np.log10(ngram.LEVELS[ngram.quantise(p)]) - np.log10(p)).max() <= ngram.STEP / 2 + 1e-9


def brute3(rows):
    """Scores under trigrams, with exact counts."""
    split = [(d, ["<", *(t or "").encode().lower().split(), None]) for d, t in rows]
    train = [w for d, w in split if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    one = Counter(x for w in train for x in w[1:])
    one["<"] = one[None]
    two = Counter(p for w in train for p in zip(w, w[1:], strict=False))
    three = Counter(p for w in train for p in zip(w, w[1:], w[2:], strict=False))
    n, v, m = one.total() - one["<"], len(one) - 1, ngram.PRIOR
    p1 = lambda x: (one[x] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda u, x: (two[u, x] + m * p1(x)) / (one[u] + m)
    p3 = lambda t, u, x: (three[t, u, x] + m * p2(u, x)) / (two[t, u] + m)
    for d, w in split:
        yield d, len(w) - 1, math.log10(p2(*w[:2])) + sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:], strict=False))


def test_trigrams_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(names, "CHUNK", 100_000)
    docs = [d[:2] for d in documents(sf)]
    got = {r.doc_id: r for r in queries.QUERIES["op1_ngram_score"](spark, sf).collect()}
    for d, n, want in brute3(docs):
        assert got[d].n_tokens == n and abs(got[d].score - want) <= ngram.STEP * n + 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.score2 for r in held)


def test_trigrams_tell_orders_of_words_that_bigrams_do_not(spark):
    rows = [(i, "a x b" if i % 2 else "c x d") for i in range(400)] + [(1001, "a x b"), (1002, "a x d")]
    got = {r.doc_id: r for r in ngram.score(spark.createDataFrame(rows, "doc_id long, text string"), trained="doc_id < 1000").collect()}
    seen, new = got[1001], got[1002]
    assert abs(seen.score2 - new.score2) < 0.05 and seen.score - new.score > 0.5


def test_searches_go_by_blocks_and_ask_for_a_word_once(monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK", 7)
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 10_000, 900, np.uint64))
    ef, x = ngram.EliasFano.of(values), rng.integers(0, 12_000, 500, np.uint64)
    assert (ef.get(np.arange(len(values))) == values).all()
    assert (ef.successor(x) == np.searchsorted(values, x)).all()
    assert ((ef.find(x) >= 0) == np.isin(x, values)).all()
    context, word = np.repeat(values[:40], 20), np.tile(values[-20:], 40)
    trie = ngram.Trie.of(context, word, np.full(800, 0.5))
    asked, find = [], ngram.EliasFano.find
    monkeypatch.setattr(ngram.EliasFano, "find", lambda self, x: (asked.append(len(x)) if self is trie.parts["words"] else None) or find(self, x))
    assert (trie.find(context, word) == np.arange(800)).all()
    assert asked == [20]
