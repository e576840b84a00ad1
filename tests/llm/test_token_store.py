import gc
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from chronoreel.llm import queries, token_store

from .helpers import EDGE_DOCS, documents, edge_docs


def plain():
    t = Tokenizer.from_file(token_store.default_tokenizer())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


def expected(rows):
    start, out, encode = 0, [], plain()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = encode(t)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_plain_tokenizer(spark, sf):
    got = queries.QUERIES["op8_token_store"](spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([d[:2] for d in documents(sf)])


def test_edge_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 500)
    folder = token_store.new_folder(spark)
    token_store.write(edge_docs(spark), folder)
    got = token_store.read(spark, folder).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == expected([d[:2] for d in EDGE_DOCS])
    encode = plain()
    assert {tuple(r.ids) for r in got} == {tuple(encode(d[1])) for d in EDGE_DOCS}
    empty = token_store.new_folder(spark)
    token_store.write(edge_docs(spark, []), empty)
    assert token_store.read(spark, empty).count() == 0


def test_tokens_of_odd_white_space():
    r, encode = random.Random(3), plain()
    texts = ["".join(r.choice(" \n\tab'1.é\x1c  <|endoftext|>") for _ in range(r.randrange(40))) for _ in range(2000)] + ["<|endoftext|> a <|endoftext|>"]
    texts += ["".join(r.choice(list("abzZ09 \n'.,;(-)$é漢\u2003\xa0\x85\u0301²½\t\x0b\u200b\u3000\x7f") + ["'s", "'re", "n't", "don", " a", "\r\n"]) for _ in range(r.randrange(60))) for _ in range(6000)]
    ids, n = token_store.tokenize([t.encode() for t in texts], token_store.default_tokenizer())
    at = np.concatenate(([0], np.cumsum(n)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [encode(t)[:-1] for t in texts]


def test_codes_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for limit, counts in ((16, rng.zipf(1.3, 300)), (9, 2 ** np.arange(40)), (6, rng.integers(0, 5, 50)), (4, np.ones(16)), (16, rng.integers(1, 90, 70_000)), (16, np.array([0, 7, 0])), (16, np.array([3, 4]))):
        counts = np.asarray(counts, np.int64)
        n = token_store.code_lengths(counts, limit).astype(int)
        used = counts > 0
        assert n.max() <= max(limit, int(used.sum() - 1).bit_length()) and (n[used] > 0).all() and not n[~used].any()
        assert used.sum() == 1 or sum(2.0 ** -n[used]) == 1
        if limit == 16 and 1 < used.sum() < 60_000:
            import heapq

            heap, cost = [int(c) for c in counts[used]], 0
            heapq.heapify(heap)
            while len(heap) > 1:
                a = heapq.heappop(heap) + heapq.heappop(heap)
                cost += a
                heapq.heappush(heap, a)
            assert cost == (counts * n).sum() or n.max() == 16
        ids = rng.choice(np.flatnonzero(used), 5000).astype(np.uint32)
        codes = token_store.codes_of(n.astype(np.uint8))
        marks, _, stream = token_store.pack(ids, codes, n.astype(np.uint8), 64)
        assert (token_store.unpack(np.frombuffer(stream, np.uint8), marks, len(ids), token_store.decode_table(n.astype(np.uint8)), 64) == ids).all()


def test_no_garbage_is_looked_for_while_words_are_tokenised():
    r, ran = random.Random(8), []
    texts = [" ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(300)) for _ in range(100)]
    look = lambda phase, info: ran.append(phase)
    token_store.load(token_store.default_tokenizer())
    gc.callbacks.append(look)
    try:
        ids, n = token_store.tokenize([t.encode() for t in texts], token_store.default_tokenizer())
    finally:
        gc.callbacks.remove(look)
    assert gc.isenabled() and not ran
    encode = plain()
    assert ids.tolist() == [i for t in texts for i in encode(t)[:-1]] and len(n) == 100
