import numpy as np
import xxhash
from pyspark.sql import functions as F

from chronoreel.llm import queries, simhash

from .helpers import components, documents, edge_docs


def plain(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_query_against_brute_force(spark, sf):
    docs = documents(sf)
    fps = {d[0]: plain(d[1]) for d in docs}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(ids, links)
    got = queries.QUERIES["op7_simhash_near_dedup"](spark, sf).collect()
    assert links and len(got) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_links_over_many_shards_and_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "TILE", 50)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 700, np.uint64)
    noisy = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), False))) for b in base[:300]]
    dense = [np.uint64(5) ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.choice(20, (300, 2))]
    fps = np.unique(np.concatenate([base, noisy, dense]).astype(np.uint64))
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = components(range(len(fps)), zip(*np.nonzero(np.triu(d <= 4, 1)), strict=True))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    links = [(at[r.a], at[r.b]) for r in simhash.hamming_links(df).collect()]
    assert all(d[a, b] <= 64 for a, b in links)
    assert components(range(len(fps)), links) == want


def test_edge_rows(spark):
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == by[6] == {1} and by[3] == by[4] == by[None] == {3} and by[9] == {9}
    assert simhash.near_duplicates(edge_docs(spark, [])).count() == 0
    assert simhash.near_duplicates(edge_docs(spark).select(F.lit(None).cast("string").alias("text"), "doc_id")).count() == 10
