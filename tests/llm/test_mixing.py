import hashlib
from collections import defaultdict

from chronoreel.llm import mixing, queries

from .helpers import EDGE_DOCS, documents, edge_docs


def brute(rows, budget=1.5, repeat=2, weights=(3, 1, 2)):
    """rows: (doc_id, source, size) without null ids."""
    size = defaultdict(int)
    for _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(size.values()) * budget, set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if repeat * size[s] < level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(repeat * size[s])
            left -= target[s]
            open_.remove(s)
    items = []
    for s in order:
        upto = 0
        for turn in range(repeat):
            for d, n in sorted(((d, n) for d, s2, n in rows if s2 == s), key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0])):
                upto += n
                if n:
                    items.append((upto / target[s], order.index(s), hashlib.md5(str(d).encode()).hexdigest(), d, turn, n))
    spent, taken = 0, defaultdict(int)
    for _, _, _, d, _, n in sorted(items):
        if spent + n > sum(size.values()) * budget:
            break
        spent += n
        taken[d] += n
    return {d: (n, size[s], target[s], taken[d]) for d, s, n in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:2] == want[d][:2] and abs(got[d][2] - want[d][2]) < 1e-6 and got[d][3] == want[d][3], (d, got[d], want[d])


def test_query_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(d[0], d[3], len((d[1] or "").encode().split())) for d in documents(sf)]
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in queries.QUERIES["op10_mix_sources"](spark, sf).collect()}
    same(got, brute(rows))
    total = sum(r[2] for r in rows)
    assert abs(sum(v[3] for v in got.values()) - 1.5 * total) < 0.02 * total


def test_edge_rows(spark):
    rows = [d for i, d in enumerate(EDGE_DOCS) if d[0] is not None and i != 9]
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(edge_docs(spark, rows)).collect()}
    same(got, brute([(d[0], d[3], len((d[1] or "").encode().split())) for d in rows]))
    assert mixing.mix(edge_docs(spark, [])).count() == 0
    everything = mixing.mix(edge_docs(spark)).collect()
    assert len(everything) == 10 and all(0 <= r.taken <= 2 * r["size"] for r in everything)
    assert mixing.mix(edge_docs(spark), budget=2.0).where("taken <> 2 * size").count() == 0
    assert {r.taken for r in mixing.mix(edge_docs(spark, EDGE_DOCS[:2])).collect()} == {0}


def test_reruns_agree_on_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rows = [(i % 7 if i % 3 else None, "w " * (i % 11), "en", "ab"[i % 2], 1) for i in range(200)]
    take = lambda order: sorted(tuple(r)[1:] for r in mixing.mix(edge_docs(spark, order).repartition(5)).collect())
    once = take(rows)
    assert once == take(rows[::-1])
    total = sum(r[1] for r in once)
    assert abs(sum(r[-1] for r in once) - 1.5 * total) <= 20
