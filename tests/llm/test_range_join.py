import math

import numpy as np

from chronoreel.llm import queries, range_join

from .helpers import components, tables


def brute(rows, threshold):
    """rows: (position, label, vector)."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: sum(map(lambda x, y: x * y, a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    use = [r for r in rows if r[1] is not None and ok(r[2])]
    return [(a[0], b[0]) for i, a in enumerate(use) for b in use[:i] if a[1] == b[1] and len(a[2]) == len(b[2]) and cos(a[2], b[2]) >= threshold]


def check(got, rows, threshold):
    links = brute(rows, threshold)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = components([r[0] for r in rows], links)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, n[i], want[i], want[i] == i) for i in sorted(n)]
    return links


def test_query_against_brute_force(spark, sf):
    rows = tables(sf).execute("SELECT vec_id, label, embedding FROM embeddings").fetchall()
    check(queries.QUERIES["op2_embedding_near_dedup"](spark, sf).collect(), rows, 0.93)


def test_many_cells_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(range_join, "CELL", 20)
    monkeypatch.setattr(range_join, "TILE", 15)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 6))
    rows = [(i, int(i % 2), (centres[i % 25] + rng.normal(size=6) * 0.25).tolist()) for i in range(300)]
    rows += [(300 + i, 1, rows[1][2]) for i in range(40)] + [(340, 1, [2 * x for x in rows[1][2]])]
    bad = [None, [], [0.0] * 6, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [None] * 6, [1.0, 2.0], [-0.0] * 6]
    rows += [(400 + i, 1, v) for i, v in enumerate(bad)] + [(500, None, rows[0][2]), (501, None, rows[0][2])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, class int, home string")
    assert len(check(range_join.near_duplicates(df, 0.93).collect(), rows, 0.93)) > 1000
    assert range_join.near_duplicates(df.limit(0)).count() == 0
