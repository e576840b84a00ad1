import numpy as np

from chronoreel.llm import ann, queries

from .helpers import tables


def exact(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = ids[order].tolist()
    return out


def test_recall_of_query(spark, sf):
    rows = tables(sf).execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want, at = exact(ids, x, 5), {int(i): k for k, i in enumerate(ids)}
    got = {}
    for r in queries.QUERIES["op3_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
        a, b = x[at[r.query_id]], x[at[r.vec_id]]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 3), 0.0]) for i in range(60)] + [(70, None), (71, [0.0, 0.0, 0.0]), (72, [float("nan"), 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (100, [1.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, cell int, part string")
    got = ann.search(df, probe=1.0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, i + 1, v) for i, v in enumerate([3, 6, 9, 12, 15])] + [(50, i + 1, v) for i, v in enumerate([2, 5, 8, 11, 14])]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id in (0, 1, 2)"), probe=1.0).count() == 2


def test_other_lengths_and_repeated_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(200 + i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(0, rows[0][1]), (50, rng.normal(size=6).tolist())]  # a query once more, and another vector under a query's id
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probe=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: len(v) for q, v in got.items()} == {0: 5, 50: 10, 100: 5, 200: 5, 250: 5}
    for n, at in ((6, range(120)), (4, range(120, 180))):
        ids, x = np.array([rows[i][0] for i in at]), np.array([rows[i][1] for i in at])
        for q, want in exact(ids, x, 5).items():
            if q not in (0, 50, 100):
                assert [v for _, v in got[q]] == want
    assert len({v for _, v in got[0]}) == 5


def test_all_of_the_nearest_in_dense_groups_and_far_cells(spark):
    """Near copies finer than any code of theirs, rows without clusters, few components, and components of any size."""
    rng = np.random.default_rng(8)
    dense = np.repeat(rng.normal(size=(4, 16)), 500, axis=0) + rng.normal(size=(2_000, 16)) * 1e-4
    for x in (dense, rng.normal(size=(2_000, 16)), rng.normal(size=(2_000, 3)), rng.normal(size=(300, 4)) * 10.0 ** rng.integers(-200, 200, (300, 1))):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        want = exact(np.arange(len(x)), x / np.abs(x).max(axis=1, keepdims=True), 5)
        for probe in (0.9, 0.1):
            got = {}
            for r in ann.search(df, probe=probe).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.vec_id)
            assert got == want
