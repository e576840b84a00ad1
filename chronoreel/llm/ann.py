"""Nearest neighbours by an inverted file: exact, by bounds on what a cell can hold.

Vectors are scaled to length 1, so nearest by cosine is nearest by distance. Coarse
centroids are fitted on a bounded sample; every vector is indexed. A query visits its nearest
cells first, and then each other cell whose nearest possible vector, by the distance of its
centroid and the reach of its vectors from that, isn't farther than the query's last find.
In a cell all vectors are compared: their products cost less than the look-ups of codes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.llm.common import cut
from chronoreel.llm.range_join import as_matrix, unit, valid

#: Vectors that centroids and codebooks are fitted on.
FIT_SAMPLE = 20_000
#: Vectors in one task's part of a cell.
PART = 20_000
#: Products worked on at once, and numbers of candidates scored at once.
BLOCK, SCORED = 1_000_000, 2_000_000
#: More than rounding can change in a product or a distance of unit vectors.
SLACK, FAR = 1e-10, 1e-5


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 11):
        self.coarse = kmeans(sample, cells, 8, seed)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row to each centroid."""
        d = (x * x).sum(axis=1)[:, None] + (self.coarse**2).sum(axis=1) - 2 * x @ self.coarse.T
        return np.sqrt(np.maximum(d, 0))


def search(
    vectors: DataFrame,
    is_query: str = "vec_id % 50 = 0",
    k: int = 5,
    probe: float = 0.9,
    cells: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest others by cosine, ties to the smaller id.

    ``is_query`` is SQL over ``vec_id``. ``probe`` is the part of the cells that a query
    visits before bounds tell which of the others it needs; the result doesn't depend on it. Null, zero and non-finite vectors and null ids take no part. Vectors meet those of
    their own length: lengths of more than PART vectors have an index each, the others are compared
    one with all. A query's own id is no candidate. Repeated ids are rows of their own: as
    candidates each counts, as queries each different vector has its own ranks.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(f"vec_id IS NOT NULL AND {valid('v')}")
    rows = cut(rows.withColumn("dim", F.size("v")), "vectors")
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # one row a length
    found = [_indexed(rows.where(F.col("dim") == d).select("vec_id", "v"), n, is_query, k, probe, cells) for d, n in sorted(sizes.items()) if n > PART or n == max(sizes.values())]
    small = [d for d, n in sizes.items() if n <= PART and n < max(sizes.values())]
    if small:
        rest = rows.where(F.col("dim").isin(small))
        both = rest.select("dim", F.lit(0).cast("long").alias("q"), "vec_id", "v", F.lit(False).alias("asks")).union(_queries(rest, is_query).select("dim", "q", "vec_id", "v", F.lit(True)))
        found.append(both.groupBy("dim").applyInArrow(lambda key, t: _scan(t, k), FOUND))
    if not found:
        return spark.createDataFrame([], schema)
    return _best(reduce(DataFrame.union, found), k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, q long, vec_id long, score double"


def _queries(rows: DataFrame, is_query: str) -> DataFrame:
    """Different query vectors, told apart by ``q`` where they share an id."""
    return rows.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("q", F.xxhash64("v"))


def _best(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _scan(t: pa.Table, k: int) -> pa.Table:
    """The best ``k`` among a group's points for each of its queries: whatever may be among them by products of unit vectors, by its cosine then."""
    asks, ids, x, key = t.column("asks").to_numpy(), t.column("vec_id").to_numpy(), as_matrix(t.column("v")), t.column("q").to_numpy()
    p, q = np.flatnonzero(~asks), np.flatnonzero(asks)
    out = [[], [], [], []]
    if len(p) and len(q):
        u = unit(x)
        step, some = max(1, BLOCK // len(p)), max(1, SCORED // x.shape[1])
        for i in range(0, len(q), step):
            own = q[i : i + step]
            near = u[own] @ u[p].T
            near[ids[own][:, None] == ids[p]] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k] if k < len(p) else np.full(len(own), -np.inf)
            row, at = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
            score = np.concatenate([cosine(x[own[row[j : j + some]]], x[p[at[j : j + some]]]) for j in range(0, len(row), some)] or [np.zeros(0)])
            order = np.lexsort((ids[p[at]], -score, row))
            begin = np.searchsorted(row, np.arange(len(own)))
            order = order[np.arange(len(row)) - begin[row] < k]
            row, at, score = own[row[order]], p[at[order]], score[order]
            for column, value in zip(out, (ids[row], key[row], ids[at], score), strict=True):
                column.append(value)
    return pa.table([np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, (np.int64, np.int64, np.int64, np.float64), strict=True)], names=["query_id", "q", "vec_id", "score"])


def _indexed(rows: DataFrame, n: int, is_query: str, k: int, probe: float, cells: int | None) -> DataFrame:
    """Rows ``FOUND`` for vectors of one length, by an index of their own."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(FIT_SAMPLE).select("v").collect()
    sample = unit(np.array([r[0] for r in sample], np.float64))
    index = Index(sample, cells or int(max(1, min(4096, round(np.sqrt(n) / 4), len(sample) // 8))))
    cells = len(index.coarse)
    visit = min(cells, max(1, int(np.ceil(cells * probe))))

    def place(batches):
        for b in batches:
            d = index.distances(unit(as_matrix(b.column("v"))))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), b.column("vec_id"), b.column("v")], ["cell", "far", "vec_id", "v"])

    placed = cut(rows.mapInArrow(place, "cell int, far double, vec_id long, v array<double>"), "placed")
    per_cell, inner, outer = np.zeros(cells, np.int64), np.full(cells, np.inf), np.zeros(cells)
    for c, *facts in placed.groupBy("cell").agg(F.count("*"), F.min("far"), F.max("far")).collect():  # one row a cell
        per_cell[c], inner[c], outer[c] = facts
    shares = np.maximum(1, -(-per_cell // PART))
    spread = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), F.col("cell") + 1)
    points = placed.select("cell", F.pmod(F.xxhash64("vec_id", "v"), spread).cast("int").alias("part"), "vec_id", "v", F.lit(0).cast("long").alias("q"), F.lit(False).alias("asks"))

    def ask(batches):
        """Each query for its nearest cells, or, where ``last`` is known, for those of the others that may hold a nearer vector."""
        for b in batches:
            d, later = index.distances(unit(as_matrix(b.column("v")))), "last" in b.schema.names
            nearest = np.zeros(d.shape, bool)
            np.put_along_axis(nearest, d.argsort(axis=1, kind="stable")[:, :visit], True, axis=1)
            if later:
                reach = np.sqrt(np.maximum(0, 2 - 2 * b.column("last").to_numpy()))[:, None] + FAR
                nearest = ~nearest & (d - outer <= reach) & (inner - d <= reach)
            row, cell = np.nonzero(nearest & (per_cell > 0))
            row, at = np.repeat(row, shares[cell]), np.repeat(cell, shares[cell])
            part = np.arange(len(at)) - np.repeat(np.cumsum(shares[cell]) - shares[cell], shares[cell])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32)), b.column("vec_id").take(take), b.column("v").take(take), b.column("q").take(take)], ["cell", "part", "vec_id", "v", "q"]
            )

    def answers(asking: DataFrame) -> DataFrame:
        asked = asking.mapInArrow(ask, "cell int, part int, vec_id long, v array<double>, q long").withColumn("asks", F.lit(True))
        return points.unionByName(asked).groupBy("cell", "part").applyInArrow(lambda key, t: _scan(t, k), FOUND)

    queries = _queries(rows, is_query)
    found = answers(queries)
    if visit == cells:
        return found
    found = cut(_best(found, k).select("query_id", "q", "vec_id", "score"), "nearest")
    last = found.groupBy(F.col("query_id").alias("vec_id"), "q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-1.0).alias("last"))
    # fewer than k finds so far: any cell may hold more, as no two unit vectors are farther apart than 2
    return found.union(answers(queries.join(last, ["vec_id", "q"], "left").withColumn("last", F.coalesce("last", F.lit(-1.0)))))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In double precision on the vectors as given, over the last axis; scaled by powers of two, which changes no digit, so that nothing overflows."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True, initial=0))[1]) for x in (a, b))
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))
