"""Exact metric range join of embeddings, cell by cell.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. Each label's vectors fall to their nearest
pivot. A vector also goes, as a query, to each other cell that may hold a partner: those
whose dividing plane is no farther than the range (the four-point form of the triangle
inequality, exact in Euclidean space) and whose covering radius plus the range reaches it.
Cells then join on their own. Copies are one vector with a multiplicity throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import Forest, components, cut

#: Vectors sampled to choose pivots, over all labels; pivots only place vectors.
PIVOT_SAMPLE = 40_000
#: Distinct vectors wanted in a cell, and points in one tile of a cell.
CELL = 2_000
TILE = 8_000
SLACK = 1e-9


def valid(v: str) -> str:
    """SQL: neither null nor zero, and every component a finite number."""
    return f"({v} IS NOT NULL AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists({v}, x -> x <> 0))"


def as_matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first among the sample, so that pivots don't gather in one dense group."""
    at = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < min(k, len(sample)):
        i = int(far.argmax())
        if far[i] < 1e-12:
            break
        at.append(i)
        far = np.minimum(far, ((sample - sample[i]) ** 2).sum(axis=1))
    return sample[at]


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each vector, linked within its label at cosine >= ``threshold``.

    Vectors that are null, zero or hold null or non-finite components, those without a label
    and those of another length than their partner link with nothing and stand alone. All links count; copies
    count by multiplicity. Rows with equal ids count as vectors of their own and share a
    component only if linked. A null id stays, with itself (null) as its component unless linked.
    """
    spark = vectors.sparkSession
    raw = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    raw = raw.withColumn("ok", F.expr(f"label IS NOT NULL AND {valid('v')}")).withColumn("dim", F.size("v"))
    rows = raw.withColumn("class", F.when(F.col("ok"), F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0.0)))))
    keyed = rows.select("vec_id", "class")
    classes = cut(
        rows.where("ok")
        .groupBy("class")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"), F.first("dim").alias("dim")),
        "classes",
    )
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    found = cut(_cells(spark, classes, groups, threshold), "cells")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others")).withColumnRenamed("a", "class")
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "class")
    per_class = cut(
        classes.select("class", "least", "copies").join(links, "class", "left").join(roots, "class", "left").select(
            "class", "least", F.coalesce("root", "class").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "classes",
    )
    named = cut(per_class.groupBy("root").agg(F.min("least").alias("component")), "named")
    per_class = cut(per_class.join(named, "root").select("class", "n_links", "component"), "classes")
    return keyed.join(per_class, "class", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )


def _cells(spark, classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Rows ``kind, a, b``: kind 0, a class and the vectors linked to it in one cell; kind 1, a link of a cell's forest."""
    total = classes.count()
    few = classes.select("label", "dim", "v").orderBy(F.xxhash64("class", F.lit(3))).limit(PIVOT_SAMPLE).collect()
    sample: dict[tuple, list] = {}
    for label, dim, v in few:
        sample.setdefault((label, dim), []).append(v)
    share, reach = total / max(1, len(few)), float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    pivots = {k: choose_pivots(unit(np.array(v, np.float64)), max(1, round(len(v) * share / CELL))) for k, v in sample.items()}
    names = {k: i for i, k in enumerate(sorted(pivots))}

    def home_of(x: np.ndarray, p: np.ndarray):
        d = np.maximum(0, 2 - 2 * x @ p.T)
        return d, d.argmin(axis=1)

    def each(t):
        """Rows by label and length; a group that the sample missed has the one cell -1."""
        group = np.fromiter((names.get(k, -1) for k in zip(t.column("label").to_pylist(), t.column("dim").to_pylist(), strict=True)), np.int64, t.num_rows)
        for g in np.unique(group):
            yield int(g), t.take(pa.array(np.flatnonzero(group == g)))

    def radii(batches):
        for b in batches:
            for g, t in each(b):
                if g >= 0:
                    p = by_number[g]
                    d, home = home_of(unit(as_matrix(t.column("v"))), p)
                    r = np.zeros(len(p))
                    np.maximum.at(r, home, d[np.arange(len(home)), home])
                    n = np.bincount(home, minlength=len(p))
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array(at), pa.array(np.sqrt(r[at])), pa.array(n[at])], ["g", "cell", "r", "n"])

    by_number = {names[k]: p for k, p in pivots.items()}
    body = classes.select("class", "copies", "label", "dim", "v")
    per_cell = body.mapInArrow(radii, "g long, cell long, r double, n long").groupBy("g", "cell").agg(F.max("r").alias("r"), F.sum("n").alias("n"))
    radius = {g: np.full(len(p), -np.inf) for g, p in by_number.items()}
    tiles = {g: np.ones(len(p), np.int64) for g, p in by_number.items()}
    for g, c, r, n in per_cell.collect():  # one row a pivot
        radius[g][c], tiles[g][c] = r, max(1, -(-n // TILE))

    def send(batches):
        for b in batches:
            for g, t in each(b):
                x, cls = unit(as_matrix(t.column("v"))) if g >= 0 else None, t.column("class").to_numpy()
                label, n = t.column("label"), t.num_rows
                if g < 0:
                    plan = [(np.arange(n), -1, 0, np.ones(n, bool))]
                else:
                    p = by_number[g]
                    d, home = home_of(x, p)
                    own = d[np.arange(n), home]
                    gap = np.sqrt(np.maximum(1e-300, 2 - 2 * p @ p.T))[home]
                    go = ((d - own[:, None]) <= 2 * gap * reach + SLACK) & (np.sqrt(d) <= radius[g] + reach)
                    go[np.arange(n), home] = True
                    plan = []
                    for c in range(len(p)):
                        rows = np.flatnonzero(go[:, c])
                        for k in range(int(tiles[g][c])) if len(rows) else ():
                            plan.append((rows, c, k, (home[rows] == c) & (cls[rows] % int(tiles[g][c]) == k)))
                for rows, c, k, mine in plan:
                    m = len(rows)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [label.take(at), t.column("dim").take(at), pa.array(np.full(m, c, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(cls[rows]), t.column("copies").take(at), t.column("v").take(at), pa.array(mine)],
                        ["label", "dim", "cell", "tile", "class", "copies", "v", "home"],
                    )

    def join(t):
        x, cls = unit(as_matrix(t.column("v"))), t.column("class").to_numpy()
        copies, p = t.column("copies").to_numpy(), np.flatnonzero(t.column("home").to_numpy())
        n, forest = np.zeros(len(x), np.int64), Forest(len(x))
        y = x[p]
        step = max(1, 2_000_000 // max(1, len(p)))
        for i in range(0, len(x), step):
            c = x[i : i + step] @ y.T
            a, b = np.nonzero(c >= threshold - SLACK)
            close = np.abs(c[a, b] - threshold) <= SLACK
            if close.any():  # decided by a plain sum of products
                at = np.flatnonzero(close)
                c[a[at], b[at]] = (x[i + a[at]] * y[b[at]]).sum(axis=1)
            hit = (c[a, b] >= threshold) & (cls[i + a] != cls[p[b]])
            a, b = i + a[hit], p[b[hit]]
            np.add.at(n, a, copies[b])
            forest.link(a, b)
        some, far = np.flatnonzero(n), np.flatnonzero(forest.root != np.arange(len(x)))
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(far)])
        return pa.table({"kind": kind, "a": np.concatenate([cls[some], cls[far]]), "b": np.concatenate([n[some], cls[forest.root[far]]])})

    sent = body.mapInArrow(send, "label string, dim int, cell int, tile int, class long, copies long, v array<double>, home boolean")
    return sent.groupBy("label", "dim", "cell", "tile").applyInArrow(join, "kind int, a long, b long")
