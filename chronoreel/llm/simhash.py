"""SimHash near-duplicates: exact pairs within a few bits, found by vantage-point trees.

A full 64-bit tree prunes badly at a radius of 4: fingerprints of unrelated texts all lie
near 32 bits from any vantage point, with a spread of 4. So the bits are cut into three
blocks. Two fingerprints within 4 bits are within 1 bit in some block, and a tree over
block distances with radius 1 has little on its boundaries. Each block's tree is grown on
a bounded sample and only says where a fingerprint goes; each shard then grows its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import Forest, as_bytes, components, cut

#: Fingerprints taken to grow the routing trees; they place rows and never decide a link.
ROUTING_SAMPLE = 40_000
#: Fingerprints wanted in a shard, and points of one tile of a shard that no tree can split.
SHARD = 4_000
TILE = 20_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    k = min(shingle, len(words))
    digest, spans = xxhash.xxh64_intdigest, zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(line[s:e], 42) for s, e in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: each text's fingerprint as a signed 64-bit integer. Null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in as_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def blocks_of(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(mask, radius in it): any two values within ``radius`` are that near in one of the blocks at least."""
    n = max(1, -(-(radius + 1) // 2))
    ends = [bits * i // n for i in range(n + 1)]
    return [(((1 << b) - (1 << a)), radius // n) for a, b in zip(ends, ends[1:], strict=False)]


class Node:
    """A vantage point: nearer than ``mu`` in the masked bits is inside. Leaves have a number and a count of tiles."""

    __slots__ = ("v", "mu", "inner", "outer", "leaf", "tiles")

    def __init__(self):
        self.v = self.mu = self.inner = self.outer = self.leaf = None
        self.tiles = 1


def split(points: np.ndarray, mask: np.uint64, tries: int = 4):
    """The vantage point and distance that cut ``points`` most evenly, or None where all look alike."""
    best = None
    for i in range(tries):
        v = points[(i * 7919 + len(points) // 2) % len(points)]
        d = np.bitwise_count((points ^ v) & mask)
        at = np.bincount(d, minlength=65)
        below = np.cumsum(at) - at
        mu = int(np.argmin(np.abs(below * 2 - len(points))))
        uneven = abs(int(below[mu]) * 2 - len(points))
        if 0 < below[mu] < len(points) and (best is None or uneven < best[0]):
            best = (uneven, v, mu, d)
    return best


def grow(sample: np.ndarray, mask: int, size: int, share: float) -> tuple[Node, int]:
    """A tree whose leaves stand for about ``size`` fingerprints each; ``share`` of them per sampled one."""
    mask, leaves = np.uint64(mask), 0
    top, todo = Node(), []
    todo.append((top, sample))
    while todo:
        node, own = todo.pop()
        found = split(own, mask) if len(own) * share > size and len(own) >= 16 else None
        if found is None:
            node.leaf, leaves = leaves, leaves + 1
            node.tiles = max(1, round(len(own) * share / TILE))
            continue
        _, node.v, node.mu, d = found
        node.inner, node.outer = Node(), Node()
        todo += [(node.inner, own[d < node.mu]), (node.outer, own[d >= node.mu])]
    return top, leaves


def route(top: Node, fps: np.ndarray, mask: int, radius: int):
    """(row, leaf, tile, home): every shard that may hold a partner, by the triangle inequality."""
    mask, todo = np.uint64(mask), [(top, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node.leaf is not None:
            own = (fps[rows] % np.uint64(node.tiles)).astype(np.int64)
            for tile in range(node.tiles):
                yield rows, node.leaf, tile, home & (own == tile)
            continue
        d = np.bitwise_count((fps[rows] ^ node.v) & mask).astype(np.int64)
        i, o = d < node.mu + radius, d + radius >= node.mu
        todo += [(node.inner, rows[i], home[i] & (d[i] < node.mu)), (node.outer, rows[o], home[o] & (d[o] >= node.mu))]


def near(points: np.ndarray, queries: np.ndarray, mask: int, block_radius: int, radius: int):
    """Index pairs (query, point) within ``radius`` bits, for all that are within ``block_radius`` in the masked bits."""
    mask, todo = np.uint64(mask), [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        found = split(points[p], mask, 2) if len(p) > 64 and len(p) * len(q) > 65_536 else None
        if found is None:
            step = max(1, 2_000_000 // len(p))
            for i in range(0, len(q), step):
                hit = np.bitwise_count(queries[q[i : i + step], None] ^ points[p][None, :]) <= radius
                a, b = np.nonzero(hit)
                yield q[i + a], p[b]
            continue
        _, v, mu, d = found
        e = np.bitwise_count((queries[q] ^ v) & mask).astype(np.int64)
        todo += [(p[d < mu], q[e < mu + block_radius]), (p[d >= mu], q[e + block_radius >= mu])]


def hamming_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` that join exactly the distinct values of ``fps(fp)`` within ``radius`` bits of each other, directly or by way of others.

    Every link between different values is found; a shard returns a spanning forest of its
    links instead of all pairs of a dense group.
    """
    spark = fps.sparkSession
    n = fps.count()
    few = [r[0] for r in fps.orderBy(F.xxhash64("fp", F.lit(1))).limit(ROUTING_SAMPLE).collect()]
    sample = np.array(few, np.int64).view(np.uint64)
    blocks = blocks_of(radius)
    trees = [grow(sample, m, SHARD, n / max(1, len(sample)))[0] for m, _ in blocks] if n else []

    def send(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (tree, (mask, r)) in enumerate(zip(trees, blocks, strict=True)):
                for rows, leaf, tile, home in route(tree, fp, mask, r):
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, k, np.int32)), pa.array(np.full(m, leaf, np.int32)), pa.array(np.full(m, tile, np.int32)), pa.array(fp[rows].view(np.int64)), pa.array(home)],
                        ["block", "leaf", "tile", "fp", "home"],
                    )

    def search(key, t):
        mask, r = blocks[key[0].as_py()]
        fp, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy()
        points = np.flatnonzero(home)
        forest = Forest(len(fp))
        for q, p in near(fp[points], fp, mask, r, radius):
            forest.link(q, points[p])
        far = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pa.table({"a": fp[far].view(np.int64), "b": fp[forest.root[far]].view(np.int64)})

    if not trees:
        return spark.createDataFrame([], "a long, b long")
    sent = fps.select("fp").mapInArrow(send, "block int, leaf int, tile int, fp long, home boolean")
    return sent.groupBy("block", "leaf", "tile").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable by links of at most ``radius`` differing bits, itself included.

    Equal fingerprints are one node, so copies cost nothing beyond their row. Null text is
    empty text (fingerprint 0); rows with a null id are fingerprinted and get their group's
    id, but never name a group. Repeated ids keep a row each. An empty table gives an empty table.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(hamming_links(nodes, radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    labels = cut(rooted.join(named, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")
