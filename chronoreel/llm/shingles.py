"""Near-duplicates by SimHash and exact shingle similarity: every link of a Jaccard similarity or more counts.

SimHash trees come first: fingerprints within a few bits, linked as a forest, and each link
checked on the whole sets. That gathers large groups of near copies by few links. As no
radius holds every pair (README), a join by shared shingles finds the rest, first of each
set with the least of those that share a shingle, then of sets that are still apart.

A shared order of shingles, frequent ones last, makes candidates complete: two sets of the
wanted similarity share a shingle within the first part of each (all but what the overlap
needs, plus one). Frequent shingles are told from a sample; they change the order, which may
be any, and so the work but never the result. The sample grows with the table, so a shingle
counts as frequent from the same number of texts on, and candidates grow as the table does.
The most frequent are ordered by how many texts have them, the others are bits of a filter.

Candidates go by sketches first: a set's shingles, hashed to a few times as many bits, each bit the
parity of how many fell on it. Two sketches differ in no more bits than their sets in shingles,
so a pair whose sketches differ too much is no link, and whole sets move for few pairs alone.

Sets of one group need no comparison, and a group of near copies may leave many sets alone at
first. So sets that are apart aren't paired at once: sketches go to their shingles, and each
set takes the nearest one of another group, until that links nothing; pairs that are left are
those of different groups whose sketches are near. A set is paired once a round, whatever a group's size.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import as_bytes, collect_garbage, components, cut, drop, hash_words, mix64, release, split_words
from chronoreel.llm.simhash import fingerprint, hamming_links

#: Texts and part of all texts that frequent shingles are told from, whichever are more; in how many of them one is frequent, how many are told apart, and bits for the others.
SAMPLE, PART, OFTEN, MOST, BITS = 10_000, 0.2, 3, 50_000, 1 << 24
#: Bits of a sketch in multiples of the least ones; rounds in which each set takes its nearest before all pairs left are checked.
FINE, ROUNDS = 4, 4
#: Bytes of text worked on at once, and prefix entries wanted in a bucket.
PIECE, BUCKET = 2_000_000, 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
PLACED = ["root", "bucket", "shingle", "node", "n", "pos"]


def shingle_sets(texts: list[bytes], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one text after another, and how many each has.

    A text of fewer words than ``shingle`` has one shingle of all its words, one without words none.
    """
    buf, start, end, n = split_words(texts, lower=True)
    words = hash_words(buf, start, end)
    many = np.where(n > 0, np.maximum(n - shingle, 0) + 1, 0)
    first, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), many)
    at = first[doc] + np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
    size = np.minimum(n, shingle)[doc]
    h = size.astype(np.uint64)
    for j in range(shingle):
        live = np.flatnonzero(j < size)
        h[live] = mix64(h[live] * _ODD + words[at[live] + j])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return h[new], np.bincount(doc[new], minlength=len(n))


def set_names(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 of an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h, 9), dtype=np.uint64)))
    stop = np.cumsum(n)
    return np.where(n > 0, mix64(total[stop] - total[stop - n] + n.astype(np.uint64), 10), np.uint64(0)).view(np.int64)


def sketches(h: np.ndarray, n: np.ndarray, fine: int = 1) -> list[bytes]:
    """Parities of each set's shingles by their low bits, in as many bits as the set has shingles or up to twice that, 256 at least; ``fine`` times as many, a power of two."""
    bits = np.int64(fine) << np.ceil(np.log2(np.maximum(n, 256))).astype(np.int64)
    stop = np.cumsum(bits)
    at = np.repeat(stop - bits, n) + (h & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[(e - m) // 8 : e // 8] for e, m in zip(stop.tolist(), bits.tolist(), strict=True)]


def sketch_distances(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits each pair of sketches differs, the longer one folded: never more than their sets differ in shingles."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(sizes), np.int64)
    for pair in np.unique(sizes, axis=0):
        rows, least = np.flatnonzero((sizes == pair).all(axis=1)), int(pair.min())
        a, b = (np.bitwise_xor.reduce(np.frombuffer(b"".join([z[i] for i in rows]), np.uint64).reshape(len(rows), -1, least // 8), axis=1) for z in (x, y))
        out[rows] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


class Folded:
    """Sketches side by side, in their own size and folded to each smaller one."""

    def __init__(self, made: list[bytes]):
        self.size = np.fromiter(map(len, made), np.int64, len(made))
        self.of = {}
        for k in np.unique(self.size).tolist():
            place, parts, upto = np.zeros(len(made), np.int64), [], 0
            for larger in np.unique(self.size[self.size >= k]).tolist():
                rows = np.flatnonzero(self.size == larger)
                own = np.frombuffer(b"".join([made[i] for i in rows]), np.uint64).reshape(len(rows), -1, k // 8)
                parts.append(np.bitwise_xor.reduce(own, axis=1))
                place[rows] = upto + np.arange(len(rows))
                upto += len(rows)
            self.of[k] = np.concatenate(parts), place

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the sketches numbered ``a`` and ``b`` differ, the longer one folded."""
        least, out = np.minimum(self.size[a], self.size[b]), np.zeros(len(a), np.int64)
        for k in np.unique(least).tolist():
            bits, place = self.of[k]
            rows, step = np.flatnonzero(least == k), max(1, PIECE * 8 // k)
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                out[r] = np.bitwise_count(bits[place[a[r]]] ^ bits[place[b[r]]]).sum(axis=1, dtype=np.int64)
        return out


def _pieces(column: pa.Array):
    """(from, to, texts) of a batch, a bounded part of the text at a time."""
    texts, i, held = as_bytes(column), 0, 0
    for j, t in enumerate(texts):
        held += len(t) + 1
        if held >= PIECE or j + 1 == len(texts):
            yield i, j + 1, texts[i : j + 1]
            i, held = j + 1, 0


def _binaries(a: np.ndarray, n: np.ndarray) -> pa.Array:
    raw, stop = a.tobytes(), np.cumsum(n) * 8
    return pa.array([raw[e - 8 * m : e] for e, m in zip(stop.tolist(), n.tolist(), strict=True)], pa.binary())


def name_rows(docs: DataFrame, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``node``, the name of their text's set of shingles. Null text counts as empty."""
    names = [f.name for f in docs.schema.fields]
    at = names.index(text_col)

    def run(batches):
        release()
        for b in batches:
            node = [set_names(*shingle_sets(t, shingle)) for _, _, t in _pieces(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(node) if node else np.zeros(0, np.int64))], [*names, "node"])

    return docs.mapInArrow(run, docs.selectExpr("*", "cast(0 as long) AS node").schema)


def links(docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5), radius: int = 4, text_col: str = "text") -> DataFrame:
    """``a, b``: links between names of sets among the texts, each of a Jaccard similarity of ``similarity`` or more.

    Any two sets of that similarity are joined by links, directly or by way of others; links within a group are left out.
    """
    spark = docs.sparkSession
    p, q = similarity.numerator, similarity.denominator
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    n_texts = texts.count()

    def whole(batches):
        release()
        for b in batches:
            for i, j, t in _pieces(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _binaries(*shingle_sets(t, shingle))], ["node", "shingles"])

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are similar: by sketches first, then on the whole sets."""
        sketched = nodes.select("node", "n", "sketch")
        both = pairs.join(sketched.toDF("a", "n_a", "of_a"), "a").join(sketched.toDF("b", "n_b", "of_b"), "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")
        pairs = cut(both.mapInArrow(likely, "a long, b long"), "likely")
        del both
        sets = whole_sets(pairs)
        out = similar(pairs, sets)
        drop(sets)
        drop(pairs)
        collect_garbage(spark)
        return out

    def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b").select("a", "b", "of_a", "of_b")
        return cut(both.mapInArrow(check, "a long, b long"), "similar")

    def whole_sets(pairs: DataFrame) -> DataFrame:
        """``node, shingles`` of each set in the pairs, made again from one text each."""
        wanted = cut(pairs.selectExpr("a AS node").union(pairs.selectExpr("b")).distinct(), "wanted")
        collect_garbage(spark)
        # which names are wanted, some more with them by chance: most texts needn't move
        bits = 1 << max(6, (16 * wanted.count()).bit_length())
        found = wanted.selectExpr(f"shiftright(node & {bits - 1}L, 6) AS at", "shiftleft(1L, cast(node & 63 AS int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits"))
        filled = np.zeros(bits // 64, np.uint64)
        for r in found.collect():
            filled[r["at"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)

        def some(batches):
            release()
            for b in batches:
                for i, j, t in _pieces(b.column(0)):
                    node = set_names(*shingle_sets(t, shingle))
                    at = (node & np.int64(bits - 1)).astype(np.uint64)
                    live = (filled[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(node)], ["text", "node"]).filter(pa.array(live))

        one = texts.mapInArrow(some, "text string, node long").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        sets = cut(one.mapInArrow(whole, "node long, shingles binary"), "sets")
        drop(wanted)
        del one, found
        collect_garbage(spark)
        return sets

    def likely(batches):
        for b in batches:
            n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            near = sketch_distances(b.column("of_a").to_pylist(), b.column("of_b").to_pylist()) * (p + q) <= (q - p) * n
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(near))

    def check(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("of_a"), b.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared * q >= p * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def list_shingles(batches):
        release()
        for b in batches:
            for _, _, t in _pieces(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(t, shingle)[0].view(np.int64))], ["shingle"])

    share = min(1.0, max(SAMPLE / max(1, n_texts), PART)) if SAMPLE else 0.0
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()
    seen = cut(some.mapInArrow(list_shingles, "shingle long").groupBy("shingle").count().where(F.col("count") >= OFTEN), "seen")
    often = seen.orderBy(F.desc("count"), "shingle").limit(MOST).toArrow()
    hot, rank = often.column("shingle").to_numpy().view(np.uint64), often.column("count").to_numpy().astype(np.int64)
    order = np.argsort(hot)
    hot, rank = hot[order], rank[order]
    n_seen = seen.count()
    others = 1 << min(BITS.bit_length() - 1, max(6, (8 * n_seen).bit_length()))
    filter_of = np.zeros(others // 64, np.uint64)
    if n_seen > MOST:
        words = seen.selectExpr(f"shiftright(shingle & {others - 1}L, 6) AS at", "shiftleft(1L, cast(shingle & 63 AS int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        filter_of[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    drop(seen)

    def prefixes(batches):
        release()
        for b in batches:
            for _, _, t in _pieces(b.column(0)):
                h, n = shingle_sets(t, shingle)
                fp = np.fromiter((fingerprint(x, shingle) for x in t), np.uint64, len(t))
                doc = np.repeat(np.arange(len(n)), n)
                low = h & np.uint64(others - 1)
                late = ((filter_of[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)).astype(np.int64)
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    late = np.where(hot[i] == h, rank[i], late)
                order = np.lexsort((h, late, doc))
                pos = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
                keep = np.where(n > 0, n - -(-n * p // q) + 1, 0)
                first = order[pos < keep[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(h, n)), pa.array(fp.view(np.int64)), pa.array(n.astype(np.int32)), _binaries(h[first], keep), pa.array(sketches(h, n, FINE), pa.binary())], ["node", "fp", "n", "prefix", "sketch"])

    # texts with one set may differ in a repeat, and so in their fingerprint: the least stands for the set
    own = texts.mapInArrow(prefixes, "node long, fp long, n int, prefix binary, sketch binary").where("n > 0")
    nodes = cut(own.groupBy("node").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "prefixes")

    del own, some, seen, often
    collect_garbage(spark)

    # by SimHash: a forest of links between fingerprints, and of each fingerprint's sets to the least of them
    of_fp = nodes.groupBy("fp").agg(F.min("node").alias("a"))
    trees = hamming_links(cut(of_fp.select("fp"), "fingerprints"), radius)
    near = trees.join(of_fp.toDF("a", "x"), "a").join(of_fp.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.select("node", "fp").join(of_fp, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    found = checked(cut(near.union(same).distinct(), "pairs"))

    entries = nodes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // 8 // BUCKET)

    def spread(batches):
        for b in batches:
            n = np.array([len(x) // 8 for x in b.column("prefix").to_pylist()], np.int64)
            h = np.frombuffer(b"".join(b.column("prefix").to_pylist()), np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(h)) - (np.cumsum(n) - n)[row]
            for i in range(0, len(h), 500_000):
                s = slice(i, i + 500_000)
                take = pa.array(row[s])
                columns = [b.column("root").take(take), pa.array((mix64(h[s], 11) % np.uint64(buckets)).astype(np.int32)), pa.array(h[s].view(np.int64)), b.column("node").take(take), b.column("n").take(take), pa.array(pos[s].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, PLACED)

    def sorted_entries(t):
        s, root, n, node, pos = (t.column(c).to_numpy() for c in ("shingle", "root", "n", "node", "pos"))
        order = np.lexsort((node, n, s))
        return order, s[order], root[order], n[order].astype(np.int64), node[order], pos[order].astype(np.int64)

    def fits(n, pos, a, b):
        """Whether two entries of one shingle may belong to sets similar enough, by their sizes and what is left of them."""
        reach = np.minimum(n[a] - pos[a], n[b] - pos[b])
        return (np.minimum(n[a], n[b]) * q >= np.maximum(n[a], n[b]) * p) & (reach * (p + q) >= p * (n[a] + n[b]))

    def unique(parts):
        found = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *parts]), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    def some_fit(key, t):
        """Entries of shingles that several groups have, if the smallest set there that is large enough leaves them a chance."""
        order, s, root, n, _, pos = sorted_entries(t)
        if not len(s):
            return t.select(PLACED)
        new = np.concatenate(([True], s[1:] != s[:-1]))
        begin, of = np.flatnonzero(new), np.cumsum(new) - 1
        several = np.minimum.reduceat(root, begin) < np.maximum.reduceat(root, begin)
        every, wide = np.arange(len(s)), int(n.max()) + 1
        other = np.searchsorted(of * wide + n, of * wide + -(-n * p // q))
        other = np.minimum(other + (other == every), len(s) - 1)
        live = several[of] & (other != every) & (s[other] == s) & (np.minimum(n, n[other]) * q >= np.maximum(n, n[other]) * p) & ((n - pos) * (p + q) >= p * (n + n[other]))
        return t.select(PLACED).take(pa.array(order[live]))

    def stars(key, t):
        """Each set with the one before it in size and with the middle one among those of its shingle: no more pairs than twice the entries."""
        _, s, root, n, node, pos = sorted_entries(t)
        new = np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(s))
        every = np.arange(len(s))
        out = []
        for hub in (np.repeat(begin + size // 2, size), np.where(new, every, every - 1)):
            some = np.flatnonzero((root != root[hub]) & fits(n, pos, every, hub))
            x, y = node[some], node[hub[some]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        return unique(out)

    def apart(s, root, n, pos):
        """Pairs of entries of a shingle that fit and are in different groups. All but the sets of a shingle's largest group go along its sets, up and down."""
        if not len(s):
            return
        order = np.lexsort((root, s))
        new = np.concatenate(([True], (s[order[1:]] != s[order[:-1]]) | (root[order[1:]] != root[order[:-1]])))
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(begin, append=len(s))
        by = np.lexsort((size, s[order[begin]]))
        last = np.concatenate((s[order[begin[by[1:]]]] != s[order[begin[by[:-1]]]], [True]))
        other = np.ones(len(s), bool)
        other[order[np.isin(group, by[last])]] = False
        for way in (1, -1):
            live, d = np.flatnonzero(other), way
            while len(live):
                live = live[(live + d >= 0) & (live + d < len(s))]
                # sets are in order of size, so a pair too uneven ends its row
                live = live[(s[live] == s[live + d]) & (np.minimum(n[live], n[live + d]) * q >= np.maximum(n[live], n[live + d]) * p)]
                a = live[(root[live] != root[live + d]) & ((way > 0) | ~other[live + d])]
                a = a[fits(n, pos, a, a + d)]
                if len(a):
                    yield a, a + d
                d += way

    def still_apart(key, t):
        """Entries that are in a pair of ``apart``."""
        order, s, root, n, _, pos = sorted_entries(t)
        live = np.zeros(len(s), bool)
        for a, b in apart(s, root, n, pos):
            live[a] = live[b] = True
        return t.select(PLACED).take(pa.array(order[live]))

    def near_pairs(t, use):
        """Gives ``use`` the pairs of ``apart`` whose sketches are near, by numbers of sets, and how near; a number's name is returned."""
        order, s, root, n, node, pos = sorted_entries(t)
        names, first, number = np.unique(node, return_index=True, return_inverse=True)
        made = Folded(t.column("sketch").take(pa.array(order[first])).to_pylist())
        held, many = [], 0

        def flush():
            pairs = np.unique(np.concatenate(held))
            x, y = pairs // len(names), pairs % len(names)
            d = made.distances(x, y)
            near = d * (p + q) <= (q - p) * (n[first[x]] + n[first[y]])
            use(x[near], y[near], d[near])

        for a, b in apart(s, root, n, pos):
            a, b = number[a], number[b]
            held.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
            many += len(a)
            if many > 1_000_000:
                flush()
                held, many = [], 0
        if held:
            flush()
        return names

    def nearest(key, t):
        """Each set with the one of another group whose sketch is nearest, if near enough: no more pairs than sets."""
        best = {}

        def use(x, y, d):
            x, y, d = np.concatenate([best.get("x", x[:0]), x, y]), np.concatenate([best.get("y", x[:0]), y, x]), np.concatenate([best.get("d", d[:0]), d, d])
            order = np.lexsort((y, d, x))
            first = order[np.concatenate((np.ones(min(1, len(x)), bool), x[order[1:]] != x[order[:-1]]))]
            best.update(x=x[first], y=y[first], d=d[first])

        names = near_pairs(t, use)
        if not best:
            return unique([])
        x, y = names[best["x"]], names[best["y"]]
        return unique([np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)])

    def rest(key, t):
        """All sets of a shingle that are in different groups and whose sketches are near."""
        out = []
        names = near_pairs(t, lambda x, y, d: out.append(np.stack([x, y], axis=1)))
        return unique([names[x] for x in out])

    def placed(entries: DataFrame) -> DataFrame:
        """The rows with the groups that all links so far make."""
        roots = components(found).withColumnRenamed("root", "of")
        return entries.join(roots, "node", "left").withColumn("root", F.coalesce("of", "node")).drop("of")

    def pairs_of(entries: DataFrame, pair) -> DataFrame:
        return cut(entries.groupBy("bucket").applyInArrow(pair, "a long, b long").distinct(), "pairs")

    schema = "root long, bucket int, shingle long, node long, n int, pos int"
    spreads = placed(nodes.select("node", "n", "prefix")).mapInArrow(spread, schema)
    entries = cut(spreads.groupBy("bucket").applyInArrow(some_fit, schema), "entries")
    del spreads
    collect_garbage(spark)
    pairs = pairs_of(entries, stars)
    found = cut(found.union(checked(pairs)), "links")
    drop(pairs)

    left = cut(placed(entries.drop("root")).groupBy("bucket").applyInArrow(still_apart, schema), "left")
    drop(entries)
    sketched = left.join(nodes.select("node", "sketch"), "node")
    pairs, sets, turn = pairs_of(sketched, nearest), None, 1
    while not pairs.isEmpty():
        if sets is None:  # every set with a near one is in a pair of the first round, so later ones need no others
            sets = whole_sets(pairs)
            sketched = cut(sketched.drop("root").join(sets.select("node"), "node", "left_semi"), "sketched")
        good = similar(pairs, sets)
        found = cut(found.union(good), "links")
        drop(pairs)
        if turn > ROUNDS:
            break
        turn = turn + 1 if turn < ROUNDS and not good.isEmpty() else ROUNDS + 1
        pairs = pairs_of(placed(sketched), nearest if turn <= ROUNDS else rest)
    for x in (pairs, sets, sketched, left):
        drop(x)
    drop(nodes)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``component``, a name that rows share whose texts are similar, directly or by way of others.

    Texts are sets of shingles of words, A-Z in lower case. Texts without words are alike. Null text is empty text.
    """
    roots = components(links(docs, shingle, similarity, text_col=text_col)).withColumnRenamed("root", "component")
    rows = name_rows(docs, shingle, text_col).join(roots, "node", "left")
    return rows.withColumn("component", F.coalesce("component", "node")).drop("node")


def least_rows(docs: DataFrame, id_col: str = "doc_id", shingle: int = 5, similarity: Fraction = Fraction(4, 5), text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, the one with the least id, a null id last; ties go to the least row.

    Rows meet by their set of shingles first; only what is left of sets that have links moves again.
    """
    names = docs.columns
    least = F.min(F.struct(F.col(id_col).isNull().alias("nameless"), id_col, *[c for c in names if c != id_col])).alias("r")
    roots = components(links(docs, shingle, similarity, text_col=text_col))
    sets = name_rows(docs, shingle, text_col).groupBy("node").agg(least)
    rooted = cut(sets.join(roots, "node", "left").select("root", "r"), "rooted")
    linked = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("r").alias("r"))
    return rooted.where("root IS NULL").select("r").union(linked.select("r")).select(*[f"r.{c}" for c in names])
