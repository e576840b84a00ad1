"""Scoring texts under an n-gram model held in Elias-Fano tries.

Documents are written in chunks, so all passes see the same. A Spark round gives every distinct
word a global name and its count. Counts are combined by chunk before they travel, as packed
arrays. Trigrams, the word after an end being a pad, go to shards by their first word; one with
a large part of all tokens is spread over all shards by the second. So a shard has all trigrams
of its bigrams, whose counts are sums of theirs. It builds one trie: contexts, below each its
successors, and below each of these its own, as numbers relative to the level above, in one
monotone sequence a level that a search answers by the next value not below. What a chunk asked
for comes back in the order asked, a few codes for each trigram. A shard's trie is mapped from a
file without a name in its worker's own temporary folder; a task run again builds it again.

P(w|u) = c(u,w) / (c(u) + M)  +  M / (c(u) + M) * P(w),  P(w) = (c(w) + .5) / (N + .5 (V + 1)).
P(w|t,u) = c(t,u,w) / (c(t,u) + M)  +  M / (c(t,u) + M) * P(w|u); a first word has P(w|u) alone.
The first terms are what the trie holds, quantised, and the weight before P(w|u).
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm import names
from chronoreel.llm.common import collect_garbage, cut, drop, mix64
from chronoreel.llm.names import ANSWER, ASK, squeeze, unsqueeze

#: N-grams wanted in a shard.
SHARD_NGRAMS = 1_500_000
#: Weight of the lower order in tokens, and the share of all tokens from which a context is spread.
PRIOR, HOT_SHARE = 30.0, 1 / 2_000
#: The context of a first word, and what follows an end; names of words are larger. An end is the empty word.
BEGIN, PAD = np.uint64(1), np.uint64(2)
#: Searches done at once: their arrays stay in a core's cache.
BLOCK = 16_384
#: Steps of log10 that a quantised probability is told in; code 0 is none.
STEP = 8 / 254


# --- Elias-Fano ------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence: low bits side by side, high bits in unary with a rank directory. Arrays may be memory-mapped."""

    FIELDS = ("low", "high", "ones")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.last = int(self.get(np.array([n - 1]))[0] >> np.uint64(bits)) if n else 0
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((((int(place[-1]) if n else 0) + 2) // 64 + 1) * 64, np.uint8)
        unary[place] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high)))).astype(np.uint32)
        return cls(n, bits, low, high, ones)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        spill = (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (value | spill) & np.uint64((1 << self.bits) - 1)

    def _in_word(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one (from 0) of each word, by halving."""
        at, k = np.zeros(len(word), np.uint64), k.astype(np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count((word >> at) & np.uint64((1 << half) - 1)).astype(np.int64)
            go = k >= below
            k -= np.where(go, below, 0)
            at += np.where(go, half, 0).astype(np.uint64)
        return at.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.uint64)
        for a in range(0, len(i), BLOCK):
            out[a : a + BLOCK] = self._get(i[a : a + BLOCK])
        return out

    def _get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + self._in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._lows(i)

    def before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``bucket``: the ones before its zero, found by a search for the zero."""
        word = np.minimum(np.searchsorted(self.zeros, bucket - 1, side="right") - 1, len(self.high) - 1)
        place = word * 64 + self._in_word(~self.high[word], bucket - 1 - self.zeros[word])
        return np.where(bucket <= 0, 0, np.minimum(place - (bucket - 1), self.n))

    def _ones_from(self, place: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from each place of the high bits."""
        out, live = np.zeros(len(place), np.int64), np.arange(len(place))
        at = place.copy()
        while len(live):
            word, off = at >> 6, at & 63
            x = ~(self.high[np.minimum(word, len(self.high) - 1)] >> off.astype(np.uint64))
            run = np.minimum(np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64), 64 - off)
            out[live] += run
            on = (run == 64 - off) & (word + 1 < len(self.high))
            live, at = live[on], (at + run)[on]
        return out

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x, ``n`` if none, and whether it is x."""
        x = np.asarray(x, np.uint64)
        at, same = np.empty(len(x), np.int64), np.empty(len(x), bool)
        for a in range(0, len(x), BLOCK):
            at[a : a + BLOCK], same[a : a + BLOCK] = self._search_block(x[a : a + BLOCK])
        return at, same

    def _search_block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of equal high bits, then halving by low bits."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        bucket = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = bucket <= self.last
        bucket = np.where(inside, bucket, self.last)
        lo = self.before(bucket)
        end = lo + self._ones_from(lo + bucket)
        want = x & np.uint64((1 << self.bits) - 1)
        lo, hi = np.where(inside, lo, self.n), np.where(inside, end, self.n)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        same = inside & (lo < end)
        some = np.flatnonzero(same)
        same[some] = self._lows(lo[some]) == want[some]
        return lo, same

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x, ``n`` if none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1."""
        i, same = self._search(x)
        return np.where(same, i, -1)


def quantise(p: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 254)).astype(np.uint8)


#: What a code stands for.
LEVELS = np.concatenate(([0.0], 10.0 ** (-STEP * np.arange(255))))


class Trie:
    """Contexts, pointers to their successors, the successors, and a quantised probability each; and the same once more below each successor."""

    PARTS = ("contexts", "words", "pointers", "successors", "words3", "pointers3", "successors3")
    CODES = ("codes", "weights", "codes3")

    def __init__(self, parts: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.parts, self.codes = parts, codes

    @staticmethod
    def _level(first: np.ndarray, word: np.ndarray) -> tuple[EliasFano, EliasFano, EliasFano]:
        """Distinct words, pointers to each parent's first entry, and the entries relative to their parents."""
        words, number = np.unique(word, return_inverse=True)
        parent = np.repeat(np.arange(len(first)), np.diff(first, append=len(word)))
        line = parent.astype(np.uint64) * np.uint64(max(1, len(words))) + number.astype(np.uint64)
        return EliasFano.of(words), EliasFano.of(np.append(first, len(word))), EliasFano.of(line)

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, p: np.ndarray, weight: np.ndarray | None = None, third: tuple | None = None) -> Trie:
        """From distinct pairs in order of (context, word), both 64-bit hashes.

        ``weight`` is each pair's of the lower order, ``third`` the next level: each pair's first
        entry, and the entries' words, in order below their pair, and probabilities.
        """
        contexts, first = np.unique(context, return_index=True)
        none = np.zeros(0, np.uint64)
        start, word3, p3 = third or (np.zeros(len(context), np.int64), none, none)
        parts = (EliasFano.of(contexts), *cls._level(first, word), *cls._level(start, word3))
        return cls(dict(zip(cls.PARTS, parts, strict=True)), {"codes": quantise(p), "weights": quantise(np.ones(len(p)) if weight is None else weight), "codes3": quantise(p3)})

    def _below(self, parent: np.ndarray, times: np.ndarray, word: np.ndarray, level: str) -> np.ndarray:
        """Place of each word below its parent's place, -1 where either is missing: found relative to it, within its pointers.

        ``times`` is how many of the words ask below each parent, in order.
        """
        words, pointers, successors = (self.parts[x + level] for x in ("words", "pointers", "successors"))
        safe = np.maximum(parent, 0)
        lo, hi = (np.repeat(pointers.get(at).astype(np.int64), times) if pointers.n > 1 else np.zeros(len(word), np.int64) for at in (safe, safe + 1))
        parent = np.repeat(parent, times)
        out = np.full(len(word), -1)
        some = np.flatnonzero((parent >= 0) & (lo < hi))
        asked, number = np.unique(word[some], return_inverse=True)
        w = words.find(asked)[number]
        some, w = some[w >= 0], w[w >= 0]
        at = successors.find(parent[some].astype(np.uint64) * np.uint64(max(1, words.n)) + w.astype(np.uint64))
        good = (at >= lo[some]) & (at < hi[some])
        out[some[good]] = at[good]
        return out

    def find(self, context: np.ndarray, word: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """Place of each pair, -1 if the trie has none; ``times`` words ask below each context, one if it is left out."""
        return self._below(self.parts["contexts"].find(context), np.ones(len(context), np.int64) if times is None else times, word, "")

    def find3(self, pair: np.ndarray, times: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each word below the pairs at these places, ``times`` below each, -1 if the trie has none."""
        return self._below(pair, times, word, "3")

    def code(self, kind: str, at: np.ndarray, other: int = 0) -> np.ndarray:
        codes = self.codes[kind]
        return np.where(at >= 0, codes[np.maximum(at, 0)], other).astype(np.uint8) if len(codes) else np.full(len(at), other, np.uint8)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 if the trie has none."""
        return self.code("codes", self.find(context, word))

    def save(self, f) -> list:
        """All levels one after another into an open file; what to read where."""
        index = []
        for name in self.PARTS:
            ef = self.parts[name]
            for field in EliasFano.FIELDS:
                a = getattr(ef, field)
                f.write(b"\0" * (-f.tell() % 8))
                index.append((name, ef.n, ef.bits, field, a.dtype.str, len(a), f.tell()))
                f.write(a.tobytes())
        for name in self.CODES:
            index.append((name, 0, 0, "codes", "|u1", len(self.codes[name]), f.tell()))
            f.write(self.codes[name].tobytes())
        f.flush()
        return index

    @classmethod
    def load(cls, f, index: list) -> Trie:
        """Levels memory-mapped from an open file."""
        found: dict[str, dict] = {}
        for name, n, bits, field, kind, size, at in index:
            a = np.memmap(f, np.dtype(kind), "r", at, (size,)) if size else np.zeros(0, kind)
            found.setdefault(name, {"n": n, "bits": bits})[field] = np.asarray(a)
        codes = {name: found.pop(name)["codes"] for name in cls.CODES}
        return cls({k: EliasFano(**v) for k, v in found.items()}, codes)

    def mapped(self) -> Trie:
        """The same trie on a file that has no name and goes with its last reader."""
        with tempfile.TemporaryFile() as f:
            return self.load(f, self.save(f))


# --- what a chunk sends and gets -----------------------------------------------------------

TEXT, PLACED, NAMED = "chunk long, docs binary, at binary, words binary, n_words long", "chunk long, docs binary, at binary, places binary", "chunk long, docs binary, words binary"


class Trigrams:
    """Distinct trigrams of a chunk in order of their shards, and the place among them of the one that each token is the middle of."""

    def __init__(self, own: dict, shards: int, hot: np.ndarray):
        _, _, train, sizes = unsqueeze(own["docs"])
        at, name, count = unsqueeze(own["words"])
        self.sizes, self.at, self.count = sizes.astype(np.int64), at, count
        # words by the order of their names, a begin and a pad before them: trigrams come out in order
        rank, k = np.empty(len(name), np.int64), np.int64(len(name) + 1)
        by_name = np.argsort(name)
        rank[by_name] = np.arange(1, k)
        name, at = name[by_name], rank[at]
        stop = np.cumsum(self.sizes) - 1
        came = np.concatenate(([0], at[:-1]))
        came[stop[:-1] + 1] = 0
        then = np.append(at[1:], 0)
        then[stop] = 0
        pair, of_pair = np.unique(came * k + at, return_inverse=True)
        triple, of_triple = np.unique(of_pair * k + then, return_inverse=True)
        of, x = np.divmod(triple, k)
        u, w = np.divmod(pair[of], k)
        context, middle, after = np.append(BEGIN, name)[u], name[w - 1], np.append(PAD, name)[x]
        key = mix64(context, 3)
        spread = np.isin(context, hot)
        key[spread] = mix64(context[spread] ^ mix64(middle[spread], 4), 3)
        shard = (key % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.place = self.place[of_triple]
        self.shard, self.context, self.middle, self.after = shard[order], context[order], middle[order], after[order]
        self.n = np.bincount(of_triple, np.repeat(train, self.sizes), len(triple)).astype("<u4")[order]

    def ask(self, chunk: int) -> pa.RecordBatch:
        spans, rows = names.slices(self.shard), []
        for a, b in spans:
            context, middle = self.context[a:b], self.middle[a:b]
            fresh = np.ones(b - a, bool)
            fresh[1:] = context[1:] != context[:-1]
            new = fresh.copy()
            new[1:] |= middle[1:] != middle[:-1]
            new = np.flatnonzero(new)
            top = np.flatnonzero(fresh[new])
            steps = np.diff(context[new[top]], prepend=np.uint64(0))
            rows.append(squeeze(steps, middle[new], self.after[a:b], np.diff(top, append=len(new)).astype("<u4"), np.diff(new, append=b - a).astype("<u4"), self.n[a:b]))
        return names.batch([[int(self.shard[a]) for a, _ in spans], [chunk] * len(spans), [b - a for a, b in spans], rows], ASK)


def _rows(batches, columns: list[str]):
    for b in batches:
        for chunk, *blobs in zip(b.column("chunk").to_pylist(), *(b.column(c) for c in columns), strict=True):
            yield chunk, {c: x.as_buffer() for c, x in zip(columns, blobs, strict=True)}


def score(docs: DataFrame, trained: str = "crc32(string(doc_id)) % 5 <> 1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score2`` for each row.

    The model learns from rows for which ``trained``, SQL over ``doc_id``, holds; rows with a
    null id are neither learned from nor held out. Tokens are the words of the text with A-Z in lower
    case, then one end. ``base_score`` is under single tokens alone, ``score`` under the trigram
    model, ``score2`` under its bigrams alone, all log10. Null text is empty. Equal ids are rows of
    their own. An empty table gives an empty table. One text is worked on in one task, up to 2 GB.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("train", F.coalesce(F.expr(trained), F.lit(False)))

    def split(batches):
        for chunk, t, texts in names.gather(batches, "text"):
            words, at, n = names.distinct_words(texts, lower=True)
            ids, train, sizes = t.column("doc_id"), t.column("train").to_numpy(), n + 1
            stop = np.cumsum(sizes) - 1
            token = np.full(int(sizes.sum()), len(words), "<u4")
            inner = np.ones(len(token), bool)
            inner[stop] = False
            token[inner] = at
            seen = np.bincount(token, np.repeat(train, sizes), len(words) + 1).astype("<u4")
            words = pa.concat_arrays([words, pa.array([b""], words.type)])
            yield names.batch([[chunk], [squeeze(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), train, sizes.astype("<u4"))], [squeeze(token)], [names.pack_words(words, seen)], [len(words)]], TEXT)

    text = cut(rows.mapInArrow(split, TEXT), "text")
    buckets = names.n_buckets(text, text.agg(F.sum("n_words")).first()[0] or 0)

    def name_and_count(number, seen, asked, bucket):
        total = np.bincount(number, seen, len(asked)).astype(np.int64)[number]
        return [names.name_of(number, bucket, buckets), total.astype("<u4" if total.max(initial=0) < 1 << 32 else "<u8")]

    def summary(words, number, seen, bucket):
        """Under chunk -1 the bucket's tokens, -2 its distinct trained words, -3 its frequent words, -4 the end; names as blobs."""
        total = np.bincount(number, seen, len(words)).astype(np.int64)
        often = np.flatnonzero(total >= total.sum() * HOT_SHARE).tolist()
        end = np.flatnonzero(np.diff(names.raw_words(words)[1]) == 0).tolist()
        name = lambda i: squeeze(names.name_of(np.array([i]), bucket, buckets))
        kinds = [-1, -2] + [-3] * len(often) + [-4] * len(end)
        return names.table([kinds, [bucket] * len(kinds), [int(total.sum()), int((total > 0).sum()), *total[often].tolist(), *total[end].tolist()], [None, None, *map(name, often), *map(name, end)]], ANSWER)

    answers = cut(names.answer_words(names.ask_words(text, buckets), buckets, name_and_count, summary), "counts")
    tokens, distinct = answers.agg(*[F.coalesce(F.sum(F.when(F.col("chunk") == k, F.col("n"))), F.lit(0)) for k in (-1, -2)]).first()
    found = answers.where((F.col("chunk") == -4) | (F.col("chunk") == -3) & (F.col("n") >= F.lit(tokens * HOT_SHARE))).select("chunk", "n", "rows").collect()
    often = {int(unsqueeze(r.rows)[0][0]): r.n for r in found}  # at most 1 / HOT_SHARE words, and the end
    ends = sum(r.n for r in found if r.chunk == -4)
    often[int(BEGIN)] = ends
    hot_words = np.array(sorted(often), np.uint64)
    hot_counts = np.array([often[int(h)] for h in hot_words], np.int64)

    def places(batches):
        """Where each of a chunk's words is among the answers, which come in order of bucket."""
        for chunk, own in _rows(batches, ["docs", "at", "words"]):
            sizes, data, _ = unsqueeze(own["words"])
            order, _ = names.word_buckets(data, np.concatenate(([0], np.cumsum(sizes.astype(np.int64)))), buckets)
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            yield names.batch([[chunk], [own["docs"].to_pybytes()], [own["at"].to_pybytes()], [squeeze(place)]], PLACED)

    def first(chunk, own, got):
        got, place = [unsqueeze(a) for a in got], unsqueeze(own["places"])[0]
        name, count = (np.concatenate([a[k] for a in got])[place] for k in range(2))
        return names.table([[chunk], [own["docs"].to_pybytes()], [squeeze(unsqueeze(own["at"])[0], name, count)]], NAMED)

    named = cut(names.with_answers(text.select("chunk", "docs", "at", "words").mapInArrow(places, PLACED), answers.where("chunk >= 0"), first, NAMED), "named")
    asked = text.agg(F.sum("n_words")).first()[0] or 0
    drop(text)
    drop(answers)
    del text, answers
    collect_garbage(spark)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked * 8 // SHARD_NGRAMS))

    def ask(batches):
        for chunk, own in _rows(batches, ["docs", "words"]):
            yield Trigrams(own, shards, hot_words).ask(chunk)

    def build_and_answer(key, t):
        t = t.sort_by("chunk")
        asks, seen = [], []  # by chunk: contexts, middles below them, trigrams of each, last words
        for x in t.column("rows"):
            steps, middle, after, per_top, per_pair, n = unsqueeze(x.as_buffer())
            top = np.cumsum(steps, dtype=np.uint64)
            asks.append((top, middle, per_top, per_pair, after))
            some = np.flatnonzero(n)
            of = np.repeat(np.arange(len(middle)), per_pair)[some]
            seen.append((np.repeat(top, per_top)[of], middle[of], after[some], n[some].astype(np.int64)))
        u, v, w, c = (np.concatenate([s[j] for s in seen]) for j in range(4))
        del seen
        order = np.lexsort((w, v, u))
        u, v, w, c = u[order], v[order], w[order], c[order]
        changed = lambda *of: np.concatenate((np.ones(min(1, len(u)), bool), np.logical_or.reduce([x[1:] != x[:-1] for x in of])))
        new = np.flatnonzero(changed(u, v, w))
        pair = changed(u, v)[new]
        u, v, w, c = u[new], v[new], w[new], np.add.reduceat(c, new) if len(new) else c
        first = np.flatnonzero(pair)
        parent = np.cumsum(pair) - 1
        both = np.bincount(parent, c, len(first))
        contexts, of = np.unique(u[first], return_inverse=True)
        total = np.bincount(of, both, len(contexts))
        i = np.minimum(np.searchsorted(hot_words, contexts), len(hot_words) - 1)
        total = np.where(hot_words[i] == contexts, hot_counts[i], total)
        third = (first, w, c / (both[parent] + PRIOR))
        trie = Trie.of(u[first], v[first], both / (total[of] + PRIOR), PRIOR / (both + PRIOR), third).mapped()
        context, middle, per_top, per_pair, after = (np.concatenate([x[k] for x in asks]) for k in range(5))
        at = trie.find(context, middle, per_top)
        at3 = trie.find3(at, per_pair, after)
        codes = trie.code("codes3", at3), np.repeat(trie.code("codes", at), per_pair), np.repeat(trie.code("weights", at, 1), per_pair)
        ends = np.cumsum([len(x[4]) for x in asks]).tolist()
        blobs = [squeeze(*[x[i:j] for x in codes]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        return names.table([t.column("chunk").to_pylist(), [key[0].as_py()] * len(blobs), t.column("n").to_pylist(), blobs], ANSWER)

    base = np.log10(tokens + 0.5 * (distinct + 1))

    def finish(chunk, own, got):
        ids, null, train, sizes = unsqueeze(own["docs"])
        t = Trigrams(own, shards, hot_words)
        got = [unsqueeze(a) for a in got]
        p3, p, weight = (LEVELS[np.concatenate([a[k] for a in got])[t.place]] for k in range(3))
        begin = np.cumsum(t.sizes) - t.sizes
        c = t.count.astype(np.int64)[t.at]
        single = np.log10(c + 0.5) - base
        before = np.concatenate(([0], c[:-1]))
        before[begin] = ends
        both = np.log10(p + PRIOR / (before + PRIOR) * 10.0**single)
        three = both.copy()
        three[1:] = np.log10(p3[:-1] + weight[:-1] * 10.0 ** both[1:])
        three[begin] = both[begin]
        add = lambda x: np.add.reduceat(x, begin)
        out = [pa.array(ids, mask=null), ~train & ~null, t.sizes, add((c > 0).astype(np.int64)), np.full(len(ids), tokens, np.int64), add(single), add(three), add(both)]
        return pa.Table.from_arrays([pa.array(x) for x in out], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "score2"])

    trigrams = cut(named.mapInArrow(ask, ASK).groupBy("bucket").applyInArrow(build_and_answer, ANSWER), "trigrams")
    collect_garbage(spark)
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score2 double"
    return names.with_answers(named, trigrams, finish, result)
