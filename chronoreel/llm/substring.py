"""Repeated passages across documents, by recompression in Spark rounds.

The first round names every distinct word. Each round after it names blocks, runs of equal
neighbours and pairs of neighbours, in one global table, so equal passages get equal symbols
but for a few at either end; a block that only one document has gets the symbol 0 and is a
wall from then on. Which neighbours pair depends on their own names alone, so an end spoils
no more than a run and the half of a pair in each round. There are as many rounds as leave
GRAM whole symbols sure inside a window. The least hash of GRAM neighbouring symbols there is
the window's anchor; windows whose anchor no other document has are out. The others meet by
anchor, with the global names of all their words, which are compared one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm import names
from chronoreel.llm.common import as_bytes, collect_garbage, cut, drop, mix64, release
from chronoreel.llm.names import ASK, squeeze, unsqueeze

#: Symbols in an anchor.
GRAM = 4
_A, _K = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
NO_ANCHOR = np.uint64(0)
NAMED, SYMBOLS = "chunk long, docs binary, words binary", "chunk long, docs binary, symbols binary"
CANDIDATES = "chunk long, docs binary, windows binary"
SPLIT, PLACED = "chunk long, docs binary, at binary, words binary, n_words long", "chunk long, docs binary, at binary, places binary"
FOUND = "bucket int, chunk long, starts binary, asks binary"


def limits_of(window: int) -> tuple[int, ...]:
    """Most words that a symbol may stand for after each round."""
    limits: tuple[int, ...] = ()
    while len(limits) < names.LEVELS - 1:
        more = (*limits, 2 << len(limits))
        if (window - 2 * edge_of(more) - (more[-1] - 1)) // more[-1] < GRAM:
            break
        limits = more
    return limits


def edge_of(limits: tuple[int, ...]) -> int:
    """Words that context may change at either end: in each round a run, and a neighbour that may pair with it."""
    return sum(2 * n - 1 for n in limits)


class Blocks:
    """The blocks of a round: two neighbours that pair or one alone, each a symbol and how often it runs (times 64, plus)."""

    def __init__(self, sym: np.ndarray, size: np.ndarray, doc: np.ndarray, limit: int, level: int):
        none = np.zeros(0, np.int64)
        first = np.ones(len(sym), bool)
        first[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1]) | (sym[1:] == 0)
        run = np.flatnonzero(first)
        k = np.diff(run, append=len(sym)) if len(run) else none
        fits = (k > 1) & (k * size[run] <= limit)
        keep = first | ~np.repeat(fits, k)
        times = np.ones(len(sym), np.int64)
        times[run[fits]] = k[fits]
        sym, times, size, doc = sym[keep], times[keep], (size * times)[keep], doc[keep]
        unit = sym * np.uint64(64) + times.astype(np.uint64)
        right = (mix64(unit, 32 + level) & np.uint64(1)).astype(bool)
        real = sym != 0
        pair = np.flatnonzero(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]) & (size[1:] + size[:-1] <= limit) & real[1:] & real[:-1])
        self.right = np.zeros(len(unit), np.uint64)
        self.right[pair] = unit[pair + 1]
        size[pair] += size[pair + 1]
        keep = np.ones(len(unit), bool)
        keep[pair + 1] = False
        self.left, self.right, self.sym, self.size, self.doc = unit[keep], self.right[keep], sym[keep], size[keep], doc[keep]
        self.new = np.flatnonzero((self.right != 0) | (times[keep] > 1))  # the others keep their symbol

    def pairs(self, buckets: int) -> names.Pairs:
        return names.Pairs(self.left[self.new], self.right[self.new], self.doc[self.new], buckets)


def _words(blob) -> np.ndarray:
    """The global names of a chunk's words, kept as numbers among its distinct words and the names of those."""
    at, name = unsqueeze(blob)
    return name[at]


def _symbols(own: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a chunk, words that each stands for and the text of each; before the first round for blocks its words."""
    if "symbols" in own:
        sym, size, n = unsqueeze(own["symbols"])
    else:
        sym, (_, _, n) = _words(own["words"]), unsqueeze(own["docs"])
        size = np.ones(len(sym))
    return sym, size.astype(np.int64), np.repeat(np.arange(len(n)), n)


def _rows(batches, columns: list[str]):
    """(chunk, its blobs by name), row by row."""
    release()
    for b in batches:
        for chunk, *blobs in zip(b.column("chunk").to_pylist(), *(b.column(c) for c in columns), strict=True):
            yield chunk, {c: x.as_buffer() for c, x in zip(columns, blobs, strict=True)}


def _round(state: DataFrame, level: int, limit: int, buckets: int) -> DataFrame:
    """Names this round's blocks: those that several documents have; symbols of the others become 0."""
    columns = [c for c in state.columns if c != "chunk"]

    def ask(batches):
        for chunk, own in _rows(batches, columns):
            yield names.ask_pairs(chunk, Blocks(*_symbols(own), limit, level).pairs(buckets))

    def apply(chunk, own, answers):
        sym, size, doc = _symbols(own)
        n = len(unsqueeze(own["docs"])[0])
        blocks = Blocks(sym, size, doc, limit, level)
        name = np.concatenate([unsqueeze(a)[0] for a in answers] or [np.zeros(0, np.uint64)])
        blocks.sym[blocks.new] = name[blocks.pairs(buckets).at]
        packed = squeeze(blocks.sym, blocks.size.astype("<u2"), np.bincount(blocks.doc, minlength=n).astype("<u4"))
        return names.table([[chunk], [own["docs"].to_pybytes()], [packed]], SYMBOLS)

    answers = names.answer_pairs(state.mapInArrow(ask, ASK), buckets, level)
    return cut(names.with_answers(state, answers, apply, SYMBOLS), f"round{level}")


class Windows:
    """Windows of a chunk that may repeat: text, first word, and anchor of each."""

    def __init__(self, doc: np.ndarray, at: np.ndarray, anchor: np.ndarray):
        self.doc, self.at, self.anchor = doc, at.astype(np.int64), anchor

    @classmethod
    def of(cls, own: dict, window: int) -> Windows:
        _, null, n = unsqueeze(own["docs"])
        limits = limits_of(window)
        edge, most, gram = edge_of(limits), (limits or (1,))[-1], min(GRAM, window)
        reach = window - 2 * edge - (most - 1)
        n = n.astype(np.int64)
        count = np.where(null, 0, np.maximum(0, n - window + 1))
        doc = np.repeat(np.arange(len(n)), count)
        at = np.arange(count.sum()) + np.repeat((np.cumsum(n) - n) - (np.cumsum(count) - count), count)
        sym, size, _ = _symbols(own)
        begin = np.cumsum(size) - size
        alone = np.zeros(int(n.sum()) + 1, np.int64)  # words that no other document has
        alone[begin[(sym == 0) & (size == 1)] + 1] = 1
        np.cumsum(alone, out=alone)
        whole = alone[at + window] == alone[at]
        doc, at = doc[whole], at[whole]
        anchor = np.full(len(at), NO_ANCHOR)
        if len(at):
            m = len(sym) - gram + 1
            h, wall = np.zeros(m, np.uint64), np.zeros(m, bool)
            for i in range(gram):
                h = mix64(h * _A + sym[i : m + i], 64)
                wall |= sym[i : m + i] == 0
            h = np.where(wall, NO_ANCHOR, np.maximum(h, np.uint64(1)))
            stop = begin[gram - 1 :] + size[gram - 1 :]
            j = np.searchsorted(begin, at + edge)
            used, back = np.unique(j, return_inverse=True)
            last = np.searchsorted(stop, begin[used] + reach, side="right")
            width = np.maximum(1, last - used)
            power = np.frexp(width.astype(np.float64))[1] - 1
            line, out = h, np.empty(len(used), np.uint64)
            for k in range(int(power.max()) + 1):
                own_ = np.flatnonzero(power == k)
                out[own_] = np.minimum(line[used[own_]], line[used[own_] + width[own_] - (1 << k)])
                if len(line) > 1 << k:
                    line = np.minimum(line[: -(1 << k)], line[1 << k :])
            anchor = out[back]
        some = anchor != NO_ANCHOR
        return cls(doc[some], at[some], anchor[some])

    def packed(self) -> bytes:
        return squeeze(self.doc.astype("<u4"), self.at.astype("<u4"), self.anchor)

    def keys(self, buckets: int) -> names.Pairs:
        return names.Pairs(self.anchor, np.zeros(len(self.anchor), np.uint64), self.doc, buckets)


def earlier(anchor: np.ndarray, words: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each window, ``window`` words from ``at`` on: the smallest document that has an equal one. Words are compared, hashes only sort."""
    h = np.zeros(len(at), np.uint64)
    for i in range(window):
        h = h * _K + words[at + i]
    h = mix64(h, 80)
    group = np.zeros(len(at), np.int64)
    order = np.lexsort((doc, h, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (h[order][1:] != h[order][:-1])
    group[order] = np.cumsum(new) - 1
    first = at[order][new]
    apart = np.zeros(len(at), bool)
    for i in range(window):
        apart |= words[at + i] != words[first[group] + i]
    if apart.any():  # one hash of different words: told apart by the words themselves
        odd = np.flatnonzero(np.isin(group, group[apart]))
        rows = np.stack([words[at[odd] + i] for i in range(window)], axis=1)
        group[odd] = group.max() + 1 + np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    return least[group]


def _segments(w: Windows, some: np.ndarray):
    """Neighbouring windows of one anchor, as one stretch of words: first window, windows."""
    at, anchor, doc = w.at[some], w.anchor[some], w.doc[some]
    new = np.ones(len(some), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return begin, np.diff(begin, append=len(some))


def _stretch(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of each, ``n`` long, one after another."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def repeats(chunks: DataFrame, window: int, spark) -> DataFrame:
    """``chunk, starts``: the places in a chunk of windows that also start in a document with a smaller id."""
    def split(batches):
        for chunk, own in _rows(batches, ["body"]):
            t = pa.ipc.open_stream(own["body"]).read_all()
            words, at, n = names.distinct_words(as_bytes(t.column("text")))
            ids = t.column("doc_id")
            facts = names.several(at, np.repeat(np.arange(len(n)), n), len(words))
            docs = squeeze(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), n.astype("<u4"))
            yield names.batch([[chunk], [docs], [squeeze(at.astype("<u4"))], [names.pack_words(words, facts)], [len(words)]], SPLIT)

    text = cut(chunks.select("chunk", "body").mapInArrow(split, SPLIT), "words")
    buckets = names.n_buckets(text, text.agg(F.sum("n_words")).first()[0] or 0)

    def name_words(number, facts, asked, bucket):
        shared = (asked > 1) | (np.bincount(number, facts, len(asked)) > 0)
        return [np.where(shared[number], names.name_of(number, bucket, buckets), np.uint64(0))]

    def places(batches):
        """Where each of a chunk's words is among the answers, which come in order of bucket."""
        for chunk, own in _rows(batches, ["docs", "at", "words"]):
            sizes, data, _ = unsqueeze(own["words"])
            order, _ = names.word_buckets(data, np.concatenate(([0], np.cumsum(sizes.astype(np.int64)))), buckets)
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            yield names.batch([[chunk], [own["docs"].to_pybytes()], [own["at"].to_pybytes()], [squeeze(place)]], PLACED)

    def first(chunk, own, answers):
        name = np.concatenate([unsqueeze(a)[0] for a in answers] or [np.zeros(0, np.uint64)])
        return names.table([[chunk], [own["docs"].to_pybytes()], [squeeze(unsqueeze(own["at"])[0], name[unsqueeze(own["places"])[0]])]], NAMED)

    # answers and places are written, so that neither the requests nor the words are kept beside what comes of them
    answers = cut(names.answer_words(names.ask_words(text, buckets), buckets, name_words), "answers")
    collect_garbage(spark)
    placed = cut(text.select("chunk", "docs", "at", "words").mapInArrow(places, PLACED), "places")
    drop(text)
    named = cut(names.with_answers(placed, answers, first, NAMED), "round0")
    drop(placed)
    drop(answers)
    del text, placed, answers
    collect_garbage(spark)
    state = named
    for level, limit in enumerate(limits_of(window), 1):
        new = _round(state, level, limit, buckets)
        if state is not named:
            drop(state)
        state = new
        del new
        collect_garbage(spark)
    columns = [c for c in state.columns if c != "chunk"]

    def look(batches):
        for chunk, own in _rows(batches, columns):
            yield names.batch([[chunk], [own["docs"].to_pybytes()], [Windows.of(own, window).packed()]], CANDIDATES)

    candidates = cut(state.mapInArrow(look, CANDIDATES), "candidates")
    if state is not named:
        drop(state)

    def ask(batches):
        for chunk, own in _rows(batches, ["windows"]):
            yield names.ask_pairs(chunk, Windows(*unsqueeze(own["windows"])).keys(buckets))

    def meet(chunk, own, answers):
        """What the chunk settles by itself, and the windows of which others must be asked: of equal ones, those of the smallest document."""
        w, words, (ids, _, _) = Windows(*unsqueeze(own["windows"])), _words(own["words"]), unsqueeze(own["docs"])
        shared = np.concatenate([unsqueeze(a)[0] for a in answers] or [np.zeros(0, np.uint64)]) != 0
        some = np.flatnonzero(shared[w.keys(buckets).at])
        w.doc, w.at, w.anchor = w.doc[some], w.at[some], w.anchor[some]
        doc = ids[w.doc]
        again = doc > earlier(w.anchor, words, w.at, doc, window)
        out = [[chunk % buckets], [chunk], [squeeze(w.at[again].astype("<u4"))], [None]]
        rest = np.flatnonzero(~again)
        begin, n = _segments(w, rest)
        seg = rest[begin]
        bucket = (w.anchor[seg] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        for i, j in names.slices(bucket[order]):
            own_ = order[i:j]
            s, k = seg[own_], n[own_]
            said = words[_stretch(w.at[s], k + window - 1)]
            for column, value in zip(out, (int(bucket[own_[0]]), chunk, None, squeeze(w.anchor[s], doc[s], w.at[s].astype("<u4"), k.astype("<u4"), said)), strict=True):
                column.append(value)
        return names.table(out, FOUND)

    anchors = names.answer_pairs(candidates.select("chunk", "windows").mapInArrow(ask, ASK), buckets, names.LEVELS - 1)

    def settle(key, t):
        done = t.filter(t.column("starts").is_valid()).select(["chunk", "starts"])
        t = t.filter(t.column("asks").is_valid()).sort_by("chunk")
        if not t.num_rows:
            return done
        parts = [unsqueeze(x.as_buffer()) for x in t.column("asks")]
        chunk = np.repeat(t.column("chunk").to_numpy(), [len(p[0]) for p in parts])
        anchor, doc, at, k, words = (np.concatenate([p[i] for p in parts]) for i in range(5))
        k = k.astype(np.int64)
        length = k + window - 1
        seg = np.repeat(np.arange(len(k)), k)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(k) - k, k)
        again = doc[seg] > earlier(anchor[seg], words, (np.cumsum(length) - length)[seg] + inside, doc[seg], window)
        chunk, starts = chunk[seg][again], (at.astype(np.int64)[seg] + inside)[again].astype("<u4")
        spans = names.slices(chunk)
        mine = names.table([[int(chunk[i]) for i, _ in spans], [squeeze(starts[i:j]) for i, j in spans]], "chunk long, starts binary")
        return pa.concat_tables([done.cast(mine.schema), mine])

    found = names.with_answers([named.select("chunk", "words"), candidates], anchors, meet, FOUND)
    out = cut(found.groupBy("bucket").applyInArrow(settle, "chunk long, starts binary"), "repeats")
    drop(candidates)
    drop(named)
    del state, named, candidates, anchors, found
    collect_garbage(spark)
    return out


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, n_words, n_removed, kept_sha256`` and the columns ``keep``, one row per row of ``docs``.

    Each word covered by a window of ``window`` words whose sequence also starts in a document
    with a smaller id goes; windows are judged on the input. A text that loses nothing stays as
    it is, else its words are joined by one space. Null text stays null, with no words. Rows
    with a null id neither lose words nor count as an earlier document; rows with equal ids are
    not earlier than each other. An empty table gives an empty table. A column of ``keep`` that
    has the name of one of the others is an error. One text is worked on in one task, up to 2 GB.
    """
    spark = docs.sparkSession
    ours = ("doc_id", "text", "n_words", "n_removed", "kept_sha256")
    if clash := sorted(set(ours) & set(keep)):
        raise ValueError(f"keep names columns of the result: {clash}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in keep])

    def pack(batches):
        for chunk, t, _ in names.gather(batches, "text"):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as f:
                f.write_table(t)
            yield names.batch([[chunk], [sink.getvalue().to_pybytes()]], "chunk long, body binary")

    chunks = cut(rows.mapInArrow(pack, "chunk long, body binary"), "chunks")
    found = repeats(chunks, window, spark).select("chunk", F.lit(0).alias("bucket"), F.lit(None).cast("long").alias("n"), F.col("starts").alias("rows"))

    def apply(chunk, own, starts):
        t = pa.ipc.open_stream(own["body"]).read_all()
        split = [x.split() for x in as_bytes(t.column("text"))]
        n = np.fromiter(map(len, split), np.int64, len(split))
        end = np.cumsum(n)
        hit = np.zeros(int(n.sum()) + 1, np.int64)
        for s in starts:
            at = unsqueeze(s)[0].astype(np.int64)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + window, -1)
        gone = np.cumsum(hit[:-1]) > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[np.concatenate(([0], end))])
        texts, digests = [], []
        for text, words, e, k, lost in zip(t.column("text").to_pylist(), split, end.tolist(), n.tolist(), removed.tolist(), strict=True):
            if lost:
                words = [words[i] for i in np.flatnonzero(~gone[e - k : e]).tolist()]
            line = b" ".join(words)
            texts.append(line.decode() if lost else text)
            digests.append(hashlib.sha256(line).hexdigest())
        return pa.table([t.column("doc_id"), pa.array(texts, pa.string()), *[t.column(c) for c in keep], pa.array(n), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "text", *keep, *ours[2:]])

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return names.with_answers(chunks, found, apply, f"doc_id long, text string{extra}, n_words long, n_removed long, kept_sha256 string")
