"""Global names, given in Spark rounds to the distinct words or blocks of all documents.

Documents are gathered into chunks, written once, so every later pass sees the same rows in
the same order, whatever executors are lost. In a round each chunk sends what it has to name
once, packed by bucket; a bucket sees all chunks' requests for its keys, compares the keys
themselves, never a hash of them, and answers each with a name, small and the same for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import hash_words, mix64, release, split_words

#: Bytes of text in a chunk (a longer text is a chunk of its own), and requests wanted in a bucket.
CHUNK, BUCKET = 6_000_000, 3_000_000
#: Names leave the low bits to the round that gave them.
LEVELS = 8

ASK = "bucket int, chunk long, n long, rows binary"
ANSWER = "chunk long, bucket int, n long, rows binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def table(columns: list, schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array(c, _KINDS[k]) for c, (n, k) in zip(columns, fields, strict=True)})


def batch(columns: list, schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# --- blobs ------------------------------------------------------------------------------


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob, each by byte planes, so that high bytes that are all alike cost nothing."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [len(a), a.dtype.itemsize, ord(a.dtype.kind)]
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    raw = np.array(head, "<i8").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(blob) -> list[np.ndarray]:
    raw = memoryview(blob)
    raw = memoryview(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"))
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 3 * k, 8).reshape(k, 3)
    out, at = [], 8 + 24 * k
    for n, size, kind in head.tolist():
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}") if n else np.zeros(0, f"{chr(kind)}{size}"))
        at += n * size
    return out


def slices(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    if not len(sorted_keys):
        return []
    at = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(sorted_keys)], strict=True))


# --- chunks -----------------------------------------------------------------------------


def gather(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table, list[bytes]]]:
    """(chunk, rows, texts): the rows of a task in order, about ``CHUNK`` bytes of text at a time; null text as empty."""
    release()
    part, seq = TaskContext.get().partitionId() << 32, 0
    held, texts, size = [], [], 0
    for b in batches:
        i = 0
        for j, t in enumerate(b.column(column).cast(pa.binary()).to_pylist()):
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= CHUNK:
                held.append(b.slice(i, j + 1 - i))
                yield part + seq, pa.Table.from_batches(held), texts
                i, seq, held, texts, size = j + 1, seq + 1, [], [], 0
        if i < b.num_rows:
            held.append(b.slice(i))
    if held:
        yield part + seq, pa.Table.from_batches(held), texts


def distinct_words(texts: list[bytes], lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in order of their first place, each word's number among them, and words per text."""
    buf, start, end, n = split_words(texts, lower)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    np.cumsum(edge[:-1], dtype=np.int8, out=edge[:-1])
    solid = edge[:-1] > 0
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(buf[solid])])
    found = words.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), n


def raw_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_binary array's values, and where each begins and the last ends."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    at = np.frombuffer(words.buffers()[1], "<i8", len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def as_words(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(data))])


def word_buckets(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by bucket, and the bucket of each in that order."""
    bucket = (hash_words(data, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def n_buckets(df: DataFrame, requests: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-requests // BUCKET))


# --- a round for words --------------------------------------------------------------------


def pack_words(words: pa.Array, facts: np.ndarray) -> bytes:
    """Distinct words of a chunk and a number that it knows of each."""
    data, at = raw_words(words)
    return squeeze(np.diff(at).astype("<u4"), data, facts)


def ask_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Requests, from ``chunk, words`` as ``pack_words`` made them: the words of a bucket and what their chunk knows of each."""

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("words"), strict=True):
                sizes, data, facts = unsqueeze(blob.as_buffer())
                words = as_words(data, sizes)
                order, bucket = word_buckets(*raw_words(words), buckets)
                data, at = raw_words(words.take(pa.array(order)))
                sizes, facts, spans = np.diff(at).astype("<u4"), facts[order], slices(bucket)
                rows = [squeeze(sizes[i:j], data[at[i] : at[j]], facts[i:j]) for i, j in spans]
                yield batch([[int(bucket[i]) for i, _ in spans], [chunk] * len(spans), [j - i for i, j in spans], rows], ASK)

    return chunks.select("chunk", "words").mapInArrow(run, ASK)


def answer_words(asks: DataFrame, buckets: int, answer: Callable, extra: Callable | None = None) -> DataFrame:
    """Answers to ``ask_words``: ``answer(number, facts, asked)`` gives arrays for all requests of a bucket.

    ``number`` is each requested word's, from 0, the same for equal words and no others;
    ``asked`` how often each number was. ``extra(words, number, facts, bucket)`` may add rows
    of ``ANSWER`` about the bucket's words.
    """

    def run(key, t):
        t = t.sort_by("chunk")
        parts = [unsqueeze(x.as_buffer()) for x in t.column("rows")]
        words = as_words(np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts])).dictionary_encode()
        number, facts = words.indices.to_numpy().astype(np.int64), np.concatenate([p[2] for p in parts])
        asked = np.bincount(number, minlength=len(words.dictionary))
        found = answer(number, facts, asked, key[0].as_py())
        ends = np.cumsum([len(p[0]) for p in parts]).tolist()
        rows = [squeeze(*[x[i:j] for x in found]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        out = table([t.column("chunk").to_pylist(), [key[0].as_py()] * len(rows), t.column("n").to_pylist(), rows], ANSWER)
        return pa.concat_tables([out, extra(words.dictionary, number, facts, key[0].as_py())]) if extra else out

    return asks.groupBy("bucket").applyInArrow(run, ANSWER)


def name_of(number: np.ndarray, bucket: int, buckets: int, level: int = 0) -> np.ndarray:
    """Names, never 0, that no other bucket or round gives."""
    return ((number.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)) * np.uint64(LEVELS)) + np.uint64(level)


# --- a round for pairs --------------------------------------------------------------------


class Pairs:
    """Distinct pairs of a chunk, by bucket: what they are and each row's number among them."""

    def __init__(self, left: np.ndarray, right: np.ndarray, row: np.ndarray, buckets: int):
        a, ia = np.unique(left, return_inverse=True)
        b, ib = np.unique(right, return_inverse=True)
        key, first, number = np.unique(ia * np.int64(max(1, len(b))) + ib, return_index=True, return_inverse=True)
        left, right = left[first], right[first]
        bucket = (mix64(left ^ mix64(right, 21), 22) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.left, self.right, self.bucket, self.at = left[order], right[order], bucket[order], place[number]
        self.many = several(self.at, row, len(order))


def several(number: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each number: whether it stands in more than one row. Rows ascend."""
    first, last = np.empty(n, np.int64), np.empty(n, np.int64)
    last[number] = row
    first[number[::-1]] = row[::-1]
    return first != last


def ask_pairs(chunk: int, p: Pairs) -> pa.RecordBatch:
    spans = slices(p.bucket)
    rows = [squeeze(p.left[i:j], p.right[i:j], p.many[i:j]) for i, j in spans]
    return batch([[int(p.bucket[i]) for i, _ in spans], [chunk] * len(spans), [j - i for i, j in spans], rows], ASK)


def answer_pairs(asks: DataFrame, buckets: int, level: int) -> DataFrame:
    """A name for each pair that more than one document has, 0 for the others; as steps from one to the next."""

    def run(key, t):
        t = t.sort_by("chunk")
        parts = [unsqueeze(x.as_buffer()) for x in t.column("rows")]
        left, right, many = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((right, left))
        a, b = left[order], right[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        shared = (np.bincount(number) > 1) | (np.bincount(number, many) > 0)
        name = np.where(shared[number], name_of(number, key[0].as_py(), buckets, level), np.uint64(0))
        ends = np.cumsum([len(p[0]) for p in parts]).tolist()
        rows = [squeeze(name[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        return table([t.column("chunk").to_pylist(), [key[0].as_py()] * len(rows), t.column("n").to_pylist(), rows], ANSWER)

    return asks.groupBy("bucket").applyInArrow(run, ANSWER)


# --- answers at their chunks ----------------------------------------------------------------


def with_answers(chunks: DataFrame | list[DataFrame], answers: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(chunk, its blobs by name, answers in order of bucket)`` gives a table of ``schema`` for each chunk.

    Columns of ``chunks`` must be binary, next to ``chunk``; of several tables a chunk has one row in each.
    """
    frames = chunks if isinstance(chunks, list) else [chunks]
    tables, blobs = len(frames), list(dict.fromkeys(c for f in frames for c in f.columns if c != "chunk"))
    none = F.lit(None).cast("binary")
    both = answers.select("chunk", "bucket", *[none.alias(c) for c in blobs], "rows")
    for f in frames:
        both = f.select("chunk", F.lit(-1).alias("bucket"), *[F.col(c) if c in f.columns else none.alias(c) for c in blobs], none.alias("rows")).union(both)

    def each(key, t):
        t = t.sort_by("bucket")
        own = {}
        for c in blobs:
            for x in t.column(c).slice(0, tables):
                if x.is_valid:
                    own[c] = x.as_buffer()
        return run(key[0].as_py(), own, [x.as_buffer() for x in t.column("rows").slice(tables)])

    return both.groupBy("chunk").applyInArrow(each, schema)
