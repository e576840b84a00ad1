"""Token ids in binary files under one canonical, length-limited Huffman code.

A store is a folder: ``codebook`` (the code length of every id, from global counts) and one
``*.hti`` file per segment, named so that file order is document order. A segment holds a
header with the number of ids before it, document ids and lengths, the bit offset of every
block of ids, and the bits. Blocks decode on their own from their checkpoints, many at a time,
by one table look-up per id.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import KEPT, as_bytes, collect_garbage, cut, drop, shared_dir
from chronoreel.llm.names import squeeze, unsqueeze
from chronoreel.llm.ragged import Memo, packed, pick

#: Bits of a code, unless more ids are used than so many bits tell apart; and the most that a look-up takes.
MAGIC, LIMIT, MOST, BLOCK = b"HTI2", 16, 24, 2_048
#: Ids wanted in a segment, and bytes of text tokenised at once.
SEGMENT_IDS, CHUNK = 4_000_000, 3_000_000
HEAD = struct.Struct("<4sIQQQQ")  # magic, block, documents, ids, bits, ids of all segments before


# --- the code --------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, or as many as all ids need, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, (len(used) - 1).bit_length())
    if limit > MOST:
        raise ValueError(f"{len(used)} ids need codes longer than {MOST} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64)
    line, leaves = w, []
    for _ in range(limit - 1):
        packed = line[: len(line) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([w, packed])
        at = np.argsort(both, kind="stable")
        leaves.append(at < len(w))
        line = both[at]
    take, size = 2 * len(w) - 2, np.zeros(len(w), np.int64)
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        size[:n] += 1
        take = 2 * (take - n)
    size[:take] += 1
    lengths[order] = size
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for n in np.unique(lengths[order]):
        own = order[lengths[order] == n]
        code <<= int(n) - before
        codes[own] = code + np.arange(len(own))
        code, before = code + len(own), int(n)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the next bits, as many as the longest code has: the id they begin with and its length."""
    limit = max(1, int(lengths.max(initial=1)))
    ids, size = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    codes = codes_of(lengths)
    order = np.lexsort((codes, lengths))
    order = order[lengths[order] > 0]
    span = 1 << (limit - lengths[order].astype(np.int64))
    n = int(span.sum())
    ids[:n], size[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, int, bytes]:
    """Checkpoints of the blocks, bits in all, and the bits, the first the highest of its byte."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    begin = end - n
    bits = int(end[-1]) if len(end) else 0
    words = np.zeros((bits >> 5) + 2, np.uint64)
    if len(ids):
        value = codes[ids].astype(np.uint64) << (64 - n - (begin & 31)).astype(np.uint64)
        at = begin >> 5
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        words[at[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[at[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return begin[::block].astype("<u8"), bits, words.astype(">u4").tobytes()


def unpack(stream: np.ndarray, checkpoints: np.ndarray, n_ids: int, table, block: int = BLOCK) -> np.ndarray:
    """All blocks in step: each reads one id at a time from its own offset."""
    ids, size = table
    drop_bits = np.uint32(32 - (len(ids).bit_length() - 1))
    s = np.concatenate([stream, np.zeros(4, np.uint8)])
    window = np.ndarray((len(s) - 3,), ">u4", s, strides=(1,)).astype(np.uint32)
    pos = checkpoints.astype(np.int64)
    out = np.zeros((block, len(pos)), np.uint32)
    tail = n_ids - block * (len(pos) - 1) if len(pos) else 0
    for k in range(min(block, n_ids)):
        if k == tail:  # the last block is shorter
            pos = pos[:-1]
        key = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> drop_bits
        out[k, : len(pos)] = ids[key]
        pos = pos + size[key]
    return out.T.reshape(-1)[:n_ids]


def to_bytes(doc_ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, start: int) -> bytes:
    at, bits, stream = pack(ids, codes, lengths)
    head = HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), bits, start)
    return head + b"".join([doc_ids.astype("<i8").tobytes(), np.packbits(null).tobytes(), sizes.astype("<u4").tobytes(), at.tobytes(), stream])


def from_bytes(content, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, which of them are null, lengths and all ids of a segment, and the number of ids before it."""
    magic, block, docs, n, _, start = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    raw, at = np.frombuffer(content, np.uint8), HEAD.size

    def take(count, kind):
        nonlocal at
        size = count * np.dtype(kind).itemsize
        at += size
        return raw[at - size : at].view(kind)

    doc_ids, null, sizes = take(docs, "<i8"), np.unpackbits(take(-(-docs // 8), "u1"), count=docs).astype(bool), take(docs, "<u4").astype(np.int64)
    marks = take(-(-n // block), "<u8")
    return doc_ids, null, sizes, unpack(raw[at:], marks, n, table, block), start


# --- tokenising ------------------------------------------------------------------------

#: Kinds of bytes: letters of ASCII, its other signs but the apostrophe, and white space or control.
_LETTER, _SIGN, _BLANK = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] = True
_BLANK[[*range(0x21), 0x7F]] = True
#: First bytes of the characters among which white space is found beyond ASCII, and that white space.
_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_WIDE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_PLAIN = re.compile(rb" ?(?:(?!" + _WIDE + rb")[\x21-\x7e\x80-\xff])+")
#: Letters up to U+017F, which the pattern takes as one match.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+")
#: The byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = dict.fromkeys(_PRINTED) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_ALPHABET = {b: b if c is None else c for b, c in _ALPHABET.items()}
_ALPHABET_LINE = chr(_ALPHABET[0x0A])
_LOADED: dict[str, Tokenization] = {}
KEPT.append(_LOADED)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_texts(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Texts cut where a token of the byte-level pattern must begin, and how many parts each has.

    That is before a space and at a line end between other characters, where letters meet
    signs, and after signs before letters. An apostrophe may draw letters to it, so nothing is cut behind it.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    stop = np.cumsum([len(t) for t in texts])
    cut_at = np.zeros(len(buf) + 1, bool)
    if len(buf) > 2:
        begins = ~_BLANK[buf] & ~np.isin(buf, _LEADS)
        ends = ~_BLANK[buf]
        ends[1:] &= ~((buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0)))
        ends[2:] &= ~np.isin(buf[:-2], _LEADS[1:])
        between = ends[:-2] & begins[2:]
        line = between & (buf[1:-1] == 0x0A)
        cut_at[1:-2] = line | (between & (buf[1:-1] == 0x20))
        cut_at[2:-1] |= line
    if len(buf):
        letter, sign = _LETTER[buf], _SIGN[buf]
        cut_at[1:-1] |= letter[:-1] & (sign[1:] | (buf[1:] == 0x27)) | (sign[:-1] & letter[1:])
    cut_at[stop[stop < len(buf)]] = True
    cut_at[:1] = len(buf) > 0
    at = np.flatnonzero(cut_at[: len(buf)])
    offsets = np.append(at, len(buf)).astype("<i8")
    parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(buf)])
    return parts, np.diff(np.searchsorted(at, np.concatenate(([0], stop))))


class Tokenization:
    """A tokenizer of the library, given each distinct part of texts once while it is kept."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path) as f:
            shape = json.load(f)
        before = shape.get("pre_tokenizer") or {}
        #: Parts may be encoded by themselves only under the pattern that ``cut_texts`` knows.
        self.parts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not shape.get("normalizer")
        self.added = [x["content"].encode() for x in shape.get("added_tokens") or []]
        self.line = self.lib.token_to_id("Ċ")
        self.memo = Memo(self.encode_parts, 200_000)

    def whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode_parts(self, strings: list[bytes]):
        """Runs of letters go to the library's model, which skips its pattern; of the others many as one text, each on a line of its own.

        A line end between other characters is a token by itself.
        """
        words, plain, rest = [], [], []
        for x in strings:
            (words if _LETTERS.fullmatch(x) else plain if _PLAIN.fullmatch(x) else rest).append(x)
        tokenize = self.lib.model.tokenize
        # all words are spelled in one go, a line end between them has a sign of its own
        spelled = b"\n".join(words).decode("latin-1").translate(_ALPHABET).split(_ALPHABET_LINE) if words else []
        found = [[t.id for t in tokenize(x)] for x in spelled]
        order, flat, n = packed(words, found)
        parts, sizes = [flat], [n]
        for a in range(0, len(plain), 20_000):
            own = plain[a : a + 20_000]
            ids = np.array(self.whole([b"\n".join(own)])[0], np.int32)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(own) - 1:
                order += own
                parts.append(np.delete(ids, ends))
                sizes.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
            else:
                rest += own
        _, flat, n = packed(rest, self.whole(rest))
        return order + rest, np.concatenate([*parts, flat]), np.concatenate([*sizes, n])

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has. A text with one of the added tokens goes to the library whole."""
        everything = b"\n".join(texts)
        some_odd = not self.parts or any(x in everything for x in self.added)
        odd = [some_odd and (not self.parts or any(x in t for x in self.added)) for t in texts]
        parts, n_parts = cut_texts([b"" if o else t for o, t in zip(odd, texts, strict=True)])
        found = parts.dictionary_encode()
        flat, begin, n = self.memo.each(found.dictionary.to_pylist())
        at = found.indices.to_numpy()
        begin, n = begin[at], n[at]
        upto = np.cumsum(n_parts)
        sizes = np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], upto))])
        if not some_odd:
            return pick(flat, begin, n), sizes
        some = [i for i, o in enumerate(odd) if o]
        _, more, k = packed(some, self.whole([texts[i] for i in some]))
        sizes[some] = k
        out = np.empty(int(sizes.sum()), np.int32)
        mine = np.repeat(np.array(odd), sizes)
        out[~mine], out[mine] = pick(flat, begin, n), more
        return out, sizes


def load(path: str) -> Tokenization:
    """Once per process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenization(path)
    return _LOADED[path]


def tokenize(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, in UTF-8, as the library's ``encode`` without special tokens gives them, and how many each has."""
    collects = gc.isenabled()
    gc.disable()  # a list for each word would set it off again and again, and none is in a cycle
    try:
        return load(path).ids(texts)
    finally:
        if collects:
            gc.enable()


# --- writing and reading ---------------------------------------------------------------


def _put(path: str, content: bytes) -> None:
    """Whole or not at all: written under another name, then moved; a retried task leaves the same bytes."""
    store, base = fs.FileSystem.from_uri(path)
    part = f"{base}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, base)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise every whole text, end each document with ``end_id`` and store them in ascending order of id.

    Null ids come first, rows with equal ids in any order; null text is empty. The strings of
    added tokens in a text are those tokens, as the library has it. ``folder`` is a URI that all executors reach.
    """
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = max(end_id + 1, load(path).lib.get_vocab_size())
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def encode(batches):
        shard, seq, held, before = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            own, sizes, null, ids = (np.concatenate([h[k] for h in held]) for k in range(4))
            counts = np.bincount(ids, minlength=vocabulary).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([squeeze(counts)], pa.binary())] + [pa.array([x.tobytes()], pa.binary()) for x in (own, null, sizes.astype("<i4"), ids.astype(kind))],
                ["shard", "seq", "before", "n_ids", "counts", "doc_ids", "null", "sizes", "ids"],
            )

        n = 0
        for b in batches:
            texts, column, i = as_bytes(b.column("text")), b.column("doc_id"), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                    size += len(texts[j])
                    j += 1
                ids, sizes = tokenize(texts[i:j], path)
                upto = np.cumsum(sizes)
                own = column.slice(i, j - i)
                held.append((own.fill_null(0).to_numpy(zero_copy_only=False), sizes + 1, own.is_null().to_numpy(zero_copy_only=False), np.insert(ids, upto, end_id)))
                n, i = n + len(held[-1][3]), j
                if n >= SEGMENT_IDS:
                    yield flush()
                    seq, before, n, held = seq + 1, before + n, 0, []
        if held:
            yield flush()

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    tokens = cut(ordered.mapInArrow(encode, "shard int, seq int, before long, n_ids long, counts binary, doc_ids binary, null binary, sizes binary, ids binary"), "tokens")
    del ordered
    collect_garbage(spark)

    def add_up(key, t):
        total = np.zeros(vocabulary, np.int64)
        for x in t.column("counts"):
            total += unsqueeze(x.as_buffer())[0]
        return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros(vocabulary, np.int64)
    few = tokens.select((F.col("shard") % 32).alias("of"), "counts").groupBy("of").applyInArrow(add_up, "counts binary")
    for r in few.collect():  # 32 rows at most
        counts += np.frombuffer(r.counts, np.int64)
    lengths = code_lengths(counts)
    codes = codes_of(lengths)
    starts, upto = {}, 0
    for shard, n in sorted(tokens.groupBy("shard").agg(F.sum("n_ids")).collect()):  # one row a partition, whatever the corpus
        starts[shard], upto = upto, upto + n

    def store(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], kind)
                name = f"{r['shard']:08d}-{r['seq']:08d}.hti"
                content = to_bytes(np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["null"], bool), np.frombuffer(r["sizes"], "<i4"), ids, codes, lengths, starts[r["shard"]] + r["before"])
                _put(f"{folder}/{name}", content)
                yield pa.RecordBatch.from_arrays([pa.array([len(content)], pa.int64())], ["n_bytes"])

    store_at, base = fs.FileSystem.from_uri(folder)
    store_at.create_dir(base, recursive=True)
    _put(f"{folder}/codebook", zlib.compress(lengths.tobytes()))
    size = tokens.mapInArrow(store, "n_bytes long").agg(F.sum("n_bytes")).first()[0] or 0
    _put(f"{folder}/about.json", json.dumps({"vocabulary": vocabulary, "end_id": end_id, "n_ids": upto, "n_bytes": size}).encode())
    drop(tokens)


def _get(path: str) -> bytes:
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(base) as f:
        return f.read()


def read(spark, folder: str, digest_only: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of a store's documents; ``ids`` is left out if only digests are wanted."""
    lengths = np.frombuffer(zlib.decompress(_get(f"{folder}/codebook")), np.uint8)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")

    def run(batches):
        table = decode_table(lengths)
        for b in batches:
            for content in b.column("content"):
                docs, null, sizes, ids, start = from_bytes(content.as_buffer(), table)
                upto = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(upto.tolist(), sizes.tolist(), strict=True)]
                out = [pa.array(docs, mask=null), pa.array(upto - sizes + start), pa.array(sizes), pa.array(crc, pa.int64())]
                if not digest_only:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hti").load(folder).select("content")
    return files.mapInArrow(run, schema)


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
