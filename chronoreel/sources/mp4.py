"""MP4 files as tables: boxes, tracks and samples, whole or fragmented."""

from __future__ import annotations

import bisect
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "edts", "dinf", "mvex", "moof", "traf", "udta"}


def scan(data, begin: int = 0, end: int | None = None, path: str = "", depth: int = 0):
    """(path, depth, type, offset, size, header) of each box, depth first; sizes to the end and of 64 bits included."""
    end, at = len(data) if end is None else end, begin
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head, kind = 8, kind.decode("latin-1")
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        size = min(size, end - at)
        yield path + "/" + kind, depth, kind, at, size, head
        if kind in CONTAINERS:
            yield from scan(data, at + head, at + size, path + "/" + kind, depth + 1)
        at += size


def _pairs(body: bytes, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", body, 4)[0]
    return np.frombuffer(body, kind, n * columns, 8).reshape(n, columns).astype(np.int64)


def _children(data, begin, end):
    return [(k, at + head, at + size) for _, depth, k, at, size, head in scan(data, begin, end) if depth == 0]


def _find(data, begin, end, *names):
    for name in names:
        found = next(((a, b) for k, a, b in _children(data, begin, end) if k == name), None)
        if found is None:
            return None
        begin, end = found
    return begin, end


def track(data, begin: int, end: int) -> dict | None:
    """Headers and sample tables of a trak box; None if its media or table is missing."""
    media, table = _find(data, begin, end, "mdia"), _find(data, begin, end, "mdia", "minf", "stbl")
    if media is None or table is None:
        return None
    out = {"id": 0, "handler": "unkn", "timescale": 90_000, "duration": 0, "width": 0, "height": 0, "stss": None, "stts": [], "ctts": [], "stsc": [], "stsz": [], "chunks": []}
    if at := _find(data, begin, end, "tkhd"):
        b = data[at[0] : at[1]]
        out["id"] = struct.unpack_from(">I", b, 20 if b[0] else 12)[0]
        out["width"], out["height"] = (x / 65536 for x in struct.unpack_from(">II", b, len(b) - 8))
    if at := _find(data, *media, "mdhd"):
        b = data[at[0] : at[1]]
        out["timescale"], out["duration"] = struct.unpack_from(">IQ", b, 20) if b[0] else struct.unpack_from(">II", b, 12)
    if at := _find(data, *media, "hdlr"):
        out["handler"] = data[at[0] + 8 : at[0] + 12].decode("latin-1")
    for kind, a, b in _children(data, *table):
        body = bytes(data[a:b])
        if kind == "stts":
            out["stts"] = _pairs(body, 2)
        elif kind == "ctts":
            out["ctts"] = _pairs(body, 2, ">i4" if body[0] else ">u4")
        elif kind == "stsc":
            out["stsc"] = _pairs(body, 3)
        elif kind == "stss":
            out["stss"] = _pairs(body, 1)[:, 0]
        elif kind == "stsz":
            same, n = struct.unpack_from(">II", body, 4)
            out["stsz"] = np.full(n, same, np.int64) if same else np.frombuffer(body, ">u4", n, 12).astype(np.int64)
        elif kind == "stco" or kind == "co64" and not len(out["chunks"]):
            out["chunks"] = _pairs(body, 1, ">u4" if kind == "stco" else ">u8")[:, 0]
    return out


def sample_table(t: dict) -> dict[str, np.ndarray]:
    """Offsets, sizes and times of each sample, from the packed tables."""
    n = len(t["stsz"])
    grow = lambda rows: np.repeat(rows[:, 1], rows[:, 0]) if len(rows) else np.zeros(0, np.int64)
    fit = lambda a, fill: np.concatenate([a[:n], np.full(max(0, n - len(a)), fill, np.int64)])
    d = grow(t["stts"])
    d = fit(d, d[-1] if len(d) else 0)
    shift = fit(grow(t["ctts"]), 0)
    dts = np.cumsum(d) - d
    per = np.ones(len(t["chunks"]), np.int64)
    if len(t["stsc"]):
        at = np.searchsorted(t["stsc"][:, 0], np.arange(1, len(per) + 1), side="right") - 1
        per = t["stsc"][np.maximum(at, 0), 1]
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    size = t["stsz"][: len(chunk)]
    run = np.cumsum(size) - size
    first = np.concatenate(([True], chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, bool)
    offset = t["chunks"][chunk] + run - run[np.flatnonzero(first)][np.cumsum(first) - 1] if len(chunk) else run
    key = np.ones(n, bool)
    if t["stss"] is not None:
        key[:] = False
        key[t["stss"][t["stss"] <= n] - 1] = True
    m = len(chunk)
    return {"idx": np.arange(m), "dts": dts[:m], "pts": np.maximum(dts, dts + shift)[:m], "duration": d[:m], "size": size, "offset": offset, "is_key": key[:m]}


def fragment_samples(data) -> list[tuple]:
    """(track, dts, pts, duration, size, offset, is_key) of all fragments; a moof without its mdat is passed over."""
    defaults, times, out = {}, {}, []
    top = [(k, a, b, at) for _, depth, k, at, size, head in scan(data) if depth == 0 for a, b in [(at + head, at + size)]]
    mdats = [at for k, _, _, at in top if k == "mdat"]
    moofs = [at for k, _, _, at in top if k == "moof"]
    for k, a, b, at in top:
        if k == "moov" and (x := _find(data, a, b, "mvex")):
            for kind, c, _ in _children(data, *x):
                if kind == "trex":
                    i, _, *rest = struct.unpack_from(">5I", data, c + 4)
                    defaults[i] = rest
        if k != "moof":
            continue
        follow = bisect.bisect_left(mdats, at)
        later = bisect.bisect_right(moofs, at)
        if follow == len(mdats) or later < len(moofs) and moofs[later] < mdats[follow]:
            continue
        end_of = mdats[follow] + 8
        for kind, c, e in _children(data, a, b):
            if kind != "traf":
                continue
            parts = _children(data, c, e)
            head = next((x for x in parts if x[0] == "tfhd"), None)
            if head is None:
                continue
            flags, i = struct.unpack_from(">II", data, head[1])
            p, base = head[1] + 8, at
            d0, s0, f0 = defaults.get(i, [0, 0, 0])
            if flags & 1:
                base, p = struct.unpack_from(">Q", data, p)[0], p + 8
            p += 4 * bool(flags & 2)
            if flags & 8:
                d0, p = struct.unpack_from(">I", data, p)[0], p + 4
            if flags & 16:
                s0, p = struct.unpack_from(">I", data, p)[0], p + 4
            if flags & 32:
                f0 = struct.unpack_from(">I", data, p)[0]
            now = times.get(i, 0)
            for x, y, _ in parts:
                if x == "tfdt":
                    now = struct.unpack_from(">Q" if data[y] else ">I", data, y + 4)[0]
            place = end_of
            for x, y, _ in parts:
                if x != "trun":
                    continue
                bits, n = struct.unpack_from(">II", data, y)
                signed, bits, p = bits >> 24, bits & 0xFFFFFF, y + 8
                if bits & 1:
                    place, p = base + struct.unpack_from(">i", data, p)[0], p + 4
                first = None
                if bits & 4:
                    first, p = struct.unpack_from(">I", data, p)[0], p + 4
                for j in range(n):
                    d, s, f, c0 = d0, s0, f0, 0
                    if bits & 0x100:
                        d, p = struct.unpack_from(">I", data, p)[0], p + 4
                    if bits & 0x200:
                        s, p = struct.unpack_from(">I", data, p)[0], p + 4
                    if bits & 0x400:
                        f, p = struct.unpack_from(">I", data, p)[0], p + 4
                    if bits & 0x800:
                        c0, p = struct.unpack_from(">i" if signed else ">I", data, p)[0], p + 4
                    f = first if j == 0 and first is not None else f
                    out.append((i, now, now + c0, d, s, place, not f >> 16 & 1))
                    now, place = now + d, place + s
            times[i] = now
    return out


SAMPLES = "track_id long, handler string, timescale long, idx long, dts long, pts long, duration long, size long, offset long, is_key boolean, error string"


def samples(files: DataFrame, key: str = "file") -> DataFrame:
    """Samples of all tracks of each file, in ticks; a file without a moov is one row with its ``error``."""
    kind, names = dict(files.dtypes)[key], [x.split()[0] for x in SAMPLES.split(", ")]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.string()]

    def of(content: bytes):
        top = {k: (a, b) for k, a, b in _children(content, 0, len(content))}
        if "moov" not in top:
            return [(*[None] * 10, "no moov box found")]
        tracks = [t for k, a, b in _children(content, *top["moov"]) if k == "trak" if (t := track(content, a, b))]
        rows = []
        if "moof" in top:
            by = {t["id"]: t for t in tracks}
            n: dict[int, int] = {}
            for i, dts, pts, d, s, at, sync in fragment_samples(content):
                t = by.get(i, {"handler": "unkn", "timescale": 90_000})
                rows.append((i, t["handler"], t["timescale"], n.get(i, 0), dts, pts, d, s, at, sync, None))
                n[i] = n.get(i, 0) + 1
            return rows
        for t in tracks:
            x = {k: v.tolist() for k, v in sample_table(t).items()}
            rows += [(t["id"], t["handler"], t["timescale"], *r, None) for r in zip(*(x[c] for c in ("idx", "dts", "pts", "duration", "size", "offset", "is_key")), strict=True)]
        return rows

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = of(content or b"")
                first = pa.array([name] * len(rows), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([first, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [key, *names])

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, {SAMPLES}")


def boxes(files: DataFrame, key: str = "file") -> DataFrame:
    """``path, depth, type, offset, size`` of all boxes."""
    kind = dict(files.dtypes)[key]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [r[:5] for r in scan(content or b"")]
                first = pa.array([name] * len(rows), b.schema.field(0).type)
                types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([first, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [key, "path", "depth", "type", "offset", "size"])

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, path string, depth int, type string, offset long, size long")
