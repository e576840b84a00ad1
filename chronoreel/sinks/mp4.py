"""Samples to MP4 files, whole or in fragments."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The transformation matrix of an unturned picture; fixed values.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode("latin-1")) + body


def full_box(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def runs(values: list[int]) -> list[tuple[int, int]]:
    """(count, value) of equal neighbours."""
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [tuple(x) for x in out]


def durations(dts: list[int], default: int = 3_003) -> list[int]:
    """Steps of decode time; the last is that of the last run that is closed, ``default`` if only one is open."""
    steps = [b - a for a, b in zip(dts, dts[1:], strict=False)]
    found = runs(steps)
    return steps + [found[-2][1] if len(found) > 1 else default]


def avc_config(sps: bytes, pps: bytes) -> bytes:
    return box("avcC", bytes([1, *sps[1:4], 0xFF, 0xE1]), struct.pack(">H", len(sps)), sps, b"\1", struct.pack(">H", len(pps)), pps)


def descriptor(rate: int, channels: int, rates: tuple[int, ...]) -> bytes:
    index = rates.index(rate) if rate in rates else 3
    own = struct.pack(">H", 2 << 11 | index << 7 | channels << 3)
    decoder = b"\x40\x15" + bytes(11) + b"\5" + bytes([len(own)]) + own
    body = struct.pack(">HB", 1, 0) + b"\4" + bytes([len(decoder)]) + decoder + b"\6\1\2"
    return full_box("esds", 0, 0, b"\3", bytes([len(body)]), body)


def sample_entry(track: dict) -> bytes:
    from chronoreel.sinks.mpegts import RATES

    if track["handler"] == "vide":
        head = bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HHIIIH", track.get("width", 1920), track.get("height", 1080), 0x480000, 0x480000, 0, 1) + bytes(32) + struct.pack(">Hh", 24, -1)
        entry = box("avc1", head, avc_config(track.get("sps") or b"\x67\x42\0\x1e\xab", track.get("pps") or b"\x68\xce\x38\x80"))
    else:
        rate, channels = track.get("rate", 48_000), track.get("channels", 2)
        entry = box("mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHIHH", channels, 16, 0, rate & 0xFFFF, 0), descriptor(rate, channels, RATES))
    return full_box("stsd", 0, 0, struct.pack(">I", 1), entry)


def sample_tables(samples: list[dict], length: list[int], offset: int) -> bytes:
    """All samples of a track in one chunk at ``offset``."""
    pairs = lambda kind, rows, code=">II": full_box(kind, 0, 0, struct.pack(">I", len(rows)), *(struct.pack(code, *r) for r in rows))
    shift = [s["pts"] - s["dts"] for s in samples]
    out = [pairs("stts", runs(length))]
    if any(shift) and len(samples) > 1:  # one sample can't be out of order, and an offset would put it beyond the track's end
        rows = runs(shift)
        out.append(full_box("ctts", 1 if min(shift) < 0 else 0, 0, struct.pack(">I", len(rows)), *(struct.pack(">Ii" if min(shift) < 0 else ">II", *r) for r in rows)))
    keys = [i + 1 for i, s in enumerate(samples) if s["is_key"]]
    if 0 < len(keys) < len(samples):
        out.append(full_box("stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)))
    out.append(full_box("stsc", 0, 0, struct.pack(">IIII", 1, 1, len(samples), 1)))
    out.append(full_box("stsz", 0, 0, struct.pack(f">II{len(samples)}I", 0, len(samples), *(len(s["data"]) for s in samples))))
    out.append(full_box("co64", 0, 0, struct.pack(">IQ", 1, offset)) if offset >= 1 << 32 else full_box("stco", 0, 0, struct.pack(">II", 1, offset)))
    return b"".join(out)


def edit_list(media_time: int, length: int) -> bytes:
    return box("edts", full_box("elst", 0, 0, struct.pack(">IIiI", 1, length, media_time, 0x10000))) if media_time else b""


def track_box(track: dict, samples: list[dict], length: list[int], offset: int, movie_scale: int) -> bytes:
    scale, total = track["timescale"], sum(length)
    movie = int(total * movie_scale / scale + 0.5)
    sound = track["handler"] == "soun"
    size = struct.pack(">II", 0 if sound else track.get("width", 1920) << 16, 0 if sound else track.get("height", 1080) << 16)
    head = full_box("tkhd", 1, 3, struct.pack(">QQIIQ", 0, 0, track["id"], 0, movie), bytes(8), struct.pack(">HHHH", 0, 0, 0x100 if sound else 0, 0), MATRIX, size)
    media = full_box("mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, scale, total, 0x55C4, 0))
    handler = full_box("hdlr", 0, 0, bytes(4), track["handler"].encode(), bytes(12), b"media\0")
    info = full_box("smhd", 0, 0, bytes(4)) if sound else full_box("vmhd", 0, 1, bytes(8))
    data = box("dinf", full_box("dref", 0, 0, struct.pack(">I", 1), full_box("url ", 0, 1)))
    table = box("stbl", sample_entry(track), sample_tables(samples, length, offset))
    return box("trak", head, edit_list(track.get("media_time", 0), movie), box("mdia", media, handler, box("minf", info, data, table)))


def movie_header(scale: int, duration: int, next_id: int) -> bytes:
    return full_box("mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, scale, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", next_id))


def build(tracks: list[tuple[dict, list[dict]]], movie_scale: int = 90_000) -> bytes:
    """ftyp, moov and mdat: track by track. Laid out once for the header's size, once with true offsets."""
    head, base = box("ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2avc1mp41"), 0
    length = [t.get("lengths") or durations([s["dts"] for s in samples]) for t, samples in tracks]
    for _ in range(2):
        at, parts = base, []
        for (t, samples), n in zip(tracks, length, strict=True):
            parts.append(track_box(t, samples, n, at, movie_scale))
            at += sum(len(s["data"]) for s in samples)
        total = max((int(sum(n) * movie_scale / t["timescale"] + 0.5) for (t, _), n in zip(tracks, length, strict=True)), default=0)
        moov = box("moov", movie_header(movie_scale, total, max((t["id"] for t, _ in tracks), default=0) + 1), *parts)
        base = len(head) + len(moov) + 8
    return head + moov + box("mdat", *(s["data"] for _, samples in tracks for s in samples))


def init_segment(tracks: list[dict], movie_scale: int = 90_000) -> bytes:
    """ftyp and moov without samples, with defaults for fragments."""
    extends = box("mvex", *(full_box("trex", 0, 0, struct.pack(">IIIII", t["id"], 1, 0, 0, 0)) for t in tracks))
    empty = [track_box(t, [], [], 0, movie_scale) for t in tracks]
    return box("ftyp", b"iso5", struct.pack(">I", 0x200), b"iso5iso6mp41") + box("moov", movie_header(movie_scale, 0, max((t["id"] for t in tracks), default=0) + 1), *empty, extends)


def fragment(sequence: int, tracks: list[tuple[dict, list[dict], list[int]]]) -> bytes:
    """moof and mdat; offsets count from the start of the moof."""
    moof = b""
    for _ in range(2):
        at, parts = len(moof) + 8, []
        for t, samples, length in tracks:
            head = full_box("tfhd", 0, 0x20000, struct.pack(">I", t["id"]))
            base = full_box("tfdt", 1, 0, struct.pack(">Q", samples[0]["dts"]))
            rows = b"".join(struct.pack(">IIIi", n, len(s["data"]), 0x02000000 if s["is_key"] else 0x01010000, s["pts"] - s["dts"]) for s, n in zip(samples, length, strict=True))
            parts.append(box("traf", head, base, full_box("trun", 1, 0xF01, struct.pack(">Ii", len(samples), at), rows)))
            at += sum(len(s["data"]) for s in samples)
        moof = box("moof", full_box("mfhd", 0, 0, struct.pack(">I", sequence)), *parts)
    return moof + box("mdat", *(s["data"] for _, samples, _ in tracks for s in samples))


def write(samples: DataFrame, keys: tuple[str, ...] = ("file",), timescale: int = 90_000, fragments: int | None = None) -> DataFrame:
    """``file, content`` from samples ``track_id, handler, idx, dts, pts, is_key, data``; with ``fragments``, so many samples in each."""

    def mux(key, t):
        tracks: dict[int, tuple[dict, list[dict]]] = {}
        for r in t.sort_by([("track_id", "ascending"), ("idx", "ascending")]).to_pylist():
            tracks.setdefault(r["track_id"], ({"id": r["track_id"], "handler": r["handler"], "timescale": timescale}, []))[1].append(r)
        rows = list(tracks.values())
        if fragments is None:
            content = build(rows)
        else:
            parts = [init_segment([t for t, _ in rows])]
            length = {t["id"]: (lambda s: s + [s[-1] if s else 3_003])([b["dts"] - a["dts"] for a, b in zip(x, x[1:], strict=False)]) for t, x in rows}
            for n, i in enumerate(range(0, max(len(x) for _, x in rows), fragments)):
                parts.append(fragment(n + 1, [(t, x[i : i + fragments], length[t["id"]][i : i + fragments]) for t, x in rows if x[i : i + fragments]]))
            content = b"".join(parts)
        return pa.table({**{n: [k.as_py()] for n, k in zip(keys, key, strict=True)}, "content": pa.array([content], pa.binary())})

    types = dict(samples.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["content binary"])
    return samples.select(*keys, "track_id", "handler", F.col("idx").cast("long"), "dts", "pts", "is_key", "data").groupBy(*keys).applyInArrow(mux, schema)
