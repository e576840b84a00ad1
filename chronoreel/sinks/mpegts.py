"""Access units to MPEG transport streams."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Packet identifiers of a written stream; fixed values.
PMT_PID, VIDEO_PID, AUDIO_PID = 0x100, 0x101, 0x102
PACKET = 188
AUD = b"\0\0\0\1\x09\xf0"
#: Sampling rates in the order of their index in an ADTS header; fixed values.
RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: not reflected, started from all ones, not inverted."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def adts_header(size: int, rate: int, channels: int, fallback: int = 3) -> bytes:
    """Seven bytes before an AAC frame of ``size`` bytes; an unknown rate has the index ``fallback``."""
    index, n = RATES.index(rate) if rate in RATES else fallback, size + 7
    return bytes([0xFF, 0xF1, 1 << 6 | index << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 0xFF, (n & 7) << 5 | 0x1F, 0xFC])


def timestamp(prefix: int, t: int) -> bytes:
    """33 bits in five bytes, marker bits between."""
    return bytes([prefix << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def pes(stream: int, payload: bytes, pts: int, dts: int | None = None) -> bytes:
    two = dts is not None and dts != pts
    times = timestamp(3, pts) + timestamp(1, dts) if two else timestamp(2, pts)
    size = len(payload) + 3 + len(times)
    return b"\0\0\1" + bytes([stream]) + (size if size < 65536 and stream != 0xE0 else 0).to_bytes(2, "big") + bytes([0x80, 0xC0 if two else 0x80, len(times)]) + times + payload


def section(table: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 4).to_bytes(2, "big")
    return b"\0" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


class Muxer:
    """Packets of one stream; counts continuity by identifier."""

    def __init__(self, audio: bool, sps: bytes = b"", pps: bytes = b""):
        self.audio, self.sps, self.pps, self.out, self.count = audio, sps, pps, [], {}

    def packets(self, pid: int, data: bytes, pcr: int | None = None) -> None:
        at, first = 0, True
        while at < len(data) or first:
            n = self.count.get(pid, 0)
            self.count[pid] = n + 1
            field = b""
            if first and pcr is not None:
                base = pcr & (1 << 33) - 1
                field = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            left = len(data) - at
            if left < room:  # the rest is stuffed, never padded behind the payload
                pad = room - left
                if field:
                    field += b"\xff" * pad
                elif pad > 1:
                    field = b"\0" + b"\xff" * (pad - 2)
                adapt = bytes([len(field)]) + field
            else:
                adapt = bytes([len(field)]) + field if field else b""
            size = PACKET - 4 - len(adapt)
            head = bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 0xFF, (0x30 if adapt else 0x10) | n & 15])
            self.out.append(head + adapt + data[at : at + size])
            at, first = at + size, False

    def tables(self) -> None:
        pat = section(0, (1).to_bytes(2, "big") + b"\xc1\0\0" + (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
        streams = [(0x1B, VIDEO_PID)] + [(0x0F, AUDIO_PID)] * self.audio
        body = (1).to_bytes(2, "big") + b"\xc1\0\0" + (0xE000 | VIDEO_PID).to_bytes(2, "big") + b"\xf0\0"
        body += b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" for kind, pid in streams)
        for pid, part in ((0, pat), (PMT_PID, section(2, body))):
            self.packets(pid, part + b"\xff" * (PACKET - 4 - len(part)))

    def video(self, nals: Iterable[bytes], pts: int, dts: int, key: bool) -> None:
        """An access unit; a key frame comes with the tables and with one pair of parameter sets."""
        nals = list(nals)
        if key:
            self.tables()
            if self.sps:
                nals = [self.sps, self.pps, *(n for n in nals if n[0] & 31 not in (7, 8))]
        self.packets(VIDEO_PID, pes(0xE0, AUD + b"".join(b"\0\0\0\1" + n for n in nals), pts, dts), dts if key else None)

    def sound(self, frames: bytes, pts: int) -> None:
        self.packets(AUDIO_PID, pes(0xC0, frames, pts))

    def build(self) -> bytes:
        return b"".join(self.out)


def write(units: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """``file, content`` from units ``kind, pos, pts, dts, is_key, data``: in order of ``pos``, video and audio interleaved.

    A file's bytes come together in one task; split long ones by groups of pictures first.
    """

    def mux(key, t):
        rows = t.sort_by("pos").to_pylist()
        m = Muxer(any(r["kind"] == "audio" for r in rows), b"\x67\x42\0\x1e\xab", b"\x68\xce\x38\x80")
        if not any(r["is_key"] and r["kind"] == "video" for r in rows[:1]):
            m.tables()
        for r in rows:
            if r["kind"] == "video":
                m.video([r["data"]], r["pts"], r["dts"], r["is_key"])
            else:
                m.sound(adts_header(len(r["data"]), 48_000, 2) + r["data"], r["pts"])
        return pa.table({**{n: [k.as_py()] for n, k in zip(keys, key, strict=True)}, "content": pa.array([m.build()], pa.binary())})

    types = dict(units.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["content binary"])
    return units.select(*keys, "kind", F.col("pos").cast("long"), "pts", "dts", "is_key", "data").groupBy(*keys).applyInArrow(mux, schema)
