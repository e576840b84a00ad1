"""MPEG transport streams as tables: packets in SQL, access units by one Arrow function a file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.sinks.mpegts import PACKET, RATES

VIDEO_TYPES, AUDIO_TYPES = (0x01, 0x02, 0x1B, 0x24), (0x03, 0x04, 0x0F, 0x11, 0x81, 0x87)


def packets(files: DataFrame, key: str = "file") -> DataFrame:
    """``file, pkt, pid, pusi, has_payload`` of aligned streams, in SQL alone; a partial last packet is left out."""
    n = F.floor(F.length("content") / PACKET).cast("int")
    rows = files.where(n > 0).select(key, "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("pkt"))
    head = F.conv(F.hex(F.substring("content", F.col("pkt") * PACKET + 1, F.lit(4))), 16, 10).cast("long")
    rows = rows.select(key, F.col("pkt").cast("long").alias("pkt"), head.alias("h")).where(F.shiftright("h", 24) == 0x47)
    bits = lambda shift, mask: F.shiftright("h", shift).bitwiseAND(F.lit(mask))
    return rows.select(key, "pkt", bits(8, 0x1FFF).cast("int").alias("pid"), (bits(22, 1) == 1).alias("pusi"), (bits(4, 1) == 1).alias("has_payload"))


def read_time(b: bytes) -> int:
    """All 33 bits, by their true value."""
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def split_nals(data: bytes) -> list[bytes]:
    """Units between start codes of three or four bytes; empty ones are left out."""
    out, at = [], data.find(b"\0\0\1")
    while at >= 0:
        begin = at + 3
        at = data.find(b"\0\0\1", begin)
        end = len(data) if at < 0 else at - (at > begin and data[at - 1] == 0)
        if end > begin:
            out.append(data[begin:end])
    return out


def split_length_prefixed(data: bytes) -> list[bytes]:
    """Units each behind four bytes of length; stops at an empty one and at one that runs over."""
    out, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if n == 0 or at + 4 + n > len(data):
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def is_key(nals: list[bytes], hevc: bool = False) -> bool:
    """H.264 instant refresh; with ``hevc``, by the types 16 to 21 of H.265."""
    return any(16 <= n[0] >> 1 & 63 <= 21 for n in nals) if hevc else any(n[0] & 31 == 5 for n in nals)


class Demuxer:
    """State across calls of ``feed``: units not yet complete, audio left over, and running times."""

    def __init__(self):
        self.pmt = self.video = self.audio = self.video_type = self.audio_type = None
        self.parts: dict[int, list[bytes]] = {}
        self.units: list[tuple] = []  # kind, pts, dts, data or units
        self.rest, self.next_pts, self.rate, self.channels = b"", None, None, None
        self.stats = {"packets": 0, "skipped": 0, "lost_audio": 0}

    def feed(self, data: bytes) -> None:
        at = data.find(b"\x47")
        self.stats["skipped"] += len(data) if at < 0 else at
        while 0 <= at <= len(data) - PACKET:
            if data[at] != 0x47:  # to the next byte that may begin a packet
                found = data.find(b"\x47", at)
                self.stats["skipped"] += (len(data) if found < 0 else found) - at
                at = found
                continue
            self._packet(data[at : at + PACKET])
            at += PACKET

    def _packet(self, p: bytes) -> None:
        self.stats["packets"] += 1
        pid, start, kind = (p[1] & 31) << 8 | p[2], bool(p[1] & 64), p[3] >> 4 & 3
        if not kind & 1:
            return
        body = p[5 + p[4] :] if kind == 3 else p[4:]
        if not body:
            return
        if pid == 0:
            self._pat(body, start)
        elif pid == self.pmt:
            self._pmt(body, start)
        elif pid in (self.video, self.audio):
            if start:
                self._pes(pid)
                self.parts[pid] = []
            self.parts.setdefault(pid, []).append(body)

    def _table(self, body: bytes, start: bool) -> bytes:
        body = body[1 + body[0] :] if start else body
        return body[: 3 + ((body[1] & 15) << 8 | body[2]) - 4] if len(body) > 3 else b""

    def _pat(self, body: bytes, start: bool) -> None:
        t = self._table(body, start)
        for i in range(8, len(t) - 3, 4):
            program, pid = int.from_bytes(t[i : i + 2], "big"), int.from_bytes(t[i + 2 : i + 4], "big") & 0x1FFF
            if program and pid:
                self.pmt = pid
                return

    def _pmt(self, body: bytes, start: bool) -> None:
        t = self._table(body, start)
        i = 12 + (int.from_bytes(t[10:12], "big") & 0xFFF) if len(t) >= 12 else len(t)
        while i + 5 <= len(t):
            kind, pid = t[i], int.from_bytes(t[i + 1 : i + 3], "big") & 0x1FFF
            if kind in VIDEO_TYPES and self.video is None:
                self.video, self.video_type = pid, kind
            elif kind in AUDIO_TYPES and self.audio is None:
                self.audio, self.audio_type = pid, kind
            i += 5 + (int.from_bytes(t[i + 3 : i + 5], "big") & 0xFFF)

    def _pes(self, pid: int) -> None:
        data = b"".join(self.parts.pop(pid, []))
        if len(data) < 9 or data[:3] != b"\0\0\1":
            return
        flags, body = data[7] >> 6, data[9 + data[8] :]
        pts = read_time(data[9:14]) if flags & 2 and len(data) >= 14 else None
        dts = read_time(data[14:19]) if flags == 3 and len(data) >= 19 else pts
        if pid == self.video:
            nals = split_nals(body)
            if nals and pts is not None:
                self.units.append(("video", pts, dts, nals))
        else:
            self._frames(body, pts)

    def _frames(self, body: bytes, pts: int | None) -> None:
        data, frames, at = self.rest + body, [], 0
        self.rest = b""
        while at < len(data) - 7:
            if data[at] != 0xFF or data[at + 1] & 0xF0 != 0xF0:
                at += 1
                continue
            head, size = 7 if data[at + 1] & 1 else 9, (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
            if size < head:
                at += 1
                continue
            if at + size > len(data):
                self.rest = data[at:]
                break
            index = data[at + 2] >> 2 & 15
            if self.rate is None and index < len(RATES):
                self.rate, self.channels = RATES[index], (data[at + 2] & 1) << 2 | data[at + 3] >> 6
            frames.append(data[at + head : at + size])
            at += size
        now = self.next_pts if pts is None else pts
        for f in frames:
            if now is None:
                self.stats["lost_audio"] += 1
                continue
            self.units.append(("audio", now, now, f))
            now += int(1024 * 90_000 / (self.rate or 48_000) + 0.5)
        self.next_pts = now

    def finish(self) -> list[tuple]:
        for pid in list(self.parts):
            self._pes(pid)
        return self.units

    def error(self) -> str | None:
        """The first thing that keeps a stream from being converted."""
        if self.pmt is None:
            return "no PAT found"
        if self.video is None:
            return "no PMT found"
        if self.video_type not in (0x1B, 0x24):
            return f"unsupported video type 0x{self.video_type:02x}"
        if self.audio_type not in (None, 0x0F, 0x11):
            return f"unsupported audio type 0x{self.audio_type:02x}"
        return None if any(u[0] == "video" for u in self.units) else "no video frames found"


UNITS = "kind string, idx long, pts long, dts long, is_key boolean, size long, nals array<binary>, error string"


def units(files: DataFrame, key: str = "file", payload: bool = True) -> DataFrame:
    """Access units of each file ``kind, idx, pts, dts, is_key, size, nals``; a bad file is one row with its ``error``.

    Sizes are those of units without start codes, access unit delimiters and parameter sets.
    """
    kind = dict(files.dtypes)[key]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = Demuxer()
                d.feed(content or b"")
                d.finish()
                rows, n, problem = [], {"video": 0, "audio": 0}, d.error()
                if problem:
                    rows.append((None, None, None, None, None, None, None, problem))
                for k, pts, dts, data in [] if problem else d.units:
                    nals = [data] if k == "audio" else [x for x in data if x[0] & 31 not in (7, 8, 9)]
                    rows.append((k, n[k], pts, dts, k == "audio" or is_key(data), sum(map(len, nals)), nals if payload else None, None))
                    n[k] += 1
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.binary()), pa.string()]
                names = [x.split()[0] for x in UNITS.split(", ")]
                first = pa.array([name] * len(rows), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([first, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [key, *names])

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, {UNITS}")
