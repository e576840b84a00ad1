"""Scalar functions of media timelines, as column expressions."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte that each packet of a transport stream begins with, and its length.
SYNC, PACKET = 0x47, 188

#: Elementary stream types; fixed values.
STREAM_TYPES = (
    (0x01, "MPEG-1 Video", False),
    (0x02, "MPEG-2 Video", False),
    (0x03, "MPEG-1 Audio", False),
    (0x04, "MPEG-2 Audio", False),
    (0x0F, "AAC", True),
    (0x11, "AAC-LATM", True),
    (0x1B, "H.264/AVC", True),
    (0x24, "H.265/HEVC", True),
    (0x81, "AC-3", False),
    (0x87, "E-AC-3", False),
)


def jsround(x: Column) -> Column:
    """Half up towards positive infinity: -2.5 gives -2."""
    return F.floor(x + F.lit(0.5)).cast("long")


def big_endian(content: Column, offset, size: int) -> Column:
    """Unsigned integer of ``size`` bytes at a 0-based offset, by its true value."""
    part = F.substring(content, (offset if isinstance(offset, Column) else F.lit(offset)) + 1, F.lit(size))
    return F.conv(F.hex(part), 16, 10).cast("decimal(20,0)").cast("long")


def box_type(content: Column, offset) -> Column:
    return F.decode(F.substring(content, (offset if isinstance(offset, Column) else F.lit(offset)) + 5, F.lit(4)), "ISO-8859-1")


def rescale(ticks: Column, to: Column, of: Column) -> Column:
    """Ticks of one timescale in another; unscaled if it has none."""
    return F.when(of > 0, jsround(ticks * to / of)).otherwise(ticks)


def seconds(ticks: Column, timescale) -> Column:
    return ticks.cast("double") / timescale


def size_label(size: Column) -> Column:
    """Megabytes with two decimals from 1 MiB on, ties to even, else kilobytes with one, ties up; null of null."""
    mb = F.format_string("%.2f MB", F.bround(size / F.lit(1048576.0), 2))
    kb = F.format_string("%.1f KB", F.floor(size / F.lit(1024.0) * 10 + 0.5) / F.lit(10.0))
    return F.when(size >= 1048576, mb).when(size < 1048576, kb)


def fixed(x: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", x.cast("double"))


def absolute_url(rel: Column, base: Column) -> Column:
    """``rel`` against ``base``, as URLs resolve: from a scheme, a host, the root, a query or beside the base; dots in the path are worked off."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.regexp_replace(base, r"#.*$", "")
    plain = F.regexp_replace(whole, r"\?.*$", "")
    folder = F.when(plain == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))
    found = (
        F.when(rel.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), rel)
        .when(rel.startswith("//"), F.concat(scheme, rel))
        .when(rel.startswith("/"), F.concat(root, rel))
        .when(rel.startswith("?"), F.concat(plain, rel))
        .when(rel.startswith("#") | (rel == ""), F.concat(whole, rel))
        .otherwise(F.concat(folder, rel))
    )
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(/[^?#]*)(.*)$"
    part = lambda i: F.regexp_extract(found, shape, i)
    steps = F.split(F.substring(part(2), 2, 1 << 30), "/")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    open_end = F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0)
    path = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))
    return F.when(part(2).rlike(r"/\.\.?(/|$)"), F.concat(part(1), path, part(3))).otherwise(found)


def quality_name(resolution: Column, bandwidth: Column) -> Column:
    kbps = F.when(bandwidth != 0, F.concat(jsround(bandwidth / 1000).cast("string"), F.lit("kbps")))
    return F.coalesce(resolution, kbps, F.lit("unknown"))


def is_playlist_url(url: Column) -> Column:
    low = F.lower(url)
    return low.contains(".m3u8") | low.contains("format=m3u8")


def output_name(url: Column) -> Column:
    """Last part of a path without its query, transport stream and segment endings made mp4."""
    last = F.element_at(F.split(F.regexp_replace(url, r"\?.*$", ""), "/"), -1)
    return F.regexp_replace(last, r"\.(ts|m4s)$", ".mp4")


def is_sync(flags: Column) -> Column:
    """No flags, or the bit for non-sync samples clear."""
    return flags.isNull() | (F.shiftright(flags, 16).bitwiseAND(F.lit(1)) == 0)


def format_of(data: bytes | None) -> str:
    """``mpegts``, ``mp4``, ``fmp4`` or ``unknown``, in this order: by the sync byte, first or twice a packet apart, and the types of the boxes at the top."""
    data = data or b""
    if len(data) >= 4 and (data[0] == SYNC or any(data[i] == SYNC == data[i + PACKET] for i in range(min(PACKET, max(0, len(data) - PACKET))))):
        return "mpegts"
    first, kinds, at = data[4:8], set(), 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if size < 8:
            break
        kinds.add(kind)
        at += size
    if len(data) >= 12 and first == b"ftyp" and b"moov" in kinds and b"moof" not in kinds:
        return "mp4"
    return "fmp4" if first in (b"ftyp", b"styp", b"moof") else "unknown"


def media_format(content: Column) -> Column:
    """``format_of`` each file's bytes, a batch at a time."""

    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        return files.map(format_of)

    return run(content)
