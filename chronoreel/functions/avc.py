"""Parameter sets of H.264 streams: picture sizes, and the first sets of a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: Profiles whose set tells the chroma format and scaling lists; fixed values.
HIGH = (100, 110, 122, 244, 44, 83, 86, 118, 128)
#: The size where a set is missing or ends early.
DEFAULT = (1920, 1080)


class Bits:
    """Reads single bits and Exp-Golomb numbers; beyond the end it raises."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int = 1) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def number(self) -> int:
        zeros = 0
        while not self.take():
            zeros += 1
        return (1 << zeros) - 1 + self.take(zeros)

    def skip(self, n: int) -> None:
        for _ in range(n):
            self.number()


def picture_size(sps: bytes | None) -> tuple[int, int]:
    """Width and height that a sequence parameter set gives, cropping of two pixels a step in both directions."""
    if not sps or len(sps) < 4:
        return DEFAULT
    bits = Bits(sps[4:])
    try:
        bits.skip(1)
        if sps[1] in HIGH:
            chroma = bits.number()
            bits.take(chroma == 3)
            bits.skip(2)
            bits.take()
            if bits.take():
                for i in range(12 if chroma == 3 else 8):
                    if bits.take():
                        bits.skip(16 if i < 6 else 64)
        bits.skip(1)
        order = bits.number()
        if order == 0:
            bits.skip(1)
        elif order == 1:
            bits.take()
            bits.skip(2)
            bits.skip(bits.number())
        bits.skip(1)
        bits.take()
        across, down = bits.number() + 1, bits.number() + 1
        frames = bits.take()
        bits.take(1 if frames else 2)
        left, right, top, bottom = [bits.number() for _ in range(4)] if bits.take() else (0, 0, 0, 0)
    except EOFError:
        return DEFAULT
    return 16 * across - 2 * (left + right), 16 * down * (2 - frames) - 2 * (top + bottom)


def build_sps(width: int, height: int, level: int = 30) -> bytes:
    """A baseline sequence parameter set for pictures of an even size, without escapes of start codes."""
    out = ""

    def number(n: int) -> None:
        nonlocal out
        out += "0" * ((n + 1).bit_length() - 1) + f"{n + 1:b}"

    across, down = -(-width // 16), -(-height // 16)
    for n in (0, 0, 2, 1):
        number(n)
    out += "0"
    number(across - 1)
    number(down - 1)
    out += "11"
    crop = (16 * across - width) // 2, (16 * down - height) // 2
    out += "1" if any(crop) else "0"
    for n in (0, crop[0], 0, crop[1]) if any(crop) else ():
        number(n)
    out += "01"
    out += "0" * (-len(out) % 8)
    return bytes([0x67, 66, 0, level]) + int(out, 2).to_bytes(len(out) // 8, "big")


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def sps_size(sps: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([picture_size(x) for x in sps], columns=["width", "height"])


@F.pandas_udf(BinaryType())
def make_sps(width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([build_sps(int(w), int(h)) for w, h in zip(width, height, strict=True)], dtype=object)


def nal_type(nal: Column) -> Column:
    return F.conv(F.hex(F.substring(nal, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(31))


def first_sets(units: DataFrame, keys: list[str]) -> DataFrame:
    """``sps, pps`` of each group: the first units of type 7 and 8 in order of ``idx``, null where there are none."""
    rows = units.select(*keys, "idx", F.posexplode("nals").alias("pos", "nal")).withColumn("t", nal_type(F.col("nal"))).where("t IN (7, 8)")
    first = lambda t: F.min_by(F.when(F.col("t") == t, F.col("nal")), F.when(F.col("t") == t, F.struct("idx", "pos")))
    found = rows.groupBy(*keys).agg(first(7).alias("sps"), first(8).alias("pps"))
    return units.select(*keys).distinct().join(found, keys, "left")
