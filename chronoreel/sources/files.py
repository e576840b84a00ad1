"""Media files as rows, byte ranges of them read by position, and payloads of samples."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``file, size, content`` of each file below ``path``; without ``content`` in a query no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    reader = reader if glob is None else reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), "content")


def _open(file: str):
    """An input of a file or address, for reads by position."""
    if "://" in file:
        system, path = pafs.FileSystem.from_uri(file)
    else:
        system, path = pafs.LocalFileSystem(), unquote(urlsplit(file).path) if file.startswith("file:") else file
    return system.open_input_file(path)


def read_ranges(ranges: DataFrame, key: str = "file") -> DataFrame:
    """``ranges`` with ``content``, the bytes from ``start`` to ``end`` (not included); nothing else of a file is read.

    A range that runs over the end gets what is there. Rows of one file that stand together share one open input.
    """
    names = ranges.columns
    at = [names.index(c) for c in (key, "start", "end")]

    def run(batches):
        for b in batches:
            last, source = None, None
            for i, (file, start, end) in enumerate(zip(*(b.column(c).to_pylist() for c in at), strict=True)):
                if file != last:
                    last, source = file, _open(file)
                start = min(start, source.size())
                content = source.read_at(max(0, min(end, source.size()) - start), start)
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([content], pa.binary())], [*names, "content"])

    return ranges.mapInArrow(run, ranges.selectExpr("*", "cast(null AS binary) AS content").schema)


def payloads(files: DataFrame, samples: DataFrame, key: str = "file") -> DataFrame:
    """Samples ``track_id, idx`` with ``data``, their bytes by ``offset`` and ``size``; a file's content moves once."""
    own = samples.groupBy(key).agg(F.collect_list(F.struct("track_id", "idx", F.col("offset").cast("int").alias("o"), F.col("size").cast("int").alias("n"))).alias("_s"))
    cut = F.transform("_s", lambda x: F.struct(x["track_id"].alias("track_id"), x["idx"].alias("idx"), F.substring("content", x["o"] + 1, x["n"]).alias("data")))
    return files.select(key, "content").join(own, key).select(key, F.explode(cut).alias("s")).select(key, "s.*")
