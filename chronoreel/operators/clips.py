"""Clips of tracks other than video, joins by bands and ranks, and small reshapes of samples.

Bounds are found in one sort of samples and bounds together, and samples meet clips by blocks
of their index, so no join pairs all samples of a track with all its clips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.scalar import jsround

#: Samples of a block that clips are matched by.
BLOCK = 1_024
#: Rows of a table of requests that is still sent to all tasks.
FEW = 100_000


def if_small(requests: DataFrame) -> DataFrame:
    """Marked for a broadcast if counted to be of few rows; else Catalyst chooses."""
    return F.broadcast(requests) if requests.limit(FEW + 1).count() <= FEW else requests


def with_defaults(samples: DataFrame, *columns: str) -> DataFrame:
    """Missing numbers are 0; flags stay as they are."""
    return samples.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(samples.schema[c].dataType)) for c in columns})


def to_ticks(samples: DataFrame, timescale: int) -> DataFrame:
    """``duration, offset_ticks, flags`` in ticks from times in seconds; flags say that a sample isn't a sync sample."""
    return samples.withColumns(
        {
            "offset_ticks": jsround((F.col("pts") - F.col("dts")) * timescale),
            "duration": jsround(F.col("duration") * timescale),
            "flags": F.when(F.col("is_key"), 0).otherwise(0x10000).cast("long"),
        }
    )


def whole_samples(samples: DataFrame, file_size: Column) -> DataFrame:
    """Samples whose bytes all lie inside the file."""
    return samples.where(F.col("offset") + F.col("size") <= file_size)


def playback_duration(total: Column, preroll: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), total - preroll)


def relative_range(start: Column, end: Column, actual_start: Column) -> tuple[Column, Column]:
    """A range on the time of segments that begin at ``actual_start``; open ends stay open."""
    return F.when(start.isNotNull(), F.greatest(F.lit(0.0), start - actual_start)), end - actual_start


def edit_time(preroll: Column, first_pts: Column, rate: Column | None = None) -> Column:
    """Media time of an edit list: the pre-roll, else the first presentation time, for sound in its own rate; null needs no list."""
    own = F.when(preroll > 0, preroll).otherwise(first_pts)
    own = own if rate is None else jsround(own.cast("double") * rate / 90_000)
    return F.nullif(own, F.lit(0).cast("long"))


def info(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by kind, key frames of video, and whether pictures are out of order."""
    video = F.col("handler") == "vide"
    return samples.groupBy(*keys).agg(
        F.count_if(video).alias("video_samples"),
        F.count_if(F.col("handler") == "soun").alias("audio_samples"),
        F.count_if(video & F.col("is_key")).alias("keyframes"),
        F.coalesce(F.bool_or(F.when(video, F.col("pts") != F.col("dts"))), F.lit(False)).alias("has_b_frames"),
    )


def reach(samples: DataFrame, bounds: DataFrame, keys: list[str], *carry: str) -> DataFrame:
    """``bounds`` with ``idx``: the first sample in decode order with a presentation time not before ``bound``, or null; ``carry`` of it too.

    The greatest time so far reaches a bound where the first such sample stands.
    """
    up_to = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None).cast(bounds.schema)
    a = samples.select(*keys, F.max("pts").over(up_to).alias("_t"), F.lit(1).alias("_k"), F.col("idx").alias("_i"), F.struct("idx", *carry).alias("_v"), none.alias("_b"))
    empty = [F.lit(None).cast(a.schema[c].dataType).alias(c) for c in ("_i", "_v")]
    b = bounds.select(*keys, F.col("bound").alias("_t"), F.lit(0).alias("_k"), *empty, F.struct(*bounds.columns).alias("_b"))
    # from the latest time down: the last sample met is the first that reaches the bound
    down = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_k"), F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_f", F.last("_v", True).over(down))
    return both.where("_k = 0").select("_b.*", *[F.col(f"_f.{c}").alias(c) for c in ("idx", *carry)])


def within(samples: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of each span ``first`` to ``stop`` (not included), joined by blocks of the index."""
    blocks = F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(stop - 1) div {BLOCK}"))
    cells = spans.where("first < stop").withColumn("_block", F.explode(blocks))
    rows = samples.withColumn("_block", F.expr(f"idx div {BLOCK}"))
    return rows.join(cells, [*keys, "_block"]).where("idx >= first AND idx < stop").drop("_block")


def clip_other(samples: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rid, idx, dts, pts, duration, playback``: samples of tracks without key frames in each range, times from the first.

    A range ``rid, s, e`` in ticks begins at the first sample not before ``s`` and ends before
    the next not before ``e``, null for open: a stretch in decode order. Playback lasts as long
    as the range, no longer than the samples. A range that meets nothing has no rows.
    """
    own = with_defaults(samples.select(*keys, "idx", "dts", "pts", "duration"), "dts", "pts", "duration")
    asked = own.groupBy(*keys).agg((F.max("idx") + 1).alias("_n")).crossJoin(ranges).withColumn("s", F.coalesce("s", F.lit(0).cast("long")))
    first = reach(own, asked.withColumn("bound", F.col("s")), keys).withColumnRenamed("idx", "first").drop("bound").where("first IS NOT NULL")
    stop = reach(own, first.withColumn("bound", F.coalesce("e", F.lit((1 << 63) - 1))), keys).withColumnRenamed("idx", "stop")
    spans = stop.withColumn("stop", F.when(F.col("e") <= F.col("s"), F.col("first")).otherwise(F.coalesce("stop", "_n"))).select(*keys, "rid", "s", "e", "first", "stop")
    rows = within(own, spans, keys)
    w = Window.partitionBy(*keys, "rid")
    total = F.sum("duration").over(w)
    base = F.min(F.struct("idx", "dts")).over(w)["dts"]
    return rows.select(
        *keys, "rid", "idx", (F.col("dts") - base).alias("dts"), (F.col("pts") - base).alias("pts"), "duration", F.least(F.coalesce(F.col("e") - F.col("s"), total), total).alias("playback")
    )


def in_segments(points: DataFrame, segments: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Points with the segment ``seg, start, end`` that holds them, ends excluded; points outside all segments go.

    Segments of a group don't overlap. One sort of both; each point looks at the last segment begun.
    """
    w = Window.partitionBy(*keys).orderBy("_t", "_k", "_s").rowsBetween(Window.unboundedPreceding, 0)
    span = F.struct("seg", "end")
    a = segments.where("start < end").select(*keys, F.col("start").alias("_t"), F.lit(0).alias("_k"), span.alias("_s"))
    b = points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(a.schema["_s"].dataType).alias("_s"), F.struct(*points.columns).alias("_p"))
    both = a.withColumn("_p", F.lit(None).cast(b.schema["_p"].dataType)).unionByName(b)
    return both.withColumn("_f", F.last("_s", True).over(w)).where("_k = 1 AND _t < _f.end").select("_p.*", F.col("_f.seg").alias("seg"))


def match_by_rank(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows at the same place of two ordered lists; what one list has more is left out."""
    place = lambda df, by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return place(left, left_order).join(place(right, right_order), [*keys, "_r"]).drop("_r")
