"""Canonical sample timeline and stream analysis.

A timeline is a table with one row per sample: ``track, idx, dts, pts, duration,
size, offset, is_key``, times in integer ticks, ``idx`` the decode order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.operators.clips import if_small, reach, within

EPOCH_US = 1_704_067_200_000_000


def from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of a user as the samples of a track, at 90 kHz."""
    w = Window.partitionBy("track").orderBy("ts", "event_id")
    order = Window.partitionBy("track").orderBy("idx")
    return (
        events.select(F.col("user_id").alias("track"), "ts", "event_id", "event_type", "value")
        .withColumn("idx", F.row_number().over(w).cast("long") - 1)
        .withColumn("dts", F.expr(f"((unix_micros(cast(ts as timestamp)) - {EPOCH_US}) * 9) div 100"))
        .select(
            "track",
            "idx",
            "dts",
            (F.col("dts") + (F.col("event_id") % 3) * F.lit(5_000_000_000)).alias("pts"),
            (F.floor("value") + 1).cast("long").alias("size"),
            (F.col("event_type") == "signup").alias("is_key"),
            *keep,
        )
        .withColumn("duration", F.lead("dts").over(order) - F.col("dts"))
        .withColumn("offset", exclusive_sum("size", ["track"], "idx"))
    )


def exclusive_sum(value: str, keys: list[str], order: str):
    """Sum of the rows before this one, 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def analyze(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Frames, key frames, presentation span and the key list of each track, in decode order."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        F.count_if("is_key").alias("keys"),
        (F.max("pts") - F.min("pts")).alias("span"),
        F.array_sort(F.collect_list(F.when(F.col("is_key"), F.struct("idx", "pts")))).alias("keyframes"),
    )


# --- rebasing, prefix sums and runs ------------------------------------------------------


def normalise(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Both times from the least presentation time of the whole group; decode times may turn negative."""
    base = F.min("pts").over(Window.partitionBy(*keys))
    return samples.withColumns({"pts": F.col("pts") - base, "dts": F.col("dts") - base})


def rebase(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Both times from the first decode time of each track by itself."""
    base = F.first("dts").over(Window.partitionBy(*keys).orderBy("idx"))
    return samples.withColumns({"pts": F.col("pts") - base, "dts": F.col("dts") - base})


def fill_forward(samples: DataFrame, keys: list[str], value: str, step: str) -> DataFrame:
    """Missing times go on from the last known one by a step a row; before the first they stay missing."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("t"), F.col("idx").alias("i"))), True).over(w)
    return samples.withColumn("_a", anchor).withColumn(value, F.col("_a.t") + (F.col("idx") - F.col("_a.i")) * F.col(step)).drop("_a")


def display_timeline(samples: DataFrame, keys: list[str], single: int = 3_000) -> DataFrame:
    """``frame, start, end`` in display order; the last lasts as long as the one before, a single one ``single`` ticks."""
    w = Window.partitionBy(*keys).orderBy("pts", "idx")
    after = F.lead("pts").over(w)
    last = F.coalesce(F.col("pts") - F.lag("pts").over(w), F.lit(single))
    return samples.select(
        *keys, (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("pts").alias("start"), F.coalesce(after, F.col("pts") + last).alias("end")
    )


def run_lengths(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``run, count, value``: equal neighbours in order as one row."""
    w = Window.partitionBy(*keys).orderBy("idx")
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag("idx").over(w).isNotNull(), 0).otherwise(1)
    runs = samples.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1)
    return runs.groupBy(*keys, "run").agg(F.count("*").alias("count"), F.first(value).alias("value"))


def expand_runs(runs: DataFrame, keys: list[str], count: str = "count", value: str = "value") -> DataFrame:
    """The inverse: ``idx, value`` for each repetition, numbered over the whole of a group."""
    w = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(count).over(w), F.lit(0))
    return (
        runs.where(F.col(count) > 0)
        .withColumn("_b", begin)
        .select(*keys, "_b", F.col(value).alias("value"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias("_i"))
        .select(*keys, (F.col("_b") + F.col("_i")).alias("idx"), "value")
    )


def video_stts(samples: DataFrame, keys: list[str], default: int = 3_003) -> DataFrame:
    """Durations of a video track as runs ``run, count, value``.

    The last sample lasts as long as the last run that is closed, or ``default`` while only one
    is open; it joins the run before it where equal.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    gap = F.lead("dts").over(w) - F.col("dts")
    rows = samples.select(*keys, "idx", gap.alias("d"))
    closed = rows.withColumn("_c", F.when((F.lead("d").over(w) != F.col("d")) & F.lead("d").over(w).isNotNull(), F.struct("idx", "d")))
    closed = closed.withColumn("_c", F.max("_c").over(Window.partitionBy(*keys)))
    return run_lengths(closed.withColumn("d", F.coalesce("d", F.col("_c.d"), F.lit(default))), keys, "d")


def audio_durations(samples: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Samples of each audio frame: the rounded step to the next, 1024 where that isn't in 1..2048, and for the last."""
    w = Window.partitionBy(*keys).orderBy("idx")
    step = F.floor((F.lead("pts").over(w) - F.col("pts")) * F.lit(rate) / F.lit(90_000) + 0.5).cast("long")
    return samples.select(*keys, "idx", F.when(step.between(1, 2_048), step).otherwise(F.lit(1_024)).alias("duration"))


def fragment_durations(samples: DataFrame, keys: list[str], default: int = 3_003) -> DataFrame:
    """In a fragment the last sample lasts as long as the one before it."""
    w = Window.partitionBy(*keys).orderBy("idx")
    step = F.lead("dts").over(w) - F.col("dts")
    return samples.withColumn("duration", F.coalesce(step, F.col("dts") - F.lag("dts").over(w), F.lit(default)))


# --- totals ------------------------------------------------------------------------------


def track_duration(samples: DataFrame, keys: list[str], single: int = 3_003) -> DataFrame:
    """Span of decode times and a mean frame more, rounded."""
    n, span = F.count("*"), F.max_by("dts", "idx") - F.min_by("dts", "idx")
    mean = F.try_divide(span.cast("double"), n - 1)
    value = F.when(n == 1, F.lit(single).cast("long")).otherwise(F.floor(span + mean + 0.5).cast("long"))
    return samples.groupBy(*keys).agg(value.alias("duration"))


def bitrate(samples: DataFrame, keys: list[str], timescale: int = 90_000) -> DataFrame:
    bits = F.sum("size") * 8 * F.lit(float(timescale))
    span = F.max("dts") - F.min("dts")
    return samples.groupBy(*keys).agg(F.coalesce(F.floor(F.try_divide(bits, span.cast("double")) + 0.5).cast("long"), F.lit(0)).alias("bps"))


def in_byte_ranges(samples: DataFrame, keys: list[str], gap: int = 65_536) -> DataFrame:
    """Samples with the ``range_id`` of the bytes that are read with theirs: those within ``gap`` of what came before."""
    w = Window.partitionBy(*keys).orderBy("offset", "idx")
    reach = F.max(F.col("offset") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("offset") > reach + gap), 1).otherwise(0)
    return samples.withColumn("_new", new).withColumn("range_id", F.sum("_new").over(w) - 1).drop("_new")


def byte_ranges(samples: DataFrame, keys: list[str], gap: int = 65_536) -> DataFrame:
    """``range_id, start, end, n``: the stretches of bytes that hold all samples."""
    return in_byte_ranges(samples, keys, gap).groupBy(*keys, "range_id").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("size")).alias("end"), F.count("*").alias("n"))


def build_segments(samples: DataFrame, keys: list[str], target: int = 360_000, include_tail: bool = False) -> DataFrame:
    """``seg, v_start, v_end, start, duration``: stretches between key frames, joined while shorter than ``target``.

    Only key frames meet in a fold, few of a track's rows. ``v_end`` is exclusive, and the last
    sample of a track belongs to no segment unless ``include_tail``.
    """
    last = samples.groupBy(*keys).agg(F.max(F.struct("idx", "dts")).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("idx")
    key_rows = samples.where("is_key").select(*keys, "idx", "dts").join(last, keys)
    stop = F.coalesce(F.lead(F.struct("idx", "dts")).over(w), F.col("_l"))
    gops = key_rows.withColumn("_e", stop).where("_e.idx > idx").select(*keys, F.struct("idx", F.col("_e.idx").alias("stop"), "dts", (F.col("_e.dts") - F.col("dts")).alias("d")).alias("g"))
    line = gops.groupBy(*keys).agg(F.array_sort(F.collect_list("g")).alias("gs"))
    folded = line.withColumn(
        "segs",
        F.expr(
            f"""aggregate(gs, cast(array() as array<struct<idx:bigint,stop:bigint,dts:bigint,d:bigint>>), (acc, g) ->
            if(size(acc) > 0 and element_at(acc, -1).d + g.d < {target},
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('idx', element_at(acc, -1).idx, 'stop', g.stop, 'dts', element_at(acc, -1).dts, 'd', element_at(acc, -1).d + g.d))),
               concat(acc, array(named_struct('idx', g.idx, 'stop', g.stop, 'dts', g.dts, 'd', g.d)))))"""
        ),
    )
    out = folded.select(*keys, F.posexplode("segs").alias("seg", "s"))
    out = out.select(*keys, F.col("seg").cast("long"), F.col("s.idx").alias("v_start"), F.col("s.stop").alias("v_end"), F.col("s.dts").alias("start"), F.col("s.d").alias("duration"))
    if include_tail:
        tail = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seg"))) == 1
        out = out.withColumn("v_end", F.when(tail, F.col("v_end") + 1).otherwise(F.col("v_end")))
    return out


def first_known(rows: DataFrame, keys: list[str], order: str, value: str, *with_it: str) -> DataFrame:
    """The first value that is known, and what stood beside it."""
    got = F.min(F.when(F.col(value).isNotNull(), F.struct(order, value, *with_it)))
    return rows.groupBy(*keys).agg(got.alias("_v")).select(*keys, f"_v.{value}", *[f"_v.{c}" for c in with_it])


# --- joins and clips ---------------------------------------------------------------------


def _clip_begin(samples: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rid, s, e, hit, n, k_idx, k_pts`` of each track and range: the key frame that a clip begins at, and the sample that its scan stops at."""
    key = F.when(F.col("is_key"), F.struct("idx", "pts"))
    whole = samples.groupBy(*keys).agg(F.max(key).alias("_l"), F.max(F.when(F.col("idx") == 0, F.struct("idx", "pts"))).alias("_z"), (F.max("idx") + 1).alias("n"))
    bounds = whole.crossJoin(ranges.select("rid", "s", "e")).withColumn("bound", F.coalesce("s", F.lit(0).cast("long")) + 1)
    before = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    met = reach(samples.withColumn("_k", F.max(key).over(before)), bounds, keys, "_k")
    found = met.withColumn("_k", F.coalesce(F.when(F.col("idx").isNull(), F.col("_l")).otherwise(F.col("_k")), "_z"))
    return found.select(*keys, "rid", "s", "e", F.col("idx").alias("hit"), "n", F.col("_k.idx").alias("k_idx"), F.col("_k.pts").alias("k_pts"))


def keyframe_before(samples: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rid, k_idx``: in decode order, the last key frame before the scan meets a presentation time beyond the start; 0 if none."""
    return _clip_begin(samples, ranges, keys).select(*keys, "rid", F.coalesce("k_idx", F.lit(0)).cast("long").alias("k_idx"))


def clip(samples: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Key-frame accurate clips: the samples of each range, times from its key frame, with the pre-roll.

    A range is ``rid, s, e`` in ticks, null for open. A clip begins at the key frame before
    its start and ends before the first sample in decode order with a presentation time not
    before its end.
    """
    own = samples.select(*keys, "idx", "dts", "pts", "is_key")
    begin = _clip_begin(own, ranges, keys).where("k_idx IS NOT NULL").withColumnRenamed("k_idx", "first")
    start, columns = F.coalesce("s", F.lit(0).cast("long")), [*keys, "rid", "s", "k_pts", "first", "stop"]
    # a time beyond the start comes after the key frame; a range that ends no later than it begins may end before that
    ahead = begin.where(F.col("e").isNull() | (F.col("e") > start)).withColumn("bound", F.coalesce("e", F.lit((1 << 63) - 1)))
    ahead = reach(own, ahead, keys).withColumn("stop", F.coalesce("idx", "n")).select(*columns)
    early = within(own, begin.where(F.col("e") <= start).withColumn("stop", F.coalesce(F.col("hit") + 1, "n")), keys)
    early = early.groupBy(*keys, "rid", "s", "k_pts", "first", "stop").agg(F.min(F.when(F.col("pts") >= F.col("e"), F.col("idx"))).alias("_x"))
    spans = ahead.union(early.withColumn("stop", F.coalesce("_x", "stop")).select(*columns))
    return within(own, spans, keys).select(
        *keys, "rid", "idx", (F.col("dts") - F.col("k_pts")).alias("dts"), (F.col("pts") - F.col("k_pts")).alias("pts"), "is_key", F.greatest(F.lit(0), start - F.col("k_pts")).alias("preroll")
    )


def clip_samples(samples: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rid, first, last, media_time, playback`` of a video sample clip.

    The first sample that ends after the start, back to the sync sample before it; up to the
    last that starts before the end.
    """
    rows = samples.withColumn("duration", F.coalesce("duration", F.lit(0))).join(if_small(ranges))
    s, e = F.coalesce("s", F.lit(0)), F.col("e")
    shown = rows.groupBy(*keys, "rid").agg(
        F.min(F.when(F.col("pts") + F.col("duration") > s, F.col("idx"))).alias("hit"),
        F.min(F.when(e.isNotNull() & (F.col("pts") >= e), F.col("idx"))).alias("_x"),
        F.max("idx").alias("_n"),
        F.first("s").alias("s"),
        F.first("e").alias("e"),
    )
    sync = samples.where("is_key").select(*keys, "idx").join(shown, keys).where("idx <= hit").groupBy(*keys, "rid").agg(F.max("idx").alias("k"))
    after = samples.select(*keys, "idx", "pts").join(shown, keys).where(F.col("e").isNotNull() & (F.col("idx") > F.col("hit")) & (F.col("pts") >= F.col("e")))
    after = after.groupBy(*keys, "rid").agg(F.min("idx").alias("x"))
    bound = shown.where("hit IS NOT NULL").join(sync, [*keys, "rid"], "left").join(after, [*keys, "rid"], "left")
    bound = bound.select(*keys, "rid", "s", "e", F.coalesce("k", "hit").alias("first"), F.coalesce(F.col("x") - 1, F.col("_n")).alias("last"))
    inside = samples.join(bound, keys).where("idx BETWEEN first AND last")
    return inside.groupBy(*keys, "rid", "first", "last").agg(
        F.greatest(F.lit(0), F.coalesce(F.first("s"), F.lit(0)) - F.min_by("dts", "idx")).alias("media_time"), F.sum(F.coalesce("duration", F.lit(0))).alias("total"), (F.first("e") - F.coalesce(F.first("s"), F.lit(0))).alias("_w")
    ).select(*keys, "rid", "first", "last", "media_time", F.least(F.coalesce("_w", F.col("total") - F.col("media_time")), F.col("total") - F.col("media_time")).alias("playback"))


def overlap(intervals: DataFrame, ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Half-open intervals that meet half-open ranges: touching is not meeting; a null end is open."""
    s, e = F.coalesce("s", F.lit(0)), F.col("e")
    return intervals.join(if_small(ranges), (F.col(end) > s) & (e.isNull() | (F.col(start) < e)))


def as_of(points: DataFrame, steps: DataFrame, keys: list[str], time: str, start: str, value: str, none=-1) -> DataFrame:
    """Each point with the last step not after it, one shuffle: both sorted together and filled forward.

    Of steps that start together the last is the one of the largest ``value``. The first step where all are later, ``none`` where there is no step.
    """
    w = Window.partitionBy(*keys).orderBy("_t", "_k", "_v").rowsBetween(Window.unboundedPreceding, 0)
    a = steps.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_v"))
    b = points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(steps.schema[value].dataType).alias("_v"), F.struct(*points.columns).alias("_p"))
    first = F.min(F.when(F.col("_k") == 0, F.struct("_t", "_v"))).over(Window.partitionBy(*keys))["_v"]
    both = a.withColumn("_p", F.lit(None).cast(b.schema["_p"].dataType)).unionByName(b)
    return both.withColumn("_f", F.coalesce(F.last("_v", True).over(w), first, F.lit(none).cast(steps.schema[value].dataType))).where("_k = 1").select("_p.*", F.col("_f").alias(value))


def nearest(points: DataFrame, segments: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Each point with the segment whose middle is nearest, the first of equals: the one below and the one above decide.

    Middles rise with ``idx``, as segments follow one another.
    """
    mid = F.col("start") + F.col("duration") / 2
    side = F.struct(mid.alias("m"), F.col("idx").alias("i"))
    a = segments.select(*keys, mid.alias("_t"), F.lit(0).alias("_k"), side.alias("_s"))
    b = points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(a.schema["_s"].dataType).alias("_s"), F.struct(*points.columns).alias("_p"))
    both = a.withColumn("_p", F.lit(None).cast(b.schema["_p"].dataType)).unionByName(b)
    w = Window.partitionBy(*keys)
    low = F.last("_s", True).over(w.orderBy("_t", "_k", F.desc("_s.i")).rowsBetween(Window.unboundedPreceding, 0))
    # downwards, as a frame that ends at the last row is computed anew for each row
    high = F.last("_s", True).over(w.orderBy(F.desc("_t"), F.desc("_k"), F.desc("_s.i")).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumns({"_l": low, "_h": high}).where("_k = 1")
    up = (F.col("_h.m") - F.col("_t")) < (F.col("_t") - F.col("_l.m"))
    pick = F.when(F.col("_l").isNull() | (F.col("_h").isNotNull() & up), F.col("_h.i")).otherwise(F.col("_l.i"))
    return out.select("_p.*", pick.alias("idx"))


def interleave(video: DataFrame, audio: DataFrame, keys: list[str]) -> DataFrame:
    """``pos, kind, idx``: audio goes before the first picture that is not earlier; what is left goes last. Both keep their own order."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    v = video.select(*keys, F.max("pts").over(w).alias("t"), F.lit(1).alias("k"), "idx")
    a = audio.select(*keys, F.max("pts").over(w).alias("t"), F.lit(0).alias("k"), "idx")
    order = Window.partitionBy(*keys).orderBy("t", "k", "idx")
    kind = F.when(F.col("k") == 1, "video").otherwise("audio")
    return v.unionByName(a).select(*keys, (F.row_number().over(order) - 1).cast("long").alias("pos"), kind.alias("kind"), "idx")


def concat_timelines(samples: DataFrame, keys: list[str], segment: str = "seg", single: int = 0) -> DataFrame:
    """Segments of a track one after another: each moves by the durations of those before it, from its own first decode time."""
    length = track_duration(samples, [*keys, segment], single).withColumnRenamed("duration", "_d")
    first = samples.groupBy(*keys, segment).agg(F.min_by("dts", "idx").alias("_f"))
    w = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    shift = length.withColumn("_o", F.coalesce(F.sum("_d").over(w), F.lit(0))).join(first, [*keys, segment])
    order = Window.partitionBy(*keys).orderBy(segment, "idx")
    moved = F.col("_o") - F.col("_f")
    return samples.join(shift, [*keys, segment]).select(*keys, segment, (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.col("dts") + moved).alias("dts"), (F.col("pts") + moved).alias("pts"), "is_key")
