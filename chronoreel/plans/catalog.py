"""Registered queries of the timeline engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoreel.functions import avc, registry
from chronoreel.functions import scalar as sc
from chronoreel.operators import clips
from chronoreel.operators import timeline as tl
from chronoreel.sinks import mp4 as mp4_sink
from chronoreel.sinks import mpegts as ts_sink
from chronoreel.sources import files as file_source
from chronoreel.sources import mp4 as mp4_source
from chronoreel.sources import mpegts as ts_source
from chronoreel.sources import playlist

QUERIES = {}
ORACLE_SQL = {}


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


TIMELINE_CTE = """
WITH numbered AS (
  SELECT user_id AS track, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         ((epoch_us(ts) - 1704067200000000) * 9) // 100 AS dts
  FROM events),
timeline AS (
  SELECT track, CAST(idx AS BIGINT) AS idx, CAST(dts AS BIGINT) AS dts,
         CAST(dts + (event_id % 3) * 5000000000 AS BIGINT) AS pts,
         CAST(floor(value) + 1 AS BIGINT) AS size, event_type = 'signup' AS is_key, event_type,
         CAST(lead(dts) OVER w - dts AS BIGINT) AS duration,
         CAST(coalesce(sum(CAST(floor(value) + 1 AS BIGINT)) OVER
              (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM numbered WINDOW w AS (PARTITION BY track ORDER BY idx))
"""


@register(
    "a01_analyze",
    TIMELINE_CTE
    + """
SELECT track, CAST(count(*) AS BIGINT) AS frames, CAST(count(*) FILTER (is_key) AS BIGINT) AS keys,
       CAST(max(pts) - min(pts) AS BIGINT) AS span,
       coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (is_key), '') AS key_list
FROM timeline GROUP BY track""",
)
def a01_analyze(spark, d):
    return tl.analyze(tl.from_events(spark.read.parquet(f"{d}/events.parquet")), ["track"]).select(
        "track", "frames", "keys", "span", F.array_join(F.transform("keyframes", lambda k: k.idx.cast("string")), ",").alias("key_list")
    )


def _timeline(spark, d):
    return tl.from_events(spark.read.parquet(f"{d}/events.parquet"))


def _ranges(spark):
    day = 86_400 * 90_000
    return spark.createDataFrame([(0, 2 * day, 9 * day), (1, 5 * day, None), (2, None, 60_000 * 90_000 + 5_000_000_000), (3, 40 * day, 50 * day)], "rid int, s long, e long")


RANGES_CTE = """, ranges(rid, s, e) AS (VALUES (0, 15552000000, 69984000000), (1, 38880000000, NULL), (2, NULL, 10400000000), (3, 311040000000, 388800000000))
"""


@register("p05_rebase", TIMELINE_CTE + "SELECT track, idx, CAST(dts - first(dts) OVER w AS BIGINT) AS dts, CAST(pts - first(dts) OVER w AS BIGINT) AS pts FROM timeline WINDOW w AS (PARTITION BY track ORDER BY idx)")
def p05_rebase(spark, d):
    return tl.rebase(_timeline(spark, d), ["track"]).select("track", "idx", "dts", "pts")


@register("w01_normalise", TIMELINE_CTE + "SELECT track, idx, CAST(dts - min(pts) OVER (PARTITION BY track) AS BIGINT) AS dts, CAST(pts - min(pts) OVER (PARTITION BY track) AS BIGINT) AS pts FROM timeline")
def w01_normalise(spark, d):
    return tl.normalise(_timeline(spark, d), ["track"]).select("track", "idx", "dts", "pts")


@register("w02_prefix_sums", TIMELINE_CTE + 'SELECT track, idx, size, "offset" FROM timeline')
def w02_prefix_sums(spark, d):
    return _timeline(spark, d).select("track", "idx", "size", "offset")


@register("w03_lead_durations", TIMELINE_CTE + "SELECT track, idx, CAST(coalesce(lead(dts) OVER w - dts, dts - lag(dts) OVER w, 3003) AS BIGINT) AS duration FROM timeline WINDOW w AS (PARTITION BY track ORDER BY idx)")
def w03_lead_durations(spark, d):
    return tl.fragment_durations(_timeline(spark, d), ["track"]).select("track", "idx", F.col("duration").cast("long").alias("duration"))


@register(
    "w04_fill_forward",
    TIMELINE_CTE
    + """, sparse AS (SELECT track, idx, CASE WHEN idx % 5 = 2 THEN pts END AS t FROM timeline),
a AS (SELECT *, max(CASE WHEN t IS NOT NULL THEN idx END) OVER (PARTITION BY track ORDER BY idx) AS i FROM sparse)
SELECT a.track, a.idx, CAST(b.t + (a.idx - a.i) * 1920 AS BIGINT) AS pts FROM a LEFT JOIN sparse b ON a.track = b.track AND a.i = b.idx""",
)
def w04_fill_forward(spark, d):
    rows = _timeline(spark, d).select("track", "idx", F.when(F.col("idx") % 5 == 2, F.col("pts")).alias("pts"), F.lit(1920).cast("long").alias("step"))
    return tl.fill_forward(rows, ["track"], "pts", "step").select("track", "idx", "pts")


@register(
    "w05_display_timeline",
    TIMELINE_CTE
    + """SELECT track, CAST(row_number() OVER w - 1 AS BIGINT) AS frame, pts AS start,
CAST(coalesce(lead(pts) OVER w, pts + coalesce(pts - lag(pts) OVER w, 3000)) AS BIGINT) AS "end" FROM timeline WINDOW w AS (PARTITION BY track ORDER BY pts, idx)""",
)
def w05_display_timeline(spark, d):
    return tl.display_timeline(_timeline(spark, d), ["track"]).select("track", "frame", "start", F.col("end").cast("long").alias("end"))


RUNS = """, marked AS (SELECT track, idx, pts - dts AS v, CASE WHEN lag(pts - dts) OVER w IS NOT DISTINCT FROM pts - dts AND idx > 0 THEN 0 ELSE 1 END AS n FROM timeline WINDOW w AS (PARTITION BY track ORDER BY idx)),
runs AS (SELECT track, CAST(g AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS count, first(v) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY track ORDER BY idx) - 1 AS g FROM marked) GROUP BY track, g)
"""


@register("w06_run_lengths", TIMELINE_CTE + RUNS + "SELECT * FROM runs")
def w06_run_lengths(spark, d):
    rows = _timeline(spark, d).withColumn("v", F.col("pts") - F.col("dts"))
    return tl.run_lengths(rows, ["track"], "v").select("track", "run", "count", "value")


@register("a07_expand_runs", TIMELINE_CTE + "SELECT track, idx, CAST(pts - dts AS BIGINT) AS value FROM timeline")
def a07_expand_runs(spark, d):
    return tl.expand_runs(w06_run_lengths(spark, d), ["track"]).select("track", F.col("idx").cast("long").alias("idx"), "value")


@register("a02_counts", TIMELINE_CTE + "SELECT track, CAST(count(*) AS BIGINT) AS frames, CAST(count(*) FILTER (is_key) AS BIGINT) AS keys FROM timeline GROUP BY track")
def a02_counts(spark, d):
    return _timeline(spark, d).groupBy("track").agg(F.count("*").alias("frames"), F.count_if("is_key").alias("keys"))


@register("a03_sum_durations", TIMELINE_CTE + "SELECT track, CAST(sum(coalesce(duration, 0)) AS BIGINT) AS total FROM timeline GROUP BY track")
def a03_sum_durations(spark, d):
    return _timeline(spark, d).groupBy("track").agg(F.sum(F.coalesce("duration", F.lit(0))).alias("total"))


@register(
    "a04_track_duration",
    TIMELINE_CTE
    + """SELECT track, CASE WHEN count(*) = 1 THEN 3003 ELSE CAST(floor((arg_max(dts, idx) - arg_min(dts, idx)) + CAST(arg_max(dts, idx) - arg_min(dts, idx) AS DOUBLE) / (count(*) - 1) + 0.5) AS BIGINT) END AS duration FROM timeline GROUP BY track""",
)
def a04_track_duration(spark, d):
    return tl.track_duration(_timeline(spark, d), ["track"])


@register("a11_bitrate", TIMELINE_CTE + "SELECT track, coalesce(CAST(floor(sum(size) * 8 * 90000.0::DOUBLE / nullif(max(dts) - min(dts), 0)::DOUBLE + 0.5) AS BIGINT), 0) AS bps FROM timeline GROUP BY track")
def a11_bitrate(spark, d):
    return tl.bitrate(_timeline(spark, d), ["track"])


@register(
    "a08_byte_ranges",
    TIMELINE_CTE
    + """, spread AS (SELECT track, idx, "offset" + (idx // 7) * 300 AS o, size FROM timeline),
r AS (SELECT *, max(o + size) OVER (PARTITION BY track ORDER BY o, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spread),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR o > reach + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY o, idx) - 1 AS range_id FROM r)
SELECT track, CAST(range_id AS BIGINT) AS range_id, CAST(min(o) AS BIGINT) AS start, CAST(max(o + size) AS BIGINT) AS "end", CAST(count(*) AS BIGINT) AS n FROM g GROUP BY track, range_id""",
)
def a08_byte_ranges(spark, d):
    rows = _timeline(spark, d).withColumn("offset", F.col("offset") + F.expr("idx div 7") * 300)
    return tl.byte_ranges(rows, ["track"], 200)


@register(
    "a09_segments",
    "WITH RECURSIVE "
    + TIMELINE_CTE.strip().removeprefix("WITH ")
    + """, l AS (SELECT track, max(idx) AS li, max_by(dts, idx) AS ld FROM timeline GROUP BY track),
k AS (SELECT t.track, t.idx, t.dts, coalesce(lead(t.idx) OVER w, li) AS stop, coalesce(lead(t.dts) OVER w, ld) - t.dts AS d FROM timeline t JOIN l USING (track) WHERE is_key WINDOW w AS (PARTITION BY t.track ORDER BY t.idx)),
o AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY idx) AS n FROM k WHERE stop > idx),
f AS (SELECT track, n, idx, stop, dts, d, CAST(0 AS BIGINT) AS seg FROM o WHERE n = 1
  UNION ALL SELECT o.track, o.n, CASE WHEN f.d + o.d < 86400000000 THEN f.idx ELSE o.idx END, o.stop, CASE WHEN f.d + o.d < 86400000000 THEN f.dts ELSE o.dts END,
  CASE WHEN f.d + o.d < 86400000000 THEN f.d + o.d ELSE o.d END, CASE WHEN f.d + o.d < 86400000000 THEN f.seg ELSE f.seg + 1 END FROM f JOIN o ON o.track = f.track AND o.n = f.n + 1)
SELECT track, seg, arg_max(idx, n) AS v_start, arg_max(stop, n) AS v_end, arg_max(dts, n) AS start, CAST(arg_max(d, n) AS BIGINT) AS duration FROM f GROUP BY track, seg""",
)
def a09_segments(spark, d):
    return tl.build_segments(_timeline(spark, d), ["track"], 86_400_000_000)


@register("a13_first_known", TIMELINE_CTE + "SELECT track, arg_min(size, idx) AS rate, arg_min(pts, idx) AS pts FROM timeline WHERE size > 50 GROUP BY track")
def a13_first_known(spark, d):
    rows = _timeline(spark, d).select("track", "idx", F.when(F.col("size") > 50, F.col("size")).alias("rate"), "pts")
    return tl.first_known(rows, ["track"], "idx", "rate", "pts").where("rate IS NOT NULL")


@register(
    "j02_keyframe_before",
    TIMELINE_CTE
    + RANGES_CTE
    + """, b AS (SELECT track, rid, min(idx) FILTER (pts > coalesce(s, 0)) AS stop FROM timeline, ranges GROUP BY track, rid)
SELECT b.track, b.rid, CAST(coalesce(max(t.idx) FILTER (is_key AND (stop IS NULL OR t.idx < stop)), 0) AS BIGINT) AS k_idx FROM b JOIN timeline t USING (track) GROUP BY b.track, b.rid""",
)
def j02_keyframe_before(spark, d):
    return tl.keyframe_before(_timeline(spark, d), _ranges(spark), ["track"])


CLIP = """, b AS (SELECT track, rid, s, e, min(idx) FILTER (pts > coalesce(s, 0)) AS stop FROM timeline, ranges GROUP BY track, rid, s, e),
k AS (SELECT b.track, b.rid, b.s, b.e, coalesce(max(t.idx) FILTER (is_key AND (stop IS NULL OR t.idx < stop)), 0) AS k FROM b JOIN timeline t USING (track) GROUP BY ALL),
c AS (SELECT t.*, k.rid, k.s, k.e, o.pts AS kp, max(CASE WHEN k.e IS NOT NULL AND t.pts >= k.e THEN 1 ELSE 0 END) OVER (PARTITION BY t.track, k.rid ORDER BY t.idx) AS over
  FROM k JOIN timeline t USING (track) JOIN timeline o ON o.track = k.track AND o.idx = k.k WHERE t.idx >= k.k)
"""


@register("r01_clip", TIMELINE_CTE + RANGES_CTE + CLIP + "SELECT track, rid, idx, CAST(dts - kp AS BIGINT) AS dts, CAST(pts - kp AS BIGINT) AS pts, is_key, CAST(greatest(0, coalesce(s, 0) - kp) AS BIGINT) AS preroll FROM c WHERE over = 0")
def r01_clip(spark, d):
    return tl.clip(_timeline(spark, d), _ranges(spark), ["track"]).withColumn("preroll", F.col("preroll").cast("long"))


@register(
    "r02_clip_samples",
    TIMELINE_CTE
    + RANGES_CTE
    + """, h AS (SELECT track, rid, s, e, min(idx) FILTER (pts + coalesce(duration, 0) > coalesce(s, 0)) AS hit, max(idx) AS n FROM timeline, ranges GROUP BY track, rid, s, e),
f AS (SELECT h.track, h.rid, h.s, h.e, coalesce(max(t.idx) FILTER (is_key AND t.idx <= hit), hit) AS first, coalesce(min(t.idx) FILTER (e IS NOT NULL AND t.idx > hit AND t.pts >= e) - 1, n) AS last
  FROM h JOIN timeline t USING (track) WHERE hit IS NOT NULL GROUP BY h.track, h.rid, h.s, h.e, hit, n),
a AS (SELECT f.track, f.rid, first, last, s, e, greatest(0, coalesce(s, 0) - arg_min(dts, idx)) AS m, sum(coalesce(duration, 0)) AS total FROM f JOIN timeline t ON t.track = f.track AND t.idx BETWEEN first AND last GROUP BY f.track, f.rid, first, last, s, e)
SELECT track, rid, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST(m AS BIGINT) AS media_time, CAST(least(coalesce(e - coalesce(s, 0), total - m), total - m) AS BIGINT) AS playback FROM a""",
)
def r02_clip_samples(spark, d):
    return tl.clip_samples(_timeline(spark, d), _ranges(spark), ["track"])


@register(
    "j07_as_of_frame",
    TIMELINE_CTE
    + """, f AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY pts, idx) - 1 AS frame, pts AS start FROM timeline),
p AS (SELECT track, idx, dts + 3000000000 AS t FROM timeline)
SELECT p.track, p.idx, CAST(coalesce(max(frame) FILTER (start <= t), 0) AS BIGINT) AS frame FROM p JOIN f USING (track) GROUP BY p.track, p.idx""",
)
def j07_as_of_frame(spark, d):
    rows = _timeline(spark, d)
    frames = tl.display_timeline(rows, ["track"])
    points = rows.select("track", "idx", (F.col("dts") + 3_000_000_000).alias("t"))
    return tl.as_of(points, frames, ["track"], "t", "start", "frame").select("track", "idx", "frame")


@register(
    "j08_interleave",
    TIMELINE_CTE
    + """, v AS (SELECT track, max(pts) OVER w AS t, 1 AS k, idx FROM timeline WHERE event_type <> 'view' WINDOW w AS (PARTITION BY track ORDER BY idx)),
a AS (SELECT track, max(pts) OVER w AS t, 0 AS k, idx FROM timeline WHERE event_type = 'view' WINDOW w AS (PARTITION BY track ORDER BY idx)),
u AS (SELECT * FROM v UNION ALL SELECT * FROM a)
SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY t, k, idx) - 1 AS BIGINT) AS pos, CASE k WHEN 1 THEN 'video' ELSE 'audio' END AS kind, idx FROM u""",
)
def j08_interleave(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = tl.from_events(events, keep=("event_type",))
    return tl.interleave(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"), ["track"])


@register(
    "w07_concat_timelines",
    TIMELINE_CTE
    + """, s AS (SELECT *, idx // 20 AS seg FROM timeline),
l AS (SELECT track, seg, arg_min(dts, idx) AS f, CASE WHEN count(*) = 1 THEN 0 ELSE CAST(floor((arg_max(dts, idx) - arg_min(dts, idx)) + CAST(arg_max(dts, idx) - arg_min(dts, idx) AS DOUBLE) / (count(*) - 1) + 0.5) AS BIGINT) END AS d FROM s GROUP BY track, seg),
o AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY track ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l)
SELECT s.track, s.seg, CAST(row_number() OVER (PARTITION BY s.track ORDER BY s.seg, s.idx) - 1 AS BIGINT) AS idx, CAST(dts + o - f AS BIGINT) AS dts, CAST(pts + o - f AS BIGINT) AS pts, is_key FROM s JOIN o USING (track, seg)""",
)
def w07_concat_timelines(spark, d):
    rows = _timeline(spark, d).withColumn("seg", F.expr("idx div 20"))
    return tl.concat_timelines(rows, ["track"])


# --- playlists --------------------------------------------------------------------------

SEGMENTS_CTE = """
WITH seg AS (SELECT o_custkey AS playlist, row_number() OVER w - 1 AS idx, o_orderkey, round(o_totalprice / 1000, 6) AS duration FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
segments AS (SELECT playlist, CAST(idx AS INTEGER) AS idx, 'https://media.example/' || playlist || '/s' || o_orderkey || '.ts' AS url, duration,
  coalesce(sum(duration) OVER (PARTITION BY playlist ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM seg)
"""


def _segments(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("playlist"),
        (F.row_number().over(w) - 1).alias("idx"),
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("url"),
        F.round(F.col("o_totalprice") / 1000, 6).alias("duration"),
    )


def _read_back(spark, d):
    """Written as playlists and parsed again."""
    texts = playlist.write_media(_segments(spark, d)).withColumn("base", F.concat(F.lit("https://media.example/"), F.col("playlist"), F.lit("/index.m3u8")))
    return playlist.segments(texts)


@register("s05_parse_playlist", SEGMENTS_CTE + """SELECT CAST(playlist AS VARCHAR) AS playlist, idx, url, CAST(round(duration * 1e6) AS BIGINT) AS duration_us, CAST(round(start * 1e6) AS BIGINT) AS start_us FROM segments""")
def s05_parse_playlist(spark, d):
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return _read_back(spark, d).select("playlist", "idx", "url", us("duration").alias("duration_us"), us("start").alias("start_us"))


@register(
    "k09_write_playlist",
    SEGMENTS_CTE
    + """SELECT CAST(playlist AS VARCHAR) AS playlist, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(ceil(max(duration)) AS BIGINT) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10)
|| string_agg('#EXTINF:' || printf('%.6f', duration) || ',' || chr(10) || replace(url, 'https://media.example/' || playlist || '/', ''), chr(10) ORDER BY idx) || chr(10) || '#EXT-X-ENDLIST' AS content FROM segments GROUP BY playlist""",
)
def k09_write_playlist(spark, d):
    return playlist.write_media(_segments(spark, d))


@register(
    "j03_segment_overlap",
    SEGMENTS_CTE + """, ranges(rid, s, e) AS (VALUES (0, 100.0, 700.0), (1, 300.0, NULL), (2, 0.0, 50.0))
SELECT CAST(playlist AS VARCHAR) AS playlist, rid, idx FROM segments, ranges WHERE start + duration > s + 0.0000001 AND (e IS NULL OR start < e)""",
)
def j03_segment_overlap(spark, d):
    ranges = spark.createDataFrame([(0, 100.0, 700.0), (1, 300.0, None), (2, 0.0, 50.0)], "rid int, s double, e double")
    return tl.overlap(_read_back(spark, d), ranges).select("playlist", "rid", "idx")


@register("o04_limit", SEGMENTS_CTE + "SELECT CAST(playlist AS VARCHAR) AS playlist, idx FROM (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY idx) AS n FROM segments WHERE start + duration > 100 AND start < 900) WHERE n <= 3")
def o04_limit(spark, d):
    return playlist.prune(_read_back(spark, d), 100.0, 900.0, 3).select("playlist", "idx")


@register(
    "j05_nearest_segment",
    SEGMENTS_CTE + """, p AS (SELECT playlist, t FROM (SELECT DISTINCT playlist FROM segments), (VALUES (10.0), (250.0), (900.0), (5000.0)) v(t))
SELECT CAST(playlist AS VARCHAR) AS playlist, CAST(t AS DOUBLE) AS t, arg_min(idx, abs(CAST(t AS DOUBLE) - (start + duration / 2))) AS idx FROM p JOIN segments USING (playlist) GROUP BY playlist, t""",
)
def j05_nearest_segment(spark, d):
    found = _read_back(spark, d)
    points = found.select("playlist").distinct().withColumn("t", F.explode(F.array(*map(F.lit, (10.0, 250.0, 900.0, 5000.0)))))
    return tl.nearest(points, found, ["playlist"]).select("playlist", "t", "idx")


@register(
    "j06_first_containing",
    SEGMENTS_CTE + """, p AS (SELECT playlist, t FROM (SELECT DISTINCT playlist FROM segments), (VALUES (10.0), (250.0), (900.0), (5000.0)) v(t))
SELECT CAST(playlist AS VARCHAR) AS playlist, CAST(t AS DOUBLE) AS t, coalesce(min(idx) FILTER (t < start + duration), max(idx)) AS idx FROM p JOIN segments USING (playlist) GROUP BY playlist, t""",
)
def j06_first_containing(spark, d):
    found = _read_back(spark, d)
    points = found.select("playlist").distinct().withColumn("t", F.explode(F.array(*map(F.lit, (10.0, 250.0, 900.0, 5000.0)))))
    return points.join(found, "playlist").groupBy("playlist", "t").agg(F.coalesce(F.min(F.when(F.col("t") < F.col("end"), F.col("idx"))), F.max("idx")).alias("idx"))


@register(
    "a12_times_by_segment",
    SEGMENTS_CTE + """, p AS (SELECT playlist, t FROM (SELECT DISTINCT playlist FROM segments), (VALUES (10.0), (20.0), (250.0), (900.0), (5000.0)) v(t)),
f AS (SELECT playlist, t, coalesce(min(idx) FILTER (t < start + duration), max(idx)) AS idx FROM p JOIN segments USING (playlist) GROUP BY playlist, t)
SELECT CAST(playlist AS VARCHAR) AS playlist, idx, string_agg(CAST(CAST(t AS INTEGER) AS VARCHAR), ',' ORDER BY t) AS times FROM f GROUP BY playlist, idx""",
)
def a12_times_by_segment(spark, d):
    found = _read_back(spark, d)
    points = found.select("playlist").distinct().withColumn("t", F.explode(F.array(*map(F.lit, (10.0, 20.0, 250.0, 900.0, 5000.0)))))
    at = points.join(found, "playlist").groupBy("playlist", "t").agg(F.coalesce(F.min(F.when(F.col("t") < F.col("end"), F.col("idx"))), F.max("idx")).alias("idx"))
    return at.groupBy("playlist", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.cast("int").cast("string")), ",").alias("times"))


@register(
    "a10_clip_summary",
    SEGMENTS_CTE + """, ranges(rid, s, e) AS (VALUES (0, 100.0, 700.0), (1, 0.0, 50.0))
SELECT CAST(playlist AS VARCHAR) AS playlist, rid, CAST(count(*) AS BIGINT) AS n, CAST(round(greatest(0, first(s) - min(start)) * 1e6) AS BIGINT) AS preroll_us, CAST(round(sum(duration) * 1e6) AS BIGINT) AS media_us, CAST(round((greatest(0, first(s) - min(start)) + first(e - s)) * 1e6) AS BIGINT) AS end_us
FROM segments JOIN ranges ON start + duration > s + 0.0000001 AND start < e GROUP BY playlist, rid""",
)
def a10_clip_summary(spark, d):
    ranges = spark.createDataFrame([(0, 100.0, 700.0), (1, 0.0, 50.0)], "rid int, s double, e double")
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return playlist.clip(_read_back(spark, d), ranges).select("playlist", "rid", "n", us("preroll").alias("preroll_us"), us("media_duration").alias("media_us"), us("playback_end").alias("end_us"))


VARIANTS_CTE = """
WITH variants AS (SELECT p_brand AS playlist, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS n, CAST(floor(p_retailprice) * 1000 AS BIGINT) AS bandwidth,
  CASE WHEN p_size % 3 > 0 THEN (p_size * 16) || 'x' || (p_size * 9) END AS resolution, 'v' || p_partkey || '.m3u8' AS url FROM part),
named AS (SELECT *, coalesce(resolution, CAST(floor(bandwidth / 1000 + 0.5) AS BIGINT) || 'kbps') AS name FROM variants)
"""


def _variants(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_brand").alias("playlist"),
        F.row_number().over(w).alias("pos"),
        (F.floor("p_retailprice") * 1000).cast("long").alias("bandwidth"),
        F.when(F.col("p_size") % 3 > 0, F.concat((F.col("p_size") * 16).cast("string"), F.lit("x"), (F.col("p_size") * 9).cast("string"))).alias("resolution"),
        F.lit("avc1.4d001f,mp4a.40.2").alias("codecs"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string"), F.lit(".m3u8")).alias("url"),
    )
    texts = playlist.write_master(rows).withColumn("base", F.lit("https://media.example/a/master.m3u8"))
    return playlist.variants(texts)


@register("o01_variants_by_bandwidth", VARIANTS_CTE + "SELECT playlist, CAST(row_number() OVER (PARTITION BY playlist ORDER BY bandwidth DESC, n) AS INTEGER) AS rank, bandwidth, resolution, name, 'https://media.example/a/' || url AS url FROM named")
def o01_variants_by_bandwidth(spark, d):
    w = Window.partitionBy("playlist").orderBy(F.desc("bandwidth"), "pos")
    return _variants(spark, d).select("playlist", F.row_number().over(w).alias("rank"), "bandwidth", "resolution", "name", "url")


@register("o02_extreme_variants", VARIANTS_CTE + "SELECT playlist, max(bandwidth) AS highest, min(bandwidth) AS lowest FROM named GROUP BY playlist")
def o02_extreme_variants(spark, d):
    found = _variants(spark, d)
    high = playlist.select_variant(found, ["playlist"]).select("playlist", F.col("bandwidth").alias("highest"))
    return high.join(playlist.select_variant(found, ["playlist"], "lowest").select("playlist", F.col("bandwidth").alias("lowest")), "playlist")


@register("o03_closest_variant", VARIANTS_CTE + "SELECT playlist, bandwidth, 'https://media.example/a/' || url AS url FROM (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY abs(bandwidth - 1100500), bandwidth DESC, n) AS r FROM named) WHERE r = 1")
def o03_closest_variant(spark, d):
    return playlist.select_variant(_variants(spark, d), ["playlist"], 1_100_500).select("playlist", "bandwidth", "url")


# --- scalars ----------------------------------------------------------------------------


@register("p10_quality_names", VARIANTS_CTE + "SELECT playlist, bandwidth, resolution, name FROM named")
def p10_quality_names(spark, d):
    return _variants(spark, d).select("playlist", "bandwidth", "resolution", "name")


@register("p07_stream_types", "SELECT l_linenumber AS code, count(*) AS n, coalesce(max(CASE l_linenumber WHEN 1 THEN 'MPEG-1 Video' WHEN 2 THEN 'MPEG-2 Video' WHEN 3 THEN 'MPEG-1 Audio' WHEN 4 THEN 'MPEG-2 Audio' END), 'Unknown (0x' || printf('%02x', l_linenumber) || ')') AS name FROM lineitem GROUP BY l_linenumber")
def p07_stream_types(spark, d):
    codes = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("code")).agg(F.count("*").alias("n"))
    types = spark.createDataFrame(sc.STREAM_TYPES, "code int, name string, supported boolean")
    unknown = F.concat(F.lit("Unknown (0x"), F.lower(F.lpad(F.hex("code"), 2, "0")), F.lit(")"))
    return codes.join(F.broadcast(types), "code", "left").select("code", "n", F.coalesce("name", unknown).alias("name"))


@register("c08_jsround", "SELECT l_orderkey, l_linenumber, CAST(floor((l_quantity - 25) / 2 + 0.5) AS BIGINT) AS r FROM lineitem")
def c08_jsround(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", sc.jsround((F.col("l_quantity") - 25) / 2).alias("r"))


@register("c09_rescale", TIMELINE_CTE + "SELECT track, idx, CAST(floor(CAST(dts AS DOUBLE) * 1000 / 90000 + 0.5) AS BIGINT) AS ms FROM timeline")
def c09_rescale(spark, d):
    return _timeline(spark, d).select("track", "idx", sc.rescale(F.col("dts").cast("double"), F.lit(1000), F.lit(90_000)).alias("ms"))


@register("p02_sync_samples", TIMELINE_CTE + "SELECT track, idx, is_key AS sync FROM timeline")
def p02_sync_samples(spark, d):
    flags = F.when(F.col("is_key"), F.lit(0x02000000)).otherwise(F.lit(0x01010000))
    return _timeline(spark, d).select("track", "idx", sc.is_sync(flags).alias("sync"))


@register("k12_result_sizes", "SELECT doc_id, CASE WHEN n_chars * 100 >= 1048576 THEN printf('%.2f MB', n_chars * 100 / 1048576.0::DOUBLE) ELSE printf('%.1f KB', floor(n_chars * 100 / 1024.0::DOUBLE * 10 + 0.5) / 10) END AS label FROM documents")
def k12_result_sizes(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", sc.size_label(F.col("n_chars") * 100).alias("label"))


@register("s02_output_names", "SELECT page_id, regexp_replace(list_extract(string_split(regexp_replace(url || '/a.ts?x=1', '\\?.*$', ''), '/'), -1), '\\.(ts|m4s)$', '.mp4') AS name FROM pages")
def s02_output_names(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", sc.output_name(F.concat("url", F.lit("/a.ts?x=1"))).alias("name"))


@register(
    "s27_media_format",
    "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'mpegts' WHEN 1 THEN 'mp4' WHEN 2 THEN 'fmp4' WHEN 3 THEN 'fmp4' WHEN 5 THEN 'mpegts' WHEN 6 THEN 'mp4' WHEN 7 THEN 'fmp4' ELSE 'unknown' END AS format FROM documents",
)
def s27_media_format(spark, d):
    box = lambda t, body=b"": (8 + len(body)).to_bytes(4, "big") + t + body
    heads = [
        b"\x47\x40\0\x10", box(b"ftyp") + box(b"moov"), box(b"ftyp") + box(b"moov") + box(b"moof"), box(b"moof"), b"#####",
        b"junk" + (b"\x47" + bytes(187)) * 2, box(b"ftyp") + box(b"mdat", b"moof") + box(b"moov"), box(b"ftyp", b"moov"),
    ]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", sc.media_format(head).alias("format"))


#: Relative and whole addresses, and what each is beside ``http://h/a/<id>/p.m3u8?q=/z``.
URLS = [
    ("../x.ts", "http://h/a/x.ts"), ("./s/./y.ts", "http://h/a/{}/s/y.ts"), ("//cdn/x.ts", "http://cdn/x.ts"), ("?k=1", "http://h/a/{}/p.m3u8?k=1"),
    ("/r/../y.ts", "http://h/y.ts"), ("https://o/z.ts", "https://o/z.ts"), ("../../../x/..", "http://h/"), ("s.ts?u=../v", "http://h/a/{}/s.ts?u=../v"),
]


@register(
    "c05_absolute_url",
    "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN replace('{u}', '{{}}', CAST(doc_id AS VARCHAR))" for i, (_, u) in enumerate(URLS)) + " END AS url FROM documents",
)
def c05_absolute_url(spark, d):
    rel = F.element_at(F.array(*[F.lit(r) for r, _ in URLS]), (F.col("doc_id") % 8 + 1).cast("int"))
    base = F.concat(F.lit("http://h/a/"), F.col("doc_id").cast("string"), F.lit("/p.m3u8?q=/z"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", sc.absolute_url(rel, base).alias("url"))


# --- bytes written and read back -----------------------------------------------------------

BYTES_CTE = """
WITH numbered AS (SELECT user_id AS file, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (epoch_us(ts) - 1704067200000000) // 1000 AS dts FROM events),
units AS (SELECT file, CAST(idx AS BIGINT) AS idx, CAST(dts AS BIGINT) AS dts, CAST(dts + (event_id % 3) * 55555555 AS BIGINT) AS pts, CAST(floor(value) + 1 AS BIGINT) AS size, event_type = 'signup' AS is_key FROM numbered)
"""


def _units(spark, d):
    """Events as access units at 1 kHz, so that a month fits 33 bits."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("file"),
        (F.row_number().over(w).cast("long") - 1).alias("idx"),
        F.expr(f"(unix_micros(cast(ts as timestamp)) - {tl.EPOCH_US}) div 1000").alias("dts"),
        (F.col("event_id") % 3 * F.lit(55_555_555)).alias("shift"),
        (F.floor("value") + 1).cast("int").alias("size"),
        (F.col("event_type") == "signup").alias("is_key"),
    )
    nal = F.concat(F.when(F.col("is_key"), F.lit(b"\x65")).otherwise(F.lit(b"\x41")), F.unhex(F.repeat(F.lit("88"), F.col("size") - 1)))
    return rows.withColumn("pts", F.col("dts") + F.col("shift")).withColumn("data", nal).withColumn("kind", F.lit("video")).withColumn("pos", F.col("idx"))


def _ts_files(spark, d):
    return ts_sink.write(_units(spark, d))


@register("s10_ts_round_trip", BYTES_CTE + "SELECT file, idx, CAST(dts - min(pts) OVER (PARTITION BY file) AS BIGINT) AS dts, CAST(pts - min(pts) OVER (PARTITION BY file) AS BIGINT) AS pts, size, is_key FROM units")
def s10_ts_round_trip(spark, d):
    return tl.normalise(ts_source.units(_ts_files(spark, d), payload=False), ["file"]).select("file", "idx", "dts", "pts", "size", "is_key")


@register("s06_ts_packets", BYTES_CTE + "SELECT file, CAST(count(*) AS BIGINT) AS starts, CAST(count(*) FILTER (is_key) + CASE WHEN bool_or(idx = 0 AND is_key) THEN 0 ELSE 1 END AS BIGINT) AS pats FROM units GROUP BY file")
def s06_ts_packets(spark, d):
    found = ts_source.packets(_ts_files(spark, d))
    return found.groupBy("file").agg(F.count_if((F.col("pid") == 0x101) & F.col("pusi")).alias("starts"), F.count_if(F.col("pid") == 0).alias("pats"))


def _mp4_rows(spark, d):
    return _units(spark, d).withColumn("track_id", F.lit(256).cast("long")).withColumn("handler", F.lit("vide"))


@register(
    "s17_mp4_round_trip",
    BYTES_CTE + """SELECT file, idx, CAST(dts - first(dts) OVER w AS BIGINT) AS dts, CAST(pts - first(dts) OVER w AS BIGINT) AS pts, size,
CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rel_offset,
is_key OR NOT bool_or(is_key) OVER (PARTITION BY file) AS is_key FROM units WINDOW w AS (PARTITION BY file ORDER BY idx)""",
)
def s17_mp4_round_trip(spark, d):
    found = mp4_source.samples(mp4_sink.write(_mp4_rows(spark, d), timescale=1_000))
    base = F.min("offset").over(Window.partitionBy("file"))
    return found.select("file", "idx", "dts", "pts", "size", (F.col("offset") - base).alias("rel_offset"), "is_key")


@register("s21_fmp4_round_trip", BYTES_CTE + "SELECT file, idx, dts, pts, size, CAST(coalesce(lead(dts) OVER w - dts, dts - lag(dts) OVER w, 3003) AS BIGINT) AS duration, is_key FROM units WINDOW w AS (PARTITION BY file ORDER BY idx)")
def s21_fmp4_round_trip(spark, d):
    found = mp4_source.samples(mp4_sink.write(_mp4_rows(spark, d), timescale=1_000, fragments=16))
    return found.select("file", "idx", "dts", "pts", "size", "duration", "is_key")


@register("s14_mp4_boxes", BYTES_CTE + "SELECT file, 'ftyp,mdat,moov' AS top, CAST(sum(size) + 8 AS BIGINT) AS mdat_size FROM units GROUP BY file")
def s14_mp4_boxes(spark, d):
    found = mp4_source.boxes(mp4_sink.write(_mp4_rows(spark, d), timescale=1_000)).where("depth = 0")
    return found.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("top"), F.max(F.when(F.col("type") == "mdat", F.col("size"))).alias("mdat_size"))


@register("r07_ts_to_mp4", BYTES_CTE + "SELECT file, idx, CAST(dts - first(dts) OVER w AS BIGINT) AS dts, size, is_key OR NOT bool_or(is_key) OVER (PARTITION BY file) AS is_key FROM units WINDOW w AS (PARTITION BY file ORDER BY idx)")
def r07_ts_to_mp4(spark, d):
    units = ts_source.units(_ts_files(spark, d)).where("kind = 'video'")
    rows = units.select("file", F.lit(256).cast("long").alias("track_id"), F.lit("vide").alias("handler"), "idx", "dts", "pts", "is_key", F.element_at("nals", 1).alias("data"))
    found = mp4_source.samples(mp4_sink.write(rows, timescale=1_000))
    return found.select("file", "idx", "dts", "size", "is_key")


# --- clips of other tracks, bands, ranks and reshapes --------------------------------------


@register(
    "r03_clip_other",
    TIMELINE_CTE
    + RANGES_CTE
    + """, f AS (SELECT track, rid, coalesce(s, 0) AS s, e, min(idx) FILTER (pts >= coalesce(s, 0)) AS first, max(idx) + 1 AS n FROM timeline, ranges GROUP BY track, rid, s, e),
b AS (SELECT f.track, f.rid, f.s, f.e, first, coalesce(min(t.idx) FILTER (t.idx >= first AND t.pts >= f.e), n) AS stop FROM f JOIN timeline t USING (track) WHERE first IS NOT NULL GROUP BY f.track, f.rid, f.s, f.e, first, n),
c AS (SELECT b.track, rid, s, e, idx, dts, pts, coalesce(duration, 0) AS duration FROM b JOIN timeline t ON t.track = b.track AND idx >= first AND idx < stop)
SELECT track, rid, idx, CAST(dts - first_value(dts) OVER w AS BIGINT) AS dts, CAST(pts - first_value(dts) OVER w AS BIGINT) AS pts, CAST(duration AS BIGINT) AS duration,
  CAST(least(coalesce(e - s, sum(duration) OVER v), sum(duration) OVER v) AS BIGINT) AS playback FROM c WINDOW w AS (PARTITION BY track, rid ORDER BY idx), v AS (PARTITION BY track, rid)""",
)
def r03_clip_other(spark, d):
    return clips.clip_other(_timeline(spark, d), _ranges(spark), ["track"])


DAY_SEGMENTS = ", segs AS (SELECT track, idx AS seg, dts AS start, lead(dts) OVER (PARTITION BY track ORDER BY idx) AS stop FROM timeline WHERE idx % 5 < 2)"


@register("j04_audio_in_segments", TIMELINE_CTE + DAY_SEGMENTS + " SELECT t.track, t.idx, t.pts AS t, s.seg FROM timeline t JOIN segs s ON s.track = t.track AND t.pts >= s.start AND t.pts < s.stop WHERE s.seg % 5 = 0")
def j04_audio_in_segments(spark, d):
    rows = _timeline(spark, d)
    marks = rows.where("idx % 5 < 2").withColumn("end", F.lead("dts").over(Window.partitionBy("track").orderBy("idx")))
    segments = marks.where("idx % 5 = 0 AND end IS NOT NULL").select("track", F.col("idx").alias("seg"), F.col("dts").alias("start"), "end")
    return clips.in_segments(rows.select("track", "idx", F.col("pts").alias("t")), segments, ["track"])


@register(
    "j10_match_by_rank",
    "WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 2 = 0), "
    "b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 2 = 1) "
    "SELECT a.o_custkey AS file, a.o_orderkey AS fragment_track, b.o_orderkey AS movie_track FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.r = b.r",
)
def j10_match_by_rank(spark, d):
    ids = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("file"), "o_orderkey")
    left = ids.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "fragment_track")
    right = ids.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "movie_track")
    return clips.match_by_rank(left, right, ["file"], "fragment_track", "movie_track")


@register(
    "j12_sample_in_range",
    TIMELINE_CTE
    + """, spread AS (SELECT track, idx, "offset" + (idx // 7) * 300 AS o, size FROM timeline),
r AS (SELECT *, max(o + size) OVER (PARTITION BY track ORDER BY o, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spread),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR o > reach + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY o, idx) - 1 AS range_id FROM r)
SELECT track, idx, CAST(range_id AS BIGINT) AS range_id, CAST(o - min(o) OVER (PARTITION BY track, range_id) AS BIGINT) AS inside FROM g""",
)
def j12_sample_in_range(spark, d):
    rows = _timeline(spark, d).withColumn("offset", F.col("offset") + F.expr("idx div 7") * 300)
    start = F.min("offset").over(Window.partitionBy("track", "range_id"))
    return tl.in_byte_ranges(rows, ["track"], 200).select("track", "idx", "range_id", (F.col("offset") - start).alias("inside"))


@register("a05_playback", TIMELINE_CTE + "SELECT track, CAST(greatest(0, sum(coalesce(duration, 0)) - max(pts)) AS BIGINT) AS playback FROM timeline GROUP BY track")
def a05_playback(spark, d):
    found = _timeline(spark, d).groupBy("track").agg(F.sum(F.coalesce("duration", F.lit(0))).alias("total"), F.max("pts").alias("preroll"))
    return found.select("track", clips.playback_duration(F.col("total"), F.col("preroll")).alias("playback"))


@register(
    "k04_edit_times",
    TIMELINE_CTE
    + """, x AS (SELECT track, idx, CASE WHEN pts - dts > 0 AND idx % 2 = 0 THEN pts - dts WHEN idx % 5 = 0 THEN 0 ELSE dts END AS m FROM timeline)
SELECT track, idx, nullif(m, 0) AS video, nullif(CAST(floor(CAST(m AS DOUBLE) * 48000 / 90000 + 0.5) AS BIGINT), 0) AS audio FROM x""",
)
def k04_edit_times(spark, d):
    preroll = F.when(F.col("idx") % 2 == 0, F.col("pts") - F.col("dts")).otherwise(F.lit(0).cast("long"))
    first = F.when(F.col("idx") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("dts"))
    return _timeline(spark, d).select("track", "idx", clips.edit_time(preroll, first).alias("video"), clips.edit_time(preroll, first, F.lit(48_000)).alias("audio"))


@register(
    "p03_to_ticks",
    TIMELINE_CTE
    + """SELECT track, idx, CAST(floor((pts / 90000.0::DOUBLE - dts / 90000.0::DOUBLE) * 1000 + 0.5) AS BIGINT) AS offset_ticks, CAST(floor(duration / 90000.0::DOUBLE * 1000 + 0.5) AS BIGINT) AS duration,
CAST(CASE WHEN is_key THEN 0 ELSE 65536 END AS BIGINT) AS flags FROM timeline""",
)
def p03_to_ticks(spark, d):
    rows = _timeline(spark, d)
    rows = rows.withColumns({c: sc.seconds(F.col(c), F.lit(90_000.0)) for c in ("dts", "pts", "duration")})
    return clips.to_ticks(rows, 1_000).select("track", "idx", "offset_ticks", "duration", "flags")


@register("p04_defaults", TIMELINE_CTE + "SELECT track, idx, coalesce(duration, 0) AS duration, is_key FROM timeline")
def p04_defaults(spark, d):
    return clips.with_defaults(_timeline(spark, d), "duration").select("track", "idx", "duration", "is_key")


@register("p06_whole_samples", TIMELINE_CTE + 'SELECT track, idx, "offset" FROM timeline WHERE "offset" + size <= 1000 + 100 * (track % 50)')
def p06_whole_samples(spark, d):
    return clips.whole_samples(_timeline(spark, d), 1_000 + 100 * (F.col("track") % 50)).select("track", "idx", "offset")


@register(
    "p09_info",
    TIMELINE_CTE
    + """SELECT track, CAST(count(*) FILTER (event_type <> 'click') AS BIGINT) AS video_samples, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS audio_samples,
CAST(count(*) FILTER (event_type <> 'click' AND is_key) AS BIGINT) AS keyframes, coalesce(bool_or(pts <> dts) FILTER (event_type <> 'click'), false) AS has_b_frames FROM timeline GROUP BY track""",
)
def p09_info(spark, d):
    rows = tl.from_events(spark.read.parquet(f"{d}/events.parquet"), keep=("event_type",))
    return clips.info(rows.withColumn("handler", F.when(F.col("event_type") == "click", "soun").otherwise("vide")), ["track"])


@register(
    "r09_relative_range",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN greatest(0.0::DOUBLE, (o_orderkey % 100)::DOUBLE - (o_custkey % 60)::DOUBLE) END AS s, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100 + 10)::DOUBLE - (o_custkey % 60)::DOUBLE END AS e FROM orders",
)
def r09_relative_range(spark, d):
    start = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 100).cast("double"))
    end = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 100 + 10).cast("double"))
    s, e = clips.relative_range(start, end, (F.col("o_custkey") % 60).cast("double"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", s.alias("s"), e.alias("e"))


@register("c02_sps_size", "SELECT o_orderkey, CAST(2 * (o_orderkey % 2000 + 8) AS INTEGER) AS width, CAST(2 * (o_custkey % 1100 + 8) AS INTEGER) AS height FROM orders")
def c02_sps_size(spark, d):
    size = [(2 * (F.col("o_orderkey") % 2_000 + 8)).cast("int"), (2 * (F.col("o_custkey") % 1_100 + 8)).cast("int")]
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", avc.sps_size(avc.make_sps(*size)).alias("z")).select("o_orderkey", "z.width", "z.height")


@register(
    "p12_first_sets",
    TIMELINE_CTE
    + """SELECT track, '67' || lpad(to_hex(arg_min(size, idx) FILTER (event_type = 'view')), 8, '0') AS sps, '68' || lpad(to_hex(arg_min(size, idx) FILTER (event_type = 'signup')), 8, '0') AS pps FROM timeline GROUP BY track""",
)
def p12_first_sets(spark, d):
    rows = tl.from_events(spark.read.parquet(f"{d}/events.parquet"), keep=("event_type",))
    kind = F.when(F.col("event_type") == "view", "67").when(F.col("event_type") == "signup", "68").otherwise("41")
    unit = F.unhex(F.concat(kind, F.lpad(F.hex("size"), 8, "0")))
    found = avc.first_sets(rows.select("track", "idx", F.array(F.lit(b"\x09\xf0"), unit).alias("nals")), ["track"])
    return found.select("track", F.hex("sps").alias("sps"), F.hex("pps").alias("pps"))


@register(
    "x01_registered_functions",
    "SELECT l_orderkey, l_linenumber, CAST(floor(CAST(l_extendedprice AS DOUBLE) + 0.5) AS BIGINT) AS rounded, CAST(floor(CAST(l_partkey AS DOUBLE) * 90000 / 48000 + 0.5) AS BIGINT) AS ticks, CAST(l_partkey AS DOUBLE) / 90000 AS t FROM lineitem",
)
def x01_registered_functions(spark, d):
    registry.register(spark)
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "media_round(cast(l_extendedprice as double)) AS rounded", "media_rescale(l_partkey, 90000, 48000) AS ticks", "media_seconds(l_partkey, 90000) AS t"
    )


@register("s24_payloads", BYTES_CTE + "SELECT file, idx, CASE WHEN is_key THEN '65' ELSE '41' END || repeat('88', CAST(size - 1 AS INTEGER)) AS data FROM units")
def s24_payloads(spark, d):
    files = mp4_sink.write(_mp4_rows(spark, d), timescale=1_000)
    found = file_source.payloads(files, mp4_source.samples(files))
    return found.select("file", "idx", F.hex("data").alias("data"))
