from pyspark.sql import functions as F

from chronoreel.functions import scalar as sc
from chronoreel.operators import timeline as tl

SCHEMA = "f int, idx long, dts long, pts long, size long, offset long, is_key boolean"


def rows(spark, dts, pts=None, keys=(0,), sizes=None, offsets=None):
    n = range(len(dts))
    return spark.createDataFrame([(1, i, dts[i], (pts or dts)[i], (sizes or [1] * len(dts))[i], (offsets or dts)[i], i in keys) for i in n], SCHEMA)


def test_frame_pick(spark):
    frames = tl.display_timeline(rows(spark, [0, 1, 2, 3, 4, 5, 6], [0, 9000, 3000, 6000, 18000, 12000, 15000]), ["f"])
    points = spark.createDataFrame([(1, -1), (1, 0), (1, 1500), (1, 3000), (1, 14_999), (1, 9_000_000)], "f int, t long")
    got = tl.as_of(points, frames, ["f"], "t", "start", "frame").orderBy("t").collect()
    assert [r.frame for r in got] == [0, 0, 0, 1, 4, 6]
    assert {r.frame for r in tl.as_of(points, frames.limit(0), ["f"], "t", "start", "frame").collect()} == {-1}
    tied = spark.createDataFrame([(1, 0, 2), (1, 0, 0), (1, 0, 1), (1, 50, 3)], "f int, start long, frame long").repartition(3)
    assert [r.frame for r in tl.as_of(points, tied, ["f"], "t", "start", "frame").orderBy("t").collect()][:2] == [0, 2]


def test_nearest_takes_the_first_of_equal_middles(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 4.0, 2.0), (1, 2, 5.0, 0.0), (1, 3, 10.0, 10.0), (1, 4, 14.0, 2.0)], "f int, idx long, start double, duration double").repartition(3)
    points = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 9.0), (1, 10.0), (1, 11.0), (1, 99.0)], "f int, t double")
    assert [r.idx for r in tl.nearest(points, segments, ["f"]).orderBy("t").collect()] == [0, 0, 0, 0, 3, 3]


def test_last_duration_rules(spark):
    def runs(dts):
        return [(r["count"], r["value"]) for r in tl.video_stts(rows(spark, dts), ["f"]).orderBy("run").collect()]

    assert runs([0, 3, 6, 9]) == [(3, 3), (1, 3003)]
    assert runs([0]) == [(1, 3003)]
    assert runs([0, 3, 6, 10, 14]) == [(2, 3), (2, 4), (1, 3)]
    assert runs([0, 3003, 6006]) == [(3, 3003)]
    assert [r.duration for r in tl.fragment_durations(rows(spark, [0, 5, 9]), ["f"]).orderBy("idx").collect()] == [5, 4, 4]
    assert [r.duration for r in tl.audio_durations(rows(spark, [0, 1920, 9000, 9000]), ["f"], 48_000).orderBy("idx").collect()] == [1024, 1024, 1024, 1024]


def test_segments_and_ranges(spark):
    got = tl.build_segments(rows(spark, list(range(0, 1000, 100)), keys=(0, 2, 4, 6)), ["f"], 400).orderBy("seg").collect()
    assert [(r.v_start, r.v_end, r.duration) for r in got] == [(0, 2, 200), (2, 4, 200), (4, 6, 200), (6, 9, 300)]
    whole = tl.build_segments(rows(spark, list(range(0, 1000, 100)), keys=(0, 2, 4, 6)), ["f"], 401, include_tail=True).orderBy("seg").collect()
    assert [(r.v_start, r.v_end) for r in whole] == [(0, 4), (4, 6), (6, 10)]
    at = tl.byte_ranges(rows(spark, [0, 1, 2], sizes=[10, 10, 10], offsets=[0, 10 + 65_536, 20 + 2 * 65_536 + 1]), ["f"]).orderBy("range_id").collect()
    assert [(r.start, r.end, r.n) for r in at] == [(0, 65_556, 2), (131_093, 131_103, 1)]
    touching = spark.createDataFrame([(0, 0.0, 5.0), (1, 5.0, 9.0), (2, 9.0, 12.0)], "i int, start double, end double")
    ask = spark.createDataFrame([(0, 5.0, 9.0)], "rid int, s double, e double")
    assert [r.i for r in tl.overlap(touching, ask).collect()] == [1]


def test_scalars(spark):
    one = spark.createDataFrame([(-2.5, b"\x80\0\0\0", "../x.ts")], "x double, b binary, u string")
    r = one.select(
        sc.jsround(F.col("x")).alias("a"), sc.jsround(-F.col("x")).alias("b"), sc.big_endian(F.col("b"), 0, 4).alias("c"), sc.is_sync(F.lit(None).cast("int")).alias("d"), sc.is_sync(F.lit(0x10000)).alias("e"),
        sc.size_label(F.lit(1048576)).alias("f"), sc.absolute_url(F.lit("/y.ts"), F.lit("http://h/a/b.m3u8?q=/z")).alias("g"), sc.absolute_url(F.lit("y.ts"), F.lit("http://h/a/b.m3u8?q=/z")).alias("h"), sc.is_playlist_url(F.lit("A.M3U8?x")).alias("i"),
        sc.media_format(F.lit(b"\x47\x47\x47")).alias("j"), sc.media_format(F.lit(b"\x47\x47\x47\x47")).alias("k"),
    ).first()
    assert tuple(r) == (-2, 3, 0x80000000, True, False, "1.00 MB", "http://h/y.ts", "http://h/a/y.ts", True, "unknown", "mpegts")


def test_size_label_ties_and_nulls(spark):
    sizes = [3_276_800, 3_407_872, 16_384_000, 1_048_575, 256, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "i int, x long").select("i", sc.size_label(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["3.12 MB", "3.25 MB", "15.62 MB", "1024.0 KB", "0.3 KB", None]
