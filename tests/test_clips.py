from chronoreel.functions import avc, registry
from chronoreel.operators import clips

SCHEMA = "f int, idx long, dts long, pts long, duration long"


def test_clip_other_takes_a_stretch_in_decode_order(spark):
    pts = [0, 30, 10, 20, 50, 40]
    rows = spark.createDataFrame([(1, i, 10 * i, p, 10 if i < 5 else None) for i, p in enumerate(pts)], SCHEMA)
    ranges = spark.createDataFrame([(0, 10, 40), (1, None, None), (2, 60, None), (3, 30, 30), (4, 45, 10)], "rid int, s long, e long")
    got = sorted(map(tuple, clips.clip_other(rows, ranges, ["f"]).select("rid", "idx", "dts", "pts", "playback").collect()))
    assert got == [(0, 1, 0, 20, 30), (0, 2, 10, 0, 30), (0, 3, 20, 10, 30)] + [(1, i, 10 * i, pts[i], 50) for i in range(6)]


def test_spans_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(clips, "BLOCK", 4)
    rows = spark.range(30).selectExpr("1 AS f", "id AS idx")
    spans = spark.createDataFrame([(1, 0, 3, 9), (1, 1, 8, 8), (1, 2, 0, 30), (2, 3, 0, 9)], "f int, rid int, first long, stop long")
    got = {r: sorted(x.idx for x in clips.within(rows, spans, ["f"]).where(f"rid = {r}").collect()) for r in range(4)}
    assert got == {0: list(range(3, 9)), 1: [], 2: list(range(30)), 3: []}


def test_points_outside_segments_go(spark):
    segments = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 30)], "f int, seg int, start long, end long")
    points = spark.createDataFrame([(1, t) for t in (-1, 0, 9, 10, 19, 20, 30)], "f int, t long")
    assert sorted((r.t, r.seg) for r in clips.in_segments(points, segments, ["f"]).collect()) == [(0, 0), (9, 0), (20, 2)]


def test_picture_sizes():
    # a set as an encoder writes it, high profile
    assert avc.picture_size(bytes.fromhex("6764001facd9405005bb011000000300100000030 3c0f183196 0".replace(" ", ""))) == (1280, 720)
    for size in ((16, 16), (1280, 720), (1920, 1080), (640, 360), (2, 4098)):
        assert avc.picture_size(avc.build_sps(*size)) == size
    whole = avc.build_sps(640, 360)
    assert {avc.picture_size(x) for x in (None, b"", whole[:3], whole[:6])} == {(1920, 1080)}


def test_registered_functions(spark):
    assert set(registry.register(spark)) == {"media_round", "media_rescale", "media_seconds", "media_sps_size"}
    row = spark.createDataFrame([(bytearray(avc.build_sps(1280, 720)),)], "sps binary").selectExpr("media_round(-2.5D) AS a", "media_rescale(5, 10, 0) AS b", "media_sps_size(sps).height AS c").first()
    assert tuple(row) == (-2, 5, 720)


def test_clips_as_a_scan_finds_them(spark):
    from chronoreel.operators import timeline as tl

    pts = [0, 30, 10, 20, 50, 40, 70, 60, 90, 80]
    keys = {0, 3, 6}
    rows = spark.createDataFrame([(1, i, 10 * i, p, i in keys) for i, p in enumerate(pts)], "f int, idx long, dts long, pts long, is_key boolean")
    asked = [(r, s, e) for r, (s, e) in enumerate((s, e) for s in (None, 0, 15, 35, 55, 200) for e in (None, 5, 20, 35, 60, 200))]
    want = []
    for r, s, e in asked:
        hit = next((i for i, p in enumerate(pts) if p > (s or 0)), len(pts))
        k = max((i for i in keys if i < hit), default=0)
        stop = next((i for i in range(k, len(pts)) if e is not None and pts[i] >= e), len(pts))
        want += [(r, i, 10 * i - pts[k], pts[i] - pts[k], max(0, (s or 0) - pts[k])) for i in range(k, stop)]
    got = tl.clip(rows, spark.createDataFrame(asked, "rid int, s long, e long"), ["f"]).select("rid", "idx", "dts", "pts", "preroll")
    assert sorted(map(tuple, got.collect())) == want
