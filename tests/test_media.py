from chronoreel.sinks import mp4 as mp4_sink
from chronoreel.sinks import mpegts as sink
from chronoreel.sources import mp4, mpegts, playlist


def stream(pts):
    m = sink.Muxer(True, b"\x67\x42\0\x1e", b"\x68\xce")
    m.video([b"\x65" + b"\x11" * 300], pts, pts, True)
    frame = b"\x22" * 50
    m.sound(sink.adts_header(50, 48_000, 2) + frame, pts)
    m.video([b"\x41\x01"], pts + 3000, pts + 1000, False)
    return m.build()


def test_transport_stream_round_trip_and_times():
    for pts in (0, 1 << 31, (1 << 32) + 5, (1 << 33) - 4000):
        data = stream(pts)
        assert len(data) % 188 == 0 and all(data[i] == 0x47 for i in range(0, len(data), 188))
        d = mpegts.Demuxer()
        d.feed(data)
        got = d.finish()
        video = [u for u in got if u[0] == "video"]
        assert [u[1] for u in video] == [pts, pts + 3000] and video[1][2] == pts + 1000
        assert mpegts.is_key(video[0][3]) and not mpegts.is_key(video[1][3]) and d.error() is None
        assert [u[3] for u in got if u[0] == "audio"] == [b"\x22" * 50] and (d.rate, d.channels) == (48_000, 2)


def test_resynchronisation_and_errors():
    d = mpegts.Demuxer()
    d.feed(b"junk" + stream(90_000))
    assert len([u for u in d.finish() if u[0] == "video"]) == 2 and d.stats["skipped"] == 4
    empty = mpegts.Demuxer()
    empty.feed(b"\0" * 500)
    assert empty.error() == "no PAT found"


def test_adts_carry_and_tail():
    d = mpegts.Demuxer()
    frames = [sink.adts_header(20, 48_000, 2) + bytes([i]) * 20 for i in range(1, 4)]
    data = b"".join(frames)
    d._frames(data[:40], 1000)
    d._frames(data[40:], 5000)
    assert [(u[1], u[3][:1]) for u in d.units] == [(1000, b"\1"), (5000, b"\2"), (6920, b"\3")]
    late = mpegts.Demuxer()
    late._frames(frames[0], None)
    assert not late.units and late.stats["lost_audio"] == 1


def test_checksums_and_units():
    assert sink.crc32_mpeg(b"123456789") == 0x0376E6E7
    assert mpegts.split_nals(b"\0\0\0\1\x09\0\0\1\x65\x01\0\0\0\1") == [b"\x09", b"\x65\x01"]
    assert mpegts.split_length_prefixed(b"\0\0\0\2ab\0\0\0\1c\0\0\0\x09d") == [b"ab", b"c"]


def test_mp4_boxes_and_edges():
    assert list(mp4.scan(b"\0\0\0\4free")) == []
    assert [r[2:5] for r in mp4.scan(b"\0\0\0\1mdat" + (24).to_bytes(8, "big") + b"x" * 8 + b"\0\0\0\0free12")] == [("mdat", 0, 24), ("free", 24, 10)]
    s = [{"dts": i * 10, "pts": i * 10 + (5 if i % 2 else -5), "is_key": i == 0, "data": bytes([i]) * (i + 1)} for i in range(4)]
    data = mp4_sink.build([({"id": 1, "handler": "vide", "timescale": 1000}, s)])
    trak = mp4._find(data, 0, len(data), "moov", "trak")
    t = mp4.track(data, *trak)
    x = mp4.sample_table(t)
    assert x["pts"].tolist() == [0, 15, 20, 35] and x["is_key"].tolist() == [True, False, False, False]
    assert [data[o : o + n] for o, n in zip(x["offset"], x["size"], strict=True)] == [r["data"] for r in s]
    assert t["duration"] == 30 + 3003


def test_a_single_picture_has_no_offsets():
    one = [{"dts": 0, "pts": 9000, "is_key": True, "data": b"x"}]
    assert b"ctts" not in mp4_sink.sample_tables(one, [3003], 0)
    assert b"ctts" in mp4_sink.sample_tables([*one, {"dts": 5, "pts": 5, "is_key": False, "data": b"y"}], [5, 5], 0)


def test_bad_file_is_an_error_row(spark):
    files = spark.createDataFrame([("a", b"nothing"), ("b", None)], "file string, content binary")
    assert {r.error for r in mpegts.units(files).collect()} == {"no PAT found"}
    assert {r.error for r in mp4.samples(files).collect()} == {"no moov box found"}


def test_playlist_edges(spark):
    texts = [
        ("m", "#EXTM3U\n#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=5,BANDWIDTH=800000,RESOLUTION=640x360\na.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=1\n\nb.m3u8\n#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=7,URI=\"i.m3u8\"\n"),
        ("s", '#EXTM3U\r\n#EXT-X-MAP:URI="x.mp4"\n#EXT-X-MAP:URI="y.mp4"\n#EXTINF:6.006,\nsa.ts\nsb.ts\n#EXTINF:2,\n#EXT-X-KEY:z\nhttp://o/sc.ts\n'),
        ("n", "#EXTM3U\n"),
    ]
    df = spark.createDataFrame([(n, "http://h/d/p.m3u8", t) for n, t in texts], "playlist string, base string, content string")
    assert [(r.kind, r.bandwidth, r.url, r.name) for r in playlist.variants(df).orderBy("pos").collect()] == [("stream", 800_000, "http://h/d/a.m3u8", "640x360"), ("iframe", 7, "http://h/d/i.m3u8", "0kbps")]
    assert [(r.url, r.duration, r.start) for r in playlist.segments(df).orderBy("idx").collect()] == [("http://h/d/sa.ts", 6.006, 0.0), ("http://h/d/sb.ts", 0.0, 6.006), ("http://o/sc.ts", 2.0, 6.006)]
    assert {r.playlist: r.init for r in playlist.init_segment(df).collect()} == {"s": "http://h/d/y.mp4"}
    assert {r.playlist: r.kind[:5] for r in playlist.kind(df).collect()} == {"m": "maste", "s": "media", "n": "error"}
