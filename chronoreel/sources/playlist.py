"""HLS playlists: text to tables and tables to text, all in SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoreel.functions.scalar import absolute_url, fixed, quality_name
from chronoreel.operators.clips import if_small


def lines(playlists: DataFrame) -> DataFrame:
    """``playlist, base, pos, line`` from ``playlist, base, content``, trimmed."""
    split = F.posexplode(F.split("content", "\n")).alias("pos", "line")
    return playlists.select("playlist", "base", split).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def read(path: str, spark) -> DataFrame:
    """Playlist files as rows ``playlist, base, content``; the file's own place is the base."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("playlist"), F.col("value").alias("content"))
    return rows.select("playlist", F.col("playlist").alias("base"), "content")


def _attribute(name: str, value: str):
    return F.nullif(F.regexp_extract("line", rf"(?:^[^:]*:|,){name}={value}", 1), F.lit(""))


def variants(playlists: DataFrame) -> DataFrame:
    """``playlist, pos, kind, bandwidth, resolution, codecs, url, name``: a stream's address is the very next line, an I-frame list's an attribute."""
    w = Window.partitionBy("playlist").orderBy("pos")
    rows = lines(playlists).withColumn("next", F.lead("line").over(w))
    stream, iframe = F.col("line").startswith("#EXT-X-STREAM-INF:"), F.col("line").startswith("#EXT-X-I-FRAME-STREAM-INF:")
    uri = F.when(iframe, _attribute("URI", '"([^"]*)"')).when(~F.col("next").startswith("#"), F.nullif(F.col("next"), F.lit("")))
    found = rows.where(stream | iframe).select(
        "playlist",
        "base",
        "pos",
        F.when(iframe, "iframe").otherwise("stream").alias("kind"),
        F.coalesce(_attribute("BANDWIDTH", r"(\d+)").cast("long"), F.lit(0)).alias("bandwidth"),
        _attribute("RESOLUTION", r"(\d+x\d+)").alias("resolution"),
        _attribute("CODECS", '"([^"]*)"').alias("codecs"),
        uri.alias("url"),
    )
    found = found.where("url IS NOT NULL").withColumn("url", absolute_url(F.col("url"), F.col("base")))
    return found.withColumn("name", quality_name(F.col("resolution"), F.col("bandwidth"))).drop("base")


def segments(playlists: DataFrame) -> DataFrame:
    """``playlist, idx, url, duration, start, end`` of media playlists; one with a stream line anywhere has none."""
    whole = Window.partitionBy("playlist")
    w = whole.orderBy("pos")
    rows = lines(playlists)
    rows = rows.withColumn("master", F.max(F.col("line").startswith("#EXT-X-STREAM-INF").cast("int")).over(whole))
    media = rows.where("master = 0").withColumn("is_segment", (F.col("line") != "") & ~F.col("line").startswith("#"))
    length = F.regexp_extract("line", r"^#EXTINF:([\d.]+)", 1)
    media = media.withColumn("d", F.when(F.col("line").startswith("#EXTINF:"), F.coalesce(length.try_cast("double"), F.lit(0.0))))
    # a duration counts for the next segment alone
    turn = F.coalesce(F.sum(F.col("is_segment").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    media = media.withColumn("turn", turn)
    last = F.last("d", True).over(Window.partitionBy("playlist", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    found = media.withColumn("duration", F.coalesce(last, F.lit(0.0))).where("is_segment")
    before = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    found = found.select("playlist", F.col("turn").cast("int").alias("idx"), absolute_url(F.col("line"), F.col("base")).alias("url"), "duration", before.alias("start"))
    return found.withColumn("end", F.col("start") + F.col("duration"))


def init_segment(playlists: DataFrame) -> DataFrame:
    """``playlist, init``: the last EXT-X-MAP wins."""
    rows = lines(playlists).where(F.col("line").startswith("#EXT-X-MAP:"))
    return rows.groupBy("playlist").agg(F.max_by(absolute_url(_attribute("URI", '"([^"]*)"'), F.col("base")), "pos").alias("init"))


def kind(playlists: DataFrame) -> DataFrame:
    """``playlist, kind``: master, media, or an error in words."""
    by = lines(playlists).groupBy("playlist").agg(
        F.max(F.col("line").startswith("#EXT-X-STREAM-INF")).alias("m"), F.max((F.col("line") != "") & ~F.col("line").startswith("#")).alias("s")
    )
    return by.select("playlist", F.when(F.col("m"), "master").when(F.col("s"), "media").otherwise("error: neither variants nor segments").alias("kind"))


def select_variant(found: DataFrame, keys: list[str], wanted=None) -> DataFrame:
    """One variant of each group: highest for None or 'highest', 'lowest', nearest to a bandwidth, or of a resolution, else the highest."""
    rank = F.struct((-F.col("bandwidth")).alias("b"), "pos")
    if wanted == "lowest":
        best = F.struct(F.col("bandwidth").alias("b"), (-F.col("pos")).alias("p"))
    elif isinstance(wanted, int):
        best = F.struct(F.abs(F.col("bandwidth") - wanted).alias("a"), rank.alias("r"))
    elif isinstance(wanted, str) and wanted != "highest":
        best = F.struct(F.when(F.col("resolution") == wanted, 0).otherwise(1).alias("a"), rank.alias("r"))
    else:
        best = rank
    columns = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.min_by(F.struct(*columns), best).alias("v")).select(*keys, "v.*")


def prune(found: DataFrame, start: float | None = None, end: float | None = None, limit: int | None = None) -> DataFrame:
    """Segments that meet a time range, then the first few of a playlist; done before any media is opened."""
    if start is not None or end is not None:
        found = found.where(F.col("end") > F.lit(start or 0.0))
        found = found if end is None else found.where(F.col("start") < F.lit(end))
    if limit is not None:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("playlist").orderBy("idx"))).where(F.col("_n") <= limit).drop("_n")
    return found


def clip(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Summary of a clip of each playlist and range ``rid, s, e`` in seconds: no media is read."""
    rows = found.join(if_small(ranges), (F.col("end") > F.col("s")) & (F.col("start") < F.col("e")))
    return rows.groupBy("playlist", "rid").agg(
        F.count("*").alias("n"),
        F.first(F.col("e") - F.col("s")).alias("duration"),
        F.greatest(F.lit(0.0), F.first("s") - F.min("start")).alias("preroll"),
        F.sum("duration").alias("media_duration"),
        (F.greatest(F.lit(0.0), F.first("s") - F.min("start")) + F.first(F.col("e") - F.col("s"))).alias("playback_end"),
    )


def write_media(found: DataFrame, target: float | None = None) -> DataFrame:
    """``playlist, content``: a media playlist; the target duration is the longest segment's unless given."""
    entry = F.concat(F.lit("#EXTINF:"), fixed(F.col("duration"), 6), F.lit(",\n"), F.col("url"))
    length = F.max("duration") if target is None else F.lit(target)
    head = ["#EXTM3U", "#EXT-X-VERSION:3"]
    text = F.concat_ws(
        "\n", *map(F.lit, head), F.concat(F.lit("#EXT-X-TARGETDURATION:"), F.ceil(length).cast("string")), F.lit("#EXT-X-MEDIA-SEQUENCE:0"), F.lit("#EXT-X-PLAYLIST-TYPE:VOD"),
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("idx", entry.alias("t")))), lambda x: x["t"])), F.lit("#EXT-X-ENDLIST"),
    )
    return found.groupBy("playlist").agg(text.alias("content"))


def write_master(found: DataFrame) -> DataFrame:
    """``playlist, content``: variants by falling bandwidth."""
    attributes = F.concat_ws(",", F.concat(F.lit("BANDWIDTH="), F.col("bandwidth")), F.concat(F.lit("RESOLUTION="), F.col("resolution")), F.concat(F.lit('CODECS="'), F.col("codecs"), F.lit('"')))
    entry = F.concat(F.lit("#EXT-X-STREAM-INF:"), attributes, F.lit("\n"), F.col("url"))
    order = F.struct((-F.col("bandwidth")).alias("b"), "pos", entry.alias("t"))
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]))
    return found.groupBy("playlist").agg(F.concat_ws("\n", F.lit("#EXTM3U"), body).alias("content"))
