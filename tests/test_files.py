from pyspark.sql import functions as F

from chronoreel.sources import files


def test_files_and_ranges(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"a {i}.ts").write_bytes(bytes(range(10 * i, 10 * i + 10)))
    (tmp_path / "other.txt").write_bytes(b"x")
    found = files.read(spark, str(tmp_path), "*.ts")
    assert sorted((r.size, bytes(r.content)[0]) for r in found.collect()) == [(10, 0), (10, 10), (10, 20)]
    path = str(tmp_path / "a 1.ts")
    ranges = spark.createDataFrame([(path, 0, 3, 7), (path, 1, 8, 99), (path, 2, 50, 60), (str(tmp_path / "other.txt"), 0, 0, 1)], "file string, rid int, start long, end long")
    got = {(r.file[-5:], r.rid): bytes(r.content) for r in files.read_ranges(ranges).collect()}
    assert got == {(" 1.ts", 0): bytes(range(13, 17)), (" 1.ts", 1): bytes([18, 19]), (" 1.ts", 2): b"", ("r.txt", 0): b"x"}
    listed = files.read(spark, str(tmp_path), "*.ts").select(F.col("file"), F.lit(0).alias("rid"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))
    assert sorted(bytes(r.content)[0] for r in files.read_ranges(listed).collect()) == [0, 10, 20]


def test_payloads(spark):
    rows = spark.createDataFrame([("f", bytearray(b"abcdef"))], "file string, content binary")
    samples = spark.createDataFrame([("f", 1, 0, 0, 2), ("f", 1, 1, 2, 4), ("g", 1, 0, 0, 1)], "file string, track_id long, idx long, offset long, size long")
    assert sorted((r.idx, bytes(r.data)) for r in files.payloads(rows, samples).collect()) == [(0, b"ab"), (1, b"cdef")]
