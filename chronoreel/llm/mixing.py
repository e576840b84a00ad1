"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document of a source, in shuffled order, gets a virtual finish time: the source's
tokens up to and with it, divided by the source's target. A source that is to be repeated
queues its documents again. The queue is served in order of that time until the budget is
spent: it is sorted by ranges over all tasks, the ranges' totals tell in which of them the
budget ends, and that one alone is looked into, by ranges again while it is large. A source's
prefix sums run in two steps, bucket totals first. So no source and no range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from chronoreel.llm.common import WORD, cut

#: Rows wanted in a bucket of a prefix sum or a range of the queue, and ranges made at once.
BUCKET_ROWS, RANGES = 4_000, 2_000


def word_count(text: Column) -> Column:
    """Words of a text, by the starts of runs; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def tie_of(text_col: str) -> Column:
    """What tells rows of one id apart: a hash of the text, null as empty."""
    return F.xxhash64(text_of(text_col))


def source_targets(sizes: DataFrame, budget: float, repeat: float, weights: tuple[int, ...]) -> DataFrame:
    """``source, source_no, source_size, n, weight, target`` from one row of totals per source.

    Water-filling in closed form: by rising ratio of cap to weight, the first k sources sit at
    their caps, where the level the others share would be no more than the next ratio.
    """
    everything = Window.partitionBy(F.lit(0))
    ratio = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    order = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(w) for w in weights])
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("source_no", order)
        .withColumn("weight", F.get(choice, order % len(weights)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_no", "source_size", "n", "weight", "target")
    )


def mix(
    docs: DataFrame,
    budget: float = 1.5,
    repeat: int = 2,
    weights: tuple[int, ...] = (3, 1, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, tie, source_size, target, taken``: the words that a mix takes of each document.

    ``budget`` is the mix's size as a multiple of all sizes; no document is taken more than
    ``repeat`` times. Null text has size 0; a null source is a source of its own, the last.
    The shuffle is the order of md5(id), ties by id, then by size and a hash of the text; null
    ids, first, have the md5 of their text instead. Rows alike in all of that stand in one order
    or another, which no result can tell. An empty table gives an empty table.
    """
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.coalesce(F.md5(F.col(id_col).cast("long").cast("string")), F.md5(text_of(text_col))).alias("key"),
            tie_of(text_col).alias("tie"),
        ),
        "sizes",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = cut(source_targets(totals, budget, repeat, weights), "targets")
    all_sources, all_words = goals.agg(F.count("*"), F.sum("source_size")).first()
    if not all_sources:
        return rows.selectExpr("doc_id", "source", "size", "tie", "size AS source_size", "0D AS target", "size AS taken")
    limit = all_words * budget

    g = goals.select(F.col("source").alias("of"), "source_no", "source_size", "target", F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("buckets"))
    place = F.coalesce(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(0))
    placed = rows.join(F.broadcast(g) if all_sources <= 10_000 else g, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "bucket", F.shiftright(place * F.col("buckets"), 32)
    )
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        placed.groupBy("source_no", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .select("source_no", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    queued = cut(
        placed.withColumn("upto", F.sum("size").over(within))
        .join(offset, ["source_no", "bucket"])
        .select("doc_id", "source", "source_no", "key", "size", "tie", "source_size", "target", (F.col("upto") + F.col("offset")).alias("upto")),
        "queued",
    )
    items = queued.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("finish", _finish(F.col("round")))
    mark, all_taken = _last_served(items.select(*RANK), limit)
    times = F.lit(repeat if all_taken else 0)
    if mark is not None and not all_taken:
        last = F.struct(*[F.lit(x).cast(t) for x, t in zip(mark, RANK_TYPES, strict=True)])
        for r in range(repeat):
            rank = F.struct(*[_finish(F.lit(r)) if c == "finish" else F.lit(r) if c == "round" else F.col(c) for c in RANK])
            times += F.when((F.col("size") > 0) & (rank <= last), 1).otherwise(0)
    return queued.select("doc_id", "source", "size", "tie", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


#: The order in which the queue is served.
RANK = ("finish", "source_no", "key", "doc_id", "size", "tie", "round")
RANK_TYPES = ("double", "int", "string", "long", "long", "long", "int")


def _finish(round_no: Column) -> Column:
    """Virtual finish time of a document in a round of its source."""
    return F.try_divide(F.col("upto") + round_no * F.col("source_size"), F.col("target"))


def _last_served(queue: DataFrame, limit: float) -> tuple[Row | None, bool]:
    """The last item of the queue, sorted, up to which sizes sum to no more than ``limit``, null for none; and whether all do."""
    spent, mark = 0, None
    while True:
        n = queue.count()
        small = n <= BUCKET_ROWS
        if not small:
            parts = min(RANGES, -(-n // BUCKET_ROWS) * 2)
            queue = cut(queue.repartitionByRange(parts, *RANK).withColumn("part", F.spark_partition_id()), "queue")
            totals = queue.groupBy("part").agg(F.sum("size").alias("s"), F.max(F.struct(*RANK)).alias("last"))
            totals = totals.withColumn("after", F.sum("s").over(Window.orderBy("part")) + F.lit(spent)).cache()
            over = totals.where(F.col("after") > F.lit(limit)).orderBy("part").select("part", F.col("after") - F.col("s")).first()
            held = totals.where(F.col("after") <= F.lit(limit)).orderBy(F.desc("part")).select("last").first()
            totals.unpersist()
            mark = held[0] if held else mark
            if over is None:
                return mark, True
            small = totals.count() == 1  # rows that are all alike can't be told apart by ranges
            spent, queue = over[1], queue.where(F.col("part") == over[0]).select(*RANK)
        if small:
            sums = queue.withColumn("after", F.sum("size").over(Window.orderBy(*RANK).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(spent))
            held, all_taken = sums.agg(F.max(F.when(F.col("after") <= F.lit(limit), F.struct(*RANK))), F.coalesce(F.max("after") <= F.lit(limit), F.lit(True))).first()
            return held or mark, all_taken
