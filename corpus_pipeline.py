"""A training-corpus pipeline: one operator a stage, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.llm import langid, mixing, shingles, spm, substring
from chronoreel.llm.common import cut, give_back, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def begin(spark: SparkSession) -> None:
    """What each stage needs first: bounded batches, and executors that have given back the heap of the stage before."""
    small_batches(spark)
    give_back(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter, null and empty texts too, or whose language is refused.

    The whole text decides, however long. Rows of equal text share their fate, repeated and null
    ids keep a row each, other columns than a document's are left out. An empty table stays empty.
    """
    begin(spark)
    model = langid.learn(docs)
    return langid.identify(docs.select(*COLUMNS), model).where("accepted").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of a shingle similarity of 0.8 stays, the one with the smallest id, null the last; shingles of five words.

    Links are found by SimHash trees first, then by shared shingles, and checked on the whole
    sets. Null and empty texts and texts of white space are one group. Rows that share an id are
    rows of their own; ties go to the least text. An empty table stays empty.
    """
    begin(spark)
    return shingles.least_rows(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go, and documents that are left without a word by it.

    Null and empty texts stay as they are, so do rows with a null id; rows of equal ids are not
    earlier than each other. An empty table stays empty.
    """
    begin(spark)
    found = substring.remove_repeats(docs, 50, keep=("lang", "source", "n_chars"))
    kept = found.where("n_removed < n_words OR n_words = 0")
    length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length.cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: dropped, once, or once more.

    Null texts and texts without a word have nothing to take and go. A null source is a source.
    Rows of one id are told apart by source and text; of rows alike in all of that each is taken
    as often as the one taken most. An empty table stays empty.
    """
    begin(spark)
    keys = ("doc_id", "source", "tie")
    taken = mixing.mix(docs).where("taken > 0").select(*keys, (F.col("taken") / F.col("size")).cast("int").alias("times"))
    times = cut(taken.groupBy(*keys).agg(F.max("times").alias("times")), "times")
    times = times.toDF(*[f"of_{k}" for k in keys], "times")
    rows = docs.select(*COLUMNS).withColumn("tie", mixing.tie_of("text"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return rows.join(times, same).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with a digest of what they decode to; null text is empty, every row stays, an empty table stays empty."""
    begin(spark)
    found = spm.round_trip(docs.select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL has no expression for the learned model, nor for groups by reach; tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
