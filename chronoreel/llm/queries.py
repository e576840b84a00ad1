"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.llm import ann, chat, langid, mixing, ngram, range_join, simhash, spm, substring, token_store

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Words as the operators cut them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL_2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""

SQL_9 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
k AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + 49], ' ')) AS least FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k WHERE least < doc_id),
one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS line FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)"""

SQL_10 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
a AS (SELECT *, [3, 1, 2][CAST(no % 3 + 1 AS INT)] AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
b AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ()) * CAST(1.5 AS DOUBLE) AS total, coalesce(sum(cap) OVER before, 0) AS held, (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS others
  FROM a WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, max((total - held) / others) FILTER ((total - held) / others <= ratio) OVER () AS level FROM b),
t AS (SELECT source, no, source_size, total, coalesce(least(cap, level * weight), cap) AS target FROM c),
q AS (SELECT d.*, no, source_size, total, target, sum(size) OVER (PARTITION BY no ORDER BY key, doc_id) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, size, total, sum(size) OVER (ORDER BY (CAST(upto AS DOUBLE) + r * source_size) / target, no, key, doc_id, r ROWS UNBOUNDED PRECEDING) AS spent FROM q, (VALUES (0), (1)) x(r) WHERE size > 0),
n AS (SELECT doc_id, sum(size) AS taken FROM i WHERE spent <= total GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN n ON n.doc_id = q.doc_id"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op2_embedding_near_dedup", SQL_2)
def op2(spark, sf_dir):
    return range_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


@register("op3_nearest_neighbours")
def op3(spark, sf_dir):
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register("op7_simhash_near_dedup")
def op7(spark, sf_dir):
    found = simhash.near_duplicates(_documents(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_mix_sources", SQL_10)
def op10(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@register("op9_substring_dedup", SQL_9)
def op9(spark, sf_dir):
    return substring.remove_repeats(_documents(spark, sf_dir), 50).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op5_language_id")
def op5(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.learn(docs.where("NOT held_out"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@register("op6_sentencepiece")
def op6(spark, sf_dir):
    """Ids of every whole text, and a digest of what they decode to."""
    found = spm.round_trip(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@register("op8_token_store")
def op8(spark, sf_dir):
    folder = token_store.new_folder(spark)
    token_store.write(_documents(spark, sf_dir), folder)
    return token_store.read(spark, folder, digest_only=True)


@register("op1_ngram_score")
def op1(spark, sf_dir):
    return ngram.score(_documents(spark, sf_dir))


@register("op4_chat_windows")
def op4(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_windows(turns.union(own)))
