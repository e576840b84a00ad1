"""The engine's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from chronoreel.functions import avc

#: Name, arguments, type and body of functions in SQL itself; the optimizer inlines them.
SQL_FUNCTIONS = (
    ("media_round", "x DOUBLE", "BIGINT", "CAST(floor(x + 0.5) AS BIGINT)"),
    ("media_rescale", "ticks BIGINT, to_scale BIGINT, of_scale BIGINT", "BIGINT", "CASE WHEN of_scale > 0 THEN CAST(floor(CAST(ticks AS DOUBLE) * to_scale / of_scale + 0.5) AS BIGINT) ELSE ticks END"),
    ("media_seconds", "ticks BIGINT, scale BIGINT", "DOUBLE", "CAST(ticks AS DOUBLE) / scale"),
)


def register(spark: SparkSession) -> list[str]:
    """Offer the functions to ``spark.sql`` of this session and name them."""
    for name, arguments, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udf.register("media_sps_size", avc.sps_size)
    return [name for name, *_ in SQL_FUNCTIONS] + ["media_sps_size"]
