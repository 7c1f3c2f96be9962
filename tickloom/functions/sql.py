"""Scoring functions as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """``zscore``, ``iqr_score`` and ``safe_name`` for SQL text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION zscore(x DOUBLE, mu DOUBLE, sd DOUBLE) RETURNS DOUBLE RETURN CASE WHEN sd > 1e-12 THEN (x - mu) / sd ELSE 0D END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION iqr_score(x DOUBLE, q1 DOUBLE, q3 DOUBLE, k DOUBLE) RETURNS DOUBLE RETURN "
        "CASE WHEN q3 - q1 <= 1e-12 THEN 0D WHEN x < q1 - k * (q3 - q1) THEN (x - q1 + k * (q3 - q1)) / (q3 - q1) "
        "WHEN x > q3 + k * (q3 - q1) THEN (x - q3 - k * (q3 - q1)) / (q3 - q1) ELSE 0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION safe_name(s STRING) RETURNS STRING RETURN regexp_replace(s, '[^0-9A-Za-z_-]', '_')")
