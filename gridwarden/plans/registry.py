"""Where queries and their SQL are kept, and the pieces of SQL that many of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_id(rule: str, sheet: str, location: str) -> str:
    return f"'finding-' || substr(sha256(to_json(['{rule}', '{sheet}', {location}, NULL])::VARCHAR), 1, 16)"


def sql_finding(rule: str, sheet: str, location: str, severity: str, confidence: str) -> str:
    severity = severity if " " in severity else f"'{severity}'"
    return f"SELECT {sql_id(rule, sheet, location)} AS id, '{rule}' AS rule_id, {severity} AS severity, {location} AS location, CAST({confidence} AS DOUBLE) AS confidence"
