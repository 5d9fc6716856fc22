"""Readers with declared schemas: one pass, pruned columns, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string"
BUSINESS = "business_id string, city string, stars double, review_count bigint, attributes map<string,string>"
USER = "user_id string, review_count bigint, useful bigint, average_stars double, fans bigint"


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW).json(path)


def businesses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUSINESS).json(path)


def users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER).json(path)


def header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line in each file; values are trimmed and may be quoted."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    return header_csv(spark, path, "user_id string, business_id string")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return header_csv(spark, path, "user_id string, business_id string, stars double")


def raw_transactions(spark: SparkSession, path: str) -> DataFrame:
    """date, customer and product: columns 0, 1 and 5 of a wider file."""
    return header_csv(spark, path, "date string, customer string, c2 string, c3 string, c4 string, product string").select("date", "customer", "product")


def points(spark: SparkSession, path: str) -> DataFrame:
    """id and features of headerless lines; the second column, a true label, is skipped."""
    cells = F.split("value", ",")
    return spark.read.text(path).select(F.trim(cells[0]).cast("bigint").alias("id"), F.slice(cells, 3, F.size(cells) - 2).cast("array<double>").alias("features"))


def user_lines(spark: SparkSession, path: str) -> DataFrame:
    """One user id a line."""
    return spark.read.text(path).select(F.col("value").alias("user_id"))


def in_memory(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows from the driver; an empty list gives an empty frame."""
    return spark.createDataFrame(rows, schema)
