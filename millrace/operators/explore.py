"""Counts, top-k, join and average, partition layout."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import first_char_bucket

from .graph import checkpointed


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """key and n of the most frequent keys; ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def counts(reviews: DataFrame, year: str) -> DataFrame:
    """n_review, n_review_year, n_user, n_business in one pass."""
    return reviews.agg(F.count(F.lit(1)).alias("n_review"), F.count_if(F.col("date").contains(year)).alias("n_review_year"), F.countDistinct("user_id").alias("n_user"), F.countDistinct("business_id").alias("n_business"))


def _report_parts(reviews: DataFrame, year: str, k: int) -> DataFrame:
    """One row: the counts, and the top users and businesses as arrays of (id, n), from one pass over reviews.

    Rows are added up by user and by business at once; what is left is small
    and read for the counts and for either list, whose plans share its shuffle.
    """
    one = reviews.groupingSets([["user_id"], ["business_id"]], "user_id", "business_id").agg(F.grouping("user_id").alias("other"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("date").contains(year)).alias("n_year"))
    user, business = F.col("other") == 0, F.col("other") == 1
    out = one.agg(
        F.coalesce(F.sum(F.when(user, F.col("n"))), F.lit(0)).alias("n_review"), F.coalesce(F.sum(F.when(user, F.col("n_year"))), F.lit(0)).alias("n_review_year"),
        F.count(F.when(user, F.col("user_id"))).alias("n_user"), F.count(F.when(business, F.col("business_id"))).alias("n_business"),
    )
    for kind, key, name in ((user, "user_id", "top10_user"), (business, "business_id", "top10_business")):
        top = one.filter(kind).select(F.col(key).alias("id"), "n").orderBy(F.desc("n"), "id").limit(k)
        pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "id")))
        out = out.crossJoin(top.agg(F.transform(pairs, lambda x: F.struct(x["id"].alias("id"), (-x["m"]).alias("n"))).alias(name)))  # one row and one row
    return out


def review_report(reviews: DataFrame, year: str = "2018", k: int = 10) -> DataFrame:
    """One row: the counts, and the top users and businesses as id:count lists."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"], x["n"])), ",")
    return _report_parts(reviews, year, k).select("n_review", "n_review_year", "n_user", "n_business", text("top10_user").alias("top10_user"), text("top10_business").alias("top10_business"))


def json_quoted(id: Column) -> Column:
    """A string or number as JSON: what stands between the brackets of a one-element array."""
    text = F.to_json(F.array(id))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def review_json(reviews: DataFrame, year: str = "2018", k: int = 10) -> DataFrame:
    """value: the report as one JSON object, in which a list has [id, count] pairs."""
    row = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("["), json_quoted(x["id"]), F.lit(", "), x["n"].cast("string"), F.lit("]"))), ", "), F.lit("]"))
    r = _report_parts(reviews, year, k)
    parts = [("n_review", F.col("n_review").cast("string")), (f"n_review_{year}", F.col("n_review_year").cast("string")), ("n_user", F.col("n_user").cast("string")), ("top10_user", row("top10_user")), ("n_business", F.col("n_business").cast("string")), ("top10_business", row("top10_business"))]
    body = [x for i, (name, c) in enumerate(parts) for x in (F.lit(f'{", " if i else ""}"{name}": '), c)]
    return r.select(F.concat(F.lit("{"), *body, F.lit("}")).alias("value"))


def timed(run: Callable[[], object]) -> tuple[object, float]:
    """What run returns and its seconds of wall-clock."""
    began = time.perf_counter()
    out = run()
    return out, time.perf_counter() - began


def layout_report(df: DataFrame, key: str, n: int, k: int = 10) -> dict:
    """{default: {n_partition, n_items, exe_time}, customized: the same}: rows of each partition, and the seconds of counting them and the top keys."""
    out = {}
    for name, frame in (("default", df.select(key)), ("customized", custom_partitions(df.select(key), F.col(key), n))):

        def run(frame: DataFrame = frame) -> list[int]:
            items = [r.n_items for r in default_layout(frame).orderBy("partition_id").collect()]  # a number a partition
            top_k(frame, key, k).collect()
            return items

        items, seconds = timed(run)
        out[name] = {"n_partition": len(items), "n_items": items, "exe_time": seconds}
    return out


def sort_timings(df: DataFrame, value: str, key: str, k: int = 10) -> dict:
    """{m1, m2}: seconds of sorting all rows by (value descending, key) and then taking k, and of taking the k first without a sort of the rest."""
    order = [F.desc(value), F.asc(key)]
    _, m1 = timed(lambda: df.orderBy(*order).write.format("noop").mode("overwrite").save())
    _, m2 = timed(lambda: df.orderBy(*order).limit(k).collect())
    return {"m1": m1, "m2": m2}


def dense_ids(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Each distinct value of key with its place in their order, from 0, whatever the layout of df.

    Values are sorted by ranges; a partition needs only the number of values in
    those before it, so no task sees all of them.
    """
    values = df.select(key).filter(F.col(key).isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = checkpointed(values.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    inside = F.col("_at") - F.shiftleft(part, 33)
    return ranked.join(F.broadcast(before), part == F.col("_part")).select(key, (F.col("_before") + inside).alias(name))


def group_average(fact: DataFrame, dim: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """The mean of value by group over matching rows; partial sums, not lists, are shuffled."""
    return fact.join(dim, on).groupBy(group).agg(F.avg(value).alias(value))


def layout(spark: SparkSession, n: int, counted: DataFrame) -> DataFrame:
    """partition_id 0 to n - 1 with n_items; empty partitions are there with 0."""
    return spark.range(n).select(F.col("id").cast("int").alias("partition_id")).join(counted, "partition_id", "left").select("partition_id", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"))


def default_layout(df: DataFrame) -> DataFrame:
    found = df.select(F.spark_partition_id().alias("partition_id")).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n_items"))
    return layout(df.sparkSession, df.rdd.getNumPartitions(), found)


def custom_partitions(df: DataFrame, key: Column, n: int) -> DataFrame:
    """df dealt to n partitions by the first character of its key."""
    return df.repartitionById(n, first_char_bucket(key, n).cast("int"))


def custom_layout(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of each partition that custom_partitions makes, counted without moving them."""
    found = df.groupBy(first_char_bucket(F.col(key), n).cast("int").alias("partition_id")).agg(F.count(F.lit(1)).alias("n_items"))
    return layout(df.sparkSession, n, found)
