"""Reports as columns of text, so the formats are testable, and files from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_object(row: DataFrame) -> DataFrame:
    """One JSON object for each row."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("value"))


def csv_lines(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """A CSV with a header; a sorted frame keeps its order in one file."""
    df.toDF(*(names or df.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def text_file(lines: DataFrame, path: str, one: bool = False) -> None:
    """Lines in their order: files in the order of their names, or one file."""
    (lines.coalesce(1) if one else lines).write.mode("overwrite").text(path)


def itemset_text(items: Column) -> Column:
    """('a') for one item, ('a', 'b') for more."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """size, line: the itemsets of each size on one line, in order."""
    return itemsets.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("items")), itemset_text), ",").alias("line"))


def both_sections(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """The whole report: sizes are separated by blank lines."""
    body = lambda df: itemset_report(df).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("size", "line"))), lambda x: x["line"]), "\n\n").alias("body"))
    c, f = body(candidates).withColumnRenamed("body", "c"), body(frequent).withColumnRenamed("body", "f")
    return c.withColumn("k", F.lit(1)).join(f.withColumn("k", F.lit(1)), "k").select(F.concat(F.lit("Candidates:\n"), "c", F.lit("\n\nFrequent Itemsets:\n"), "f").alias("value"))


def community_line(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")


def plain_number(x: Column) -> Column:
    """A double as its shortest text without an exponent, in the range that reports have."""
    text = x.cast("string")
    whole = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", x), "0+$", ""), r"\.$", ".0")
    return F.when(text.contains("E"), whole).otherwise(text)


def betweenness_line(src: Column, dst: Column, value: Column) -> Column:
    return F.concat(F.lit("('"), src.cast("string"), F.lit("', '"), dst.cast("string"), F.lit("'),"), plain_number(F.round(value, 5)))


def lines(df: DataFrame, order: list, cells: list, header: str | None = None) -> DataFrame:
    """value: a report's lines, sorted by ``order``; cells are joined by commas, and the header comes first.

    The sort is by ranges, so a large report is written by many tasks, whose
    files in the order of their names are the report.
    """
    keys = [c if isinstance(c, str) else f"_key{k}" for k, c in enumerate(order)]
    body = df.select(F.lit(1).alias("_part"), "*", *[c.alias(k) for c, k in zip(order, keys) if not isinstance(c, str)])
    value = F.concat_ws(",", *[c.cast("string") for c in cells])  # made after the sort, which moves values and not their text
    if header is not None:
        body = df.sparkSession.range(1).select(F.lit(0).alias("_part")).unionByName(body, allowMissingColumns=True)
        value = F.when(F.col("_part") == 0, F.lit(header)).otherwise(value)
    return body.orderBy("_part", *keys).select(value.alias("value"))


def similarity_lines(pairs: DataFrame) -> DataFrame:
    """Pairs id1, id2, similarity, sorted by both ids."""
    return lines(pairs, ["id1", "id2"], [F.col("id1"), F.col("id2"), plain_number(F.col("similarity"))], "business_id_1, business_id_2, similarity")


def prediction_lines(predicted: DataFrame, spaced: bool = True) -> DataFrame:
    """Predictions sorted by user and item; the header has blanks after its commas if ``spaced``."""
    return lines(predicted, ["user", "item"], [F.col("user"), F.col("item"), plain_number(F.col("prediction"))], "user_id, business_id, prediction" if spaced else "user_id,business_id,prediction")


def city_lines(averages: DataFrame) -> DataFrame:
    """city, stars by stars, the highest first, then by city."""
    return lines(averages, [(-F.col("stars")).alias("stars"), F.col("city")], [F.col("city"), plain_number(F.col("stars"))], "city,stars")


def transaction_lines(prepared: DataFrame) -> DataFrame:
    return lines(prepared, ["basket_id", "item"], [F.col("basket_id"), F.col("item")], "DATE-CUSTOMER_ID,PRODUCT_ID")


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """Edges by betweenness, the highest first, then by their ends; rounded in the text only."""
    return lines(edges, [(-F.col("betweenness")).alias("b"), F.col("src"), F.col("dst")], [betweenness_line(F.col("src"), F.col("dst"), F.col("betweenness"))])


def community_lines(found: DataFrame) -> DataFrame:
    """Communities by size, then by members."""
    return lines(found, ["size", "members"], [community_line(F.col("members"))])


def bloom_lines(rates: DataFrame) -> DataFrame:
    return lines(rates, ["batch"], [F.col("batch"), plain_number(F.col("fpr"))], "Time,FPR")


def estimate_lines(estimates: DataFrame) -> DataFrame:
    return lines(estimates, ["batch"], [F.col("batch"), F.col("truth"), F.col("estimate")], "Time,Ground Truth,Estimation")


def reservoir_lines(snapshots: DataFrame) -> DataFrame:
    slots = [c for c in snapshots.columns if c.startswith("id_")]
    return lines(snapshots, ["batch"], [F.col("n"), *[F.coalesce(F.col(c), F.lit("")) for c in slots]], "seqnum," + ",".join(f"{c[3:]}_id" for c in slots))


def json_text(report: dict) -> str:
    """A small report, such as timings, as one JSON object."""
    return json.dumps(report)


def clustering_report(rounds: DataFrame, labels: DataFrame) -> DataFrame:
    """The rounds' counts and one line for each id, as ordered lines."""
    head = rounds.select(F.lit(0).alias("part"), F.col("round").cast("bigint").alias("k"), F.format_string("Round %d: %d,%d,%d,%d", "round", "ds_points", "cs_clusters", "cs_points", "rs_points").alias("value"))
    tail = labels.select(F.lit(2).alias("part"), F.col("id").alias("k"), F.concat_ws(",", "id", "cluster").alias("value"))
    spark = rounds.sparkSession
    titles = spark.createDataFrame([(0, -1, "The intermediate results:"), (1, 0, ""), (1, 1, "The clustering results:")], "part int, k long, value string")
    return titles.unionByName(head).unionByName(tail).orderBy("part", "k").select("value")
