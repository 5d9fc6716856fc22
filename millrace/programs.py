"""Command-line programs: each reads files, runs operators and writes a report.

    python -m millrace NAME ARGUMENTS

Outputs are folders of text files whose lines, in the order of the file names,
are the report; a report of one line is one file in its folder.  Arguments are
positional, in the order of the functions' parameters after the session.
"""

from __future__ import annotations

import inspect
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import clustering, explore, graph, itemsets, recommend, similarity, sketch
from millrace.sources import readers, writers
from millrace.streaming import live

PROGRAMS: dict[str, Callable] = {}


def program(f: Callable) -> Callable:
    PROGRAMS[f.__name__.replace("_", "-")] = f
    return f


def _text(spark: SparkSession, report: str, path: str) -> None:
    writers.text_file(spark.createDataFrame([(report,)], "value string"), path, one=True)


@program
def review_report(spark: SparkSession, reviews: str, output: str, year: str = "2018") -> None:
    writers.text_file(explore.review_json(readers.reviews(spark, reviews), year), output, one=True)


@program
def partition_report(spark: SparkSession, reviews: str, output: str, n: str) -> None:
    _text(spark, writers.json_text(explore.layout_report(readers.reviews(spark, reviews), "business_id", int(n))), output)


@program
def city_report(spark: SparkSession, reviews: str, businesses: str, cities: str, timings: str) -> None:
    found = explore.group_average(readers.reviews(spark, reviews).select("business_id", "stars"), readers.businesses(spark, businesses).select("business_id", "city"), "business_id", "city", "stars")
    found = found.persist()
    _text(spark, writers.json_text(explore.sort_timings(found, "stars", "city")), timings)
    writers.text_file(writers.city_lines(found), cities)
    found.unpersist()


def _itemset_file(baskets: DataFrame, support: int, output: str, chunks: int) -> None:
    baskets = graph.checkpointed(baskets)
    writers.text_file(writers.both_sections(itemsets.son_candidates(baskets, support, chunks), itemsets.frequent_itemsets(baskets, support)), output, one=True)


@program
def itemset_report(spark: SparkSession, case: str, support: str, pairs: str, output: str, chunks: str = "4") -> None:
    _itemset_file(itemsets.baskets(readers.pairs(spark, pairs), int(case)), int(support), output, int(chunks))


@program
def transaction_itemsets(spark: SparkSession, threshold: str, support: str, transactions: str, output: str, prepared: str = "", chunks: str = "4") -> None:
    """With ``prepared``, the cleaned transactions are written there as well."""
    clean = itemsets.prepare_transactions(readers.raw_transactions(spark, transactions))
    if prepared:
        writers.text_file(writers.transaction_lines(clean), prepared)
    _itemset_file(itemsets.baskets(clean, min_rows=int(threshold)), int(support), output, int(chunks))


@program
def similar_items(spark: SparkSession, ratings: str, output: str) -> None:
    sets = readers.pairs(spark, ratings).select(F.col("business_id").alias("id"), F.col("user_id").alias("element")).distinct()
    writers.text_file(writers.similarity_lines(similarity.lsh_similar(sets)), output)


def _rated(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), *(["stars"] if "stars" in df.columns else []))


@program
def collaborative_filter(spark: SparkSession, train: str, test: str, output: str) -> None:
    predicted = recommend.cf_predict(_rated(readers.ratings(spark, train)), _rated(readers.pairs(spark, test)))
    writers.text_file(writers.prediction_lines(predicted), output)


def _trees(spark: SparkSession, folder: str, test: str, extended: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    train = _rated(readers.ratings(spark, f"{folder}/yelp_train.csv"))
    users = readers.users(spark, f"{folder}/user.json").withColumnRenamed("user_id", "user")
    items = readers.businesses(spark, f"{folder}/business.json").withColumnRenamed("business_id", "item")
    pairs = _rated(readers.pairs(spark, test))
    a, b = (recommend.assemble_features(x, users, items, 3 if extended else 2, extended) for x in (train, pairs))
    return train, pairs, recommend.gbt_fit_predict(a, b)


@program
def tree_model(spark: SparkSession, folder: str, test: str, output: str) -> None:
    writers.text_file(writers.prediction_lines(_trees(spark, folder, test, False)[2], spaced=False), output)


@program
def hybrid_model(spark: SparkSession, folder: str, test: str, output: str) -> None:
    train, pairs, model = _trees(spark, folder, test, False)
    writers.text_file(writers.prediction_lines(recommend.hybrid(recommend.cf_predict(train, pairs), model)), output)


@program
def extended_tree_model(spark: SparkSession, folder: str, test: str, output: str) -> None:
    writers.text_file(writers.prediction_lines(_trees(spark, folder, test, True)[2], spaced=False), output)


def _graph(spark: SparkSession, threshold: str, pairs: str) -> DataFrame:
    return graph.checkpointed(graph.cooccurrence_edges(readers.pairs(spark, pairs).select("user_id", "business_id"), int(threshold)))


@program
def label_communities(spark: SparkSession, threshold: str, pairs: str, output: str) -> None:
    labels = graph.label_propagation(_graph(spark, threshold, pairs))
    writers.text_file(writers.community_lines(graph.communities(labels)), output)


@program
def divisive_communities(spark: SparkSession, threshold: str, pairs: str, betweenness: str, communities: str) -> None:
    edges = _graph(spark, threshold, pairs)
    writers.text_file(writers.betweenness_lines(graph.edge_betweenness(edges)), betweenness)
    writers.text_file(writers.community_lines(graph.communities(graph.divisive_communities(edges)[0], label="community")), communities)


def _ticks(spark: SparkSession, users: str, size: str, n: str) -> DataFrame:
    return graph.checkpointed(live.asks(spark, users, int(size), int(n)))


@program
def bloom_filter(spark: SparkSession, users: str, size: str, n: str, output: str) -> None:
    writers.text_file(writers.bloom_lines(sketch.bloom_fpr(_ticks(spark, users, size, n))), output)


@program
def distinct_estimate(spark: SparkSession, users: str, size: str, n: str, output: str) -> None:
    writers.text_file(writers.estimate_lines(sketch.fm_estimate(_ticks(spark, users, size, n))), output)


@program
def reservoir_sample(spark: SparkSession, users: str, size: str, n: str, output: str) -> None:
    writers.text_file(writers.reservoir_lines(sketch.reservoir_snapshots(_ticks(spark, users, size, n))), output)


@program
def cluster_points(spark: SparkSession, points: str, k: str, output: str) -> None:
    writers.text_file(writers.clustering_report(*clustering.bfr(readers.points(spark, points), int(k))), output)


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in PROGRAMS:
        for name, f in PROGRAMS.items():
            print(name, *[p if q.default is q.empty else f"[{p}]" for p, q in list(inspect.signature(f).parameters.items())[1:]])
        return 2
    from millrace.session import session

    PROGRAMS[argv[0]](session(f"millrace {argv[0]}"), *argv[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
