"""Registered queries of sources and reports: tables are staged as files in the shared folder and read back, reports are lines of text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import explore, graph, itemsets, recommend, similarity, sketch
from millrace.plans import catalog
from millrace.plans.catalog import query, t
from millrace.sources import readers, shared, writers
from millrace.streaming import live


def _staged(df: DataFrame, kind: str, **options) -> str:
    """The path of df's rows in files of a format."""
    path = shared.fresh_path(df.sparkSession, f"staged-{kind}")
    df.write.format(kind).options(**options).save(path)
    return path


# ---------------------------------------------------------------------- sources

_STR = "CAST({0} AS VARCHAR)"


@query(f"WITH {catalog._REVIEWS} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id, stars::DOUBLE AS stars, date FROM r")
def source_reviews_json(s, d):
    r = catalog.reviews(s, d).withColumn("unknown", F.lit("x"))  # a field that the schema does not have
    return readers.reviews(s, _staged(r.withColumn("user_id", F.col("user_id").cast("string")).withColumn("business_id", F.col("business_id").cast("string")), "json"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(c_nationkey AS BIGINT) AS review_count, 0::BIGINT AS useful, round(c_acctbal, 2) AS average_stars, CAST(NULL AS BIGINT) AS fans FROM customer")
def source_users_json(s, d):
    u = t(s, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_nationkey").alias("review_count"), F.lit(0).alias("useful"), F.round("c_acctbal", 2).alias("average_stars"))
    return readers.users(s, _staged(u, "json"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS business_id, p_name AS city, p_retailprice AS stars, CAST(p_size AS BIGINT) AS review_count, CASE WHEN p_size % 7 <> 0 THEN p_type END AS kind FROM part")
def source_businesses_json(s, d):
    b = t(s, d, "part").select(F.col("p_partkey").cast("string").alias("business_id"), F.col("p_name").alias("city"), F.col("p_retailprice").alias("stars"), F.col("p_size").alias("review_count"), F.when(F.col("p_size") % 7 != 0, F.create_map(F.lit("Kind"), F.col("p_type"))).alias("attributes"))
    return readers.businesses(s, _staged(b, "json")).select("business_id", "city", "stars", "review_count", F.col("attributes")["Kind"].alias("kind"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS business_id FROM orders")
def source_pairs_csv(s, d):
    return readers.pairs(s, _staged(t(s, d, "orders").select("o_custkey", "o_orderkey"), "csv", header=True))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS business_id, l_quantity AS stars FROM lineitem")
def source_ratings_csv(s, d):
    return readers.ratings(s, _staged(t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "csv", header=True))


@query("SELECT strftime(o_orderdate, '%-m/%-d/%y') || '-' || ltrim(CAST(o_custkey AS VARCHAR), '0') AS basket_id, ltrim(CAST(o_orderkey AS VARCHAR), '0') AS item FROM orders")
def source_transactions_csv(s, d):
    raw = t(s, d, "orders").select(F.date_format("o_orderdate", "M/d/yyyy").alias("date"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("customer"), F.lit("a").alias("c2"), F.lit(None).cast("string").alias("c3"), F.lit("x, y").alias("c4"), F.lpad(F.col("o_orderkey").cast("string"), 13, "0").alias("product"))
    return itemsets.prepare_transactions(readers.raw_transactions(s, _staged(raw, "csv", header=True, quoteAll=True)))


@query("SELECT vec_id AS id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def source_points_csv(s, d):
    p = t(s, d, "embeddings").select(F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",")).alias("value"))
    got = readers.points(s, _staged(p, "text"))
    return got.select("id", F.size("features").cast("bigint").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY 1")
def source_user_lines(s, d):
    lines = readers.user_lines(s, _staged(t(s, d, "events").select(F.col("user_id").cast("string")), "text"))
    return lines.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_in_memory(s, d):
    rows = [tuple(r) for r in t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows at every scale
    return readers.in_memory(s, rows, "n_nationkey int, n_name string, n_regionkey int")


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, CAST(user_id AS VARCHAR) AS user_id FROM events), n AS (SELECT count(*) AS n FROM events)
SELECT i // 100 AS batch, i AS seq, user_id FROM generate_series(0, 2999) g(i), n JOIN l ON line = CAST('0x' || substr(md5('553:' || i), 1, 15) AS BIGINT) % n""")
def stream_asks(s, d):
    """Thirty asks of a hundred users, drawn with replacement from a file of one user a line."""
    users = t(s, d, "events").orderBy("event_id").select(F.col("user_id").cast("string")).coalesce(1)  # the file's order is the numbers' order
    return live.asks(s, _staged(users, "text"), 100, 30)


@query("SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT user_id FROM events)")
def dense_ids(s, d):
    return explore.dense_ids(t(s, d, "events"), "user_id")


@query("SELECT u AS user_id, x AS fold, " + ", ".join(f"CAST((x * {a} + {b}) % {scalar.PRIME} % {scalar.BITS} AS BIGINT) AS h{i}" for i, (a, b) in enumerate(scalar.hash_parameters(4, 553))) + f" FROM (SELECT u, {catalog._fold(scalar.PRIME)} AS x FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events))")
def hash_values(s, d):
    u = t(s, d, "events").select(F.col("user_id").cast("string").alias("user_id")).distinct().withColumn("fold", scalar.byte_fold(F.col("user_id")))
    return u.select("user_id", "fold", *[scalar.affine_hash(F.col("fold"), a, b).alias(f"h{i}") for i, (a, b) in enumerate(scalar.hash_parameters(4, 553))])


# ---------------------------------------------------------------------- reports

_LIST = "'[' || (SELECT string_agg('[\"' || id || '\", ' || n || ']', ', ' ORDER BY n DESC, id) FROM (SELECT CAST({0} AS VARCHAR) AS id, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, id LIMIT 10)) || ']'"


@query(
    f"WITH {catalog._REVIEWS} SELECT '{{\"n_review\": ' || count(*) || ', \"n_review_{catalog.YEAR}\": ' || count(*) FILTER (contains(date, '{catalog.YEAR}')) || ', \"n_user\": ' || count(DISTINCT user_id)"
    f" || ', \"top10_user\": ' || {_LIST.format('user_id')} || ', \"n_business\": ' || count(DISTINCT business_id) || ', \"top10_business\": ' || {_LIST.format('business_id')} || '}}' AS value FROM r"
)
def report_json(s, d):
    r = catalog.reviews(s, d)
    return explore.review_json(r.withColumn("user_id", F.col("user_id").cast("string")).withColumn("business_id", F.col("business_id").cast("string")), catalog.YEAR)


@query(f"WITH c AS (SELECT CAST(g.i AS INT) AS i, count(p_name) AS n FROM generate_series(0, {catalog.PARTITIONS - 1}) g(i) LEFT JOIN part ON ascii(substr(p_name, 1, 1)) % {catalog.PARTITIONS} = g.i GROUP BY g.i) SELECT count(*) AS n_partition, string_agg(n, ',' ORDER BY i) AS n_items, true AS whole FROM c")
def layout_json(s, d):
    """The custom layout of the report, and whether the default one has every row and both were timed."""
    report = json.loads(writers.json_text(explore.layout_report(t(s, d, "part"), "p_name", catalog.PARTITIONS)))
    one, two = report["customized"], report["default"]
    whole = sum(one["n_items"]) == sum(two["n_items"]) and len(two["n_items"]) == two["n_partition"] and min(one["exe_time"], two["exe_time"]) > 0
    return s.createDataFrame([(one["n_partition"], ",".join(map(str, one["n_items"])), whole)], "n_partition long, n_items string, whole boolean")


@query("SELECT method, true AS measured FROM (VALUES ('m1'), ('m2')) v(method)")
def sort_timings(s, d):
    """Seconds of a full sort and of a top ten, as a report has them."""
    report = json.loads(writers.json_text(explore.sort_timings(catalog._city_reviews(s, d), "stars", "city")))
    return s.createDataFrame([(k, v > 0) for k, v in report.items()], "method string, measured boolean")


@query(f"SELECT 'city,stars' AS value UNION ALL SELECT city || ',' || stars FROM ({catalog._CITY})")
def city_lines(s, d):
    return writers.city_lines(catalog._city_reviews(s, d))


@query(f"WITH {catalog._PREP} SELECT 'DATE-CUSTOMER_ID,PRODUCT_ID' AS value UNION ALL SELECT basket_id || ',' || item FROM p")
def transaction_lines(s, d):
    return writers.transaction_lines(itemsets.prepare_transactions(catalog._raw(s, d)))


def _section(sql: str) -> str:
    return f"(SELECT string_agg(line, chr(10) || chr(10) ORDER BY size) FROM (SELECT size, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY string_split(items, ',')) AS line FROM ({sql}) GROUP BY size))"


_CANDIDATES, _FREQUENT = catalog._son_sql(2, catalog.SUPPORT[2]), catalog._sets_sql(2, catalog.SUPPORT[2], "SELECT * FROM s1 UNION ALL SELECT * FROM s2")


@query(f"SELECT 'Candidates:' || chr(10) || {_section(_CANDIDATES)} || chr(10) || chr(10) || 'Frequent Itemsets:' || chr(10) || {_section(_FREQUENT)} AS value")
def itemset_file(s, d):
    b = itemsets.baskets(catalog._brands(s, d))
    need = int(itemsets.share_of_baskets(b, catalog.SUPPORT[2]).select("need").first()[0])
    return writers.both_sections(itemsets.son_candidates(b, need, catalog.CHUNKS, 2), itemsets.frequent_itemsets(b, need, 2))


@query(f"SELECT 'business_id_1, business_id_2, similarity' AS value UNION ALL SELECT id1 || ',' || id2 || ',' || similarity FROM ({catalog._JACCARD})")
def similarity_lines(s, d):
    found = similarity.jaccard_exact(similarity.word_sets(t(s, d, "documents"))).withColumn("similarity", F.round("similarity", 9))
    return writers.similarity_lines(shared.materialise_tidy(found, "found"))  # the sort reads it twice


@query("SELECT 'user_id, business_id, prediction' AS value UNION ALL (" + catalog._SPLIT + catalog._PEARSON + catalog._TOPN + catalog._CF + " SELECT user || ',' || item || ',' || round(prediction, 5) FROM pred)")
def prediction_lines(s, d):
    return writers.prediction_lines(shared.materialise_tidy(catalog.cf_predict(s, d), "predicted"))  # the sort reads it twice


@query(catalog._LPA + " SELECT string_agg('''' || id || '''', ', ' ORDER BY CAST(id AS VARCHAR)) AS value FROM l5 GROUP BY label")
def community_lines(s, d):
    labels = graph.label_propagation(catalog._edges(s, d))
    return writers.community_lines(graph.communities(labels.withColumn("id", F.col("id").cast("string"))))


@query(catalog._WALKS + " SELECT '(''' || e.src || ''', ''' || e.dst || '''),' || round(sum(x.c * y.c / z.c) / 2, 5) AS value FROM e JOIN s o ON (o.src = e.src AND o.dst = e.dst) OR (o.src = e.dst AND o.dst = e.src) JOIN sp x ON x.b = o.src JOIN sp y ON y.a = o.dst JOIN sp z ON z.a = x.a AND z.b = y.b AND z.d = x.d + 1 + y.d GROUP BY e.src, e.dst")
def betweenness_lines(s, d):
    return writers.betweenness_lines(graph.edge_betweenness(catalog._edges(s, d)))


@query(f"SELECT 'Time,FPR' AS value UNION ALL SELECT batch || ',' || fpr FROM ({catalog.SQL['bloom_fpr']})")
def bloom_lines(s, d):
    return writers.bloom_lines(sketch.bloom_fpr(catalog._ticks(s, d)))


@query(f"SELECT 'Time,Ground Truth,Estimation' AS value UNION ALL SELECT batch || ',' || truth || ',' || estimate FROM ({catalog.SQL['fm_estimate']})")
def estimate_lines(s, d):
    return writers.estimate_lines(sketch.fm_estimate(catalog._ticks(s, d)))


@query(f"SELECT round(sum(estimate) / sum(truth), 9) AS ratio FROM ({catalog.SQL['fm_estimate']})")
def estimate_ratio(s, d):
    return sketch.estimate_ratio(sketch.fm_estimate(catalog._ticks(s, d))).select(F.round("ratio", 9).alias("ratio"))


@query("SELECT 'seqnum,0_id,20_id,40_id,60_id,80_id' AS value UNION ALL SELECT n || ',' || coalesce(id_0, '') || ',' || coalesce(id_20, '') || ',' || coalesce(id_40, '') || ',' || coalesce(id_60, '') || ',' || coalesce(id_80, '') FROM (" + catalog.SQL["reservoir_snapshots"] + ")")
def reservoir_lines(s, d):
    return writers.reservoir_lines(sketch.reservoir_snapshots(catalog._ticks(s, d)))


@query("SELECT 'The intermediate results:' AS value UNION ALL SELECT 'Round 1: ' || count(*) || ',2,3,4' FROM embeddings UNION ALL SELECT '' UNION ALL SELECT 'The clustering results:' UNION ALL SELECT vec_id || ',' || label FROM embeddings")
def clustering_lines(s, d):
    p = catalog._points(s, d)
    rounds = p.agg(F.lit(1).alias("round"), F.count(F.lit(1)).alias("ds_points"), F.lit(2).cast("bigint").alias("cs_clusters"), F.lit(3).cast("bigint").alias("cs_points"), F.lit(4).cast("bigint").alias("rs_points"))
    return writers.clustering_report(rounds, p.select("id", "cluster"))


@query("SELECT count(*) AS n_items, true AS several FROM lineitem")
def partition_default_total(s, d):
    """The default layout's partitions hold every row, and empty ones are there."""
    found = explore.default_layout(t(s, d, "lineitem").select("l_partkey"))
    return found.agg(F.sum("n_items").alias("n_items"), (F.count(F.lit(1)) >= 1).alias("several"))
