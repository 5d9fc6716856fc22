"""All registered queries of the analytics part and their SQL counterparts.

The driver's tables stand in for reviews, baskets, ratings and streams:
a review is an order line (user o_custkey, business l_suppkey, stars
1 + l_quantity mod 5), a basket an order with the brands of its parts, a rating
an order line of a part, a tick a hundred events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import clustering, explore, graph, itemsets, recommend, similarity, sketch
from millrace.sources import shared, writers
from millrace.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}
YEAR, PARTITIONS, CHUNKS, SHARED = "1997", 7, 4, 7
#: Shares of all baskets that sets of up to 2, of up to 3 and of 4 items need.
SUPPORT = {1: 0.02, 2: 0.02, 3: 0.004, 4: 0.00095}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reviews(s: SparkSession, d: str) -> DataFrame:
    lines = t(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("business_id"), (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("stars"))
    orders = t(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("user_id", "business_id", "stars", "date")


_REVIEWS = "r AS (SELECT o_custkey AS user_id, l_suppkey AS business_id, 1.0 + CAST(l_quantity AS INT) % 5 AS stars, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


# ------------------------------------------------------------------ exploration


@query("SELECT count(*) AS n_review FROM orders")
def count_rows(s, d):
    return t(s, d, "orders").agg(F.count(F.lit(1)).alias("n_review"))


@query(f"SELECT count(*) AS n_review_year FROM orders WHERE contains(strftime(o_orderdate, '%Y-%m-%d'), '{YEAR}')")
def count_year_filter(s, d):
    return t(s, d, "orders").filter(F.date_format("o_orderdate", "yyyy-MM-dd").contains(YEAR)).agg(F.count(F.lit(1)).alias("n_review_year"))


@query("SELECT count(DISTINCT o_custkey) AS n_user FROM orders")
def distinct_users(s, d):
    return t(s, d, "orders").agg(F.countDistinct("o_custkey").alias("n_user"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def topk_users(s, d):
    return explore.top_k(t(s, d, "orders"), "o_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def topk_items(s, d):
    return explore.top_k(t(s, d, "lineitem"), "l_partkey")


_TOP = "(SELECT string_agg(CAST({0} AS VARCHAR) || ':' || n, ',' ORDER BY n DESC, {0}) FROM (SELECT {0}, count(*) AS n FROM r GROUP BY {0} ORDER BY n DESC, {0} LIMIT 10))"


@query(f"WITH {_REVIEWS} SELECT count(*) AS n_review, count(*) FILTER (contains(date, '{YEAR}')) AS n_review_year, count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business, {_TOP.format('user_id')} AS top10_user, {_TOP.format('business_id')} AS top10_business FROM r")
def review_report(s, d):
    return explore.review_report(reviews(s, d), YEAR)


@query(f"SELECT CAST(g.i AS INT) AS partition_id, count(p_name) AS n_items FROM generate_series(0, {PARTITIONS - 1}) g(i) LEFT JOIN part ON ascii(substr(p_name, 1, 1)) % {PARTITIONS} = g.i GROUP BY g.i")
def partition_custom_counts(s, d):
    return explore.custom_layout(t(s, d, "part"), "p_name", PARTITIONS)


@query(f"SELECT CAST(g.i AS INT) AS partition_id, count(p_name) AS n_items FROM generate_series(0, {PARTITIONS - 1}) g(i) LEFT JOIN part ON ascii(substr(p_name, 1, 1)) % {PARTITIONS} = g.i GROUP BY g.i")
def partition_custom_dealt(s, d):
    return explore.default_layout(explore.custom_partitions(t(s, d, "part").select("p_name"), F.col("p_name"), PARTITIONS))


@query()
def partition_default_counts(s, d):
    return explore.default_layout(t(s, d, "lineitem").select("l_partkey"))


def _city_reviews(s, d):
    users = t(s, d, "customer").join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("city"))  # nation has a fixed number of rows
    return explore.group_average(reviews(s, d).select("user_id", "stars"), users, "user_id", "city", "stars").select("city", F.round("stars", 6).alias("stars"))


_CITY = f"WITH {_REVIEWS} SELECT n_name AS city, round(avg(stars), 6) AS stars FROM r JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query(_CITY)
def join_group_avg(s, d):
    return _city_reviews(s, d)


@query(_CITY + " ORDER BY stars DESC, city LIMIT 10")
def join_group_avg_top10(s, d):
    return _city_reviews(s, d).orderBy(F.desc("stars"), "city").limit(10)


# --------------------------------------------------------------------- itemsets


def _raw(s, d):
    date = F.date_format("o_orderdate", "M/d/yyyy")
    orders = t(s, d, "orders").select("o_orderkey", F.concat(F.lit('"'), date, F.lit('"')).alias("date"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("customer"))
    lines = t(s, d, "lineitem").select("l_orderkey", F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("product"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("date", "customer", "product")


_PREP = "p AS (SELECT strftime(o_orderdate, '%-m/%-d/%y') || '-' || ltrim(CAST(o_custkey AS VARCHAR), '0') AS basket_id, ltrim(CAST(l_partkey AS VARCHAR), '0') AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"WITH {_PREP} SELECT * FROM p")
def prep_transactions(s, d):
    return itemsets.prepare_transactions(_raw(s, d))


def _brands(s, d):
    return t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")


def _listed(baskets):
    return baskets.groupBy("basket_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("items"))


_BRANDS = "b AS (SELECT DISTINCT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_BRANDS} SELECT basket_id, string_agg(item, ',' ORDER BY item) AS items FROM b GROUP BY basket_id")
def baskets_case1(s, d):
    return _listed(itemsets.baskets(_brands(s, d)))


@query("SELECT o_orderpriority AS basket_id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS items FROM orders GROUP BY 1")
def baskets_case2(s, d):
    return _listed(itemsets.baskets(t(s, d, "orders").select("o_orderstatus", "o_orderpriority"), case=2))


@query(f"WITH {_PREP} SELECT basket_id, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM p GROUP BY basket_id HAVING count(*) > 5")
def baskets_min_size(s, d):
    return _listed(itemsets.baskets(itemsets.prepare_transactions(_raw(s, d)), min_rows=5))


def _frequent(s, d, share, size=None):
    b = itemsets.share_of_baskets(itemsets.baskets(_brands(s, d)), share)
    return itemsets.frequent_itemsets(b, F.col("need"), size)


def _shown(found):
    return found.select(F.array_join("items", ",").alias("items"), F.col("size").cast("int").alias("size"), "support")


def _sets_sql(k: int, share: float, body: str = "SELECT * FROM s{k}") -> str:
    parts = [_BRANDS, f"m AS (SELECT ceil(count(DISTINCT basket_id) * {share}) AS need FROM b)"]
    for n in range(1, k + 1):
        names = [f"b{i}" for i in range(n)]
        joins = "b b0" + "".join(f" JOIN b b{i} ON b{i}.basket_id = b0.basket_id AND b{i}.item > b{i - 1}.item" for i in range(1, n))
        items = " || ',' || ".join(f"{x}.item" for x in names)
        parts.append(f"s{n} AS (SELECT {items} AS items, {n} AS size, count(*) AS support FROM {joins} GROUP BY 1 HAVING count(*) >= (SELECT need FROM m))")
    return "WITH " + ", ".join(parts) + " " + body.format(k=k)


def _sized(k):
    def run(s, d):
        return _shown(_frequent(s, d, SUPPORT[k], k).filter(F.col("size") == k))

    return run


for _k, _share in SUPPORT.items():
    QUERIES[f"itemsets_{_k}"], SQL[f"itemsets_{_k}"] = _sized(_k), _sets_sql(_k, _share)


@query(_sets_sql(4, SUPPORT[3], "SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4"))
def itemsets_all(s, d):
    return _shown(_frequent(s, d, SUPPORT[3]))


_LINE = "SELECT size, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY string_split(items, ',')) AS line FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY size"


@query(_sets_sql(2, SUPPORT[2], _LINE))
def itemset_report(s, d):
    return writers.itemset_report(_frequent(s, d, SUPPORT[2], 2).withColumn("size", F.col("size").cast("int")))


def _son_sql(k: int, share: float) -> str:
    parts = [_BRANDS, f"m AS (SELECT ceil(count(DISTINCT basket_id) * {share}) AS need, count(DISTINCT basket_id) AS n FROM b)", f"c AS (SELECT basket_id % {CHUNKS} AS chunk, ceil(count(DISTINCT basket_id) * any_value(need) / any_value(n)) AS need FROM b, m GROUP BY 1)"]
    for n in range(1, k + 1):
        joins = "b b0" + "".join(f" JOIN b b{i} ON b{i}.basket_id = b0.basket_id AND b{i}.item > b{i - 1}.item" for i in range(1, n))
        items = " || ',' || ".join(f"b{i}.item" for i in range(n))
        parts.append(f"s{n} AS (SELECT DISTINCT items, {n} AS size FROM (SELECT b0.basket_id % {CHUNKS} AS chunk, {items} AS items, count(*) AS k FROM {joins} GROUP BY 1, 2) JOIN c USING (chunk) WHERE k >= need)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(1, k + 1))


@query(_son_sql(3, SUPPORT[3]))
def son_candidates(s, d):
    b = itemsets.baskets(_brands(s, d))
    need = int(itemsets.share_of_baskets(b, SUPPORT[3]).select("need").first()[0])
    found = itemsets.son_candidates(b, need, CHUNKS, 3)
    return found.select(F.array_join("items", ",").alias("items"), F.col("size").cast("int").alias("size"))


# ------------------------------------------------------------------- similarity

_SETS = r"w AS (SELECT DISTINCT doc_id AS id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS element FROM documents), sets AS (SELECT * FROM w WHERE element <> '')"
_X = "x AS (SELECT id, CAST('0x' || substr(md5(element), 1, 7) AS BIGINT) AS x FROM sets)"
_HASHES = ", ".join(f"min((x * {a} + {b}) % {similarity.MODULUS}) AS h{i}" for i, (a, b) in enumerate(similarity.hash_family()))
_BANDS = " UNION ALL ".join(f"SELECT id, {i} AS band, h{2 * i} || ',' || h{2 * i + 1} AS key FROM sig" for i in range(similarity.BANDS))


@query(f"WITH {_SETS}, {_X}, sig AS (SELECT id, {_HASHES} FROM x GROUP BY id) SELECT id, concat_ws(',', {', '.join(f'h{i}' for i in range(similarity.HASHES))}) AS signature FROM sig")
def minhash_signature(s, d):
    return similarity.minhash(similarity.word_sets(t(s, d, "documents"))).select("id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(f"WITH {_SETS}, {_X}, sig AS (SELECT id, {_HASHES} FROM x GROUP BY id) {_BANDS}")
def lsh_bands(s, d):
    return similarity.lsh_bands(similarity.minhash(similarity.word_sets(t(s, d, "documents"))))


@query(f"WITH {_SETS}, {_X}, sig AS (SELECT id, {_HASHES} FROM x GROUP BY id), bands AS ({_BANDS}) SELECT DISTINCT a.id AS id1, b.id AS id2 FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.id < b.id")
def lsh_candidates(s, d):
    return similarity.lsh_candidates(similarity.lsh_bands(similarity.minhash(similarity.word_sets(t(s, d, "documents")))))


_JACCARD = f"WITH {_SETS}, n AS (SELECT id, count(*) AS n FROM sets GROUP BY id), c AS (SELECT a.id AS id1, b.id AS id2, count(*) AS c FROM sets a JOIN sets b ON a.element = b.element AND a.id < b.id GROUP BY 1, 2) SELECT id1, id2, round(c / (x.n + y.n - c), 9) AS similarity FROM c JOIN n x ON x.id = id1 JOIN n y ON y.id = id2 WHERE c / (x.n + y.n - c) >= 0.5"


@query(_JACCARD)
def jaccard_exact(s, d):
    return similarity.jaccard_exact(similarity.word_sets(t(s, d, "documents"))).withColumn("similarity", F.round("similarity", 9))


@query(_JACCARD)
def lsh_similar_pairs(s, d):
    return similarity.lsh_similar(similarity.word_sets(t(s, d, "documents"))).withColumn("similarity", F.round("similarity", 9))


# ------------------------------------------------------------------ recommender


def _ratings(s, d):
    lines = t(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("stars"))
    return t(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user")).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("k"), "user", "item", "stars")


def split(s, d):
    """Every rating in train or in test: every twentieth order is tested, and all ratings of some users and items, so cold branches occur.  The join is made once."""
    return _split(s, d)[:2]


def _split(s, d):
    """train, test, and what to call when train has been read for the last time: it removes the table."""
    scratch = shared.Scratch(s, "rated", True)
    r = scratch.cut(_ratings(s, d))
    learnt = (F.col("k") % 20 != 0) & (F.col("item") % 25 != 0) & (F.col("user") % 50 != 0)
    test = scratch.cut(r.filter(~learnt).groupBy("user", "item").agg(F.avg("stars").alias("stars")))
    return r.filter(learnt).select("user", "item", "stars"), test, lambda: scratch.drop(test)


_SPLIT = """WITH r AS (SELECT o_orderkey AS k, o_custkey AS user, l_partkey AS item, 1.0 + CAST(l_quantity AS INT) % 5 AS stars FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
train AS (SELECT user, item, stars FROM r WHERE k % 20 <> 0 AND item % 25 <> 0 AND user % 50 <> 0),
test AS (SELECT user, item, avg(stars) AS stars FROM r WHERE NOT (k % 20 <> 0 AND item % 25 <> 0 AND user % 50 <> 0) GROUP BY 1, 2),
one AS (SELECT user, item, avg(stars) AS stars FROM train GROUP BY 1, 2),
ua AS (SELECT user, avg(stars) AS a FROM train GROUP BY 1), ia AS (SELECT item, avg(stars) AS a FROM train GROUP BY 1)"""
_PEARSON = """,
nb AS (SELECT t.user, t.item, o.item AS neighbor, o.stars FROM test t JOIN one o ON o.user = t.user AND o.item <> t.item),
wanted AS (SELECT DISTINCT nb.item, neighbor, x.a AS ba, y.a AS bn FROM nb JOIN ia x ON x.item = nb.item JOIN ia y ON y.item = neighbor),
dev AS (SELECT o.user, o.item, o.stars - ia.a AS d FROM one o JOIN ia ON ia.item = o.item),
cc AS (SELECT w.item, w.neighbor, count(*) AS c, sum(x.d * y.d) AS num, sum(x.d * x.d) AS d1, sum(y.d * y.d) AS d2
       FROM wanted w JOIN dev x ON x.item = w.item JOIN dev y ON y.item = w.neighbor AND y.user = x.user GROUP BY 1, 2),
sr AS (SELECT w.item, w.neighbor, CASE WHEN c IS NULL THEN ba / bn WHEN d1 * d2 < 1e-18 THEN 1.0 ELSE num / sqrt(d1 * d2) END AS s FROM wanted w LEFT JOIN cc ON cc.item = w.item AND cc.neighbor = w.neighbor),
sim AS (SELECT item, neighbor, CASE WHEN s > 1 THEN 1 / s ELSE s END AS sim FROM sr)"""
_TOPN = """,
top AS (SELECT * FROM (SELECT nb.user, nb.item, nb.neighbor, nb.stars, sim, row_number() OVER (PARTITION BY nb.user, nb.item ORDER BY round(sim, 9) DESC, nb.neighbor) AS rank
        FROM nb JOIN sim ON sim.item = nb.item AND sim.neighbor = nb.neighbor WHERE sim > 0) WHERE rank <= 30)"""
_CF = """,
cf AS (SELECT user, item, sum(sim * stars) / sum(abs(sim)) AS cf FROM top GROUP BY 1, 2),
pred AS (SELECT t.user, t.item, t.stars, coalesce(CASE WHEN ia.a IS NOT NULL AND ua.a IS NOT NULL THEN coalesce(cf, ia.a) ELSE coalesce(ia.a, ua.a) END, 2.5) AS prediction,
         CASE WHEN ia.a IS NOT NULL AND ua.a IS NOT NULL THEN 'both' WHEN ia.a IS NOT NULL THEN 'user cold' WHEN ua.a IS NOT NULL THEN 'item cold' ELSE 'cold' END AS branch
         FROM test t LEFT JOIN ua ON ua.user = t.user LEFT JOIN ia ON ia.item = t.item LEFT JOIN cf ON cf.user = t.user AND cf.item = t.item)"""


@query(_SPLIT + " SELECT 'user' AS kind, user AS id, round(avg(stars), 6) AS mean FROM r GROUP BY user UNION ALL SELECT 'item', item, round(avg(stars), 6) FROM r GROUP BY item")
def user_item_means(s, d):
    ratings = _ratings(s, d)
    side = lambda k: recommend.means(ratings, k).select(F.lit(k).alias("kind"), F.col(k).alias("id"), F.round("avg", 6).alias("mean"))
    return side("user").unionByName(side("item"))


@query(_SPLIT + _PEARSON + " SELECT item, neighbor, round(sim + 1e-9, 5) AS sim FROM sim")
def pearson_pairs(s, d):
    train, test, spent = _split(s, d)
    return recommend.pair_similarity(train, test, spent).withColumn("sim", F.round(F.col("sim") + 1e-9, 5))  # no exact halves to round


@query(_SPLIT + _PEARSON + _TOPN + " SELECT user, item, neighbor, stars, CAST(rank AS INT) AS rank FROM top")
def cf_neighbors_topk(s, d):
    train, test, spent = _split(s, d)
    return recommend.top_neighbors(train, test, spent=spent).select("user", "item", "neighbor", "stars", "rank")


@query(_SPLIT + _PEARSON + _TOPN + _CF + " SELECT user, item, round(prediction, 5) AS prediction, branch FROM pred")
def cf_predict(s, d):
    train, test, spent = _split(s, d)
    return recommend.cf_predict(train, test, spent=spent).withColumn("prediction", F.round("prediction", 5))


@query(_SPLIT + _PEARSON + _TOPN + _CF + " SELECT round(sqrt(avg((prediction - stars) * (prediction - stars))), 5) AS rmse, count(*) AS n FROM pred")
def rmse(s, d):
    train, test, spent = _split(s, d)
    return recommend.rmse(recommend.cf_predict(train, test, spent=spent), test).withColumn("rmse", F.round("rmse", 5))


@query(_SPLIT + _PEARSON + _TOPN + _CF + " SELECT CAST(least(floor(round(abs(prediction - stars), 9)), 4) AS INT) AS bucket, count(*) AS n FROM pred GROUP BY 1")
def error_histogram(s, d):
    train, test, spent = _split(s, d)
    predicted = recommend.cf_predict(train, test, spent=spent)
    rounded = predicted.join(test, ["user", "item"]).select("user", "item", (F.col("stars") + F.round(F.abs(F.col("prediction") - F.col("stars")), 9)).alias("prediction"))
    return recommend.error_histogram(rounded, test)


def _metadata(s, d):
    c, o = t(s, d, "customer"), t(s, d, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.count(F.lit(1)).alias("review_count"), F.count_if(F.col("o_orderstatus") == "F").alias("useful"))
    users = c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("fans")).join(o, "user").withColumn("average_stars", 1 + (F.col("user") % 5).cast("double"))
    p = t(s, d, "part").filter("p_brand <> 'Brand#13'")  # the parts of one brand have no metadata, so defaults occur
    noise = F.when(F.col("p_size") % 5 == 0, "quiet").when(F.col("p_size") % 5 == 1, "average").when(F.col("p_size") % 5 == 2, "loud").when(F.col("p_size") % 5 == 3, "very_loud")
    wifi = F.when(F.col("p_size") % 4 == 0, "free").when(F.col("p_size") % 4 == 1, "no").when(F.col("p_size") % 4 == 2, "paid")
    items = p.select(F.col("p_partkey").alias("item"), F.col("p_size").alias("review_count"), (F.col("p_retailprice") / 500).alias("stars"), F.when(F.col("p_size") % 7 != 0, F.create_map(F.lit("NoiseLevel"), noise, F.lit("WiFi"), wifi)).alias("attributes"))
    return users, items


_META = """,
us AS (SELECT c_custkey AS user, n AS review_count, f AS useful, 1.0 + c_custkey % 5 AS average_stars, c_nationkey AS fans FROM customer JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal >= 0),
it AS (SELECT p_partkey AS item, p_size AS review_count, p_retailprice / 500 AS stars,
       CASE WHEN p_size % 7 = 0 THEN 3 WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 5 = 1 THEN 2 WHEN p_size % 5 = 2 THEN 3 WHEN p_size % 5 = 3 THEN 4 ELSE 3 END AS noise,
       CASE WHEN p_size % 7 = 0 THEN -1 WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 4 = 1 THEN 0 ELSE -1 END AS wifi FROM part WHERE p_brand <> 'Brand#13'),
mu AS (SELECT avg(review_count) AS rc, avg(average_stars) AS st, avg(fans) AS fa FROM us), mi AS (SELECT avg(review_count) AS rc, avg(stars) AS st, avg(noise) AS no, avg(wifi) AS wi FROM it)"""


@query(_SPLIT + _META + """ SELECT t.user, t.item, round(coalesce(us.review_count, mu.rc), 6) AS u_review_count, CAST(coalesce(us.useful, 0) AS DOUBLE) AS u_useful, round(coalesce(us.average_stars, mu.st), 6) AS u_average_stars,
 round(coalesce(us.fans, mu.fa), 6) AS u_fans, round(coalesce(it.review_count, mi.rc), 6) AS b_review_count, round(coalesce(it.stars, mi.st), 6) AS b_stars, round(coalesce(it.noise, mi.no), 6) AS b_noise, round(coalesce(it.wifi, mi.wi), 6) AS b_wifi
 FROM test t LEFT JOIN us ON us.user = t.user LEFT JOIN it ON it.item = t.item, mu, mi""")
def features_default_join(s, d):
    _, test = split(s, d)
    users, items = _metadata(s, d)
    out = recommend.assemble_features(test.select("user", "item"), users, items, noise_default=3, extended=True)
    return out.select("user", "item", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


_LEVEL = "CASE WHEN p_size % 5 = 0 THEN {0} WHEN p_size % 5 = 1 THEN {1} WHEN p_size % 5 = 2 THEN {2} WHEN p_size % 5 = 3 THEN {3} ELSE {4} END"


@query(f"SELECT p_partkey, {_LEVEL.format(1, 2, 3, 4, 2)} AS noise_2, {_LEVEL.format(1, 2, 3, 4, 3)} AS noise_3 FROM part")
def noise_ordinal(s, d):
    level = F.when(F.col("p_size") % 5 == 0, "quiet").when(F.col("p_size") % 5 == 1, "average").when(F.col("p_size") % 5 == 2, "loud").when(F.col("p_size") % 5 == 3, "very_loud")
    return t(s, d, "part").select("p_partkey", scalar.noise_ordinal(level, 2).alias("noise_2"), scalar.noise_ordinal(level, 3).alias("noise_3"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 4 = 1 THEN 0 ELSE -1 END AS wifi FROM part")
def wifi_ordinal(s, d):
    kind = F.when(F.col("p_size") % 4 == 0, "free").when(F.col("p_size") % 4 == 1, "no").when(F.col("p_size") % 4 == 2, "paid")
    return t(s, d, "part").select("p_partkey", scalar.wifi_ordinal(kind).alias("wifi"))


def _model(s, d, extended=False, parts=None):
    train, test = parts or split(s, d)
    users, items = _metadata(s, d)
    a, b = (recommend.assemble_features(x, users, items, noise_default=3 if extended else 2, extended=extended) for x in (train, test.select("user", "item")))
    return train, test, recommend.gbt_fit_predict(a, b)


@query()
def gbt_predict(s, d):
    return _model(s, d)[2]


@query()
def gbt_predict_extended(s, d):
    return _model(s, d, True)[2]


@query()
def hybrid_predict(s, d):
    train, test, spent = _split(s, d)
    model = shared.materialise_tidy(_model(s, d, parts=(train, test))[2], "model")
    return recommend.hybrid(recommend.cf_predict(train, test, spent=spent), model)


@query(_SPLIT + " SELECT user, item, true AS in_range FROM test")
def gbt_coverage(s, d):
    """One prediction for each pair of the test, near the scale of the ratings."""
    return _model(s, d)[2].select("user", "item", F.col("prediction").between(0, 6).alias("in_range"))


@query(_SPLIT + """, k AS (SELECT count(*) AS n, round(sqrt(avg((stars - (SELECT avg(stars) FROM train)) * (stars - (SELECT avg(stars) FROM train)))), 6) AS constant FROM test)
SELECT model, n, constant, true AS comparable FROM k, (VALUES ('6 features'), ('8 features'), ('hybrid'), ('cf')) m(model)""")
def model_errors(s, d):
    """Errors of the models beside that of a constant: the ratings of these tables are random, so none can be much better, and none may be much worse."""
    train, test, six = _model(s, d)
    six = shared.materialise_tidy(six, "six")
    eight = shared.materialise_tidy(_model(s, d, True, (train, test))[2], "eight")
    cf = shared.materialise_tidy(recommend.cf_predict(train, test), "cf")
    errors = recommend.model_errors({"6 features": six, "8 features": eight, "hybrid": recommend.hybrid(cf, six), "cf": cf}, train, test)
    return errors.select("model", "n", F.round("constant", 6).alias("constant"), (F.col("rmse") < 1.1 * F.col("constant")).alias("comparable"))


# ------------------------------------------------------------------------ graph


def _edges(s, d):
    pairs = t(s, d, "orders").join(t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    return graph.checkpointed(graph.cooccurrence_edges(pairs, SHARED))


_EDGES = f"""WITH RECURSIVE p AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS MATERIALIZED (SELECT a.u AS src, b.u AS dst FROM p a JOIN p b ON a.i = b.i AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= {SHARED}),
s AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""
_REACH = _EDGES + ", r(a, b) AS (SELECT src, src FROM s UNION SELECT r.a, s.dst FROM r JOIN s ON s.src = r.b), comp AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a)"


@query(_EDGES + " SELECT * FROM e")
def cooc_edges(s, d):
    return _edges(s, d)


@query(_EDGES + " SELECT src AS id, count(*) AS degree FROM s GROUP BY src")
def degrees(s, d):
    return graph.degrees(_edges(s, d))


@query(_REACH + " SELECT * FROM comp")
def components(s, d):
    return graph.components(_edges(s, d))


_LPA = _EDGES + ", l0 AS (SELECT DISTINCT src AS id, src AS label FROM s)" + "".join(f", l{i} AS (SELECT id, label FROM (SELECT s.src AS id, l.label, row_number() OVER (PARTITION BY s.src ORDER BY count(*) DESC, l.label) AS k FROM s JOIN l{i - 1} l ON l.id = s.dst GROUP BY s.src, l.label) WHERE k = 1)" for i in range(1, 6))


@query(_LPA + " SELECT id, label FROM l5")
def label_propagation(s, d):
    return graph.label_propagation(_edges(s, d))


@query(_LPA + " SELECT string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS members, count(*) AS size FROM l5 GROUP BY label")
def lpa_communities(s, d):
    found = graph.communities(graph.label_propagation(_edges(s, d)))
    return found.select(F.array_join(F.col("members").cast("array<string>"), ", ").alias("members"), F.col("size").cast("bigint").alias("size"))


# shortest paths are the walks of least length; walks are counted by length
_WALKS = _EDGES + """, walk(a, b, n, c) AS (SELECT src, src, 0, 1.0::DOUBLE FROM (SELECT DISTINCT src FROM s) UNION ALL SELECT a, dst, n + 1, sum(c)::DOUBLE FROM walk JOIN s ON s.src = walk.b WHERE n < 40 GROUP BY a, dst, n),
sp AS MATERIALIZED (SELECT a, b, min(n) AS d, arg_min(c, n) AS c FROM walk GROUP BY a, b)"""


@query(_WALKS + " SELECT e.src, e.dst, round(sum(x.c * y.c / z.c) / 2, 5) AS betweenness FROM e JOIN s o ON (o.src = e.src AND o.dst = e.dst) OR (o.src = e.dst AND o.dst = e.src) JOIN sp x ON x.b = o.src JOIN sp y ON y.a = o.dst JOIN sp z ON z.a = x.a AND z.b = y.b AND z.d = x.d + 1 + y.d GROUP BY e.src, e.dst")
def edge_betweenness(s, d):
    return graph.edge_betweenness(_edges(s, d)).withColumn("betweenness", F.round("betweenness", 5))


@query(_REACH + ", m AS (SELECT count(*) AS m FROM e), dg AS (SELECT component, count(*) AS deg FROM s JOIN comp ON comp.id = s.src GROUP BY 1) SELECT round(sum(deg / (2.0 * m) - (deg / (2.0 * m)) * (deg / (2.0 * m))), 9) AS q FROM dg, m")
def modularity_of_components(s, d):
    e = _edges(s, d)
    return graph.modularity(e, graph.components(e)).withColumn("q", F.round("q", 9))


@query()
def divisive_communities(s, d):
    return graph.divisive_communities(_edges(s, d))[0]


# --------------------------------------------------------------------- sketches


def _ticks(s, d):
    return sketch.tick(t(s, d, "events"), "event_id", 100, "user_id")


def _fold(p: int) -> str:
    return f"CAST(list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(u, '')], lambda acc, b: (acc * 256 + b) % {p}) AS BIGINT)"


_TICKS = f"WITH k AS (SELECT event_id // 100 AS batch, event_id AS seq, CAST(user_id AS VARCHAR) AS u FROM events), x AS (SELECT *, {_fold(scalar.PRIME)} AS x FROM k)"
_PLACES = [f"(x * {a} + {b}) % {scalar.PRIME} % {scalar.BITS}" for a, b in scalar.hash_parameters(4, 553)]
_FM = [f"(x * {a} + {b}) % {scalar.PRIME} % {scalar.BITS}" for a, b in scalar.hash_parameters(4, 554)]


@query(_TICKS + f""", f AS (SELECT place, min(batch) AS since FROM ({" UNION ALL ".join(f"SELECT {p} AS place, batch FROM x" for p in _PLACES)}) GROUP BY 1), met AS (SELECT u, min(batch) AS met FROM k GROUP BY 1),
y AS (SELECT x.batch, {" AND ".join(f"f{i}.since < x.batch" for i in range(4))} AS pos, met.met >= x.batch AS fresh FROM x {" ".join(f"JOIN f f{i} ON f{i}.place = {p}" for i, p in enumerate(_PLACES))} JOIN met ON met.u = x.u),
z AS (SELECT batch, count(*) AS size, count(*) FILTER (pos) AS positives, count(*) FILTER (pos AND fresh) AS fp FROM y GROUP BY 1)
SELECT batch, positives, fp, CASE WHEN size - positives + fp = 0 THEN 0.0 ELSE fp / (size - positives + fp) END AS fpr FROM z""")
def bloom_fpr(s, d):
    return sketch.bloom_fpr(_ticks(s, d))


@query(_TICKS + f""", r AS (SELECT batch, count(DISTINCT u) AS truth, {", ".join(f"max(CASE WHEN {p} = 0 THEN 3 ELSE bit_count((({p}) & -({p})) - 1) END) AS r{i}" for i, p in enumerate(_FM))} FROM x GROUP BY 1)
SELECT batch, truth, CAST(floor((pow(2, r0) + pow(2, r1) + pow(2, r2) + pow(2, r3)) / 4) AS BIGINT) AS estimate FROM r""")
def fm_estimate(s, d):
    return sketch.fm_estimate(_ticks(s, d))


@query("SELECT event_id // 100 AS batch, count(DISTINCT user_id) AS truth FROM events GROUP BY 1")
def distinct_per_batch(s, d):
    return sketch.distinct_per_batch(_ticks(s, d))


@query()
def hll_estimate(s, d):
    return sketch.hll_per_batch(_ticks(s, d))


@query("SELECT event_id // 100 AS batch, count(DISTINCT user_id) AS truth, true AS near FROM events GROUP BY 1")
def hll_near(s, d):
    """The estimate is within six standard errors, or two, of the exact number."""
    ticks = _ticks(s, d)
    both = sketch.hll_per_batch(ticks).join(sketch.distinct_per_batch(ticks), "batch")
    return both.select("batch", "truth", (F.abs(F.col("estimate") - F.col("truth")) <= 0.3 * F.col("truth") + 2).alias("near"))


@query("""WITH k AS (SELECT event_id // 100 AS batch, event_id AS seq, CAST(user_id AS VARCHAR) AS u, md5(CAST(event_id AS VARCHAR)) AS h FROM events), b AS (SELECT batch, max(seq) + 1 AS n FROM k GROUP BY 1),
r AS (SELECT b.batch, b.n, u, row_number() OVER (PARTITION BY b.batch ORDER BY h, seq) - 1 AS slot FROM b JOIN k ON k.batch <= b.batch)
SELECT batch, n, max(u) FILTER (slot = 0) AS id_0, max(u) FILTER (slot = 20) AS id_20, max(u) FILTER (slot = 40) AS id_40, max(u) FILTER (slot = 60) AS id_60, max(u) FILTER (slot = 80) AS id_80 FROM r GROUP BY 1, 2""")
def reservoir_snapshots(s, d):
    return sketch.reservoir_snapshots(_ticks(s, d))


@query("SELECT event_id // 100 AS batch, count(*) AS n, count(DISTINCT user_id) AS truth FROM events GROUP BY 1")
def stream_tick_counts(s, d):
    return live.tick_counts(s, f"{d}/events.parquet", 100)


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM events ORDER BY md5('553:' || event_id), event_id LIMIT 100")
def stream_reservoir(s, d):
    return live.reservoir(s, f"{d}/events.parquet", 100)


_SHARDED = _TICKS + ", y AS (SELECT *, CAST('0x' || substr(md5(u), 1, 7) AS BIGINT) % 8 AS shard FROM x)"


@query(_SHARDED + f""", f AS (SELECT shard, place, min(batch) AS since FROM ({" UNION ALL ".join(f"SELECT shard, {p} AS place, batch FROM y" for p in _PLACES)}) GROUP BY 1, 2)
SELECT y.batch, count(*) FILTER ({" AND ".join(f"f{i}.since < y.batch" for i in range(4))}) AS positives FROM y {" ".join(f"JOIN f f{i} ON f{i}.shard = y.shard AND f{i}.place = {p}" for i, p in enumerate(_PLACES))} GROUP BY 1""")
def stream_bloom(s, d):
    return live.bloom(s, f"{d}/events.parquet", 100)


# ------------------------------------------------------------------- clustering


def _points(s, d):
    return t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("bigint").alias("cluster"))


_STATS = "WITH l AS (SELECT vec_id, CAST(label AS BIGINT) AS cluster, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), st AS (SELECT cluster, i - 1 AS dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM l GROUP BY 1, 2), c AS (SELECT cluster, dim, s / n AS m, greatest(q / n - (s / n) * (s / n), 1e-9) AS v FROM st)"


@query(_STATS + " SELECT cluster, CAST(dim AS INT) AS dim, n, round(s, 5) AS sum, round(q, 5) AS sumsq FROM st")
def cluster_stats(s, d):
    return clustering.cluster_stats(_points(s, d)).select("cluster", "dim", "n", F.round("sum", 5).alias("sum"), F.round("sumsq", 5).alias("sumsq"))


@query(_STATS + ", d AS (SELECT vec_id AS id, c.cluster, sqrt(sum((x - m) * (x - m) / v)) AS dist FROM l JOIN c ON c.dim = l.i - 1 GROUP BY 1, 2) SELECT id, arg_min(cluster, dist) AS cluster, round(min(dist), 5) AS dist FROM d GROUP BY id")
def mahalanobis_assign(s, d):
    p = _points(s, d)
    return clustering.mahalanobis(p, clustering.cluster_stats(p)).withColumn("dist", F.round("dist", 5))


@query(_STATS + " SELECT a.cluster AS c1, b.cluster AS c2, round(least(sqrt(sum((a.m - b.m) * (a.m - b.m) / a.v)), sqrt(sum((a.m - b.m) * (a.m - b.m) / b.v))), 5) AS dist FROM c a JOIN c b ON a.dim = b.dim AND a.cluster < b.cluster GROUP BY 1, 2")
def cluster_merge_pairs(s, d):
    return clustering.merge_pairs(clustering.cluster_stats(_points(s, d))).withColumn("dist", F.round("dist", 5))


@query()
def bfr_rounds(s, d):
    return clustering.bfr(_points(s, d), 10)[0]


@query()
def bfr_labels(s, d):
    return clustering.bfr(_points(s, d), 10)[1]


@query("WITH c AS (SELECT CAST('0x' || substr(md5('1:' || vec_id), 1, 7) AS BIGINT) % 5 + 1 AS chunk FROM embeddings) SELECT CAST(i AS INT) AS round, count(*) AS points FROM generate_series(1, 5) g(i) JOIN c ON chunk <= i GROUP BY i")
def bfr_points(s, d):
    """After each round every point read so far is in one of the three sets."""
    return clustering.bfr(_points(s, d), 10)[0].select("round", (F.col("ds_points") + F.col("cs_points") + F.col("rs_points")).alias("points"))


@query("SELECT vec_id AS id, true AS known FROM embeddings")
def bfr_coverage(s, d):
    """Every id has one label: a cluster below k, or -1."""
    return clustering.bfr(_points(s, d), 10)[1].select("id", F.col("cluster").between(-1, 9).alias("known"))


@query()
def kmeans_labels(s, d):
    return clustering.k_means(_points(s, d), 10).select("id", "cluster")


@query("SELECT count(*) AS n, 10 AS labels, true AS closer FROM embeddings")
def kmeans_summary(s, d):
    """Ten labels, and clusters whose spread is less than that of all points."""
    p = _points(s, d)
    got = graph.checkpointed(clustering.k_means(p, 10))
    spread = lambda stats: stats.agg(F.sum(F.col("sumsq") - F.col("sum") * F.col("sum") / F.col("n")).alias("spread"))
    inner, whole = spread(clustering.cluster_stats(got)), spread(clustering.cluster_stats(got.withColumn("cluster", F.lit(0)))).withColumnRenamed("spread", "all")
    sizes = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").cast("int").alias("labels"))
    return sizes.crossJoin(inner).crossJoin(whole).select("n", "labels", (F.col("spread") < F.col("all")).alias("closer"))  # one row each


@query(_STATS + ", d AS (SELECT vec_id AS id, c.cluster, sqrt(sum((x - m) * (x - m) / v)) AS dist FROM l JOIN c ON c.dim = l.i - 1 GROUP BY 1, 2) SELECT id, arg_min(cluster, dist) AS cluster FROM d GROUP BY id HAVING min(dist) < 2 * sqrt(64) * 0.5")
def mahalanobis_within(s, d):
    """Points nearer than a limit to their nearest cluster."""
    p = _points(s, d)
    return clustering.mahalanobis(p, clustering.cluster_stats(p)).filter(F.col("dist") < 2 * 64**0.5 * 0.5).select("id", "cluster")


@query("SELECT o_orderkey AS id, o_custkey AS cluster, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def label_sizes(s, d):
    return clustering.with_size(t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"))).select("id", "cluster", "n")
