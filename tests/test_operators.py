"""Hand-checked inputs, brute force and the repaired defects of the analytics operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import clustering, explore, graph, itemsets, recommend, similarity, sketch
from millrace.sources import readers, writers
from millrace.streaming import live

BASKETS = {1: "abc", 2: "ab", 3: "ac", 4: "bc", 5: "abc"}
EDGES = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute(baskets, support):
    items = sorted({i for b in baskets.values() for i in b})
    out = {}
    for k in range(1, len(items) + 1):
        for c in itertools.combinations(items, k):
            n = sum(set(c) <= set(b) for b in baskets.values())
            if n >= support:
                out[c] = n
    return out


def test_top_k_breaks_ties_by_key(spark):
    df = frame(spark, [(k,) for k in "zzaammmmm"], "k string")
    assert [tuple(r) for r in explore.top_k(df, "k").collect()] == [("m", 5), ("a", 2), ("z", 2)]


def test_report_of_reviews(spark):
    df = frame(spark, [("u1", "b1", 5.0, "2018-01-02"), ("u1", "b2", 3.0, "2017-01-02"), ("u2", "b1", 1.0, "2018-05-06")], readers.REVIEW)
    r = explore.review_report(df).first()
    assert (r.n_review, r.n_review_year, r.n_user, r.n_business, r.top10_user, r.top10_business) == (3, 2, 2, 2, "u1:2,u2:1", "b1:2,b2:1")


def test_layout_keeps_empty_partitions(spark):
    df = frame(spark, [("Ax",), ("Bx",), ("Fx",)], "k string")
    want = [1, 0, 1, 1, 0, 0, 0]
    assert [r.n_items for r in explore.custom_layout(df, "k", 7).orderBy("partition_id").collect()] == want
    dealt = explore.default_layout(explore.custom_partitions(df, F.col("k"), 7))
    assert [r.n_items for r in dealt.orderBy("partition_id").collect()] == want


def test_join_average_drops_unmatched(spark):
    fact = frame(spark, [("b1", 5.0), ("b1", 4.0), ("b2", 3.0), ("bX", 1.0)], "b string, stars double")
    dim = frame(spark, [("b1", "Q"), ("b2", "P")], "b string, city string")
    assert {tuple(r) for r in explore.group_average(fact, dim, "b", "city", "stars").collect()} == {("Q", 4.5), ("P", 3.0)}


def test_itemsets_fixture_and_report(spark):
    df = frame(spark, [(b, i) for b, s in BASKETS.items() for i in s], "basket_id long, item string")
    found = itemsets.frequent_itemsets(df, 3)
    assert {tuple(r["items"]): r.support for r in found.collect()} == brute(BASKETS, 3)
    lines = {r.size: r.line for r in writers.itemset_report(found).collect()}
    assert lines == {1: "('a'),('b'),('c')", 2: "('a', 'b'),('a', 'c'),('b', 'c')"}
    report = writers.both_sections(found, found).first().value
    assert report.startswith("Candidates:\n('a'),('b'),('c')\n\n('a', 'b')") and "\n\nFrequent Itemsets:\n" in report


def test_itemsets_against_all_subsets(spark):
    rng = random.Random(3)
    data = {b: "".join(sorted(rng.sample("abcdefg", rng.randint(1, 6)))) for b in range(40)}
    df = frame(spark, [(b, i) for b, s in data.items() for i in s], "basket_id long, item string")
    want = brute(data, 8)
    assert {tuple(r["items"]): r.support for r in itemsets.frequent_itemsets(df, 8).collect()} == want
    for chunks in (1, 2, 5):  # what is frequent is a candidate, whatever the chunks
        assert set(want) <= {tuple(r["items"]) for r in itemsets.son_candidates(df, 8, chunks).collect()}
    assert itemsets.frequent_itemsets(df, 41).count() == 0


def test_baskets_count_rows_before_repeats_go(spark):
    df = frame(spark, [("k", "x")] * 3, "a string, b string")
    assert itemsets.baskets(df, min_rows=2).count() == 1 and itemsets.baskets(df, min_rows=3).count() == 0
    assert itemsets.baskets(df, case=2).first().basket_id == "x"
    with pytest.raises(ValueError):
        itemsets.baskets(df, case=3)


def test_prepared_transactions_quoted_or_not(spark):
    raw = frame(spark, [("11/1/2000", "01104905", "004710199010372"), ('"11/1/2000"', '"01104905"', '"004710199010372"')], "date string, customer string, product string")
    assert {tuple(r) for r in itemsets.prepare_transactions(raw).collect()} == {("11/1/00-1104905", "4710199010372")}
    assert itemsets.prepare_transactions(frame(spark, [("11/01/2000", "1", "2")], "date string, customer string, product string"), True).first().basket_id == "11/1/00-1"


def test_jaccard_keeps_the_threshold(spark):
    sets = {"x": "1234", "y": "2345", "z": "19", "p": "ab", "q": "abcd"}
    df = frame(spark, [(i, e) for i, s in sets.items() for e in s], "id string, element string")
    want = {("x", "y", 0.6), ("p", "q", 0.5)}
    got = {(r.id1, r.id2, round(r.similarity, 9)) for r in similarity.jaccard_exact(df).collect()}
    assert got == want
    assert {(r.id1, r.id2) for r in similarity.lsh_similar(df).collect()} <= {w[:2] for w in want}


def test_lsh_recall(spark):
    rng = random.Random(5)
    base = [rng.sample(range(500), 40) for _ in range(20)]
    rows = [(2 * i + k, str(e)) for i, b in enumerate(base) for k in (0, 1) for e in (b if k == 0 else b[:32] + rng.sample(range(500, 900), 8))]
    df = frame(spark, rows, "id long, element string")
    exact = {(r.id1, r.id2) for r in similarity.jaccard_exact(df).collect()}
    found = {(r.id1, r.id2) for r in similarity.lsh_similar(df).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) and len(exact) >= 20


def test_collaborative_filtering(spark):
    train = frame(spark, [("u1", "i1", 5.0), ("u1", "i2", 3.0), ("u2", "i1", 4.0), ("u2", "i2", 2.0), ("u3", "i1", 1.0), ("u3", "i3", 4.0)], "user string, item string, stars double")
    test = frame(spark, [("u3", "i2"), ("u9", "i9"), ("u1", "i9"), ("u9", "i1")], "user string, item string")
    sims = {(r.item, r.neighbor): r.sim for r in recommend.item_similarity(train, recommend.neighbors(train, test)).collect()}
    assert sims["i2", "i1"] == pytest.approx(0.3939192986) and sims["i2", "i3"] == pytest.approx(0.625)
    got = {(r.user, r.item): r.prediction for r in recommend.cf_predict(train, test).collect()}
    assert got == pytest.approx({("u3", "i2"): 2.8401849907, ("u9", "i9"): 2.5, ("u1", "i9"): 4.0, ("u9", "i1"): 10 / 3})
    only = frame(spark, [("u1", "i1", 4.0), ("u2", "i1", 2.0)], "user string, item string, stars double")
    assert recommend.cf_predict(only, frame(spark, [("u1", "i1")], "user string, item string")).first().prediction == 3.0


def test_features_defaults_ordinals_and_blend(spark):
    users = frame(spark, [("u1", 10, 3, 4.0, 2), ("u2", 20, 5, 2.0, 4)], "user string, review_count long, useful long, average_stars double, fans long")
    items = frame(spark, [("i1", 7, 3.5, {"NoiseLevel": "quiet", "WiFi": "free"}), ("i2", 9, 4.5, None)], "item string, review_count long, stars double, attributes map<string,string>")
    pairs = frame(spark, [("u1", "i1"), ("u9", "i9"), ("u2", "i2")], "user string, item string")
    got = {r.user: r for r in recommend.assemble_features(pairs, users, items, 3, True).collect()}
    assert tuple(got["u1"])[2:] == (10.0, 3.0, 4.0, 2.0, 7.0, 3.5, 1.0, 2.0)
    assert tuple(got["u9"])[2:] == (15.0, 0.0, 3.0, 3.0, 8.0, 4.0, 2.0, 0.5)
    assert tuple(got["u2"])[2:] == (20.0, 5.0, 2.0, 4.0, 9.0, 4.5, 3.0, -1.0)
    a = frame(spark, [("u", "i", 1.0)], "user string, item string, prediction double")
    b = frame(spark, [("u", "i", 2.0), ("v", "i", 9.0)], "user string, item string, prediction double")
    assert [tuple(r) for r in recommend.hybrid(a, b).collect()] == [("u", "i", pytest.approx(1.9))]
    truth = frame(spark, [("u", "i", 2.5)], "user string, item string, stars double")
    assert recommend.rmse(b, truth).first().rmse == pytest.approx(0.5)
    assert [tuple(r) for r in recommend.error_histogram(b, truth).collect()] == [(0, 1)]


def test_boosted_trees_learn(spark):
    rng = random.Random(1)
    rows = [(f"u{i}", f"i{i}", *[rng.random() for _ in range(6)]) for i in range(300)]
    names = "user string, item string, u_review_count double, u_useful double, u_average_stars double, b_review_count double, b_stars double, b_noise double"
    df = frame(spark, rows, names).withColumn("stars", 1 + 4 * F.col("b_stars"))
    got = recommend.gbt_fit_predict(df, df)
    assert recommend.rmse(got, df).first().rmse < 0.4


def test_boosted_trees_see_equal_rows_once(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"u{i}", f"i{i}", rng.randrange(3) * 1.0, rng.randrange(2) * 1.0, 1.0, rng.randrange(4) * 1.0, rng.randrange(5) * 1.0, 2.0) for i in range(1500)]
    names = ["u_review_count", "u_useful", "u_average_stars", "b_review_count", "b_stars", "b_noise"]
    df = frame(spark, rows, "user string, item string, " + ", ".join(f"{c} double" for c in names))
    df = df.withColumn("stars", 1 + F.col("b_stars") * F.col("u_useful") + F.col("b_review_count") % 2 + F.pmod(F.hash("user"), F.lit(3)))
    all_rows = recommend.VectorAssembler(inputCols=names, outputCol="features").transform(df)
    want = recommend.GBTRegressor(featuresCol="features", labelCol="stars", seed=20, maxDepth=3, maxIter=4).fit(all_rows).transform(all_rows)
    want = {r.user: r.prediction for r in want.collect()}
    given, fit = [], recommend.GBTRegressor.fit
    monkeypatch.setattr(recommend.GBTRegressor, "fit", lambda self, data: (given.append(data.collect()), fit(self, data))[1])
    got = {r.user: r.prediction for r in recommend.gbt_fit_predict(df, df, depth=3, rounds=4).collect()}
    assert len(given[0]) == len({tuple(r[2:8]) for r in rows}) and sum(r.weight for r in given[0]) == 1500
    assert got == pytest.approx(want)


def test_graph_fixture(spark):
    e = frame(spark, EDGES, "src string, dst string")
    want = {"cd": 9, "ac": 4, "bc": 4, "de": 4, "df": 4, "ab": 1, "ef": 1}
    for limit in (1000, 0):  # roots dealt to tasks; frontiers as joins
        got = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(e, limit).collect()}
        assert got == pytest.approx(want)
    found, q = graph.divisive_communities(e)
    assert q == pytest.approx(0.3571428571)
    parts = {r.community: None for r in found.collect()}
    assert len(parts) == 2 and {r.id: r.community for r in found.collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d")}
    assert {r.id: r.label for r in graph.label_propagation(e).collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "c")}
    assert {r.component for r in graph.components(e).collect()} == {"a"}
    one = graph.degrees(e).select("id", F.lit("x").alias("community"))
    assert graph.modularity(e, one).first().q == pytest.approx(0.0)
    line = e.limit(1).select(writers.betweenness_line(F.lit("a"), F.lit("b"), F.lit(12.345678)).alias("v")).first().v
    assert line == "('a', 'b'),12.34568"


def test_graph_against_brute_force(spark):
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)})
    e = frame(spark, edges, "src long, dst long")
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = {k: v / 2 for k, v in graph.shares_of_roots(list(near), near).items()}
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(e, 0).collect()}
    assert got == pytest.approx(want)
    label = {}
    for v in sorted(near):
        stack = [v]
        while stack:
            w = stack.pop()
            if w not in label:
                label[w] = v if v not in label else label[v]
                stack += near[w]
    assert {r.id: r.component for r in graph.components(e).collect()} == label
    m = len(edges)
    deg = {v: len(n) for v, n in near.items()}
    q = sum(((w in near[v]) - deg[v] * deg[w] / (2 * m)) for v in near for w in near if label[v] == label[w]) / (2 * m)
    assert graph.modularity(e, frame(spark, list(label.items()), "id long, community long")).first().q == pytest.approx(q)


def test_cooccurrence_threshold(spark):
    p = frame(spark, [(u, i) for u, s in {1: "abc", 2: "abd", 3: "xyz"}.items() for i in s] + [(1, "a")], "u long, i string")
    assert [tuple(r) for r in graph.cooccurrence_edges(p, 2).collect()] == [(1, 2)]
    assert graph.cooccurrence_edges(p, 3).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(*[scalar.trailing_zeros(F.lit(v).cast("bigint")).alias(f"t{v}") for v in (96, 7, 0)], scalar.byte_fold(F.lit("ab")).alias("ab"), scalar.byte_fold(F.lit("é")).alias("e"), scalar.byte_fold(F.lit("")).alias("none")).first()
    assert tuple(row) == (5, 0, 3, 24930, 50089, 0)


def ticks(spark, batches):
    return frame(spark, [(b, i, u) for i, (b, u) in enumerate((b, u) for b, us in enumerate(batches) for u in us)], "batch long, seq long, user_id string")


def test_bloom(spark):
    got = [tuple(r) for r in sketch.bloom_fpr(ticks(spark, [["u1", "u2"], ["u1", "u3"], ["u1", "u2"]])).orderBy("batch").collect()]
    assert got == [(0, 0, 0, 0.0), (1, 1, 0, 0.0), (2, 2, 0, 0.0)]
    rng = random.Random(9)
    data = [[f"user{rng.randrange(300)}" for _ in range(60)] for _ in range(12)]
    params, filled, seen = scalar.hash_parameters(4, 553), set(), set()
    for r, users in zip(sketch.bloom_fpr(ticks(spark, data), bits=2000).orderBy("batch").collect(), data):
        places = {u: [(int.from_bytes(u.encode(), "big") * a + b) % scalar.PRIME % 2000 for a, b in params] for u in users}
        hit = [all(p in filled for p in places[u]) for u in users]
        assert r.positives == sum(hit) and r.fp == sum(h and u not in seen for h, u in zip(hit, users))
        assert all(h for h, u in zip(hit, users) if u in seen)  # no false negatives
        seen |= set(users)
        filled |= {p for ps in places.values() for p in ps}


def test_flajolet_martin(spark):
    rng = random.Random(4)
    data = [[f"{rng.randrange(400)}" for _ in range(100)] for _ in range(30)]
    params, size = scalar.hash_parameters(4, 554), lambda v: 3 if v == 0 else (v & -v).bit_length() - 1
    for r in sketch.fm_estimate(ticks(spark, data)).collect():
        most = [max(size((int.from_bytes(u.encode(), "big") * a + b) % scalar.PRIME % scalar.BITS) for u in data[r.batch]) for a, b in params]
        assert r.truth == len(set(data[r.batch])) and r.estimate == math.floor(sum(2**m for m in most) / 4)
    # the mean of 2^R has a heavy upper tail, so only its order of size is held
    assert 0.25 < sketch.estimate_ratio(sketch.fm_estimate(ticks(spark, data))).first().ratio < 32
    assert math.floor(sum(2**r for r in (0, 1, 2, 3)) / 4) == 3


def test_reservoir(spark):
    short = sketch.reservoir_snapshots(ticks(spark, [["a", "b"], ["c"]]), size=100, slots=(0, 1, 2)).orderBy("batch").collect()
    assert {short[1].id_0, short[1].id_1, short[1].id_2} == {"a", "b", "c"} and short[0].id_2 is None
    users = [f"{i}" for i in range(500)]
    slots = tuple(range(50))
    whole = sketch.reservoir_snapshots(ticks(spark, [users]), 50, slots).first()
    parts = sketch.reservoir_snapshots(ticks(spark, [users[i : i + 70] for i in range(0, 500, 70)]), 50, slots).orderBy(F.desc("batch")).first()
    assert [whole[f"id_{s}"] for s in slots] == [parts[f"id_{s}"] for s in slots]


def test_cluster_statistics(spark):
    p = frame(spark, [(1, [0.0, 0.0], 7), (2, [2.0, 4.0], 7)], "id long, features array<double>, cluster long")
    stats = clustering.cluster_stats(p)
    assert {tuple(r) for r in stats.collect()} == {(7, 0, 2, 2.0, 4.0), (7, 1, 2, 4.0, 16.0)}
    far = clustering.mahalanobis(frame(spark, [(9, [1.0, 6.0])], "id long, features array<double>"), stats).first()
    assert (far.cluster, far.dist) == (7, 2.0)


def test_bfr_labels_each_id_once(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(10 * (i % 3), 1), rng.gauss(-10 * (i % 3), 1)]) for i in range(300)] + [(300, [500.0, 500.0]), (301, [5.0, 5.0]), (302, [5.0, 5.0])]
    p = frame(spark, rows, "id long, features array<double>")
    rounds, labels = clustering.bfr(p, 3)
    got = [tuple(r) for r in labels.collect()]
    assert sorted(i for i, _ in got) == list(range(303)) and rounds.count() == 5
    by = {}
    for i, c in got:
        if i < 300 and c >= 0:
            by.setdefault(i % 3, set()).add(c)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == 3
    assert sum(c >= 0 for _, c in got) > 250
    lines = [r.value for r in writers.clustering_report(rounds, labels).collect()]
    assert lines[0] == "The intermediate results:" and lines[1].startswith("Round 1: ") and "The clustering results:" in lines and len(lines) == 8 + 303


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "business_id": "b", "stars": 4, "date": "2018-01-01", "other": 1}\n')
    assert tuple(readers.reviews(spark, str(tmp_path / "r.json")).first()) == ("u", "b", 4.0, "2018-01-01")
    (tmp_path / "t.csv").write_text('"d","c","x","y","z","p"\n"11/1/2000", 0012,1,2,3,"0077"\n')
    assert tuple(readers.raw_transactions(spark, str(tmp_path / "t.csv")).first()) == ("11/1/2000", "0012", "0077")
    (tmp_path / "p.txt").write_text("3,9,1.5,2.5\n")
    assert tuple(readers.points(spark, str(tmp_path / "p.txt")).first()) == (3, [1.5, 2.5])
    (tmp_path / "b.json").write_text('{"business_id": "b", "city": "C", "stars": 3, "review_count": 2, "attributes": {"WiFi": "free"}}\n{"business_id": "c", "attributes": null}\n')
    assert {r.business_id: r.attributes for r in readers.businesses(spark, str(tmp_path / "b.json")).collect()} == {"b": {"WiFi": "free"}, "c": None}
    assert readers.in_memory(spark, [], "a long").count() == 0
    writers.csv_lines(readers.in_memory(spark, [(1, "x,y")], "a long, b string"), str(tmp_path / "out"))
    assert [f.read_text() for f in (tmp_path / "out").glob("part-*")] == ['a,b\n1,"x,y"\n']


def test_live_forms_agree_with_relations(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    e = sketch.tick(spark.read.parquet(path), "event_id", 100, "user_id")
    want = {(r.batch, r.n, r.truth) for r in e.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("truth")).collect()}
    assert {tuple(r) for r in live.tick_counts(spark, path, 100).collect()} == want
    assert live.reservoir(spark, path, 50).count() == 50
    got = {r.batch: r.positives for r in live.bloom(spark, path, 100).collect()}
    closed = {r.batch: r.positives for r in sketch.bloom_fpr(e).collect()}
    assert all(got[b] <= closed[b] for b in closed) and got[0] == 0  # shards share no places, so they have no more positives


def test_tick_source(spark, tmp_path):
    (tmp_path / "users.txt").write_text("a\nb\nc\n")
    spark.dataSource.register(live.TickSource)
    df = spark.read.format("ticks").option("path", str(tmp_path / "users.txt")).option("size", 5).option("asks", 3).load()
    rows = df.collect()
    assert len(rows) == 15 and {r.user_id for r in rows} <= {"a", "b", "c"} and sorted(map(tuple, df.collect())) == sorted(map(tuple, rows))


def test_k_means_ignores_other_columns(spark):
    rows = [(i, [float(i % 2) * 9, float(i)], 5, [1.0], "x") for i in range(20)]
    df = frame(spark, rows, "id long, features array<double>, cluster long, v array<double>, prediction string")
    got = clustering.k_means(df, 2)
    assert got.columns == ["id", "features", "cluster"] and got.count() == 20 and got.select("cluster").distinct().count() == 2


def test_features_of_empty_tables(spark):
    users = readers.in_memory(spark, [], "user string, review_count long, useful long, average_stars double, fans long")
    items = readers.in_memory(spark, [], "item string, review_count long, stars double, attributes map<string,string>")
    pairs = frame(spark, [("u", "i", 4.0), ("v", "i", 2.0)], "user string, item string, stars double")
    got = recommend.assemble_features(pairs, users, items, 3, True)
    assert [tuple(r)[3:] for r in got.collect()] == [(0.0,) * 8] * 2
    assert recommend.gbt_fit_predict(got, got).count() == 2


def test_model_errors_beside_a_constant(spark):
    train = frame(spark, [("u", "i", 1.0), ("u", "j", 3.0)], "user string, item string, stars double")
    truth = frame(spark, [("u", "k", 4.0), ("v", "k", 2.0)], "user string, item string, stars double")
    good = truth.withColumnRenamed("stars", "prediction")
    got = {r.model: r for r in recommend.model_errors({"a": good, "b": good.withColumn("prediction", F.lit(2.0))}, train, truth).collect()}
    assert (got["a"].rmse, got["a"].n) == (0.0, 2) and got["b"].rmse == got["b"].constant == pytest.approx(math.sqrt(2))


def test_summaries_merge_first_pair_first():
    import numpy as np

    def plain(names, n, s, q, limit):
        table = {c: (n[k], s[k].copy(), q[k].copy()) for k, c in enumerate(names)}
        name = {c: c for c in names}

        def gap(a, b):
            (n1, s1, q1), (n2, s2, q2) = table[a], table[b]
            d = (s1 / n1 - s2 / n2) ** 2
            v = [np.maximum(q_ / n_ - (s_ / n_) ** 2, clustering.FLOOR) for n_, s_, q_ in (table[a], table[b])]
            return min(np.sqrt((d / x).sum()) for x in v)

        while True:
            hit = next(((a, b) for a, b in itertools.combinations(sorted(table), 2) if gap(a, b) < limit), None)
            if hit is None:
                return name
            a, b = hit
            table[a] = tuple(x + y for x, y in zip(table[a], table.pop(b)))
            name = {c: a if k == b else k for c, k in name.items()}

    rng = np.random.default_rng(3)
    for trial in range(30):
        k = int(rng.integers(1, 25))
        points = [rng.normal(rng.integers(0, 5, 2) * 4, 1, (int(rng.integers(2, 6)), 2)) for _ in range(k)]
        n, s, q = np.array([len(p) for p in points], float), np.array([p.sum(0) for p in points]), np.array([(p**2).sum(0) for p in points])
        names = sorted(rng.choice(1000, k, replace=False).tolist())
        assert clustering.merged(names, n, s, q, 2.0 + trial / 10) == plain(names, n, s, q, 2.0 + trial / 10)


def test_summaries_add_up(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random(), rng.random()], i % 3) for i in range(50)]
    p = frame(spark, rows, "id long, features array<double>, cluster long")
    whole = {(r.cluster, r.dim): (r.n, round(r["sum"], 9), round(r.sumsq, 9)) for r in clustering.cluster_stats(p).collect()}
    parts = clustering.added(clustering.cluster_stats(p.filter("id < 20")), clustering.cluster_stats(p.filter("id >= 20")))
    assert {(r.cluster, r.dim): (r.n, round(r["sum"], 9), round(r.sumsq, 9)) for r in parts.collect()} == whole


def test_nearest_of_many_clusters(spark):
    rng = random.Random(4)
    p = frame(spark, [(i, [rng.random() * 100, rng.random() * 100], i // 2) for i in range(700)], "id long, features array<double>, cluster long")  # more clusters than a block
    stats = clustering.cluster_stats(p)
    table = {}
    for r in stats.collect():
        table.setdefault(r.cluster, {})[r.dim] = (r["sum"] / r.n, max(r.sumsq / r.n - (r["sum"] / r.n) ** 2, clustering.FLOOR))
    for r in clustering.mahalanobis(p.limit(20), stats).join(p, "id").select("id", "features", "dist").collect():
        assert r.dist == pytest.approx(min(math.sqrt(sum((x - c[k][0]) ** 2 / c[k][1] for k, x in enumerate(r.features))) for c in table.values()))


def test_bfr_with_many_retained_points(spark):
    """More retained points than any limit on their clusters, copies among them."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4)]) for i in range(500)]
    rows += [(500 + i, list(rows[i][1])) for i in range(20)]
    p = frame(spark, rows, "id long, features array<double>")
    rounds, labels = clustering.bfr(p, 2, rounds=2)
    assert sorted(r.id for r in labels.collect()) == list(range(520))
    last = rounds.orderBy(F.desc("round")).first()
    assert last.ds_points + last.cs_points + last.rs_points == 520
    assert labels.filter("cluster >= 0").count() == last.ds_points


def test_divisive_search_in_tables(spark):
    e = frame(spark, EDGES, "src string, dst string")
    found, q = graph.divisive_communities(e, local_edges=0)
    assert q == pytest.approx(0.3571428571) and {r.id: r.community for r in found.collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d")}
    rng = random.Random(11)
    edges = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(18)})
    e = frame(spark, edges, "src long, dst long")
    a, b = graph.divisive_communities(e), graph.divisive_communities(e, local_edges=0)
    assert a[1] == pytest.approx(b[1])
    one = lambda found: {r.id: r.community for r in found.collect()}
    x, y = one(a[0]), one(b[0])
    assert {frozenset(i for i in x if x[i] == c) for c in set(x.values())} == {frozenset(i for i in y if y[i] == c) for c in set(y.values())}


def test_divisive_golden_value(spark):
    from millrace.plans import catalog

    edges = catalog._edges(spark, "/root/testdata/sf0.01")
    found, q = graph.divisive_communities(edges)
    assert q == pytest.approx(0.9131818696, abs=1e-9) and found.select("community").distinct().count() == 52


def test_betweenness_in_blocks_and_by_sample(spark):
    rng = random.Random(12)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    e = frame(spark, edges, "src long, dst long")
    whole = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(e).collect()}
    blocks = {(r.src, r.dst): r.betweenness for r in graph._frontier_betweenness(e, rows=400).collect()}
    assert blocks == pytest.approx(whole)
    part = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(e, 0, share=0.5).collect()}
    assert set(part) == set(whole) and sum(part.values()) == pytest.approx(sum(whole.values()), rel=0.4)


def test_samples_do_not_grow_with_the_square_of_batches(spark):
    users = [f"{i}" for i in range(6000)]
    slots = tuple(range(10))
    for size, step in ((10, 7), (10, 1), (3, 50)):
        data = [users[i : i + step] for i in range(0, len(users) if step > 1 else 600, step)]
        got = sketch.reservoir_snapshots(ticks(spark, data), size, slots[:size]).orderBy("batch").collect()
        assert len(got) == len(data)
        import hashlib

        for r in random.Random(1).sample(got, 20):
            best = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(r.n))[:size]
            assert [r[f"id_{s}"] for s in slots[:size]] == [*[users[i] for _, i in best], *[None] * (size - len(best))]


def test_lsh_folds_copies(spark):
    base = {f"d{k}": [f"w{j}" for j in range(k, k + 30)] for k in range(0, 60, 3)}
    sets = base | {f"copy{k}": base["d0"] for k in range(40)}
    df = frame(spark, [(i, e) for i, s in sets.items() for e in s], "id string, element string")
    exact = {(r.id1, r.id2): round(r.similarity, 9) for r in similarity.jaccard_exact(df).collect()}
    found = {(r.id1, r.id2): round(r.similarity, 9) for r in similarity.lsh_similar(df).collect()}
    assert set(found.items()) <= set(exact.items()) and len(found) >= 0.95 * len(exact)
    assert sum(a.startswith("copy") and b.startswith("copy") for a, b in found) == 780


def shuffled(spark, run):
    """Rows that all stages of a run write to shuffles."""
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for k, n in stages().items() if k not in before)


def dense_ratings(users=300, items=60, each=30):
    rng = random.Random(11)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(users) for i in rng.sample(range(items), each)]
    return [r for k, r in enumerate(rows) if k % 15], [r[:2] for k, r in enumerate(rows) if k % 15 == 0]


def brute_force_cf(train, test, k=30):
    by_user, by_item = {}, {}
    for u, i, s in train:
        by_user.setdefault(u, {})[i] = s
        by_item.setdefault(i, {})[u] = s
    mean = {i: sum(r.values()) / len(r) for i, r in by_item.items()}

    def sim(i, n):
        common = by_item[i].keys() & by_item[n].keys()
        x, y = [by_item[i][u] - mean[i] for u in common], [by_item[n][u] - mean[n] for u in common]
        product = sum(a * a for a in x) * sum(b * b for b in y)
        s = mean[i] / mean[n] if not common else 1.0 if product < 1e-18 else sum(a * b for a, b in zip(x, y)) / math.sqrt(product)
        return 1 / s if s > 1 else s

    pairs = {(i, n): sim(i, n) for u, i in test for n in by_user[u] if n != i}
    out = {}
    for u, i in test:
        best = sorted((-round(pairs[i, n], 9), n) for n in by_user[u] if n != i and pairs[i, n] > 0)[:k]
        out[u, i] = sum(pairs[i, n] * by_user[u][n] for _, n in best) / sum(pairs[i, n] for _, n in best) if best else mean[i]
    return pairs, out


def test_predictions_move_ratings_not_raters_of_pairs(spark):
    train, test = dense_ratings()
    want = brute_force_cf(train, test)[1]
    got = {}
    a, b = frame(spark, train, "user long, item long, stars double"), frame(spark, test, "user long, item long")
    n = shuffled(spark, lambda: got.update({(r.user, r.item): r.prediction for r in recommend.cf_predict(a, b).collect()}))
    assert got == pytest.approx(want)
    assert n < 20 * len(train), n


def test_pair_similarities_move_ratings_not_raters_of_pairs(spark):
    train, test = dense_ratings()
    want = brute_force_cf(train, test)[0]
    got = {}
    a, b = frame(spark, train, "user long, item long, stars double"), frame(spark, test, "user long, item long")
    n = shuffled(spark, lambda: got.update({(r["item"], r["neighbor"]): r["sim"] for r in recommend.pair_similarity(a, b).collect()}))
    assert got == pytest.approx(want)
    assert n < 20 * len(train), n


def test_rmse_moves_ratings_not_raters_of_pairs(spark):
    train, test = dense_ratings()
    want = brute_force_cf(train, test)[1]
    got = []
    a, b = frame(spark, train, "user long, item long, stars double"), frame(spark, [(*p, 3.0) for p in test], "user long, item long, stars double")
    n = shuffled(spark, lambda: got.append(recommend.rmse(recommend.cf_predict(a, b), b).first()))
    assert got[0].rmse == pytest.approx(math.sqrt(sum((p - 3) ** 2 for p in want.values()) / len(want))) and got[0].n == len(want)
    assert n < 20 * len(train), n


def test_top_neighbors_move_ratings_not_raters_of_pairs(spark):
    train, test = dense_ratings()
    pairs = brute_force_cf(train, test)[0]
    rated = {}
    for u, i, _ in train:
        rated.setdefault(u, set()).add(i)
    want = {(u, i, n, k + 1) for u, i in test for k, n in enumerate(sorted((n for n in rated[u] if n != i and pairs[i, n] > 0), key=lambda n: (-round(pairs[i, n], 9), n))[:5])}
    got = set()
    a, b = frame(spark, train, "user long, item long, stars double"), frame(spark, test, "user long, item long")
    n = shuffled(spark, lambda: got.update((r["user"], r["item"], r["neighbor"], r["rank"]) for r in recommend.top_neighbors(a, b, 5).collect()))
    assert got == want
    assert n < 20 * len(train), n


def test_rounds_move_only_raters_of_their_items(spark):
    train, test = dense_ratings()
    want = brute_force_cf(train, test)[1]
    a, b = frame(spark, train, "user long, item long, stars double"), frame(spark, test, "user int, item int")  # of other types than the ratings
    got = {}
    n = shuffled(spark, lambda: got.update({(r.user, r["item"]): r.prediction for r in recommend.cf_predict(a, b).collect()}))
    assert got == pytest.approx(want)
    assert n < 13 * len(train), n


def test_jaccard_moves_sets_not_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = {k: rng.sample(range(200), rng.randint(1, 40)) for k in range(240)}
    near = {1000 + k: base[k][: len(base[k]) * 3 // 4] + [500 + k] for k in range(0, 240, 8)}
    docs = {k: set(v) for k, v in (base | near | {2000: base[0]}).items()}
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sorted(docs.items()), 2) if 2 * len(x & y) >= len(x | y)}
    rows = [(k, str(e)) for k, v in docs.items() for e in v]
    df = frame(spark, [*rows, rows[0], (None, "1")], "id long, element string")
    got = {}
    n = shuffled(spark, lambda: got.update({(r.id1, r.id2): r.similarity for r in similarity.jaccard_exact(df).collect()}))
    assert got == pytest.approx(want) and len(want) > 20
    assert n < len(rows), n
    monkeypatch.setattr(similarity, "BLOCK", 500)  # several blocks, rounds and portions
    monkeypatch.setattr(similarity, "DEALT", 3000)
    monkeypatch.setattr(similarity, "COUNTED", 700)
    assert {(r.id1, r.id2): r.similarity for r in similarity.jaccard_exact(df).collect()} == pytest.approx(want)
    assert similarity.jaccard_exact(df.limit(0)).count() == 0


def test_ratings_lie_by_users(spark):
    """No round of similarities moves all ratings, and the training set goes once it is read."""
    train = spark.createDataFrame([(u, i, float(u * i % 5)) for u in range(6) for i in range(5)], "user long, item long, stars double")
    test = spark.createDataFrame([(1, 2), (3, 4)], "user long, item long")
    spent = []
    rated = recommend.Rated(train, test, lambda: spent.append(1))
    plan = rated.one.groupBy("user").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spent == [1] and rated.one.count() == 30
    path = rated.scratch.paths[id(rated.one)][0]
    rated.scratch.drop()
    assert not spark.catalog.tableExists("millrace_" + path.rsplit("-", 1)[-1])


def test_blocks_know_their_rows(monkeypatch):
    """Bitmaps of rows are dealt beside kept elements, so a round's size needs both."""
    monkeypatch.setattr(similarity, "BLOCK", 30)
    assert similarity._blocks([(4, 5), (6, 2), (8, 20)], 0.5)[1] == [[4, 6, 23, 7], *[[8, 8, 25, 5]] * 4]


def test_candidates_are_made_once_and_not_moved(spark, monkeypatch):
    """Pairs share any key of a band, equal keys of other bands do not count, and only rows are shuffled."""
    import random

    rng = random.Random(5)
    keys = {k: [str(rng.randrange(6)) for _ in range(4)] for k in range(120)}
    want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if any(x == y for x, y in zip(keys[a], keys[b]))}
    rows = [(k, band, key) for k, ks in keys.items() for band, key in enumerate(ks)]
    df = frame(spark, [*rows, rows[0], (None, 0, "1")], "id long, band int, key string")
    got = []
    n = shuffled(spark, lambda: got.extend((r.id1, r.id2) for r in similarity.lsh_candidates(df).collect()))
    assert len(got) == len(want) and set(got) == want
    assert n < 2 * len(rows) < len(want), n
    monkeypatch.setattr(similarity, "SIGNED", 30)
    monkeypatch.setattr(similarity, "CELLS", 100)
    monkeypatch.setattr(similarity, "OUT", 7)
    assert sorted(map(tuple, similarity.lsh_candidates(df).collect())) == sorted(want)
    assert similarity.lsh_candidates(df.limit(0)).count() == 0


def test_lsh_verifies_in_rounds(spark, monkeypatch):
    """Sets travel for a bounded number of pairs at once, and pairs are not made by a shuffle of bands."""
    docs = {k: {*range(k // 10 * 100, k // 10 * 100 + 30)} - {k // 10 * 100 + k % 10} for k in range(60)}
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sorted(docs.items()), 2) if a // 10 == b // 10}
    df = frame(spark, [(k, str(e)) for k, v in docs.items() for e in v], "id long, element string")
    monkeypatch.setattr(similarity, "TRAVEL", 40)
    monkeypatch.setattr(similarity, "SIGNED", 25)
    got = {}
    n = shuffled(spark, lambda: got.update({(r.id1, r.id2): r.similarity for r in similarity.lsh_similar(df, bands=60, rows=1).collect()}))
    assert got == pytest.approx(want)
    assert n < 60 * 60 + 4 * df.count(), n
