"""Report queries against SQL, report files byte by byte, and the programs."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import programs
from millrace.operators import explore, graph, similarity, sketch
from millrace.plans import catalog, reports
from millrace.sources import shared, writers
from millrace.streaming import live

from .conftest import SMALL
from .test_operators import shuffled
from .test_entry import TABLES, rows

NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == reports.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_report_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    want = con.execute(catalog.SQL[name]).df()
    assert rows(catalog.QUERIES[name](spark, SMALL).toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql(spark, name):
    # the smallest table's graph is nearly complete, which the divisive search takes minutes for
    got = catalog.QUERIES[name](spark, SMALL.replace("0.001", "0.01") if name == "divisive_communities" else SMALL).toPandas()
    assert len(got) and not got.isna().any().any()


def test_features_are_there(spark):
    got = catalog.QUERIES["features_default_join"](spark, SMALL).toPandas()
    assert not got.isna().any().any() and all(got[c].nunique() > 1 for c in got.columns)


def written(path):
    return "".join(f.read_text() for f in sorted(path.glob("part-*")))


def test_review_json_byte_by_byte(spark):
    rows = [("ü\"1", 5, "2018-01-02"), ("b", 6, "2017-01-02"), ("b", 5, "2018-05-06")]
    df = spark.createDataFrame(rows, "user_id string, business_id long, date string")
    want = {"n_review": 3, "n_review_2018": 2, "n_user": 2, "top10_user": [["b", 2], ['ü"1', 1]], "n_business": 2, "top10_business": [[5, 2], [6, 1]]}
    assert explore.review_json(df).first().value == json.dumps(want, ensure_ascii=False)
    none = json.loads(explore.review_json(df.limit(0)).first().value)
    assert none["n_review"] == 0 and none["top10_user"] == []


def test_layout_and_timings(spark):
    df = spark.createDataFrame([("Ax",), ("Bx",), ("Fx",)], "k string").repartition(2)
    got = explore.layout_report(df, "k", 7)
    assert got["customized"]["n_items"] == [1, 0, 1, 1, 0, 0, 0] and got["customized"]["n_partition"] == 7
    assert sum(got["default"]["n_items"]) == 3 and got["default"]["n_partition"] == 2 and got["default"]["exe_time"] > 0
    assert set(explore.sort_timings(df.withColumn("n", F.lit(1)), "n", "k")) == {"m1", "m2"}


def test_report_files(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "c", 0.5), ("a", "z", 1.0), ("a", "c", 2 / 3)], "id1 string, id2 string, similarity double")
    writers.text_file(writers.similarity_lines(pairs), str(tmp_path / "s"))
    assert written(tmp_path / "s") == "business_id_1, business_id_2, similarity\na,c,0.6666666666666666\na,z,1.0\nb,c,0.5\n"
    predicted = spark.createDataFrame([("u", "j", 3.25), ("t", "k", 2.5)], "user string, item string, prediction double")
    writers.text_file(writers.prediction_lines(predicted), str(tmp_path / "p"))
    assert written(tmp_path / "p") == "user_id, business_id, prediction\nt,k,2.5\nu,j,3.25\n"
    assert writers.prediction_lines(predicted, spaced=False).first().value == "user_id,business_id,prediction"
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 9.0), ("a", "c", 1.0), ("x", "y", 12.3456789), ("p", "q", 2.5e7)], "src string, dst string, betweenness double")
    writers.text_file(writers.betweenness_lines(edges), str(tmp_path / "b"))
    assert written(tmp_path / "b") == "('p', 'q'),25000000.0\n('x', 'y'),12.34568\n('c', 'd'),9.0\n('a', 'b'),1.0\n('a', 'c'),1.0\n"
    found = spark.createDataFrame([(["b", "c"], 2), (["a", "z"], 2), (["q"], 1)], "members array<string>, size int")
    writers.text_file(writers.community_lines(found), str(tmp_path / "c"))
    assert written(tmp_path / "c") == "'q'\n'a', 'z'\n'b', 'c'\n"
    ticks = spark.createDataFrame([(b, i, u) for i, (b, u) in enumerate([(0, "u1"), (0, "u2"), (1, "u1"), (1, "u3")])], "batch long, seq long, user_id string")
    writers.text_file(writers.bloom_lines(sketch.bloom_fpr(ticks)), str(tmp_path / "f"))
    assert written(tmp_path / "f") == "Time,FPR\n0,0.0\n1,0.0\n"
    short = writers.reservoir_lines(sketch.reservoir_snapshots(ticks)).collect()
    assert short[0].value == "seqnum,0_id,20_id,40_id,60_id,80_id" and [r.value.split(",")[0] for r in short[1:]] == ["2", "4"] and all(r.value.count(",") == 5 for r in short)
    city = spark.createDataFrame([("Q", 3.0), ("A", 3.0), ("B", 4.5)], "city string, stars double")
    assert [r.value for r in writers.city_lines(city).collect()] == ["city,stars", "B,4.5", "A,3.0", "Q,3.0"]
    assert [r.value for r in writers.city_lines(city.limit(0)).collect()] == ["city,stars"]


def test_orders_of_graph_results(spark):
    e = spark.createDataFrame([("c", "d", 4.0), ("a", "b", 9.0), ("a", "c", 4.0)], "src string, dst string, betweenness double")
    assert [(r.src, r.dst) for r in graph.by_betweenness(e).collect()] == [("a", "b"), ("a", "c"), ("c", "d")]
    c = spark.createDataFrame([(["b"], 1), (["a", "c"], 2), (["a"], 1)], "members array<string>, size int")
    assert [r.members for r in graph.in_order(c).collect()] == [["a"], ["b"], ["a", "c"]]


def test_dense_ids(spark):
    values = [f"v{k % 300:03d}" for k in range(1000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "k string")
    for parts in (1, 7):
        got = {r.k: r.idx for r in explore.dense_ids(df.repartition(parts), "k").collect()}
        assert got == {v: i for i, v in enumerate(sorted(set(values)))}
    assert explore.dense_ids(df.limit(0), "k").count() == 0


def test_asks(spark, tmp_path):
    (tmp_path / "users.txt").write_text("".join(f"user{k}\n" for k in range(50)))
    got = live.asks(spark, str(tmp_path / "users.txt"), 100, 30).collect()
    assert len(got) == 3000 and len({r.user_id for r in got}) == 50 and {r.batch for r in got} == set(range(30))
    (tmp_path / "none.txt").write_text("")
    assert live.asks(spark, str(tmp_path / "none.txt"), 100, 3).count() == 0


def test_programs(spark, tmp_path):
    reviews = [(f"u{u}", f"b{b}", float(1 + (u * b) % 5), f"201{8 - b % 2}-01-0{1 + u % 9}") for u in range(12) for b in range(8) if (u + b) % 3]
    (tmp_path / "review.json").write_text("".join(json.dumps(dict(zip(("user_id", "business_id", "stars", "date"), r))) + "\n" for r in reviews))
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "business.json").write_text("".join(json.dumps({"business_id": f"b{b}", "city": "PQ"[b % 2], "stars": 3.5, "review_count": b, "attributes": {"NoiseLevel": "quiet"} if b % 3 else None}) + "\n" for b in range(8)))
    (folder / "user.json").write_text("".join(json.dumps({"user_id": f"u{u}", "review_count": u, "useful": 1, "average_stars": 3.0, "fans": u}) + "\n" for u in range(11)))
    lines = "".join(f"{u},{b},{s}\n" for u, b, s, _ in reviews)
    for name in (folder / "yelp_train.csv", tmp_path / "ratings.csv"):
        name.write_text("user_id,business_id,stars\n" + lines)
    (tmp_path / "test.csv").write_text("user_id,business_id\nu1,b0\nu99,b1\nu2,b77\n")
    (tmp_path / "raw.csv").write_text("d,c,x,y,z,p\n" + "".join(f'"11/1/2000","000{k % 3}",1,2,3,"00{k}"\n' for k in range(9)))
    (tmp_path / "users.txt").write_text("".join(f"user{k}\n" for k in range(30)))
    (tmp_path / "points.txt").write_text("".join(f"{k},0,{10 * (k % 2) + k / 100},{k % 7}\n" for k in range(60)))
    at = lambda n: str(tmp_path / n)
    run = lambda name, *args: programs.PROGRAMS[name](spark, *args)
    run("review-report", at("review.json"), at("o1"))
    assert json.loads(written(tmp_path / "o1"))["n_review"] == len(reviews)
    run("partition-report", at("review.json"), at("o2"), "5")
    assert sum(json.loads(written(tmp_path / "o2"))["customized"]["n_items"]) == len(reviews)
    run("city-report", at("review.json"), str(folder / "business.json"), at("o3"), at("o4"))
    assert written(tmp_path / "o3").startswith("city,stars\n") and set(json.loads(written(tmp_path / "o4"))) == {"m1", "m2"}
    run("itemset-report", "1", "6", at("ratings.csv"), at("o5"))
    assert written(tmp_path / "o5").startswith("Candidates:\n('b0')") and "Frequent Itemsets:" in written(tmp_path / "o5")
    run("transaction-itemsets", "2", "1", at("raw.csv"), at("o6"), at("o6p"))
    assert "DATE-CUSTOMER_ID,PRODUCT_ID\n" in written(tmp_path / "o6p") and "('3')" in written(tmp_path / "o6")
    run("similar-items", at("ratings.csv"), at("o7"))
    assert written(tmp_path / "o7").startswith("business_id_1, business_id_2, similarity\n")
    for k, name in enumerate(("tree-model", "hybrid-model", "extended-tree-model")):
        run(name, str(folder), at("test.csv"), at(f"m{k}"))
        assert len(written(tmp_path / f"m{k}").splitlines()) == 4
    run("collaborative-filter", at("ratings.csv"), at("test.csv"), at("o8"))
    assert "u99,b1," in written(tmp_path / "o8")
    run("label-communities", "4", at("ratings.csv"), at("o9"))
    run("divisive-communities", "4", at("ratings.csv"), at("o10"), at("o11"))
    assert written(tmp_path / "o9").startswith("'u") and written(tmp_path / "o10").startswith("('u") and written(tmp_path / "o11").startswith("'u")
    for k, name in enumerate(("bloom-filter", "distinct-estimate", "reservoir-sample")):
        run(name, at("users.txt"), "100", "5", at(f"s{k}"))
        assert len(written(tmp_path / f"s{k}").splitlines()) == 6
    run("cluster-points", at("points.txt"), "2", at("o12"))
    assert written(tmp_path / "o12").startswith("The intermediate results:\nRound 1: ") and len(written(tmp_path / "o12").splitlines()) == 8 + 60
    assert programs.main([]) == 2


def test_tables_of_a_computation_go(spark):
    import os

    s = shared.Scratch(spark, "t")
    a, b = s.cut(spark.range(3)), s.cut(spark.range(4))
    paths = [p.removeprefix("file://") for p, _ in s.paths.values()]
    s.drop(b)
    assert [os.path.exists(p) for p in paths] == [False, True] and b.count() == 4 and a is not b


def test_similarity_lines_move_sets_not_pairs(spark):
    sets = similarity.word_sets(catalog.t(spark, SMALL, "documents")).count()
    got = []
    n = shuffled(spark, lambda: got.extend(r.value for r in reports.similarity_lines(spark, SMALL).collect()))
    assert got[0] == "business_id_1, business_id_2, similarity" and n < sets, (n, sets)


def test_lines_are_sorted_before_they_are_text(spark):
    """The sort moves values; text is made after it."""
    df = spark.createDataFrame([(2, 1.0, None), (1, 2.5, "x"), (None, 0.5, "y")], "id long, v double, w string")
    out = writers.lines(df, ["id", (-df.v).alias("v")], [F.col("id"), F.col("v"), F.col("w")], "head")
    assert [r.value for r in out.collect()] == ["head", "0.5,y", "1,2.5,x", "2,1.0"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Sort ")
