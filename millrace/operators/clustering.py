"""Out-of-core clustering from sufficient statistics.

Points are (id, features).  Summaries are long tables (cluster, dim, n, sum,
sumsq) that add up, so points are read once and their summaries carried on.
Within a round summaries are frozen, so points can be assigned in any order.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

#: The least variance of a dimension, and clusters whose summaries travel in one row.
FLOOR, BLOCK = 1e-9, 256


def cluster_stats(points: DataFrame, label: str = "cluster") -> DataFrame:
    """cluster, dim, n, sum, sumsq."""
    long = points.select(F.col(label).alias("cluster"), F.posexplode("features").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of summaries as one."""
    return a.unionByName(b).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"))


def _centres(stats: DataFrame) -> DataFrame:
    mean = F.col("sum") / F.col("n")
    return stats.select("cluster", "dim", mean.alias("mean"), F.greatest(F.col("sumsq") / F.col("n") - mean * mean, F.lit(FLOOR)).alias("var"))


def mahalanobis(points: DataFrame, stats: DataFrame) -> DataFrame:
    """id, cluster, dist of the nearest cluster; ties go to the smaller cluster.

    Up to ``BLOCK`` clusters travel as one row and a point takes the nearest of
    them where it lies, so no point is multiplied by clusters or dimensions;
    further blocks add a row a point each, reduced before the shuffle.
    """
    rows = _centres(stats).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "var"))).alias("c"))
    n = stats.select("cluster").distinct().count()
    if not n:
        return points.select("id", F.lit(0).cast("bigint").alias("cluster"), F.lit(0.0).alias("dist")).limit(0)
    block = F.pmod(F.xxhash64("cluster"), F.lit(-(-n // BLOCK)))
    blocks = rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("cluster", "c")).alias("all"))
    terms = lambda c: F.zip_with("features", c, lambda x, d: (x - d["mean"]) * (x - d["mean"]) / d["var"])
    near = F.array_min(F.transform("all", lambda k: F.struct(F.sqrt(F.aggregate(terms(k["c"]), F.lit(0.0), lambda a, x: a + x)).alias("dist"), k["cluster"].alias("cluster"))))
    met = points.select("id", "features").crossJoin(F.broadcast(blocks)).select("id", near.alias("m"))  # n // BLOCK + 1 rows of bounded size
    if n > BLOCK:
        met = met.groupBy("id").agg(F.min("m").alias("m"))
    return met.select("id", "m.cluster", "m.dist")


def merge_pairs(stats: DataFrame) -> DataFrame:
    """c1 < c2 and the smaller of the distances between centres by either variance."""
    c = _centres(stats)
    a, b = c.alias("a"), c.alias("b")
    gap = (F.col("a.mean") - F.col("b.mean")) * (F.col("a.mean") - F.col("b.mean"))
    both = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.cluster") < F.col("b.cluster"))).groupBy(F.col("a.cluster").alias("c1"), F.col("b.cluster").alias("c2"))
    return both.agg(F.least(F.sqrt(F.sum(gap / F.col("a.var"))), F.sqrt(F.sum(gap / F.col("b.var")))).alias("dist"))


def k_means(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """id, features, cluster; other columns of points are not looked at, whatever their names."""
    p = points.select("id", F.col("features").cast("array<double>").alias("features")).withColumn("_vector", array_to_vector("features"))
    model = KMeans(k=max(2, k), seed=seed, featuresCol="_vector", predictionCol="_label").fit(p)
    return model.transform(p).select("id", "features", F.col("_label").cast("bigint").alias("cluster"))


def with_size(labelled: DataFrame) -> DataFrame:
    """labelled with n, the number of points that have its cluster."""
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return labelled.join(sizes, "cluster")


def _compressed(rest: DataFrame, seed: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """Retained points clustered by one cluster fewer than points: (members of clusters of two or more, single points)."""
    n = rest.count()
    if n < 3:
        return rest.withColumn("cluster", F.lit(0).cast("bigint")).limit(0), rest
    got = checkpointed(with_size(k_means(rest, n - 1, seed)))
    return got.filter("n > 1").select("id", "features", (F.col("cluster") + offset).alias("cluster")), got.filter("n = 1").select("id", "features")


def merged(names: list, n: np.ndarray, total: np.ndarray, squares: np.ndarray, limit: float) -> dict:
    """Old cluster -> new one.  The first pair under the limit, in order of names, is merged and the search goes on, until there is none.

    names are sorted; n has a count for each, total and squares a row of sums.
    After a merge only the changed cluster can be in a new pair, so one row of distances is computed for each.
    """
    n, total, squares = n.astype(float), total.astype(float), squares.astype(float)
    alive, name = np.ones(len(names), bool), {c: c for c in names}

    def near(i: int) -> np.ndarray:
        mean = total / n[:, None]
        var = np.maximum(squares / n[:, None] - mean**2, FLOOR)
        gap = (mean - mean[i]) ** 2
        return (np.minimum((gap / var).sum(1), (gap / var[i]).sum(1)) < limit**2) & alive & (np.arange(len(names)) != i)

    i = 0
    while i < len(names):
        if not alive[i]:
            i += 1
            continue
        found = np.flatnonzero(near(i))
        # rows before i had no partner but a cluster that has changed since, so the first of them comes first
        if not len(found):
            i += 1
            continue
        a, b = sorted((i, int(found[0])))
        n[a], total[a], squares[a] = n[a] + n[b], total[a] + total[b], squares[a] + squares[b]
        alive[b] = False
        name = {c: names[a] if k == names[b] else k for c, k in name.items()}
        i = a
    return name


def _merged(stats: DataFrame, limit: float) -> dict:
    """Works on summaries, which are no points: a few rows a cluster."""
    table: dict = {}
    for r in stats.orderBy("cluster", "dim").collect():  # summaries only: clusters times dimensions
        table.setdefault(r.cluster, []).append((r.n, r["sum"], r.sumsq))
    if not table:
        return {}
    names = sorted(table)
    x = np.array([table[c] for c in names], float)
    return merged(names, x[:, 0, 0], x[:, :, 1], x[:, :, 2], limit)


def chunk_of(id, rounds: int, seed: int = 1):
    """0 to rounds - 1, by a hash of the id."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id).cast("binary")), 1, 7), 16, 10).cast("bigint") % rounds).cast("int")


def bfr(points: DataFrame, k: int, rounds: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(round, ds_points, cs_clusters, cs_points, rs_points) and (id, cluster), -1 for what no cluster took; every id has one line.

    A point's features are read in its round only: then its label and its share
    of a summary remain.  Retained points, which no cluster took, are the only
    ones kept whole; the driver holds as many centres as there are of them.
    """
    spark = points.sparkSession
    points = points.select("id", F.col("features").cast("array<double>").alias("features"))
    chunked = checkpointed(points.withColumn("chunk", chunk_of(F.col("id"), rounds, seed)))
    first = chunked.select("features").first()
    limit, report = 2 * len(first[0]) ** 0.5 if first else 0.0, []
    none = chunked.select("id", "features", F.lit(0).cast("bigint").alias("cluster")).limit(0)
    rest = none.drop("cluster")
    ds, cs = cluster_stats(none), cluster_stats(none)
    members: dict[str, list[DataFrame]] = {"ds": [], "cs": []}  # (id, cluster) of each round
    name: dict = {}  # compressed clusters that have been merged: old -> new

    def points_of(stats: DataFrame) -> tuple[int, int]:
        got = stats.filter("dim = 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        return got[0], got[1] or 0

    for r in range(rounds):
        chunk = chunked.filter(F.col("chunk") == r).select("id", "features")
        if r == 0 and not chunk.isEmpty():
            rough = checkpointed(with_size(k_means(chunk, min(10 * k, max(2, chunk.count() // 2)), seed)))
            rest = rough.filter("n = 1").select("id", "features")
            inner = rough.filter("n > 1").select("id", "features")
            if not inner.isEmpty():
                got = checkpointed(k_means(inner, k, seed))
                ds = checkpointed(cluster_stats(got))
                members["ds"].append(got.select("id", "cluster"))
        elif r:
            left = chunk
            for kind in ("ds", "cs"):
                into = ds if kind == "ds" else cs
                if into.isEmpty() or left.isEmpty():
                    continue
                got = checkpointed(left.join(mahalanobis(left, into).filter(F.col("dist") < limit).select("id", "cluster"), "id", "left"))
                took, left = got.filter("cluster is not null"), got.filter("cluster is null").select("id", "features")
                members[kind].append(took.select("id", "cluster"))
                sums = checkpointed(added(into, cluster_stats(took)))
                ds, cs = (sums, cs) if kind == "ds" else (ds, sums)
            rest = checkpointed(rest.unionByName(left))
        more, rest = _compressed(rest, seed + r, (r + 1) << 40)
        if not more.isEmpty():
            members["cs"].append(more.select("id", "cluster"))
            cs = checkpointed(added(cs, cluster_stats(more)))
        if not cs.isEmpty():
            step = _merged(cs, limit)
            name = {c: step.get(n, n) for c, n in name.items()} | step
            moved = spark.createDataFrame(list(step.items()), "cluster bigint, new bigint")
            cs = checkpointed(added(cs.join(F.broadcast(moved), "cluster").select(F.col("new").alias("cluster"), "dim", "n", "sum", "sumsq"), cluster_stats(none)))  # a row a cluster
        if r == rounds - 1 and not cs.isEmpty() and not ds.isEmpty():
            centres = _centres(cs).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c")).select(F.col("cluster").alias("id"), F.transform("c", lambda x: x["mean"]).alias("features"))
            into = checkpointed(mahalanobis(centres, ds).filter(F.col("dist") < limit).select(F.col("id").alias("cluster"), F.col("cluster").alias("new")))
            ds, cs = checkpointed(added(ds, cs.join(into, "cluster").select(F.col("new").alias("cluster"), "dim", "n", "sum", "sumsq"))), checkpointed(cs.join(into, "cluster", "left_anti"))
            if members["cs"] and name:
                last = spark.createDataFrame(list(name.items()), "cluster bigint, last bigint").join(into.withColumnRenamed("cluster", "last"), "last").select("cluster", "new")
                members["ds"] += [m.join(F.broadcast(last), "cluster").select("id", F.col("new").alias("cluster")) for m in members["cs"]]  # a row a cluster
        (_, in_ds), (clusters, in_cs) = points_of(ds), points_of(cs)
        report.append((r + 1, in_ds, clusters, in_cs, rest.count()))
    taken = none.select("id", "cluster")
    for m in members["ds"]:
        taken = taken.unionByName(m)
    labels = points.select("id").join(taken, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))
    return spark.createDataFrame(report, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long"), labels
