"""Stream sketches over ticks (columns batch, seq, user_id) as relational plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import BITS, affine_hash, byte_fold, hash_parameters, trailing_zeros

from .graph import checkpointed


def tick(df: DataFrame, seq: str, size: int, user: str) -> DataFrame:
    """Count-based batches of a stream with a gapless sequence number."""
    return df.select(F.expr(f"cast(`{seq}` div {size} as bigint)").alias("batch"), F.col(seq).alias("seq"), F.col(user).cast("string").alias("user_id"))


def bloom_fpr(ticks: DataFrame, bits: int = BITS, hashes: int = 4, seed: int = 553) -> DataFrame:
    """batch, positives, fp, fpr of a Bloom filter that is asked before a batch is inserted.

    A place is set from the first batch that hits it on; a query is positive if
    all its places were set in earlier batches, so no state is passed along.
    """
    params = hash_parameters(hashes, seed)
    x = byte_fold(F.col("user_id"))
    users = ticks.groupBy("batch", "user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("x", x)
    places = [affine_hash(F.col("x"), a, b, size=bits).alias(f"p{i}") for i, (a, b) in enumerate(params)]
    seen = users.select("user_id", "batch", "n", *places, F.min("batch").over(Window.partitionBy("user_id")).alias("met"))
    first = reduce(DataFrame.unionByName, [seen.select(F.col(f"p{i}").alias("place"), "batch") for i in range(hashes)]).groupBy("place").agg(F.min("batch").alias("since"))
    for i in range(hashes):
        seen = seen.join(first.select(F.col("place").alias(f"p{i}"), F.col("since").alias(f"s{i}")), f"p{i}")
    positive = F.greatest(*[f"s{i}" for i in range(hashes)]) < F.col("batch") if hashes > 1 else F.col("s0") < F.col("batch")
    sums = seen.groupBy("batch").agg(F.sum("n").alias("size"), F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("positives"), F.sum(F.when(positive & (F.col("met") >= F.col("batch")), F.col("n")).otherwise(0)).alias("fp"))
    return sums.select("batch", "positives", "fp", F.coalesce(F.try_divide(F.col("fp"), F.col("size") - F.col("positives") + F.col("fp")), F.lit(0.0)).alias("fpr"))


def fm_estimate(ticks: DataFrame, hashes: int = 4, seed: int = 554) -> DataFrame:
    """batch, truth, estimate: the mean of 2^R over the hashes, rounded down, beside the exact number."""
    x = ticks.select("batch", "user_id", byte_fold(F.col("user_id")).alias("x"))
    most = [F.max(trailing_zeros(affine_hash(F.col("x"), a, b))).alias(f"r{i}") for i, (a, b) in enumerate(hash_parameters(hashes, seed))]
    found = x.groupBy("batch").agg(F.countDistinct("user_id").alias("truth"), *most)
    mean = reduce(lambda a, b: a + b, [F.pow(F.lit(2.0), f"r{i}") for i in range(hashes)]) / hashes
    return found.select("batch", "truth", F.floor(mean).alias("estimate"))


def distinct_per_batch(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("batch").agg(F.countDistinct("user_id").alias("truth"))


def hll_per_batch(ticks: DataFrame, rsd: float = 0.05) -> DataFrame:
    return ticks.groupBy("batch").agg(F.approx_count_distinct("user_id", rsd).alias("estimate"))


def estimate_ratio(estimates: DataFrame) -> DataFrame:
    return estimates.agg((F.sum("estimate") / F.sum("truth")).alias("ratio"))


def reservoir_snapshots(ticks: DataFrame, size: int = 100, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """After each batch n and the users at some slots of a uniform sample.

    The sample after n elements is the ``size`` elements of smallest hashed
    sequence number.  Batches fall into eras that double in length.  An element
    of an era can only enter if it is smaller than the sample that the eras
    before left, which about ``size`` elements of each era are.  So a batch
    changes the sample in few places, the samples at those are computed, and
    every batch takes the last one before it.
    """
    ranked = ticks.select("batch", "seq", "user_id", F.md5(F.col("seq").cast("string").cast("binary")).alias("h"), F.floor(F.log2(F.col("batch").cast("double") + 1)).alias("era"))
    smallest = lambda df, key: df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("h", "seq"))).filter(F.col("_r") <= size).drop("_r")
    best = checkpointed(smallest(ranked, "era"))  # at most size rows an era
    eras = best.select(F.col("era").alias("now")).distinct()
    before = checkpointed(smallest(eras.join(best, F.col("era") < F.col("now")).withColumnRenamed("era", "was"), "now"))  # a logarithm of the batches, squared, times size
    bar = before.groupBy("now").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("h", "seq")).alias("last")).filter(F.col("k") >= size).select(F.col("now").alias("era"), "last")
    able = ranked.join(F.broadcast(bar), "era", "left").filter(F.col("last").isNull() | (F.struct("h", "seq") < F.col("last"))).drop("last")
    able = checkpointed(smallest(able, "batch"))
    ends = ticks.groupBy("batch").agg((F.max("seq") + 1).alias("n")).withColumn("era", F.floor(F.log2(F.col("batch").cast("double") + 1)))
    starts = ends.groupBy("era").agg(F.min("batch").alias("at"))
    changes = checkpointed(able.select("era", F.col("batch").alias("at")).union(starts.select("era", "at")).distinct())
    inside = changes.join(able.select("era", "batch", "h", "seq", "user_id"), "era").filter("batch <= at").select("at", "h", "seq", "user_id")
    carried = changes.join(before.withColumnRenamed("now", "era"), "era").select("at", "h", "seq", "user_id")
    held = inside.unionByName(carried).withColumn("slot", F.row_number().over(Window.partitionBy("at").orderBy("h", "seq")) - 1).filter(F.col("slot") < size)
    shown = held.groupBy("at").agg(*[F.max(F.when(F.col("slot") == s, F.col("user_id"))).alias(f"id_{s}") for s in slots])
    steps = changes.groupBy("era").agg(F.collect_list("at").alias("steps"))
    placed = ends.join(F.broadcast(steps), "era").withColumn("at", F.array_max(F.filter("steps", lambda x: x <= F.col("batch"))))
    return placed.join(F.broadcast(shown), "at").select("batch", "n", *[f"id_{s}" for s in slots])  # a row a change, which a logarithm of the batches bounds
