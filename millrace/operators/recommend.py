"""Item-based collaborative filtering, features, boosted trees and their blend."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import noise_ordinal, wifi_ordinal
from millrace.sources.shared import Scratch

#: 64-bit words of a filter of items, and the bits that an item has in it (9 bits of its hash each).
WORDS, PROBES = 8, 3
#: Classes of items that are compared one after another, so one class's filters are on disk at a time.
ROUNDS = 4


def means(ratings: DataFrame, key: str) -> DataFrame:
    """key and avg over all its ratings."""
    return ratings.groupBy(key).agg(F.avg("stars").alias("avg"))


def one_rating(ratings: DataFrame) -> DataFrame:
    """One rating for each (user, item): the mean of repeats."""
    return ratings.groupBy("user", "item").agg(F.avg("stars").alias("stars"))


def item_similarity(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """item, neighbor, sim of the wanted pairs.

    Deviations are from each item's mean over all its ratings.  Without common
    users the ratio of means stands in; without deviation the similarity is 1;
    values above 1 are folded to their reciprocal.
    """
    avg = means(ratings, "item")
    wanted = pairs.select("item", "neighbor").distinct()
    filters = wanted.select("item", F.hash("neighbor").alias("mark")).groupBy("item").agg(_filter("mark").alias("w"))
    common = _together(one_rating(ratings).join(avg, "item"), filters)
    both = wanted.join(avg.select("item", F.col("avg").alias("ba")), "item").join(avg.select(F.col("item").alias("neighbor"), F.col("avg").alias("bn")), "neighbor")
    return both.join(common.withColumn("met", F.lit(True)), ["item", "neighbor"], "left").select("item", "neighbor", F.when(F.col("met"), F.col("sim")).otherwise(_folded(F.col("ba") / F.col("bn"))).alias("sim"))


def neighbors(train: DataFrame, test: DataFrame) -> DataFrame:
    """user, item, neighbor, stars: what the user of a test pair has rated besides the item."""
    r = one_rating(train).select("user", F.col("item").alias("neighbor"), "stars")
    return test.select("user", "item").distinct().join(r, "user").filter("neighbor <> item")


def _filter(mark: str) -> F.Column:
    """Aggregate: a Bloom filter of the items whose hashes are in the column."""
    bit = lambda w: " | ".join(f"if((shiftright({mark}, {9 * p + 6}) & {WORDS - 1}) = {w}, shiftleft(1L, shiftright({mark}, {9 * p}) & 63), 0L)" for p in range(PROBES))
    return F.expr(f"array({', '.join(f'bit_or({bit(w)})' for w in range(WORDS))})")


def _either(words: str) -> F.Column:
    """Aggregate: the filter of what any of the filters has."""
    return F.array(*[F.bit_or(F.col(words)[w]) for w in range(WORDS)])


def _may_have(words: str, mark: str) -> F.Column:
    """False only if the filter does not have the item."""
    return F.expr(" AND ".join(f"(shiftright({words}[shiftright({mark}, {9 * p + 6}) & {WORDS - 1}], shiftright({mark}, {9 * p}) & 63) & 1L) = 1L" for p in range(PROBES)))


def _folded(raw: F.Column) -> F.Column:
    return F.when(raw > 1, 1 / raw).otherwise(raw)


def _together(one: DataFrame, filters: DataFrame, raters: DataFrame | None = None) -> DataFrame:
    """item, neighbor, sim of pairs that some user has rated both of: all that the item's filter has, and few others.

    one: user, item, stars, avg (the item's mean).  The filter of an item goes
    to its raters, and a pair is only made there if the filter has the neighbor.
    raters: the rows of one whose items can have a filter, if not all.
    """
    dev = (F.col("stars") - F.col("avg")).alias
    x = (one if raters is None else raters).select("user", "item", dev("dx")).join(filters, "item").select("user", "item", "dx", "w")
    y = one.select("user", F.col("item").alias("neighbor"), dev("dy"), F.hash("item").alias("mark"))
    a, b = x.alias("a"), y.alias("b")
    met = a.join(b, (F.col("a.user") == F.col("b.user")) & (F.col("a.item") != F.col("b.neighbor")) & _may_have("a.w", "b.mark"))
    sums = met.groupBy("item", "neighbor").agg(F.sum(F.col("dx") * F.col("dy")).alias("num"), F.sum(F.col("dx") * F.col("dx")).alias("d1"), F.sum(F.col("dy") * F.col("dy")).alias("d2"))
    product = F.col("d1") * F.col("d2")
    return sums.select("item", "neighbor", _folded(F.when(product < 1e-18, F.lit(1.0)).otherwise(F.col("num") / F.sqrt(F.greatest(product, F.lit(1e-300))))).alias("sim"))


class Rated:
    """Tables of a training set and the pairs to be predicted, each computed once.

    one: user, item, stars (the mean of repeats), avg (the item's mean).
    users, items: means.  pairs: the distinct pairs.  ``one`` lies by users, so
    no round moves all ratings.
    spent: called once the training set has been read for the last time.
    """

    def __init__(self, train: DataFrame, test: DataFrame, spent: Callable[[], None] = lambda: None) -> None:
        self.scratch = Scratch(train.sparkSession, "ratings", True)
        cut = self.scratch.cut
        summed = cut(train.groupBy("user", "item").agg(F.avg("stars").alias("stars"), F.sum("stars").alias("s"), F.count("stars").alias("n")))
        mean = F.try_divide(F.sum("s"), F.sum("n")).cast("double").alias("avg")
        self.users, self.items = cut(summed.groupBy("user").agg(mean)), cut(summed.groupBy("item").agg(mean))
        spent()
        self.one = self.scratch.cut_by(summed.join(self.items, "item").select("user", "item", "stars", "avg"), "user")
        self.scratch.drop(self.users, self.items, self.one)
        self.pairs = cut(test.select("user", "item").distinct())

    def near(self) -> DataFrame:
        """user, item, neighbor, stars, sim: what the user of a pair with known user and item has rated besides the item.

        Similarities are those of ``item_similarity``.  Most pairs have no common
        user and need only means, so they are made where the user's ratings are.
        What has common users is few and comes to the user's pairs as a map.
        """
        cut = self.scratch.cut
        seen = self.one.select("user", F.hash("item").alias("mark")).groupBy("user").agg(_filter("mark").alias("w"))
        known = cut(self.pairs.join(self.items.withColumnRenamed("avg", "ba"), "item").join(seen, "user").select("user", "item", "ba", "w"))
        # both sides hash the item as the training set has it, so only raters of the class are moved to its filters
        part, found = F.pmod(F.xxhash64(F.col("item").cast(self.one.schema["item"].dataType)), F.lit(ROUNDS)), []
        for k in range(ROUNDS):
            mine = known.filter(part == k)
            sims = _together(self.one, mine.groupBy("item").agg(_either("w").alias("w")), self.one.filter(part == k)).withColumn("mark", F.hash("neighbor"))
            a, b = mine.select("user", "item", "w").alias("a"), sims.alias("b")
            wanted = a.join(b, (F.col("a.item") == F.col("b.item")) & _may_have("a.w", "b.mark"))
            found.append(cut(wanted.select("a.user", "a.item", "neighbor", "sim")))
        maps = reduce(DataFrame.unionByName, found).groupBy("user", "item").agg(F.map_from_entries(F.collect_list(F.struct("neighbor", "sim"))).alias("sims"))
        base = known.select("user", "item", "ba").join(maps, ["user", "item"], "left")
        rated = self.one.select("user", F.col("item").alias("neighbor"), "stars", F.col("avg").alias("bn"))
        sim = F.when(F.map_contains_key("sims", F.col("neighbor")), F.try_element_at("sims", F.col("neighbor"))).otherwise(_folded(F.col("ba") / F.col("bn")))
        return base.join(rated, "user").filter("neighbor <> item").select("user", "item", "neighbor", "stars", sim.alias("sim"))


def pair_similarity(train: DataFrame, test: DataFrame, spent: Callable[[], None] = lambda: None) -> DataFrame:
    """item, neighbor, sim of each test item and what a user who tests it has rated."""
    return Rated(train, test, spent).near().groupBy("item", "neighbor").agg(F.first("sim").alias("sim"))


def top_neighbors(train: DataFrame, test: DataFrame, k: int = 30, spent: Callable[[], None] = lambda: None) -> DataFrame:
    """The k most similar rated neighbors with positive similarity; ties by neighbor."""
    return _top(Rated(train, test, spent), k)


def _top(rated: Rated, k: int) -> DataFrame:
    order = Window.partitionBy("user", "item").orderBy(F.desc(F.round("sim", 9)), "neighbor")
    return rated.near().filter("sim > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cf_predict(train: DataFrame, test: DataFrame, k: int = 30, cold: float = 2.5, spent: Callable[[], None] = lambda: None) -> DataFrame:
    """user, item, prediction, branch for each distinct test pair.

    Unknown item and user: ``cold``; unknown item: the user's mean; unknown user,
    or no similar neighbor: the item's mean; else the weighted mean.
    """
    rated = Rated(train, test, spent)
    best = rated.scratch.cut(_top(rated, k).groupBy("user", "item").agg((F.sum(F.col("sim") * F.col("stars")) / F.sum(F.abs("sim"))).alias("cf")))
    rated.scratch.drop(rated.users, rated.items, rated.pairs, best)
    out = rated.pairs.join(rated.users.withColumnRenamed("avg", "ua"), "user", "left").join(rated.items.withColumnRenamed("avg", "ia"), "item", "left").join(best, ["user", "item"], "left")
    item_known, user_known = F.col("ia").isNotNull(), F.col("ua").isNotNull()
    branch = F.when(item_known & user_known, "both").when(item_known, "user cold").when(user_known, "item cold").otherwise("cold")
    return out.select("user", "item", F.coalesce(F.when(item_known & user_known, F.coalesce("cf", "ia")).otherwise(F.coalesce("ia", "ua")), F.lit(cold)).alias("prediction"), branch.alias("branch"))


#: Bins of a feature that trees split between, as many as Spark takes by default.
BINS = 32
USER_FEATURES, ITEM_FEATURES = ("u_review_count", "u_useful", "u_average_stars", "u_fans"), ("b_review_count", "b_stars", "b_noise", "b_wifi")


def assemble_features(pairs: DataFrame, users: DataFrame, items: DataFrame, noise_default: int = 2, extended: bool = False) -> DataFrame:
    """pairs with 6 features, or 8 if ``extended``; unknown users and items get the tables' means, and useful 0.

    A mean of an empty table, or of a column with nulls only, counts as 0.

    users: user, review_count, useful, average_stars, fans.  items: item, review_count, stars, attributes (a map).
    """
    u = users.select("user", F.col("review_count").cast("double").alias("u_review_count"), F.col("useful").cast("double").alias("u_useful"), F.col("average_stars").alias("u_average_stars"), F.col("fans").cast("double").alias("u_fans"))
    noise, wifi = noise_ordinal(F.col("attributes")["NoiseLevel"], noise_default), wifi_ordinal(F.col("attributes")["WiFi"])
    i = items.select("item", F.col("review_count").cast("double").alias("b_review_count"), F.col("stars").alias("b_stars"), noise.cast("double").alias("b_noise"), wifi.cast("double").alias("b_wifi"))
    names = list(USER_FEATURES + ITEM_FEATURES) if extended else [n for n in USER_FEATURES + ITEM_FEATURES if n not in ("u_fans", "b_wifi")]
    mean_u = u.agg(*[F.avg(c).alias(f"m_{c}") for c in USER_FEATURES]).first()
    mean_i = i.agg(*[F.avg(c).alias(f"m_{c}") for c in ITEM_FEATURES]).first()
    default = {c: 0.0 if c == "u_useful" else (mean_u if c in USER_FEATURES else mean_i)[f"m_{c}"] or 0.0 for c in names}
    out = pairs.join(u, "user", "left").join(i, "item", "left")
    return out.select(*pairs.columns, *[F.coalesce(c, F.lit(default[c]).cast("double")).alias(c) for c in names])


def gbt_fit_predict(train: DataFrame, test: DataFrame, seed: int = 20, depth: int = 5, rounds: int = 20) -> DataFrame:
    """user, item, prediction of boosted regression trees over all feature columns both frames have.

    The trees see a feature only by its bin, and a mean and a weight tell them of
    rows with equal bins all that the rows would; so equal rows are one before
    the trees keep them in memory and on disk, once for each round.
    """
    names = [c for c in train.columns if c in USER_FEATURES + ITEM_FEATURES]
    scratch = Scratch(train.sparkSession, "features", True)
    rows = scratch.cut(train.select(*names, "stars"))
    bins = _bins(rows, names)
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")
    # null if a label is, so that the trees refuse it as they would refuse the row
    mean = F.when(F.count(F.lit(1)) == F.count("stars"), F.avg("stars"))
    grouped = scratch.cut(rows.select(*bins, "stars").groupBy(*names).agg(mean.alias("stars"), F.count(F.lit(1)).cast("double").alias("weight")))
    scratch.drop(grouped)
    model = GBTRegressor(featuresCol="features", labelCol="stars", weightCol="weight", maxBins=BINS, seed=seed, maxDepth=depth, maxIter=rounds).fit(assembler.transform(grouped))
    scratch.drop()
    return model.transform(assembler.transform(test.select("user", "item", *bins))).select("user", "item", "prediction")


def _bins(rows: DataFrame, names: list[str]) -> list[F.Column]:
    """Of each feature the number of its bin, at most BINS: one for each value where they are few, else quantiles.  NaN and null stay."""
    grid = F.array(*[F.lit(k / (32 * BINS)) for k in range(32 * BINS + 1)])
    found = rows.agg(*[F.percentile_approx(c, grid, F.lit(10000)).alias(c) for c in names]).first()  # one row of fixed size
    out = []
    for c in names:
        grid_of = [v for v in found[c] or [] if v == v]
        values = sorted(set(grid_of))
        cuts = [(x + y) / 2 for x, y in zip(values, values[1:])] if len(values) <= BINS else sorted(set(grid_of[32 : 32 * BINS : 32]))
        out.append(F.when(F.col(c).isNull() | F.isnan(c), F.col(c)).otherwise(sum((F.when(F.col(c) > v, 1.0).otherwise(0.0) for v in cuts), F.lit(0.0))).alias(c))
    return out


def hybrid(cf: DataFrame, model: DataFrame, alpha: float = 0.1) -> DataFrame:
    """alpha of the first and the rest of the second; a pair that occurs several times in either counts by its mean."""
    a = cf.groupBy("user", "item").agg(F.avg("prediction").alias("a"))
    b = model.groupBy("user", "item").agg(F.avg("prediction").alias("b"))
    return a.join(b, ["user", "item"]).select("user", "item", (alpha * F.col("a") + (1 - alpha) * F.col("b")).alias("prediction"))


def model_errors(predictions: dict[str, DataFrame], train: DataFrame, truth: DataFrame) -> DataFrame:
    """model, n, rmse, constant: each model's error on the pairs of truth that it predicts, beside that of the training mean."""
    mean = train.agg(F.avg("stars").alias("m"))  # one row
    out = []
    for name, frame in predictions.items():
        both = frame.groupBy("user", "item").agg(F.avg("prediction").alias("prediction")).join(truth.groupBy("user", "item").agg(F.avg("stars").alias("stars")), ["user", "item"]).crossJoin(F.broadcast(mean))
        error = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("stars"), 2)))
        out.append(both.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), error("prediction").alias("rmse"), error("m").alias("constant")))
    return reduce(DataFrame.unionByName, out)


def rmse(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    both = predicted.join(truth, ["user", "item"])
    return both.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def error_histogram(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """bucket 0 to 4 of the absolute error, and n."""
    error = F.abs(F.col("prediction") - F.col("stars"))
    return predicted.join(truth, ["user", "item"]).groupBy(F.least(F.floor(error), F.lit(4)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
