"""Transactions, baskets and frequent itemsets."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import short_year, unquoted, without_zeros

from .graph import checkpointed


def prepare_transactions(raw: DataFrame, normalize_dates: bool = False) -> DataFrame:
    """basket_id (short date - customer without leading zeros) and item of raw (date, customer, product) rows."""
    date = unquoted(F.col("date"))
    if normalize_dates:
        date = F.date_format(F.to_date(date, "M/d/yyyy"), "M/d/yyyy")
    return raw.select(F.concat(short_year(date), F.lit("-"), without_zeros(unquoted(F.col("customer")))).alias("basket_id"), without_zeros(unquoted(F.col("product"))).alias("item"))


def baskets(pairs: DataFrame, case: int = 1, min_rows: int | None = None) -> DataFrame:
    """Distinct (basket_id, item) of two columns; case 2 swaps them.  With min_rows, baskets need more rows than that, repeats included."""
    if case not in (1, 2):
        raise ValueError("case must be 1 or 2")
    a, b = pairs.columns if case == 1 else pairs.columns[::-1]
    out = pairs.select(F.col(a).alias("basket_id"), F.col(b).alias("item"))
    if min_rows is not None:
        large = out.groupBy("basket_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows).select("basket_id")
        out = out.join(large, "basket_id", "left_semi")
    return out.distinct()


def _levels(members: DataFrame, keep: Column, max_size: int | None, scope: list[str]) -> DataFrame:
    """Level-wise search in each scope.  members: scope, basket_id, item, need.

    A level joins what baskets hold of the last level's frequent sets with
    their larger items, so only supersets of frequent sets are counted, and
    partial counts are shuffled rather than baskets.
    """
    held = members.select(*scope, "basket_id", F.array("item").alias("items"), "need")
    out, size, items, used = None, 1, members.select(*scope, "basket_id", "item"), []
    while max_size is None or size <= max_size:
        found = checkpointed(held.groupBy(*scope, "items").agg(F.count(F.lit(1)).alias("support"), F.first("need").alias("need")).filter(keep).select(*scope, "items", F.lit(size).alias("size"), "support"))
        for frame in used:  # read for the last time
            frame.unpersist()
        if found.isEmpty():
            break
        out = found if out is None else out.unionByName(found)
        kept = held.join(found.select(*scope, "items"), [*scope, "items"], "left_semi")
        if size == 1:
            single = found.select(*scope, F.col("items")[0].alias("item"))
            items = items.join(single, [*scope, "item"], "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
        used = [held] if size > 1 else []
        held = kept.join(items, [*scope, "basket_id"]).filter(F.col("item") > F.element_at("items", -1)).select(*scope, "basket_id", F.concat("items", F.array("item")).alias("items"), "need")
        held = held.persist(StorageLevel.MEMORY_AND_DISK)
        size += 1
    for frame in (*used, held, items):
        frame.unpersist()
    if out is None:
        out = held.groupBy(*scope, "items").agg(F.count(F.lit(1)).alias("support")).select(*scope, "items", F.lit(0).alias("size"), "support").limit(0)
    return out


def frequent_itemsets(baskets: DataFrame, support: Column | int, max_size: int | None = None) -> DataFrame:
    """items (sorted), size and support of all sets in at least ``support`` baskets."""
    need = support if isinstance(support, Column) else F.lit(support)
    return _levels(baskets.select("basket_id", "item", need.alias("need")), F.col("support") >= F.col("need"), max_size, [])


def share_of_baskets(baskets: DataFrame, share: float) -> DataFrame:
    """baskets with a column need: that share of their number, rounded up."""
    n = baskets.select("basket_id").distinct().count()
    return baskets.withColumn("need", F.ceil(F.lit(n * share)))


def son_candidates(baskets: DataFrame, support: int, num_chunks: int, max_size: int | None = None) -> DataFrame:
    """Distinct sets that are frequent in some chunk of baskets at a threshold scaled to the chunk; chunks are dealt by basket id."""
    chunk = F.pmod(F.col("basket_id"), F.lit(num_chunks)) if dict(baskets.dtypes)["basket_id"] != "string" else F.pmod(F.crc32(F.col("basket_id").cast("binary")), F.lit(num_chunks))
    dealt = baskets.withColumn("chunk", chunk)
    sizes = dealt.select("chunk", "basket_id").distinct().groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))  # num_chunks rows
    total = sizes.agg(F.sum("n")).first()[0] or 1
    need = sizes.select("chunk", F.ceil(F.col("n") * support / F.lit(total)).alias("need"))
    local = _levels(dealt.join(F.broadcast(need), "chunk").select("chunk", "basket_id", "item", "need"), F.col("support") >= F.col("need"), max_size, ["chunk"])
    return local.select("items", "size").distinct()
