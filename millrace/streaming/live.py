"""Structured Streaming forms of the ticks and sketches.

A stream is a folder or file of events read once to its end (availableNow);
the same plans run on endless sources.  State is keyed by shard, so it is dealt
to tasks, and its size is fixed.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from millrace.functions.scalar import BITS, PRIME, hash_parameters
from millrace.operators.graph import checkpointed
from millrace.sources import shared


def events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)


def _drained(out: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all there is; the rows that it gave, batch by batch, from a table in the shared folder.

    Offsets and state are checkpointed in the shared folder too, and a batch
    that is repeated after a failure replaces its own rows.
    """
    spark = out.sparkSession
    folder, state = shared.fresh_path(spark, "stream"), shared.fresh_path(spark, "stream-state")
    sink = lambda frame, epoch: frame.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
    q = out.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    shared.remove(spark, state)
    epochs = spark.createDataFrame([], out.schema).write
    epochs.mode("append").parquet(f"{folder}/epoch=-1")  # a stream without rows has a table as well
    return spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in out.dtypes)}, epoch long").parquet(folder)


def _shard(user: Column, shards: int) -> Column:
    """0 to shards - 1 by a hash of the user."""
    return (F.conv(F.substring(F.md5(user.cast("string").cast("binary")), 1, 7), 16, 10).cast("bigint") % shards).cast("int")


def tick_counts(spark: SparkSession, path: str, size: int) -> DataFrame:
    """batch, n and the exact number of users of count-based ticks; distinct users are kept once in the state."""
    e = events(spark, path).select(F.expr(f"event_id div {size}").alias("batch"), "user_id")
    per = _drained(e.groupBy("batch", "user_id").agg(F.count(F.lit(1)).alias("k")), "update").groupBy("batch", "user_id").agg(F.max("k").alias("k"))  # a later count includes the earlier ones
    return per.groupBy("batch").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("truth"))


def reservoir(spark: SparkSession, path: str, size: int, shards: int = 8, seed: int = 553) -> DataFrame:
    """event_id, user_id of a uniform sample of ``size`` events, those of smallest hashed number, whatever the number of shards.

    A shard keeps its ``size`` smallest in the state, and of a batch's rows never more.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in frames:
            held = heapq.nsmallest(size, itertools.chain(held, zip(f["priority"].tolist(), f["event_id"].tolist(), f["user_id"].tolist())))
        state.update(tuple(map(list, zip(*held))))
        yield pd.DataFrame(held, columns=["priority", "event_id", "user_id"])

    priority = F.md5(F.concat_ws(":", F.lit(seed), "event_id").cast("binary"))
    e = events(spark, path).select("event_id", F.col("user_id").cast("string").alias("user_id"), priority.alias("priority"), F.pmod("event_id", F.lit(shards)).cast("int").alias("shard"))
    out = e.groupBy("shard").applyInPandasWithState(keep, "priority string, event_id long, user_id string", "priority array<string>, event_id array<long>, user_id array<string>", "update", "NoTimeout")
    # a later batch of a shard repeats what it still holds, so distinct rows suffice
    return _drained(out, "update").select("priority", "event_id", "user_id").distinct().orderBy("priority", "event_id").limit(size).select("event_id", "user_id")


def bloom(spark: SparkSession, path: str, size: int, shards: int = 8, bits: int = BITS, seed: int = 553) -> DataFrame:
    """batch, positives of a Bloom filter in the state, one filter a shard of users, asked before each batch is inserted.

    A shard's rows of one micro-batch are sorted in memory; the source bounds them.
    """
    params = hash_parameters(4, seed)

    def ask(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        filled = bytearray(state.get[0]) if state.exists else bytearray(bits // 8 + 1)
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for batch, group in rows.groupby("batch"):
            places = {}
            for u in group["user_id"].tolist():
                x = int.from_bytes(str(u).encode(), "big") % PRIME
                places[u] = [(x * a + b) % PRIME % bits for a, b in params]
            hit = {u: all(filled[p >> 3] >> (p & 7) & 1 for p in ps) for u, ps in places.items()}
            out.append((int(batch), sum(hit[u] for u in group["user_id"].tolist())))
            for ps in places.values():
                for p in ps:
                    filled[p >> 3] |= 1 << (p & 7)
        state.update((bytes(filled),))
        yield pd.DataFrame(out, columns=["batch", "positives"])

    e = events(spark, path).select("event_id", "user_id", F.expr(f"event_id div {size}").alias("batch"), _shard(F.col("user_id"), shards).alias("shard"))
    out = e.groupBy("shard").applyInPandasWithState(ask, "batch long, positives long", "filled binary", "append", "NoTimeout")
    return _drained(out, "append").groupBy("batch").agg(F.sum("positives").alias("positives"))


def asks(spark: SparkSession, path: str, size: int, n: int, seed: int = 553) -> DataFrame:
    """batch, seq, user_id: n batches of ``size`` lines of a file (one user a line), drawn uniformly with replacement.

    A draw depends on the seed and its place only.  Lines and draws meet by the
    line's number in a join, so the file is read once by whatever Spark reads it with.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.rtrim(F.col("value"), F.lit("\r\n")).alias("user_id"))
    lines = checkpointed(lines)
    part = F.shiftright("at", 33)
    sizes = lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    numbered = lines.join(F.broadcast(before), part == F.col("part")).select((F.col("before") + F.col("at") - F.shiftleft(part, 33)).alias("line"), "user_id")
    total = lines.count()
    draws = spark.range(size * n if total else 0).select(F.col("id").alias("seq"), F.expr(f"id div {size}").alias("batch"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "seq").cast("binary")), 1, 15), 16, 10).cast("bigint")
    draws = draws.withColumn("line", drawn % max(total, 1))
    return draws.join(numbered, "line").select("batch", "seq", "user_id")


class TickSource(DataSource):
    """Batches of lines drawn with replacement: options path (one user a line; a URI that all machines reach), size, asks and seed.

    A draw depends on seed and position only.  Each ask reads the whole file,
    as a live source would; ``asks`` reads it once.
    """

    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return "batch long, seq long, user_id string"

    def _rows(self, first: int, last: int) -> Iterator[tuple]:
        import random

        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path if "://" in (path := self.options["path"]) else f"file://{path}")
        with store.open_input_stream(name) as f:
            lines = f.read().decode().splitlines()
        size, seed = int(self.options.get("size", 100)), self.options.get("seed", "553")
        for batch in range(first, last):
            rng = random.Random(f"{seed}:{batch}")
            for k in range(size if lines else 0):
                yield batch, batch * size + k, lines[rng.randrange(len(lines))]

    def reader(self, schema) -> DataSourceReader:
        source = self

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(i) for i in range(int(source.options.get("asks", 1)))]

            def read(self, partition):
                return source._rows(partition.value, partition.value + 1)

        return Reader()

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        source, asks = self, int(self.options.get("asks", 1))

        class Stream(SimpleDataSourceStreamReader):
            def initialOffset(self):
                return {"batch": 0}

            def read(self, start):
                stop = min(start["batch"] + 1, asks)
                return source._rows(start["batch"], stop), {"batch": stop}

            def readBetweenOffsets(self, start, end):
                return source._rows(start["batch"], end["batch"])

        return Stream()
