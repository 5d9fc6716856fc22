"""Bounded-space online packing of token ids into sequences of at most 2048.

Each partition of the input keeps at most ``OPEN`` windows.  A document's full
lengths of 2048 leave at once as sequences of their own.  What remains goes
whole to the open window in which it leaves the least room (best fit), or to a
new window while there are fewer than ``OPEN``.  When none fits, the fullest
window is topped up with the remainder's head and emitted, so every emitted
sequence is full.  Windows left at the end of a partition are merged by the
same rule, ``FAN`` partitions at a time, until one group is left; its last
windows are joined, so all sequences but the last are exactly full.

The sequences are a table in the shared folder, written once; a repeated task
writes the same rows, because a partition's rows keep their order.  Null texts
are empty and give their end id alone; repeated rows are separate documents; an
empty table gives no sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SIZE, OPEN, FAN = 2048, 16, 64
SCHEMA = "sequence_id long, open boolean, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>, ids binary"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("open", pa.bool_()), *((n, pa.list_(pa.int64())) for n in ("doc_ids", "starts", "lengths", "doc_tokens")), ("ids", pa.binary())])


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids as bytes of 4 each)."""

    def __init__(self, size: int = SIZE, most: int = OPEN) -> None:
        self.size, self.most = size, most
        self.windows: list[tuple[int, list]] = []  # (ids held, pieces)
        self.full: list[list] = []

    def add(self, doc_id: int | None, start: int, total: int, ids: bytes) -> None:
        whole = len(ids) // (4 * self.size)
        if whole:  # each id is copied once, however long the document is
            view = memoryview(ids)
            self.full += [[(doc_id, start + k * self.size, total, bytes(view[4 * k * self.size : 4 * (k + 1) * self.size]))] for k in range(whole)]
            start, ids = start + whole * self.size, bytes(view[4 * whole * self.size :])
        n = len(ids) // 4
        if not n:
            return
        best = max((k for k, (held, _) in enumerate(self.windows) if held + n <= self.size), key=lambda k: self.windows[k][0], default=None)
        if best is None and len(self.windows) == self.most:
            k = max(range(len(self.windows)), key=lambda k: self.windows[k][0])
            held, pieces = self.windows.pop(k)
            room = self.size - held
            self.full.append([*pieces, (doc_id, start, total, ids[: 4 * room])])
            return self.add(doc_id, start + room, total, ids[4 * room :])
        held, pieces = self.windows.pop(best) if best is not None else (0, [])
        pieces.append((doc_id, start, total, ids))
        if held + n == self.size:
            self.full.append(pieces)
        else:
            self.windows.append((held + n, pieces))

    def join(self) -> None:
        """Fill the fullest windows from the emptiest, until at most one is not full."""
        self.windows.sort(key=lambda w: -w[0])
        windows, self.windows, most, self.most = self.windows, [], self.most, 1
        for _, pieces in windows:
            for d, s, t, ids in pieces:
                self.add(d, s, t, ids)
        self.most = most

    def take(self) -> list[list]:
        out, self.full = self.full, []
        return out


def _rows(sequences: list[tuple[int, bool, list]]) -> pa.RecordBatch:
    cols = list(zip(*[(i, o, [p[0] for p in ps], [p[1] for p in ps], [len(p[3]) // 4 for p in ps], [p[2] for p in ps], b"".join(p[3] for p in ps)) for i, o, ps in sequences])) or [[]] * 7
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, path: str, end: int = 1, size: int = SIZE, most: int = OPEN, fan: int = FAN) -> DataFrame:
    """Sequences, one a row: the pieces' arrays and all ids as little-endian u32."""

    def first(batches):
        enc, packer, k = tokens.encoder(path), Packer(size, most), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist(), end)):
                packer.add(d, 0, len(raw) // 4, raw)
                if len(packer.full) >= 200:
                    full = packer.take()
                    yield _rows([((part << 36) + k + i, False, ps) for i, ps in enumerate(full)])
                    k += len(full)
        enc.rest()
        full = packer.take()
        yield _rows([((part << 36) + k + i, False, ps) for i, ps in enumerate(full)] + [((part << 36) + k + len(full) + i, True, ps) for i, (_, ps) in enumerate(packer.windows)])

    def merge(group_of, last: bool):
        def run(batches):
            group, packer, mine = None, None, []

            def close():
                if last:
                    packer.join()
                done = [(False, ps) for ps in packer.take()] + [(not last, ps) for _, ps in packer.windows]
                # merged sequences take the ids of the windows they came from, of which there are no fewer
                return _rows([(i, o, ps) for i, (o, ps) in zip(mine, done, strict=False)])

            for batch in batches:
                for r in batch.to_pylist():
                    if group_of(r["sequence_id"]) != group:
                        if packer:
                            yield close()
                        group, packer, mine = group_of(r["sequence_id"]), Packer(size, most), []
                    mine.append(r["sequence_id"])
                    at = 0
                    for d, s, n, t in zip(r["doc_ids"], r["starts"], r["lengths"], r["doc_tokens"]):
                        packer.add(d, s, t, r["ids"][4 * at : 4 * (at + n)])
                        at += n
            if packer:
                yield close()

        return run

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = source.rdd.getNumPartitions()
    table = common.materialise(common.map_arrow(source, first, SCHEMA), "packed")
    out = table.filter(~F.col("open"))
    span = 1
    while True:
        span *= fan
        last = span >= parts
        left = table.filter("open").withColumn("group", F.floor(F.shiftright("sequence_id", 36) / F.lit(span)))
        left = left.repartition(max(1, -(-parts // span)), "group").sortWithinPartitions("group", "sequence_id").drop("group")
        table = common.materialise(common.map_arrow(left, merge(lambda i, s=span: (i >> 36) // s, last), SCHEMA), "packed")
        out = out.unionByName(table.filter(~F.col("open")))
        if last:
            return out.drop("open")


def pieces(sequences: DataFrame) -> DataFrame:
    """One row for each piece, with its ids."""
    at = F.expr("transform(sequence(1, size(lengths)), i -> aggregate(slice(lengths, 1, i - 1), 0L, (a, x) -> a + x))")
    one = sequences.withColumn("offsets", at).select("sequence_id", "ids", F.explode(F.arrays_zip("doc_ids", "starts", "lengths", "doc_tokens", "offsets")).alias("p"))
    return one.select(
        F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.expr("substring(ids, cast(4 * p.offsets + 1 as int), cast(4 * p.lengths as int))").alias("ids"),
        F.col("p.doc_tokens").alias("doc_tokens"), "sequence_id", F.col("p.offsets").alias("offset"),
    )


def digest(sequences: DataFrame) -> DataFrame:
    return pieces(sequences).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digest(pack(common.table(spark, sf_dir, "documents"), path or tokens.default_path()))
