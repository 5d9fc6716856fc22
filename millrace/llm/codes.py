"""Token-ID output as directly addressable codes.

A file holds the ids of many documents in ascending doc_id order.  An id is
split into chunks of 8 bits.  Level k stores the k-th chunk of every id that
has one, a bitmap that says which of them go on to level k + 1, and a rank
directory with the number of set bits before each block of 512.  The i-th id is
read by one step a level: its chunk, its bit, and the rank of that bit as its
place on the next level; nothing else is decoded.

Layout, little-endian: magic ``DAC1``; u32 documents, u64 ids, u32 levels;
i64 doc_ids, u8 flags (0: the doc_id is null), u64 starts (one more than
documents); then for each level u64 n, n chunk bytes, the bitmap (a whole number
of 64-byte blocks) and a u32 rank for each block.

Files go to a shared folder under names that depend on the partition only, by a
temporary name and a rename, so a repeated task replaces its own work.  Rows
are ordered by (doc_id, text), nulls first; null texts are empty; repeated rows
are separate documents.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK, FILE_IDS = 512, 4_000_000
_MAGIC = b"DAC1"


def write(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One file of (doc_id, ids) in the given order."""
    ids = np.concatenate([x for _, x in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    starts = np.cumsum([0, *(len(x) for _, x in docs)])
    levels, rest = [], ids
    while len(rest) or not levels:
        more = rest > 255
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        bits[: len(rest)] = more
        ranks = np.r_[0, np.cumsum(bits.reshape(-1, BLOCK).sum(1))[:-1]] if len(bits) else np.zeros(0)
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()))
        rest = rest[more] >> 8
    out = io.BytesIO()
    out.write(_MAGIC + struct.pack("<IQI", len(docs), len(ids), len(levels)))
    out.write(np.array([d or 0 for d, _ in docs], "<i8").tobytes())
    out.write(bytes(d is not None for d, _ in docs))
    out.write(starts.astype("<u8").tobytes())
    for n, *parts in levels:
        out.write(struct.pack("<Q", n) + b"".join(parts))
    return out.getvalue()


class Reader:
    """Random access to the bytes of one file."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != _MAGIC:
            raise ValueError("not a DAC1 file")
        n, self.n_ids, levels = struct.unpack_from("<IQI", raw, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        ids, flags = take("<i8", n), take("u1", n)
        self.doc_ids = [int(d) if f else None for d, f in zip(ids, flags)]
        self.starts = take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            m = int(take("<u8", 1)[0])
            blocks = -(-m // BLOCK)
            self.levels.append((take("u1", m), take("u1", blocks * BLOCK // 8), take("<u4", blocks)))

    def rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before i."""
        _, bits, ranks = self.levels[level]
        if i >> 9 >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[-BLOCK // 8 :]).sum()) if len(ranks) else 0
        whole = bits[(i >> 9) * (BLOCK // 8) : i >> 3]
        part = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
        return int(ranks[i >> 9]) + int(np.bitwise_count(whole).sum()) + part.bit_count()

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self.rank(k, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from a to b; each level is read only where they have chunks."""
        out, where = np.zeros(max(b - a, 0), np.uint32), np.arange(max(b - a, 0))
        for k, (chunks, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(bits[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 :][: b - a].astype(bool)
            a = self.rank(k, a)
            where = where[on]
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def write_files(docs: DataFrame, folder: str, path: str, end: int = 0) -> DataFrame:
    """Encode and write all documents; returns name and n_tokens of each file."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        enc, held, size, done = tokens.encoder(path), [], 0, []
        part = TaskContext.get().partitionId()

        def close():
            nonlocal held, size
            name = f"part-{part:07d}-{len(done):05d}.dac"
            temporary = f"{base}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(write(held))
            store.move(temporary, f"{base}/{name}")
            done.append((name, size))
            held, size = [], 0

        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist(), end)):
                held.append((d, np.frombuffer(raw, "<u4")))
                size += len(held[-1][1])
                if size >= FILE_IDS:
                    close()
        if held:
            close()
        enc.rest()
        yield pa.record_batch([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["name", "n_tokens"])

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(common.width(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.materialise(common.map_arrow(ordered, run, "name string, n_tokens long"), "codes-manifest")


def read_files(docs_files: DataFrame, folder: str) -> DataFrame:
    """name, doc_id, first (ids before it in its file), ids (little-endian u32) of every document in the files."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = Reader(raw.as_py())
                for lo in range(0, len(r.doc_ids), 500):
                    hi = min(lo + 500, len(r.doc_ids))
                    at = r.starts[lo : hi + 1]
                    ids, cut = r.slice(int(at[0]), int(at[-1])).astype("<u4").tobytes(), (4 * (at - at[0])).tolist()
                    yield pa.record_batch([pa.array([name] * (hi - lo), pa.string()), pa.array(r.doc_ids[lo:hi], pa.int64()), pa.array(at[:-1]), pa.array([ids[a:b] for a, b in zip(cut, cut[1:])], pa.binary())], ["name", "doc_id", "first", "ids"])

    found = docs_files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder)
    return common.map_arrow(found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), run, "name string, doc_id long, first long, ids binary")


def op2_codes(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = common.fresh_path(spark, "codes")
    files = write_files(common.table(spark, sf_dir, "documents"), folder, path or tokens.default_path())
    before = files.select("name", F.coalesce(F.sum("n_tokens").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    return read_files(files, folder).join(before, "name").select("doc_id", (F.col("before") + F.col("first")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
