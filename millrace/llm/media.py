"""Media columns: payloads kept as lossless WebP, decoded to pixel arrays and described by features.

A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, are the
8-bit samples of one or more images (see webp).  The media table is written to
the shared folder and read back; every figure comes from decoded pixels.
``write_pixels`` writes the pixel arrays themselves; the query does not, as it
would store each text a second time.

Null texts count as empty and give 64 zero samples; equal texts give equal
values; repeated rows are kept.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, webp


def payload(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(raw + bytes(64 - len(raw) if len(raw) < 64 else -len(raw) % 64), np.uint8)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [webp.encode_samples(payload(t)) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """media's columns with width, height and pixels (8-bit samples, row by row)."""
    names = media.columns

    def run(batches):
        for batch in batches:
            pixels = [webp.decode_samples(m) for m in batch.column("media").to_pylist()]
            more = [pa.array([webp.WIDTH] * len(pixels), pa.int32()), pa.array([len(p) // webp.WIDTH for p in pixels], pa.int32()), pa.array([p.tobytes() for p in pixels], pa.binary())]
            yield pa.record_batch([*batch.columns, *more], [*names, "width", "height", "pixels"])

    return common.map_arrow(media, run, ", ".join(f"`{n}` {t}" for n, t in media.dtypes) + ", width int, height int, pixels binary")


def write_pixels(media: DataFrame, path: str) -> DataFrame:
    """The decoded pixel arrays as a Parquet table at ``path``, read back."""
    pixels = decode(media)
    pixels.write.parquet(path)
    return media.sparkSession.read.schema(pixels.schema).parquet(path)


def feature(pixels: np.ndarray, width: int) -> str:
    """Size, sum, sum of squares, steps to the right neighbour, and a histogram of 8 bins."""
    x = pixels.astype(np.int64)
    steps = int(np.abs(np.diff(x.reshape(-1, width), axis=1)).sum())
    return f"{width}x{len(x) // width};sum={int(x.sum())};sq={int((x * x).sum())};dx={steps};hist=" + ",".join(map(str, np.bincount(x >> 5, minlength=8)))


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of the decoded pixels; pixels themselves do not leave the task."""

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column("media").to_pylist():
                p = webp.decode_samples(m)
                raw = p.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, webp.WIDTH)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = dict(media.dtypes)["doc_id"]
    return common.map_arrow(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark, sf_dir: str) -> DataFrame:
    stored = common.materialise(encode(common.table(spark, sf_dir, "documents")), "media")
    return describe(stored)
