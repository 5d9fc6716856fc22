"""Quality classifier: random-indexing word vectors, pooled, then a two-layer numpy network.

1. One pass over all documents builds the word vectors.  Each word and each
   word shape has a hashed bucket; a bucket has a fixed sparse ternary index
   vector, and its context vector is the sum of its neighbours' index vectors
   over the whole corpus; a word's takes the first two entries of theirs, a
   shape's all.  A task adds up its own table of fixed size and sends it in
   slabs; slabs are added up ``FAN`` tasks at a time, level by level, so no task
   reads more than ``FAN`` of each, however many there are.
2. A document is the mean of its words' unit vectors.  A bounded sample of
   labelled rows (``SAMPLE`` rows, by hash of doc_id) trains the network; a
   fifth of it fits the temperature.
3. All documents are scored where they lie, without a shuffle.

Null and empty texts pool to the zero vector and get its score.  Repeated rows
get equal scores.  Labels: a doc_id with several or null labels counts by the
mean of its non-null ones, rounded.  Without any usable label every score is 0.5.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 64, 4, 2
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 24, 40, 7
SLABS, FAN = 32, 64
#: Characters of a batch that are indexed at once, and entries of a worker's word cache.
CHUNK_WORDS, CACHE = 200_000, 200_000


def _shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        k = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class _Words(dict):
    """word -> word bucket * 2**16 + shape bucket."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        a = zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1024)
        b = BUCKETS - 1024 + zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % 1024
        self[word] = code = a << 16 | b
        return code


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), np.tile(np.array([1.0, -1.0] * (NONZERO // 2), np.float32), (BUCKETS, 1))


def _codes(texts: list[str | None], cache: _Words) -> tuple[np.ndarray, np.ndarray]:
    """All words' codes and where each text begins."""
    words = [t.split() if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    flat = np.fromiter((cache[w] for ws in words for w in ws), np.int64, int(ends[-1]))
    return flat, ends


def _slab(part: int, slab: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int64()), pa.array([slab], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "slab", "vectors"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all buckets, from every document."""

    def add(batches):
        cache, (place, sign) = _Words(), _index_vectors()
        total = np.zeros(BUCKETS * DIM, np.float64)
        for batch in batches:
            codes, ends = _codes(batch.column(0).to_pylist(), cache)
            doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for lo in range(0, len(codes), CHUNK_WORDS):
                c, d = codes[lo : lo + CHUNK_WORDS + WINDOW], doc[lo : lo + CHUNK_WORDS + WINDOW]
                word, shape = c >> 16, c & 0xFFFF
                for step in range(1, WINDOW + 1):
                    same = d[step:] == d[:-step]
                    if lo + CHUNK_WORDS < len(codes):  # pairs that begin beyond the chunk belong to the next one
                        same[CHUNK_WORDS:] = False
                    for focus, other in ((word, shape), (shape, word), (word, word), (shape, shape)):
                        for a, b in ((focus[step:][same], other[:-step][same]), (focus[:-step][same], other[step:][same])):
                            for k in range(NONZERO):
                                if k < 2 or focus is shape:
                                    total += np.bincount(a * DIM + place[b, k], sign[b, k], BUCKETS * DIM)
        if total.any():
            cut = total.astype(np.float32).reshape(SLABS, -1)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()] * SLABS, pa.int64()), pa.array(range(SLABS), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["part", "slab", "vectors"])

    def merge(batches):
        now, total = None, None
        for batch in batches:
            for part, slab, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "slab", "vectors"))):
                x = np.frombuffer(raw, np.float32)
                if (part, slab) == now:
                    total += x
                    continue
                if now:
                    yield _slab(*now, total)
                now, total = (part, slab), x.astype(np.float64)
        if now:
            yield _slab(*now, total)

    source = docs.select("text")
    parts, n = common.map_arrow(source, add, "part long, slab int, vectors binary"), source.rdd.getNumPartitions()
    while True:
        n = -(-n // FAN)
        dealt = parts.withColumn("part", F.floor(F.col("part") / FAN)).repartition(SLABS * n, "part", "slab").sortWithinPartitions("part", "slab")
        parts = common.map_arrow(dealt, merge, "part long, slab int, vectors binary")
        if n <= 1:
            break
    rows = parts.collect()  # SLABS rows of fixed size
    out = np.zeros((SLABS, BUCKETS * DIM // SLABS), np.float32)
    for r in rows:
        out[r.slab] = np.frombuffer(r.vectors, np.float32)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 0, out / np.maximum(norm, 1e-9), 0).astype(np.float32)


def _pooled(texts: list[str | None], vectors: np.ndarray, cache: _Words) -> np.ndarray:
    """Per text the mean of its words' vectors and the mean of its shapes' vectors."""
    codes, ends = _codes(texts, cache)
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if b > a:
            c = codes[a:b]
            for j, ids in enumerate((c >> 16, c & 0xFFFF)):
                n = np.bincount(ids, minlength=1)
                seen = n.nonzero()[0]
                out[i, j * DIM : (j + 1) * DIM] = n[seen].astype(np.float32) @ vectors[seen] / (b - a)
    return out


class Network:
    """tanh layer and a logistic output, trained by Adam; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        val, fit = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.mean) / self.scale
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for lo in range(0, len(fit), 128):
                i = fit[lo : lo + 128]
                h = np.tanh(z[i] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(e, p[2]) * (1 - h * h)
                g = [z[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]
                t += 1
                for k in range(4):
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(val):
            logit = self.logit(x[val])
            loss = lambda s: np.mean(np.logaddexp(0, -np.where(y[val] > 0.5, 1, -1) * logit / s))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """doc_id, text, y of a bounded sample of the rows that may be learnt from."""
    known = labels.select("doc_id", F.col(column).alias("y")).filter(F.col("y").isNotNull() & ~common.held_out())
    known = common.bounded_sample(known.groupBy("doc_id").agg(F.round(F.avg("y")).cast("double").alias("y")), rows, column)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about `rows` rows of two numbers


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        cache = _Words()
        for batch in batches:
            x = _pooled(batch.column("text").to_pylist(), sent.value, cache)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    got = common.map_arrow(labelled_sample(docs, labels, "quality", sample).select(F.col("doc_id").cast("long"), "text", "y"), pool, "doc_id long, y double, x binary").toArrow()
    order = np.lexsort([np.array(got["y"]), np.array(got["doc_id"])]) if len(got) else []
    x = np.array([np.frombuffer(b, np.float32) for b in got["x"].to_pylist()], np.float64)
    y = np.array(got["y"].to_pylist(), np.float64)
    return {"vectors": vectors, "network": Network(x[order], y[order]) if len(set(y)) > 1 else None, "constant": float(y.mean()) if len(y) else 0.5}


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m, cache = pickle.loads(sent.value), _Words()
        for batch in batches:
            x = _pooled(batch.column("text").to_pylist(), m["vectors"], cache).astype(np.float64)
            s = m["network"].score(x) if m["network"] else np.full(len(x), m["constant"])
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(docs.select("doc_id", common.held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def select_good(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns, that score the threshold or more; decided where the rows lie."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m, cache = pickle.loads(sent.value), _Words()
        for batch in batches:
            x = _pooled(batch.column("text").to_pylist(), m["vectors"], cache).astype(np.float64)
            s = m["network"].score(x) if m["network"] else np.full(len(x), m["constant"])
            yield batch.filter(pa.array(s >= threshold))

    return common.map_arrow(docs, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
