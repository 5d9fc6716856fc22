"""Language ID: nearest of several clustered centroids a language, by cosine of TF-IDF n-gram vectors.

Letters in lower case, with anything else as a border, give hashed character
n-grams of 1 to GRAMS; a text's vector holds log(1 + tf) * idf, divided by its length.  The idf is counted over every document that
may be learnt from.  For each language a bounded sample (``SAMPLE`` rows, by
hash of doc_id) is clustered by spherical k-means into ``CENTROIDS`` centroids;
however many languages there are, each is learnt, one at a time in a task.

A text goes to the language of its nearest centroid.  The score is the share
of that language in a softmax over the languages' best cosines.  A text whose
cosine is under the centroid's rejection distance, learnt from the sample, is
rejected: the score is halved, and with ``reject`` the answer is ``und``.

Null texts and texts without a letter are ``und`` with score 0; so is all when
nothing can be learnt.  Null langs are not learnt from.  Repeated rows get
equal rows; ties go to the first language in order.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS, GRAMS, CENTROIDS, SAMPLE, SHARPNESS = 12, 3, 4, 800, 12.0
DIM = 1 << BITS
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    """code point -> its lower-case letter's code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in map(chr, range(0x30000)):  # beyond are no assigned letters with case or use in text
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    out[0x30000:0x32400] = np.arange(0x30000, 0x32400)  # ideographs
    return out


def _counts(text: str | None) -> np.ndarray | None:
    """n-gram counts of a text, None without a letter."""
    if not text:
        return None
    c = np.zeros(len(text) + 2, np.uint32)  # a border on each side
    c[1:-1] = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if not c.any():
        return None
    h, out = c * _MIX[0], np.zeros(DIM, np.int64)
    some = c > 0
    for n in range(1, GRAMS + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + c[n - 1 :] * _MIX[0]
            some = some[:-1] | (c[n - 1 :] > 0)
        out += np.bincount(((h * _MIX[2]) >> np.uint32(32 - BITS))[some], minlength=DIM)
    return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / max(float(np.linalg.norm(v)), 1e-9)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out())


def document_frequency(docs: DataFrame) -> np.ndarray:
    """In how many documents each bucket occurs, and last their number: one row of fixed size from each task."""

    def run(batches):
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = _counts(text)
                if c is not None:
                    df[:-1] += c > 0
                    df[-1] += 1
        yield pa.record_batch([pa.array([df.tobytes()], pa.binary())], ["df"])

    def merge(batches):
        total = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["df"])

    parts = common.map_arrow(learnable(docs).select("text"), run, "df binary")
    for n in (64, 1):  # add up in two steps, so that no task gets a row from every other one at scale
        parts = common.map_arrow(parts.repartition(n), merge, "df binary")
    return sum((np.frombuffer(r.df, np.int64) for r in parts.collect()), np.zeros(DIM + 1, np.int64))


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, seeded by the farthest row each time."""
    centres = [x[0]]
    near = x @ x[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(15):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    df = document_frequency(docs)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1
    sizes = learnable(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    top = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * (1 << 30)
    few = learnable(docs).join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < F.floor(top))

    def run(batches):
        for batch in batches:
            out = [(d, lang, c) for d, lang, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist()) if (c := _counts(t)) is not None]
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([np.minimum(o[2], 65535).astype(np.uint16).tobytes() for o in out], pa.binary())], ["doc_id", "lang", "counts"])

    def fit(group: pa.Table) -> pa.Table:
        got = sorted(zip(group["doc_id"].to_pylist(), group["counts"].to_pylist()))
        x = np.array([_vector(np.frombuffer(raw, np.uint16), idf) for _, raw in got], np.float32)
        c = _cluster(x, centroids)
        near = x @ c.T
        own = near.argmax(1)
        limit = [float(np.quantile(near[own == j, j], 0.002)) * 0.6 if (own == j).any() else 0.0 for j in range(len(c))]
        return pa.table({"lang": group["lang"][:1], "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary()), "reject": pa.array([limit], pa.list_(pa.float64()))})

    rows = common.map_arrow(few.select(F.col("doc_id").cast("long"), "text", "lang"), run, "doc_id long, lang string, counts binary")
    # a bounded sample of one language in a task; the driver gets its centroids only
    found = rows.groupBy("lang").applyInArrow(fit, "lang string, centroids binary, reject array<double>").collect()
    model = {"idf": idf, "langs": [], "owner": [], "centroids": np.zeros((0, DIM), np.float32), "reject": []}
    parts = []
    for r in sorted(found, key=lambda r: r.lang):
        parts.append(np.frombuffer(r.centroids, np.float32).reshape(-1, DIM))
        model["owner"] += [len(model["langs"])] * len(parts[-1])
        model["reject"] += r.reject
        model["langs"].append(r.lang)
    if parts:
        model["centroids"] = np.vstack(parts)
    return model


def predict(docs: DataFrame, model: dict, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(sent.value)
        owner, limit = np.array(m["owner"], np.int64), np.array(m["reject"])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
        for batch in batches:
            pred, score, away = [], [], []
            for text in batch.column("text").to_pylist():
                c = _counts(text) if m["langs"] else None
                if c is None:
                    pred.append("und"), score.append(0.0), away.append(True)
                    continue
                near = m["centroids"] @ _vector(c, m["idf"])
                best = np.maximum.reduceat(near, starts)
                k = int(best.argmax())
                j = int(starts[k] + near[owner == k].argmax())
                p = float(1 / np.exp(SHARPNESS * (best - best[k])).sum())
                far = bool(near[j] < limit[j])
                pred.append("und" if far and reject else m["langs"][k]), score.append(p / 2 if far else p), away.append(far)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(away, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(docs.select("doc_id", common.held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
