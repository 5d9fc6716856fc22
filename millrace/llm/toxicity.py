"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams and itself; an unbroken run of
more than ``LONG`` characters counts as overlapping pieces of ``PIECE``, each a
word, so all of it is read.  A window of
``WINDOW`` words is the mean of its words' mean subword vectors; a softmax over two classes
reads that mean.  Embeddings and softmax are trained together by Adam on
windows of a bounded sample of labelled documents (``SAMPLE`` of each class, by
hash of doc_id).  A round takes at most ``TRAIN_WINDOWS`` windows of either
class at random, and all of the worst ones; scoring reads every window.  First each window takes its document's label; later rounds
keep, of a toxic document, only the windows that the model so far finds worst,
and, of a clean one, the same as hard negatives.  A document is as toxic as its
worst window; a logistic curve turns that into a probability, so one insult in
a very long text counts.

Because the softmax is linear, a word needs only one number when scoring: the
mean of its subwords' logits, kept per worker; a window's is the mean of its words'.

Null and empty texts score as a text without any evidence.  Repeated rows get
equal scores.  Several labels for a doc_id count by their rounded mean; with
no label or one class only, the score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM, GRAMS, WINDOW, LONG, PIECE = 1 << 16, 6, (3, 4, 5), 6, 40, 8
#: CALIBRATE: the share of the sample that only fits the probability.
SAMPLE, TRAIN_WINDOWS, RARE, DECAY, CALIBRATE, SEED, CACHE = 2000, 20_000, 3, 1e-7, 0.3, 11, 400_000
#: (Adam steps, windows of a toxic document that count)
ROUNDS = ((40, None), (30, 3), (40, 2))
_LIKE = {"i": "1", "o": "0", "e": "3", "a": "@", "s": "5", "l": "1", "t": "7"}
_STRIP = ".,;:!?\"'()[]{}|*#$%&…«»“”„-"


def pieces(text: str) -> list[str]:
    """What stands between white space; a run of more than LONG characters as overlapping pieces of PIECE, up to its end."""
    runs = text.split()
    if max(map(len, runs), default=0) <= LONG:
        return runs
    out = []
    for w in runs:
        out += [w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


def subwords(word: str) -> list[int]:
    w = f"<{word.strip(_STRIP).lower()}>"
    if w == "<>":
        return []
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS] + [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1)]


def misspell(word: str, rng: np.random.Generator) -> str:
    """The word with one character dropped, doubled, swapped or replaced; short words as they are."""
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    c = word[i]
    return word[:i] + ("", c + c, word[i + 1] + c, _LIKE.get(c.lower(), "*"))[kind] + word[i + (2 if kind == 2 else 1) :]


class Model:
    """Trained from texts and 0/1 labels; ``weight`` gives each class its share in the corpus back."""

    def __init__(self, texts: list[str], y: np.ndarray, weight: tuple[float, float] = (1.0, 1.0)) -> None:
        rng = np.random.default_rng(SEED)
        held = rng.random(len(texts)) < CALIBRATE
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.zeros(len(texts), bool)
        all_texts, all_y = texts, y
        texts, y = [t for t, h in zip(texts, held) if not h], y[~held]
        vocab: dict[str, int] = {}
        docs = [np.array([vocab.setdefault(w, len(vocab)) for w in pieces(t)], np.int32) for t in texts]
        bags = [np.array(subwords(w), np.int32) for w in vocab] + [np.zeros(0, np.int32)]  # the last is the padding
        pad = len(vocab)
        spread = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=pad + 1)
        rare = spread < RARE
        # of toxic texts a word of fewer than RARE training documents is not read, in training only: it says nothing about others
        # a piece of a run hardly recurs, but its n-grams do: it keeps those of RARE documents or more
        cut = [i for i in {vocab[p] for t in texts for w in t.split() if len(w) > LONG for p in pieces(w)} if rare[i]]
        if cut:
            met = np.zeros(BUCKETS, np.int64)
            for d in docs:
                met[np.unique(np.concatenate([bags[-1], *(bags[i] for i in np.unique(d))]))] += 1
            for i in cut:
                bags[i] = bags[i][met[bags[i]] >= RARE]
                rare[i] = not len(bags[i])
        rows, owners = [], []
        for k, d in enumerate(docs):
            if y[k] == 1:
                d = np.where(rare[d], pad, d)
            d = np.concatenate([d, np.full(max(WINDOW - len(d), 0), pad)])
            view = np.lib.stride_tricks.sliding_window_view(d, WINDOW)[:: WINDOW // 2]
            rows.append(np.vstack([view, d[-WINDOW:]]))
            owners.append(np.full(len(view) + 1, k))
        windows, doc = np.vstack(rows), np.concatenate(owners)
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM))
        self.out, self.bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
        params = [self.emb, self.out, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        trained = np.zeros(BUCKETS, bool)

        def logits() -> np.ndarray:
            flat = self.emb @ (self.out[:, 1] - self.out[:, 0])
            word = np.array([flat[b].mean() if len(b) else 0.0 for b in bags])
            return word[windows].mean(1)

        label = y[doc]
        for steps, best in ROUNDS:
            rest = rng.permutation(np.flatnonzero(label == 0))[:TRAIN_WINDOWS]
            if best is None:
                pick = [rest, rng.permutation(np.flatnonzero(label == 1))[:TRAIN_WINDOWS]]
            else:
                worth = logits()
                order = np.lexsort([-worth, doc])
                rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                top = order[rank < best]
                usual = np.quantile(worth[order[(rank == 0) & (label[order] == 0)]], 0.98)
                bad = top[(label[top] == 1) & (worth[top] > usual)]  # a label without any such window may be wrong
                pick = [np.union1d(top[label[top] == 0], rest), bad if len(bad) else top[label[top] == 1]]
            use = np.concatenate(pick)
            t = np.repeat([0, 1], [len(pick[0]), len(pick[1])])
            share = np.repeat([0.5 / max(len(x), 1) for x in pick], [len(x) for x in pick])
            words, w = np.unique(windows[use], return_inverse=True)
            own = [bags[i] for i in words]
            if best is not None:  # the same windows again with misspelt words
                names = [*vocab, ""]
                own += [np.array(subwords(misspell(names[i], rng)), np.int32) for i in words]
                w, t, share = np.concatenate([w.ravel(), w.ravel() + len(words)]), np.tile(t, 2), np.tile(share / 2, 2)
            w = w.reshape(-1, WINDOW)
            count = np.array([len(b) for b in own])
            buckets, sub = np.unique(np.concatenate(own), return_inverse=True)
            owner, part = np.repeat(np.arange(len(own)), count), np.repeat(1 / np.maximum(count, 1), count)
            trained[buckets] = True
            for _ in range(steps):
                e = self.emb[buckets]
                word = np.stack([np.bincount(owner, e[sub, j] * part, len(own)) for j in range(DIM)], 1)
                mean = word[w].mean(1)
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(t)), t] -= 1
                p *= share[:, None]
                back, flat = p @ self.out.T / WINDOW, w.ravel()
                g_word = np.stack([np.bincount(flat, np.repeat(back[:, j], WINDOW), len(own)) for j in range(DIM)], 1)
                g_emb = np.stack([np.bincount(sub, g_word[owner, j] * part, len(buckets)) for j in range(DIM)], 1)
                step += 1
                for k, (q, g) in enumerate(zip(params, [g_emb + DECAY * e, mean.T @ p, p.sum(0)])):
                    i = buckets if k == 0 else slice(None)
                    m[k][i] += 0.1 * (g - m[k][i])
                    v[k][i] += 0.01 * (g**2 - v[k][i])
                    q[i] -= 0.05 * (m[k][i] / (1 - 0.9**step)) / (np.sqrt(v[k][i] / (1 - 0.99**step)) + 1e-6)
        self.emb[~trained] = 0  # nothing is known of n-grams without training texts
        self.logit = self.emb @ (self.out[:, 1] - self.out[:, 0])
        self.slope, self.shift = 1.0, 0.0
        if held.any():  # texts that the embeddings have not seen
            texts, y = [t for t, h in zip(all_texts, held) if h], all_y[held]
        x = np.array([self.evidence(t, {}) for t in texts])
        self.middle, self.spread = float(x.mean()), float(x.std() + 1e-9)
        x, a, b = (x - self.middle) / self.spread, 1.0, 0.0
        cw = np.where(y == 1, weight[1], weight[0])
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            e, h = cw * (p - y), cw * p * (1 - p) + 1e-9
            hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
            da, db = np.linalg.solve(hess, [(e * x).sum() + 0.1 * a, e.sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.slope, self.shift = float(a), float(b)

    def evidence(self, text: str | None, cache: dict) -> float:
        """The worst window's logit."""
        found, last = [], None
        for w in pieces(text) if text else ():
            if w == last:  # a word said over and over counts once
                continue
            last = w
            x = cache.get(w)
            if x is None:
                if len(cache) > CACHE:
                    cache.clear()
                b = subwords(w)
                cache[w] = x = float(self.logit[b].mean()) if b else 0.0
            found.append(x)
        base = float(self.bias[1] - self.bias[0])
        if not found:
            return base
        c = np.cumsum([0.0, *found, *[0.0] * (WINDOW - len(found))])
        return float((c[WINDOW:] - c[:-WINDOW]).max()) / WINDOW + base

    def score(self, text: str | None, cache: dict) -> float:
        z = self.slope * (self.evidence(text, cache) - self.middle) / self.spread + self.shift
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    known = labels.select("doc_id", F.col("toxic").alias("y")).filter(F.col("y").isNotNull() & ~common.held_out()).groupBy("doc_id").agg(F.round(F.avg("y")).cast("double").alias("y"))
    size = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return {"model": None, "constant": next(iter(size), 0.0)}
    few = [common.bounded_sample(known.filter(F.col("y") == c), sample, "toxic") for c in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), "doc_id").select(F.col("doc_id").cast("long"), "text", "y").toArrow()
    got = sorted(zip(rows["doc_id"].to_pylist(), [t or "" for t in rows["text"].to_pylist()], rows["y"].to_pylist()))
    y = np.array([r[2] for r in got])
    if len(set(y)) < 2:
        return {"model": None, "constant": float(y.mean()) if len(y) else 0.0}
    model = Model([r[1] for r in got], y, tuple(size[c] / (y == c).sum() for c in (0.0, 1.0)))
    model.emb = None  # scoring needs the buckets' logits only
    return {"model": model, "constant": 0.0}


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m, cache = pickle.loads(sent.value), {}
        for batch in batches:
            s = np.array([m["model"].score(t, cache) if m["model"] else m["constant"] for t in batch.column("text").to_pylist()], np.float64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(docs.select("doc_id", common.held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
