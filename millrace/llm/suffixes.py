"""Suffix-array dedup of 50-byte strings, one bucket of suffixes at a time.

Documents go into blocks of about ``BLOCK`` bytes, one row each of a table that
is bucketed by block, so it is scanned again and again without a shuffle.

1. Buckets.  Every 50-byte window has an anchor: the smallest hash among its
   16-byte strings.  Equal windows have equal anchors at equal places, so the
   suffixes with one anchor form a bucket, and no match leaves its bucket.
2. Pruning.  A window contains one of two 33-byte strings beside its anchor.
   Blocks exchange the sorted 40-bit hashes of these as differences, about three
   bytes each, and get back a bit for each: met in two documents or not.  Only
   windows with such a string go on; a hash that collides only costs work.
3. Sorting.  A bucket's suffixes are sorted around its anchor.  The cover
   sample, every 16th place before the anchor, is sorted to the full depth once
   and gives ranks and common-prefix lengths; all other suffixes are compared
   by the bytes before their next cover place, at most 15, and the long tie
   behind them is resolved by the sample's ranks.  Buckets are read in order
   and sorted in portions of ``PORTION`` rows, so memory does not grow with
   the input; a bucket over several portions carries its distinct suffixes on.
4. Removal.  Each class of equal windows has a smallest doc_id; the windows of
   larger ones are covered and their bytes removed, by a scan of the blocks.

A place relative to the anchor is the same in both suffixes of a pair, so a
period of 16 is a difference cover with the one difference that occurs, 0.
Equal surroundings inside a block are folded before they are sent, so a passage
or copy that a third of the documents hold costs a row for each block.

Hot anchors.  One in ``EVERY`` of the blocks' distinct 33-byte strings, taken by
hash, names its anchor.  Anchors met ``portion / EVERY`` times or more, the
``HOT`` most frequent of them, are hot: their suffixes go to a bucket for each
33-byte string beside the anchor instead of one bucket, so they spread over
tasks by the 17 bytes before or after it.  Equal windows hold equal strings, so
this moves rows and changes no result.

Null texts are empty.  Rows with equal doc_id do not remove from each other;
a null doc_id counts as larger than all.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM, BLOCK, PORTION = 50, 16, 4 << 20, 200_000
EVERY, HOT = 256, 1 << 16  # at most 512 KB of hot anchors are broadcast
REACH = LENGTH - GRAM  # 34: how far before its anchor a window can begin
SIDE = REACH // 2  # 17
KEY = SIDE + GRAM  # 33
AROUND = REACH + LENGTH  # 84 bytes hold all windows of an anchor
COVER = (15, 31, REACH)
_LAST = np.iinfo(np.int64).max
_HOT_ROW = -1
_rng = np.random.default_rng(50)
_BYTE = _rng.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_MULT = _rng.integers(0, 1 << 63, 8, np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_ROW = _rng.integers(0, 1 << 63, AROUND + 2, np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT[6]
    return x ^ (x >> np.uint64(29))


class Runs:
    """A block's windows, grouped by anchor: windows lo to hi (inclusive) have the anchor at q."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        self.data = data
        self.doc_at = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        n = len(data) - LENGTH + 1
        empty = np.zeros(0, np.int64)
        self.lo = self.hi = self.q = self.doc = empty
        self.keys, self.key_run, self.left = np.zeros(0, np.uint64), empty, np.zeros(0, bool)
        self.gram = np.zeros(0, np.uint64)
        if n <= 0:
            return
        h = _BYTE[data]
        for k, step in enumerate((1, 2, 4, 8)):
            h = h[:-step] * _MULT[k] + h[step:]
        v = (_mix(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= REACH + 1:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        rest = REACH + 1 - size
        v = np.minimum(v[:-rest], v[rest:]) if rest else v
        anchor = (v[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        good = self.doc_at[:n] == self.doc_at[LENGTH - 1 :]
        change = np.r_[True, (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1]) | (self.doc_at[1:n] != self.doc_at[: n - 1])]
        starts = np.flatnonzero(change)
        ends = np.r_[starts[1:], n] - 1
        keep = good[starts]
        self.lo, self.hi = starts[keep], ends[keep]
        self.q, self.doc = anchor[self.lo], self.doc_at[self.lo]
        self.gram = _mix(h[self.q] * _MULT[7])
        long = lambda x: _mix((h[x] * _MULT[4] + h[x + GRAM]) * _MULT[5] + _BYTE[data[x + 2 * GRAM]])  # noqa: E731  KEY bytes from x
        left, right = np.flatnonzero(self.lo <= self.q - SIDE), np.flatnonzero(self.hi > self.q - SIDE)
        self.keys = np.concatenate([long(self.q[left] - SIDE), long(self.q[right])]) >> np.uint64(24)
        self.key_run, self.left = np.concatenate([left, right]), np.arange(len(left) + len(right)) < len(left)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, which of them two documents of the block have, and each key's place among them."""
        order = np.argsort(self.keys, kind="stable")
        k, d = self.keys[order], self.doc[self.key_run][order]
        first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(at) else np.zeros(0, bool)
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(first) - 1
        return k[at], several, place

    def sampled(self, keys: np.ndarray, place: np.ndarray, block: int, every: int) -> np.ndarray:
        """The anchor of about one in ``every`` of the block's distinct keys."""
        gram = np.zeros(len(keys), np.uint64)
        gram[place] = self.gram[self.key_run]
        return gram[_mix((keys ^ (np.uint64(block) << np.uint64(40))) * _MULT[7]) % np.uint64(every) == 0]

    def buckets(self, runs: np.ndarray, left: bool) -> np.ndarray:
        """For each run the bucket of the string on one side of its anchor, which it must have."""
        side = self.left == left
        key = np.zeros(len(self.q), np.uint64)
        key[self.key_run[side]] = self.keys[side]
        return _mix((self.gram[runs] + key[runs] * _MULT[4]) * _MULT[5] + np.uint64(left))


def _planes(values: np.ndarray) -> bytes:
    """Sorted 40-bit values as 5 planes of bytes of their differences."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _values(raw: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8, 5 * n).reshape(5, n).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def make_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, doc_ids, lengths, data of all documents, as a table bucketed by block in the warehouse."""

    def run(batches):
        part, k, ids, sizes, data, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row():
            return pa.record_batch([pa.array([(part << 24) + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())], ["block", "doc_ids", "lengths", "data"])

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                ids.append(d), sizes.append(len(raw)), data.append(raw)
                held += len(raw) + 16
                if held >= size:
                    yield row()
                    k, ids, sizes, data, held = k + 1, [], [], [], 0
        if ids:
            yield row()

    spark, name = docs.sparkSession, f"millrace_blocks_{uuid.uuid4().hex}"
    common.register(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}")  # the table's folder
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = common.map_arrow(source, run, "block long, doc_ids array<long>, lengths array<long>, data binary")
    blocks.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").bucketBy(common.width(docs), "block").saveAsTable(name)
    return spark.table(name)


def _shared_bits(blocks: DataFrame, ranges_log: int, portion: int, every: int) -> DataFrame:
    """block, range, bits: which of the block's keys in a range of values two documents have.

    Rows with the block ``_HOT_ROW`` hold hot anchors and how often the sample met them.
    """
    shift, gram_shift = np.uint64(40 - ranges_log), np.uint64(64 - ranges_log)
    names, kinds = ["range", "block", "n", "raw"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    least = max(2, portion // every)

    def send(batches):
        for batch in batches:
            for block, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("block", "lengths", "data"))):
                runs = Runs(np.frombuffer(data, np.uint8), np.array(lengths, np.int64))
                keys, several, place = runs.distinct()
                at, starts, counts = np.unique(keys >> shift, return_index=True, return_counts=True)
                rows = [(int(r), block, int(c), _planes(keys[s : s + c]) + np.packbits(several[s : s + c]).tobytes()) for r, s, c in zip(at, starts, counts)]
                some = np.sort(runs.sampled(keys, place, block, every))
                at, starts, counts = np.unique(some >> gram_shift, return_index=True, return_counts=True)
                rows += [(int(r), _HOT_ROW, int(c), some[s : s + c].tobytes()) for r, s, c in zip(at, starts, counts)]
                yield pa.record_batch([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names)

    def match(batches):
        held, now, anchors = [], None, []

        def close():
            if anchors:
                gram, met = np.unique(np.frombuffer(b"".join(anchors), np.uint64), return_counts=True)
                often = met >= least
                both = np.stack([gram[often], met[often].astype(np.uint64)], 1)
                yield pa.record_batch([pa.array([_HOT_ROW], pa.int64()), pa.array([now], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["block", "range", "bits"])
            if not held:
                return
            keys = [_values(raw, n) for _, n, raw in held]
            flags = [np.unpackbits(np.frombuffer(raw, np.uint8, offset=5 * n), count=n).astype(bool) for _, n, raw in held]
            k, f = np.concatenate(keys), np.concatenate(flags)
            order = np.argsort(k, kind="stable")
            s = k[order]
            same = s[1:] == s[:-1]
            out = f.copy()
            out[order[1:][same]] = True
            out[order[:-1][same]] = True
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.record_batch([pa.array([b for b, _, _ in held], pa.int64()), pa.array([now] * len(held), pa.int32()), pa.array([np.packbits(out[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["block", "range", "bits"])

        for batch in batches:
            for r, block, n, raw in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "n", "raw"))):
                if r != now:
                    yield from close()
                    held, now, anchors = [], r, []
                if block == _HOT_ROW:
                    anchors.append(raw)
                else:
                    held.append((block, n, raw))
        yield from close()

    sent = common.map_arrow(blocks.select("block", "lengths", "data"), send, "range int, block long, n long, raw binary")
    dealt = sent.repartition(1 << ranges_log, "range").sortWithinPartitions("range", "block")
    return common.map_arrow(dealt, match, "block long, range int, bits binary")


def hot_anchors(bits: DataFrame) -> np.ndarray:
    """Sorted hashes of the hot anchors, ``HOT`` at most, from the rows of ``_shared_bits``."""

    def rows(batches):
        for batch in batches:
            both = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["gram", "met"])

    found = common.map_arrow(bits.filter(F.col("block") == _HOT_ROW).select("bits"), rows, "gram long, met long")
    return np.sort(np.array([r.gram for r in found.orderBy(F.desc("met"), "gram").limit(HOT).collect()], np.int64).view(np.uint64))


def _candidates(blocks: DataFrame, bits: DataFrame, ranges_log: int, hot: np.ndarray) -> DataFrame:
    """Surroundings that may match elsewhere (gram, doc, block, places, lo, hi, around), and spans already known to match inside the block."""
    shift = np.uint64(40 - ranges_log)
    sent = blocks.sparkSession.sparkContext.broadcast(hot)
    names = ["gram", "doc", "block", "places", "lo", "hi", "around", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        hot = sent.value
        for batch in batches:
            for block, doc_ids, lengths, data, got in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_ids", "lengths", "data", "bits"))):
                runs = Runs(np.frombuffer(data, np.uint8), np.array(lengths, np.int64))
                keys, _, place = runs.distinct()
                counts = np.unique(keys >> shift, return_counts=True)[1]
                flags = np.concatenate([np.unpackbits(np.frombuffer(g["bits"], np.uint8), count=int(c)) for g, c in zip(got, counts)]).astype(bool)[place]
                left, right = np.zeros(len(runs.q), bool), np.zeros(len(runs.q), bool)
                left[runs.key_run[flags & runs.left]] = True
                right[runs.key_run[flags & ~runs.left]] = True
                lo = np.where(left, runs.lo, np.maximum(runs.lo, runs.q - SIDE + 1))
                hi = np.where(right, runs.hi, np.minimum(runs.hi, runs.q - SIDE))
                use = np.flatnonzero((left | right) & (lo <= hi))
                if not len(use):
                    continue
                lo, hi, q = lo[use], hi[use], runs.q[use]
                gram, doc = runs.gram[use], np.array([_LAST if d is None else d for d in doc_ids], np.int64)[runs.doc[use]]
                split = np.isin(gram, hot)
                if split.any():
                    cut = q - SIDE  # windows up to this place hold the string left of the anchor, later ones the right one
                    rest, first, second = np.flatnonzero(~split), np.flatnonzero(split & (lo <= cut)), np.flatnonzero(split & (hi > cut))
                    gram = np.concatenate([gram[rest], runs.buckets(use[first], True), runs.buckets(use[second], False)])
                    lo, hi = np.concatenate([lo[rest], lo[first], np.maximum(lo, cut + 1)[second]]), np.concatenate([hi[rest], np.minimum(hi, cut)[first], hi[second]])
                    at = np.concatenate([rest, first, second])
                    q, doc = q[at], doc[at]
                at = q[:, None] + np.arange(-REACH, LENGTH)
                inside = (at >= lo[:, None]) & (at < hi[:, None] + LENGTH)
                around = np.where(inside, runs.data[np.where(inside, at, 0)], 0).astype(np.uint8)
                a, b = (lo - q + REACH).astype(np.int32), (hi - q + REACH).astype(np.int32)
                digest = gram + a.astype(np.uint64) * _ROW[-1] + b.astype(np.uint64) * _ROW[-2]
                for k in range(AROUND):
                    digest += around[:, k] * _ROW[k]
                order = np.lexsort([q, doc, digest])
                same = np.r_[False, (digest[order[1:]] == digest[order[:-1]]) & (gram[order[1:]] == gram[order[:-1]]) & (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]]) & (around[order[1:]] == around[order[:-1]]).all(1)]
                group = np.cumsum(~same) - 1
                heads = order[~same]
                smallest = doc[heads][group]
                later = doc[order] > smallest  # covered by a document of this block
                spans = order[later]
                mine = order[~later]
                cuts = np.flatnonzero(np.r_[True, group[~later][1:] != group[~later][:-1]])
                places = [p.astype("<i4").tobytes() for p in np.split(q[mine], cuts[1:])]
                cols = [gram[heads].view(np.int64), doc[heads], np.full(len(heads), block), places, a[heads], b[heads], [r.tobytes() for r in around[heads]], [None] * len(heads)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names)
                if len(spans):
                    pairs = np.stack([lo[spans], hi[spans] + LENGTH], 1).astype("<i4").tobytes()
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(([int(_mix(np.array([block], np.uint64)).view(np.int64)[0])], [None], [block], [None], [None], [None], [None], [pairs]), kinds)], names)

    listed = bits.filter(F.col("block") != _HOT_ROW).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "bits"))).alias("bits"))
    joined = blocks.join(listed.hint("shuffle_hash"), "block")
    return common.map_arrow(joined.select("block", "doc_ids", "lengths", "data", "bits"), run, "gram long, doc long, block long, places binary, lo int, hi int, around binary, spans binary")


def covered(gram: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each row of surroundings a mask of 35 bits: which of its windows an equal window of a smaller doc covers."""
    out = np.zeros(len(gram), np.uint64)
    begin = 0
    for c in COVER:
        # the cover sample: rank and common-prefix length of the suffixes at c
        wide = np.zeros((len(gram), 56), np.uint8)
        wide[:, :LENGTH] = around[:, c : c + LENGTH]
        words = wide.view(">u8").astype(np.uint64)
        order = np.lexsort([*words.T[::-1], gram])
        differ = wide[order[1:], :LENGTH] != wide[order[:-1], :LENGTH]
        common_prefix = np.where(differ.any(1), differ.argmax(1), LENGTH)
        common_prefix[gram[order[1:]] != gram[order[:-1]]] = -1
        rank = np.empty(len(gram), np.int64)
        for o in range(begin, c + 1):
            active = np.flatnonzero((lo <= o) & (o <= hi))
            if not len(active):
                continue
            rank[order] = np.cumsum(np.r_[0, common_prefix < LENGTH - (c - o)])
            keys = [rank[active]]
            if c > o:  # the bytes before the cover place
                head = np.zeros((len(active), 16), np.uint8)
                head[:, : c - o] = around[active, o:c]
                keys += list(head.view("<u8").T)
            by = np.lexsort(keys)
            new = np.zeros(len(by), bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[by[1:]] != k[by[:-1]]
            at = np.flatnonzero(new)
            least = np.repeat(np.minimum.reduceat(doc[active[by]], at), np.diff(np.r_[at, len(by)]))
            hit = active[by[least < doc[active[by]]]]
            out[hit] |= np.uint64(1 << o)
        begin = c + 1
    return out


def _sorted_buckets(candidates: DataFrame, parts: int, portion: int) -> DataFrame:
    """block, spans (flat begin, end places in the block) of what the sorted buckets cover; known spans pass through."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        state = None  # distinct surroundings of the bucket that goes on

        def process(table: pa.Table, last: bool):
            nonlocal state
            gram, doc, block, lo, hi = (table[n].to_numpy() for n in ("gram", "doc", "block", "lo", "hi"))
            around = np.frombuffer(b"".join(table["around"].to_pylist()), np.uint8).reshape(-1, AROUND)
            places = table["places"].to_pylist()
            if state is not None:
                old = len(state[0])
                mask = covered(*[np.concatenate([s, x]) for s, x in zip(state, (gram, doc, lo, hi, around))])[old:]
            else:
                mask = covered(gram, doc, lo, hi, around)
            if last:
                state = None
            else:
                tail = gram == gram[-1]
                new = (gram[tail], doc[tail], lo[tail], hi[tail], around[tail])
                if state is not None and state[0][0] == gram[-1]:
                    new = tuple(np.concatenate([s, x]) for s, x in zip(state, new))
                text = np.concatenate([new[4], new[2][:, None].astype(np.uint8), new[3][:, None].astype(np.uint8)], 1)
                keep = np.unique(np.ascontiguousarray(text).view(f"V{AROUND + 2}").ravel(), return_index=True)[1]  # rows come by doc, so the first has the smallest
                keep.sort()
                state = tuple(x[keep] for x in new)
            spans: dict[int, list[int]] = {}
            bits = (mask[:, None] >> np.arange(REACH + 1, dtype=np.uint64) & np.uint64(1)).astype(np.int8)
            edges = np.diff(np.pad(bits, ((0, 0), (1, 1))), axis=1)
            r1, s = np.nonzero(edges == 1)
            _, e = np.nonzero(edges == -1)
            for i, a, b in zip(r1.tolist(), s.tolist(), e.tolist()):
                own = spans.setdefault(int(block[i]), [])
                for q in np.frombuffer(places[i], "<i4").tolist():
                    own += (q - REACH + a, q - REACH + b - 1 + LENGTH)
            return pa.record_batch([pa.array(list(spans), pa.int64()), pa.array([np.array(v, "<i4").tobytes() for v in spans.values()], pa.binary())], ["block", "spans"])

        for batch in batches:
            known = batch.column("around").is_null()
            if known.true_count:
                yield batch.filter(known).select(["block", "spans"])
                batch = batch.filter(pa.compute.invert(known))
            held.append(batch)
            rows += len(batch)
            if rows >= portion:
                yield process(pa.Table.from_batches(held), False)
                held, rows = [], 0
        if rows:
            yield process(pa.Table.from_batches(held), True)

    dealt = candidates.repartition(parts, "gram").sortWithinPartitions("gram", "doc")
    return common.map_arrow(dealt, run, "block long, spans binary")


def removed(docs: DataFrame, block: int = BLOCK, portion: int = PORTION, every: int = EVERY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    parts = common.width(docs)
    ranges_log = max(6, (parts - 1).bit_length())
    blocks = make_blocks(docs, block)
    bits = common.materialise(_shared_bits(blocks, ranges_log, portion, every), "bits")
    found = _candidates(blocks, bits, ranges_log, hot_anchors(bits))
    spans = _sorted_buckets(found, parts, portion).groupBy("block").agg(F.collect_list("spans").alias("spans"))

    def run(batches):
        for batch in batches:
            for doc_ids, lengths, data, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "data", "spans"))):
                raw = np.frombuffer(data, np.uint8)
                change = np.zeros(len(raw) + 1, np.int64)
                if spans:
                    flat = np.frombuffer(b"".join(spans), "<i4")
                    change += np.bincount(flat[::2], minlength=len(change)) - np.bincount(flat[1::2], minlength=len(change))
                gone = np.cumsum(change[:-1]) > 0
                ends = np.cumsum([0, *lengths]).tolist()
                out = []
                for a, b in zip(ends[:-1], ends[1:]):
                    g = gone[a:b]
                    n = int(g.sum())
                    out.append((b - a, n, int(np.count_nonzero(g[1:] & ~g[:-1])) + int(b > a and g[0]), raw[a:b][~g].tobytes() if n else data[a:b]))
                for lo in range(0, len(out), 500):
                    part = out[lo : lo + 500]
                    yield pa.record_batch([pa.array(doc_ids[lo : lo + 500], pa.int64()), *[pa.array([p[k] for p in part], pa.int64()) for k in range(3)], pa.array([p[3] for p in part], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = blocks.join(spans.hint("shuffle_hash"), "block", "left")
    return common.map_arrow(joined.select("doc_ids", "lengths", "data", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffixes(spark, sf_dir: str) -> DataFrame:
    return removed(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
