"""Set similarity: MinHash signatures, LSH bands, exact Jaccard."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import Scratch

#: Hashes, bands and rows of a band; the modulus is a prime below 2^31.
HASHES, BANDS, ROWS, MODULUS = 60, 30, 2, 2_147_483_647


def word_sets(docs: DataFrame) -> DataFrame:
    """Distinct (id, element) of lower-case words of letters."""
    return docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("element")).filter("element <> ''")


def element_number(element) -> F.Column:
    """28 bits of the element's MD5."""
    return F.conv(F.substring(F.md5(element.cast("binary")), 1, 7), 16, 10).cast("bigint")


def hash_family(k: int = HASHES, seed: int = 60) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, MODULUS), rng.randrange(MODULUS)) for _ in range(k)]


def minhash(sets: DataFrame, k: int = HASHES, seed: int = 60) -> DataFrame:
    """id and its signature: all minima in one aggregate with partial results."""
    x = sets.select("id", element_number(F.col("element")).alias("x"))
    mins = [F.min((F.col("x") * a + b) % MODULUS).alias(f"h{i}") for i, (a, b) in enumerate(hash_family(k, seed))]
    return x.groupBy("id").agg(*mins).select("id", F.array(*[f"h{i}" for i in range(k)]).alias("signature"))


def lsh_bands(signatures: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, band, key."""
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.array_join(F.slice("signature", i * rows + 1, rows).cast("array<string>"), ",").alias("key")) for i in range(bands)])
    return signatures.select("id", F.explode(keys).alias("b")).select("id", "b.band", "b.key")


#: Rows of a block of signatures, and blocks besides; cells of one block against rows of another that are marked at once; pairs of a batch.
SIGNED, SPREAD, CELLS, OUT = 60_000, 3, 8_000_000, 200_000


def lsh_candidates(bands: DataFrame) -> DataFrame:
    """Distinct id1 < id2 that share a band's key.

    Pairs are many more than rows, so they are made once and never moved: each
    two blocks of ids meet in one task, which marks what shares a key in arrays
    and hands on the marks.  Keys are told by 64-bit hashes.
    """
    scratch = Scratch(bands.sparkSession, "signed", True)
    return _sharing(scratch.cut(bands.filter("id IS NOT NULL").groupBy("id").agg(F.collect_set(F.xxhash64("band", "key")).alias("keys"))))


def _sharing(keyed: DataFrame, threshold: float | None = None) -> DataFrame:
    """id1 < id2 of rows id, keys that share a key; with a threshold also n, b (size and bitmap), which must allow it."""
    n = -(-keyed.count() // SIGNED) + SPREAD
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)).cast("int")
    # tasks (i, j) with i <= j, i * n + j; the rows of the second block are on the right
    tasks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((F.least(k, block) * n + F.greatest(k, block)).alias("task"), (k < block).alias("right")))
    dealt = keyed.select("*", F.explode(tasks).alias("t")).select(*keyed.columns, "t.task", "t.right")
    kind = keyed.schema["id"].dataType.simpleString()
    return dealt.repartition(n * (n + 1) // 2, "task").sortWithinPartitions("task").mapInArrow(_candidates(n, threshold), f"id1 {kind}, id2 {kind}")


def _candidates(n: int, threshold: float | None):
    """Of each task's rows the pairs that share a key and can reach the threshold, in batches."""

    def can(a, b, i, j):
        """Places of the pairs whose sizes, and then bitmaps, allow the threshold."""
        na, nb = a[0], b[0]
        small, large = np.minimum(na[i], nb[j]), np.maximum(na[i], nb[j])
        near = np.flatnonzero(small >= threshold * large - 1e-9)
        out = []
        for k in range(0, len(near), 1 << 15):
            at = near[k : k + (1 << 15)]
            for (ba, free_a), (bb, free_b) in zip(a[1:], b[1:]):
                x, y = i[at], j[at]
                most = np.bitwise_count(ba[x] & bb[y]).sum(axis=1, dtype=np.int64) + np.minimum(free_a[x], free_b[y])
                at = at[most >= (na[x] + nb[y]) * (threshold / (1 + threshold)) - 1e-6]
            out.append(at)
        return np.concatenate([near[:0], *out])

    def sized(rows):
        size, bits = np.array(rows["n"], np.int64), np.frombuffer(b"".join(rows["b"].to_pylist()), np.uint64).reshape(-1, BITMAP)
        coarse = np.bitwise_or.reduce(bits.reshape(-1, BITMAP // COARSE, COARSE), axis=1)
        return size, *((x, size - np.bitwise_count(x).sum(axis=1, dtype=np.int64)) for x in (coarse, bits))  # a bitmap, and elements beyond one a bit

    def met(task: int, rows: pa.Table):
        right = np.array(rows["right"], bool)
        one = task // n == task % n
        a, b = (rows, rows) if one else (rows.filter(pa.array(~right)), rows.filter(pa.array(right)))
        ids_a, ids_b = a["id"].combine_chunks(), b["id"].combine_chunks()
        width = len(ids_b)
        if not len(ids_a) or not width:
            return
        sides = [(pc.list_flatten(x["keys"]).to_numpy(), np.repeat(np.arange(len(x)), pc.list_value_length(x["keys"]).to_numpy())) for x in (a, b)]
        (ka, owner_a), (kb, owner_b) = sides
        order = np.argsort(kb, kind="stable")
        kb, owner_b = kb[order], owner_b[order]
        low, high = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
        starts = np.searchsorted(owner_a, np.arange(len(ids_a) + 1))  # rows' keys
        step = max(1, CELLS // width)
        if threshold is not None:
            told_a, told_b = sized(a), sized(b)
        for x in range(0, len(ids_a), step):
            to = min(x + step, len(ids_a))
            seen = np.zeros((to - x, width), bool)
            for k in range(starts[x], starts[to]):
                seen[owner_a[k] - x, owner_b[low[k] : high[k]]] = True
            i, j = np.nonzero(seen)
            i += x
            if one:
                i, j = i[i < j], j[i < j]
            if threshold is not None:
                keep = can(told_a, told_b, i, j)
                i, j = i[keep], j[keep]
            for k in range(0, len(i), OUT):
                p, q = ids_a.take(pa.array(i[k : k + OUT])), ids_b.take(pa.array(j[k : k + OUT]))
                less = pc.less(p, q)
                yield pa.record_batch([pc.if_else(less, p, q), pc.if_else(less, q, p)], ["id1", "id2"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            task = np.array(batch.column("task"), np.int64)
            ends = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for lo, hi in zip(ends, ends[1:]):
                if hi > lo and task[lo] != now:
                    if held:
                        yield from met(int(now), pa.Table.from_batches(held))
                    now, held = task[lo], []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from met(int(now), pa.Table.from_batches(held))

    return run


def jaccard_of(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """id1, id2, similarity of the pairs that reach the threshold.  Elements are compared by 64-bit hashes; sizes alone drop most pairs."""
    lists = sets.groupBy("id").agg(F.collect_list(F.xxhash64("element")).alias("s"))
    sizes = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    near = pairs.join(sizes.select(F.col("id").alias("id1"), F.col("n").alias("n1")), "id1").join(sizes.select(F.col("id").alias("id2"), F.col("n").alias("n2")), "id2").filter(F.least("n1", "n2") >= threshold * F.greatest("n1", "n2") - 1e-9)
    both = near.join(lists.select(F.col("id").alias("id1"), F.col("s").alias("s1")), "id1").join(lists.select(F.col("id").alias("id2"), F.col("s").alias("s2")), "id2")
    common = F.size(F.array_intersect("s1", "s2"))
    return both.select("id1", "id2", (common / (F.size("s1") + F.size("s2") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)


#: Elements whose counts set the order; kept elements of a block, and 32-bit words of all blocks that are dealt in one round; pairs of elements counted at once.
HEAVY, BLOCK, DEALT, COUNTED = 1 << 16, 2_500_000, 150_000_000, 2_000_000
#: 64-bit words of a row's bitmaps there.
MARKS = 32


def jaccard_exact(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All pairs at the threshold.

    A pair must share one of the rarest n - ceil(t n) + 1 elements of each, and
    sizes must be near enough, so common elements make no pairs.  Of the set
    whose kept elements end first in the common order, only shared ones and the
    rest can be in the overlap, so pairs with too few shared ones go as well.

    Equal sets are one row until the end.  Rows are dealt to blocks by size, and
    each two blocks whose sizes are near enough meet in one task, which counts
    shared elements in arrays; only pairs that can reach the threshold leave it,
    for which bitmaps also bound what the rest can add.
    Shared elements are told by 32 bits of their hashes there, which can only
    add pairs, and pairs are verified.
    """
    scratch = Scratch(sets.sparkSession, "jaccard", True)
    cut = scratch.cut
    reps, member = folded(sets.filter("id IS NOT NULL"), cut)
    reps, member = cut(reps), cut(member)
    scratch.drop(reps, member)
    heavy = reps.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").orderBy(F.desc("c"), "h").limit(HEAVY).toArrow()
    sizes = sorted((r["n"], r["k"]) for r in reps.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect())
    if not sizes:
        return _unfolded(reps.select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("similarity")), member)
    of, blocks = _blocks(sizes, threshold)
    meet = [(i, j) for j in range(len(blocks)) for i in range(j + 1) if blocks[i][1] >= threshold * blocks[j][0] - 1e-9]
    kept = cut(reps.mapInArrow(_kept(heavy, of, threshold), f"id {reps.schema['id'].dataType.simpleString()}, n int, block int, kept binary, marks binary, last_count long, last long"))
    rounds, dealt, found = [[]], 0, []
    for i, j in meet:
        size = sum(blocks[b][2] + 4 * MARKS * blocks[b][3] for b in {i, j})  # bitmaps travel too, 4 * MARKS times 32 bits a row
        if rounds[-1] and dealt + size > DEALT:
            rounds.append([])
            dealt = 0
        rounds[-1].append((i, j))
        dealt += size
    for pairs in rounds:
        to = {}
        for k, (i, j) in enumerate(pairs):
            for b in {i, j}:
                to.setdefault(b, []).append((k, i != j and b == j))
        table = F.create_map(*[x for b, there in to.items() for x in (F.lit(b), F.array(*[F.struct(F.lit(k).alias("task"), F.lit(right).alias("right")) for k, right in there]))])
        sent = kept.select("*", F.explode(F.try_element_at(table, F.col("block"))).alias("t")).select("id", "n", "kept", "marks", "last_count", "last", "t.task", "t.right")
        id_type = reps.schema["id"].dataType.simpleString()
        found.append(cut(sent.groupBy("task").applyInArrow(_met(threshold), f"id1 {id_type}, id2 {id_type}")))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    lists = reps.select("id", "s")
    both = pairs.join(lists.select(F.col("id").alias("id1"), F.col("s").alias("s1")), "id1").join(lists.select(F.col("id").alias("id2"), F.col("s").alias("s2")), "id2")
    common = F.size(F.array_intersect("s1", "s2"))
    exact = cut(both.select("id1", "id2", (common / (F.size("s1") + F.size("s2") - common)).alias("similarity")).filter(F.col("similarity") >= threshold))
    scratch.drop(exact, member)
    return _unfolded(exact, member)


def _blocks(sizes: list[tuple[int, int]], threshold: float) -> tuple[dict, list]:
    """size -> (its first block, number of its blocks); (smallest size, largest size, kept elements, rows) of each block."""
    of, blocks, room = {}, [], 0
    for n, k in sizes:
        load = k * (n - int(np.ceil(n * threshold - 1e-9)) + 1)
        if load > room:
            parts = -(-load // BLOCK)
            of[n] = (len(blocks), parts)
            blocks += [[n, n, load // parts, k // parts] for _ in range(parts)]
            room = BLOCK - load if parts == 1 else 0
        else:
            of[n] = (len(blocks) - 1, 1)
            blocks[-1][1] = n
            blocks[-1][2] += load
            blocks[-1][3] += k
            room -= load
    return of, blocks


def _kept(heavy: pa.Table, of: dict, threshold: float):
    """Of each set its rarest elements, 32 bits each, bitmaps of the rest and of the whole set, and the last kept one in the common order: count, then hash."""
    h, c = np.array(heavy["h"], np.int64), np.array(heavy["c"], np.int64)
    at = h.argsort()
    h, c = h[at], c[at]

    def run(batches):
        for batch in batches:
            blocks, kept, marks, counts, last = [], [], [], [], []
            for s in batch.column("s"):
                s = s.values.to_numpy()
                n = len(s)
                f = np.zeros(n, np.int64)
                if len(h):
                    to = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    f = np.where(h[to] == s, c[to], 0)
                order = np.argsort(f, kind="stable")
                order, rest = np.split(order, [n - int(np.ceil(n * threshold - 1e-9)) + 1])
                bits = np.zeros((2, 64 * MARKS), bool)
                bits[0, s[rest] & (64 * MARKS - 1)] = bits[1, s & (64 * MARKS - 1)] = True
                marks.append(np.packbits(bits).tobytes())
                first, parts = of[n]
                blocks.append(first + int(s.sum() % parts))
                kept.append((s[order] & 0xFFFFFFFF).astype(np.uint32).tobytes())
                counts.append(int(f[order[-1]]))
                last.append(int(s[order[-1]]))
            yield pa.record_batch([batch.column("id"), batch.column("n"), pa.array(blocks, pa.int32()), pa.array(kept, pa.binary()), pa.array(marks, pa.binary()), pa.array(counts, pa.int64()), pa.array(last, pa.int64())], ["id", "n", "block", "kept", "marks", "last_count", "last"])

    return run


def _met(threshold: float):
    """Of one or two blocks the pairs whose shared elements and sizes allow the threshold."""

    def side(rows):
        raw = rows["kept"].to_pylist()
        size = np.array([len(x) // 4 for x in raw], np.int64)
        n = np.array(rows["n"], np.int64)
        end = np.ceil(n * threshold - 1e-9) - 1  # what is not kept
        marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint64).reshape(-1, 2, MARKS)
        return np.frombuffer(b"".join(raw), np.uint32), size, n, end, np.array(rows["last_count"], np.int64), np.array(rows["last"], np.int64), marks

    def run(rows: pa.Table) -> pa.Table:
        right = np.array(rows["right"], bool)
        one = not right.any()
        left_rows = rows if one else rows.filter(pa.array(~right))
        right_rows = rows if one else rows.filter(pa.array(right))
        ha, size_a, na, rest_a, count_a, last_a, marks_a = side(left_rows)
        hb, size_b, nb, rest_b, count_b, last_b, marks_b = side(right_rows)
        width = len(nb)
        order = np.argsort(hb, kind="stable")
        key, start, times = np.unique(hb[order], return_index=True, return_counts=True)
        owner = np.repeat(np.arange(width, dtype=np.int32), size_b)[order]
        if len(ha) and len(key):
            at = np.minimum(np.searchsorted(key, ha), len(key) - 1)
            hit = (key[at] == ha) & (times[at] > (1 if one else 0))  # within a block an element meets itself
        else:
            at, hit = np.zeros(len(ha), np.int64), np.zeros(len(ha), bool)
        row = np.repeat(np.arange(len(na)), size_a)[hit]
        begin, length = start[at[hit]], times[at[hit]]
        upto = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(na)))])  # entries before each row
        work = np.concatenate([[0], np.cumsum(length)])[upto] if len(length) else np.zeros(len(na) + 1, np.int64)
        # of each row the fewest shared elements that allow the threshold with any row of the other side
        share = threshold / (1 + threshold)
        least = share * (na + np.maximum(nb.min(initial=1), threshold * na)) - np.maximum(rest_a, rest_b.max(initial=0)) - 1e-6
        least = np.maximum(np.ceil(least), 1).astype(np.int64)
        xs, ys, x = [], [], 0
        while x < len(na):
            to = max(x + 1, min(int(np.searchsorted(work, work[x] + COUNTED, "right")) - 1, x + max(1, COUNTED // max(1, width)), len(na)))
            lo, hi = upto[x], upto[to]
            if hi > lo:
                many = length[lo:hi]
                places = np.repeat(begin[lo:hi] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                shared = np.bincount(owner[places] + np.repeat((row[lo:hi] - x) * width, many), minlength=(to - x) * width)
                cell = np.flatnonzero(shared.reshape(-1, width) >= least[x:to, None])
                i, j = np.divmod(cell, width)
                i += x
                if one:
                    keep = i < j
                    i, j, cell = i[keep], j[keep], cell[keep]
                small, need = np.minimum(na[i], nb[j]), share * (na[i] + nb[j]) - 1e-6
                first = (count_a[i] < count_b[j]) | ((count_a[i] == count_b[j]) & (last_a[i] <= last_b[j]))
                most = shared[cell] + np.where(first, rest_a[i], rest_b[j])
                can = np.flatnonzero((most >= need) & (small >= threshold * np.maximum(na[i], nb[j]) - 1e-9))
                i, j, first, most, need = i[can], j[can], first[can], most[can], need[can]
                can = np.ones(len(i), bool)
                for k in range(0, len(i), 1 << 15):
                    p, q, f = i[k : k + (1 << 15)], j[k : k + (1 << 15)], first[k : k + (1 << 15), None]
                    alone = np.where(f, marks_a[p, 0] & ~marks_b[q, 1], marks_b[q, 0] & ~marks_a[p, 1])
                    can[k : k + (1 << 15)] = most[k : k + (1 << 15)] - np.bitwise_count(alone).sum(axis=1, dtype=np.int64) >= need[k : k + (1 << 15)]
                xs.append(i[can])
                ys.append(j[can])
            x = to
        none = np.zeros(0, np.int64)
        return pa.table({"id1": left_rows["id"].take(pa.array(np.concatenate([none, *xs]))), "id2": right_rows["id"].take(pa.array(np.concatenate([none, *ys])))})

    return run


#: Words of 64 bits in a set's bitmap, which bounds overlaps before sets travel, and in its folded form, which is compared first; pairs whose sets travel at once.
BITMAP, COARSE, TRAVEL = 64, 16, 500_000


def folded(sets: DataFrame, cut=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(id, s, n of one set of each kind, its elements hashed and sorted; id, rep: every id and the smallest id with its set)."""
    whole = cut(sets.groupBy("id").agg(F.sort_array(F.array_distinct(F.collect_list(F.xxhash64("element")))).alias("s")))
    keyed = whole.select("id", "s", F.xxhash64("s").alias("d1"), F.xxhash64(F.lit(1), "s").alias("d2"))
    rep = keyed.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    member = keyed.select("id", "d1", "d2").join(rep, ["d1", "d2"]).select("id", "rep")
    return whole.join(rep.select(F.col("rep").alias("id")), "id", "left_semi").withColumn("n", F.size("s")), member


def _marked():
    """id, n, keys and b: 1 for each of the low bits that an element of the set s has."""

    def run(batches):
        for batch in batches:
            marks = []
            for s in batch.column("s"):
                bits = np.zeros(64 * BITMAP, bool)
                bits[s.values.to_numpy() & (64 * BITMAP - 1)] = True
                marks.append(np.packbits(bits).tobytes())
            yield pa.record_batch([batch.column("id"), batch.column("n"), batch.column("keys"), pa.array(marks, pa.binary())], ["id", "n", "keys", "b"])

    return run


def lsh_similar(sets: DataFrame, threshold: float = 0.5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs found by LSH and verified exactly.

    Equal sets are one row until the end, so copies are compared once.  Blocks
    of signatures meet as in ``lsh_candidates``; sizes and bitmaps, which bound
    the overlap from above, are compared where the pair is made, so only pairs
    that can reach the threshold leave the task, and sets join those.
    """
    scratch = Scratch(sets.sparkSession, "lsh", True)
    cut = scratch.cut
    reps, member = folded(sets.filter("id IS NOT NULL"), cut)
    reps, member = cut(reps), cut(member)
    scratch.drop(reps, member)
    signed = minhash(sets.join(reps.select("id"), "id", "left_semi"), bands * rows)
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("signature")[i * rows + r] for r in range(rows)]) for i in range(bands)])
    kind = reps.schema["id"].dataType.simpleString()
    keyed = cut(signed.select("id", keys.alias("keys")).join(reps, "id").select("id", "n", "keys", "s").mapInArrow(_marked(), f"id {kind}, n int, keys array<long>, b binary"))
    pairs = cut(_sharing(keyed, threshold))
    lists, found = reps.select("id", "s"), []
    rounds = -(-pairs.count() // TRAVEL) or 1
    for k in range(rounds):
        some = pairs.filter(F.pmod(F.xxhash64("id1", "id2"), F.lit(rounds)) == k)
        both = some.join(lists.select(F.col("id").alias("id1"), F.col("s").alias("s1")), "id1").join(lists.select(F.col("id").alias("id2"), F.col("s").alias("s2")), "id2")
        common = F.size(F.array_intersect("s1", "s2"))
        found.append(cut(both.select("id1", "id2", (common / (F.size("s1") + F.size("s2") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)))
    found = cut(reduce(DataFrame.unionByName, found))
    scratch.drop(found, member)
    return _unfolded(found, member)


def _unfolded(found: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of all members of either side, and the copies of a set among themselves."""
    a, b = member.select(F.col("id").alias("a"), F.col("rep").alias("id1")), member.select(F.col("id").alias("b"), F.col("rep").alias("id2"))
    across = found.join(a, "id1").join(b, "id2").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "similarity")
    copies = a.join(b.withColumnRenamed("id2", "id1"), "id1").filter("a < b").select(F.col("a").alias("id1"), F.col("b").alias("id2"), F.lit(1.0).alias("similarity"))
    return across.unionByName(copies)
