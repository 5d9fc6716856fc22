"""N-gram Jaccard join: components of documents whose shingle sets are similar enough.

The join is a blocked sparse product of the document by shingle incidence
matrix with its transpose:

1. Documents with equal sets are one row of the matrix (by a 128-bit digest);
   copies of any number cost no more.
2. Two rows can only reach the threshold t if they share one of the
   n - ceil(t n) + 1 rarest shingles of each, for any order common to all rows.
   The order puts the shingles with the highest counts in the corpus last, so
   passages that thousands share make no blocks.  The matrix keeps these
   entries; a block is a column with two rows or more, and columns with the
   same rows are one column with a weight.
3. Within a column only rows whose sizes allow the threshold are multiplied,
   and the entries that a pair shares are added up.  First each row meets one
   row of each column and size class; a pair whose shared entries cannot reach
   the bound of its sizes goes, and the rest have their exact overlap counted.
   What is linked becomes one component.  Then pairs across components are
   taken in the same way, and last all of them: in each column the smaller
   components against the others.  Columns are ordered, those with few rows
   first; if a column is the first that a pair shares, both rows' entries from
   it on bound what they share, and most pairs are dropped by that before they
   are made.
   Pairs inside a component need no count, so a group of near copies costs
   rows, not pairs, and no link between components is lost.

A row of the matrix is a set, not a doc_id.  Rows that share a doc_id are one
document, so their sets are in one component, and each of their texts is
compared; a row without a doc_id links like any other, and its component_id is
the smallest doc_id that it reaches, null if there is none.  Null and wordless
texts have an empty set and link with nothing: their component_id is their
doc_id.  Repeated rows fall together.  An empty table gives no rows.

Columns of frequent shingles are salted into parts of about ``PART`` rows, so no
task holds such a column whole.  Sets travel with all 64 bits of their
shingles' hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import connected_components

from . import common
from .shingles import Words, shingle_sets

PERCENT, HEAVY, HEAVY_MIN, BUFFER, PART = 80, 1 << 16, 8, 2_000_000, 1000
#: Bits of the filter that keeps sets from travelling when no pair needs them; a false positive only costs bytes.
FILTER_BITS = 1 << 24
ROUNDS = 1
_SIGN = np.uint64(1 << 63)  # makes signed order of unsigned hashes


def heavy_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The HEAVY most frequent shingles and their counts, of those that some task met HEAVY_MIN times; they only set the order."""

    def run(batches):
        cache, held, size = Words(), [], 0

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= HEAVY_MIN
            return pa.record_batch([pa.array(u[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), cache):
                held.append(s)
                size += len(s)
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = common.map_arrow(docs.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    h, n = np.array(rows["h"], np.int64).view(np.uint64), np.array(rows["n"], np.int64)
    order = h.argsort()
    return h[order], n[order]


#: The column that names a row by its doc_id and text.
ROW = "__row"


def _row() -> Column:
    """128 bits of doc_id and text; null and empty are different."""
    told = F.concat(F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), F.lit("\n"), F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n")))
    return F.unhex(F.md5(told.cast("binary")))


def _signatures(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        cache, (hk, hn) = Words(), sent.value
        for batch in batches:
            n, digest, prefix, parts, last = [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), cache):
                size = len(s)
                n.append(size)
                digest.append(_digest(s))
                keep = size - -(-percent * size // 100) + 1 if size else 0
                f = np.zeros(size, np.int64)
                if len(hk):
                    at = np.minimum(np.searchsorted(hk, s), len(hk) - 1)
                    f = np.where(hk[at] == s, hn[at], 0)
                order = np.argsort(f, kind="stable")[:keep]
                prefix.append(s[order].view(np.int64))
                parts.append((f[order] // PART + 1).astype(np.int32))
                last.append((int(f[order[-1]]), int((s[order[-1]] ^ _SIGN).view(np.int64))) if size else (0, 0))
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate(x) if x else np.zeros(0, kind)) for x, kind in ((prefix, np.int64), (parts, np.int32))]
            yield pa.record_batch([batch.column(ROW), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists, pa.array([x for x, _ in last], pa.int64()), pa.array([x for _, x in last], pa.int64())], [ROW, "doc_id", "n", "digest", "prefix", "parts", "last_count", "last_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(docs.select(_row().alias(ROW), "doc_id", "text"), run, f"{ROW} binary, doc_id {kind}, n long, digest binary, prefix array<long>, parts array<int>, last_count long, last_hash long")


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _marks(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 24)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set (64 bits a shingle) of nodes, which have node, digest and rep (a doc_id that has the set, or null)."""

    def mark(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            x = _marks(np.array(batch.column(0), np.int64))
            np.bitwise_or.at(bits, x >> np.uint64(3), (1 << (x & np.uint64(7))).astype(np.uint8))
        for k, part in enumerate(bits.reshape(16, -1)):
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "bits"])

    bits = np.zeros((16, FILTER_BITS // 128), np.uint8)
    marked = common.map_arrow(nodes.select(F.coalesce(F.col("rep").cast("long"), F.lit(0))).repartition(8), mark, "k int, bits binary")
    for r in marked.toLocalIterator():  # 8 * 16 parts of fixed size
        bits[r.k] |= np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    def run(batches):
        cache, bits = Words(), sent.value
        for batch in batches:
            x = _marks(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1)
            sets = [s for s in shingle_sets(batch.column(1).take(pa.array(keep)).to_pylist(), cache) if len(s)]
            raw = [s.astype("<u8", copy=False).tobytes() for s in sets]
            yield pa.record_batch([pa.array(map(_digest, sets), pa.binary()), pa.array(raw, pa.binary())], ["digest", "set"])

    found = common.map_arrow(docs.select("doc_id", "text"), run, "digest binary, set binary")
    # of the rows with a set that is wanted one; others that passed the filter go before anything is shuffled by nodes
    return found.groupBy("digest").agg(F.first("set").alias("set")).join(nodes.select("node", "digest"), "digest").select("node", "set")


def _links(docs: DataFrame, ids: DataFrame, pairs: DataFrame, percent: int, cut) -> DataFrame:
    """The pairs x, y whose exact overlap reaches the bound of their sizes; only their sets travel."""

    def run(batches):
        for batch in batches:
            keep = []
            last, left = None, None
            for a, b in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist()):
                if a != last:
                    last, left = a, np.frombuffer(a, "<u8")
                right = np.frombuffer(b, "<u8")
                both = np.concatenate([left, right])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                keep.append(100 * overlap >= percent * (len(left) + len(right) - overlap))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    pairs = cut(pairs.select("x", "y"))
    wanted = ids.select("node", "digest", "rep").join(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "node", "left_semi")
    sets = _sets(docs, wanted)
    with_x = pairs.join(sets.select(F.col("node").alias("x"), F.col("set").alias("sx")), "x")
    with_y = with_x.join(sets.select(F.col("node").alias("y"), F.col("set").alias("sy")), "y")
    return common.map_arrow(with_y.select("x", "y", "sx", "sy"), run, "x long, y long")


def _near(a, b, percent: int):
    """Sizes that allow the threshold."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _reach(most_x: str, most_y: str, percent: int):
    """Whether an overlap can reach the bound of two sizes, x.n and y.n.

    Take the row whose kept shingles end first in the common order.  Whatever
    both rows have up to there, both have kept, so the overlap is at most the
    kept shingles that they share and the rest of that row.
    """
    need = f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}"
    first = "x.last_count < y.last_count OR (x.last_count = y.last_count AND x.last_hash <= y.last_hash)"
    return F.expr(f"CASE WHEN {first} THEN {most_x} ELSE {most_y} END >= {need}")


def _classes(docs: DataFrame, percent: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n, digest of every row; digest, component, component_id of every set)."""
    cut = scratch.cut
    sig = cut(_signatures(docs, heavy_shingles(docs), percent))
    rows = cut(sig.select(ROW, "doc_id", "n", "digest"))  # all that is read of a signature once its kept shingles are entries
    sound = sig.filter(F.col("digest").isNotNull())
    # nodes are numbered in the order of their smallest doc_ids: the first of a column, which all its rows meet, is the oldest
    ids = cut(sound.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("last_count").alias("last_count"), F.first("last_hash").alias("last_hash")))
    ids = cut(ids.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep", "digest").sortWithinPartitions("rep", "digest").withColumn("node", F.monotonically_increasing_id()))
    kept = sound.groupBy("digest").agg(F.first(F.struct("n", "prefix", "parts")).alias("k")).join(ids.select("digest", "node"), "digest")
    entries = kept.select("node", "k.n", F.explode(F.arrays_zip("k.prefix", "k.parts")).alias("e")).select("node", "n", F.col("e.prefix").alias("h"), (F.col("e.parts") > 1).alias("hot"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("e.parts")).cast("int").alias("salt"))
    # columns with two rows or more whose sizes are near enough; of a salted column every row may have such a one in another part
    w = Window.partitionBy("h", "salt").orderBy("n", "node")
    lag, lead = F.lag("n").over(w), F.lead("n").over(w)
    seen = entries.select("h", "salt", "node", "n", "hot", F.when(lag.isNotNull() & _near(lag, F.col("n"), percent), F.lag("node").over(w)).alias("before"), (lead.isNotNull() & _near(lead, F.col("n"), percent)).alias("after"))
    every = cut(seen.filter(F.col("before").isNotNull() | F.col("after") | F.col("hot")).drop("after", "hot"))
    scratch.drop(rows, ids, every)
    # columns with the same rows are one column of their number's weight
    same = every.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2")).groupBy("k", "s1", "s2").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("weight")).filter("k > 1")
    # of each entry the weight of its row's entries from it on, columns with fewer rows first
    back = Window.partitionBy("node").orderBy(F.desc("k"), F.desc("h"))
    onward = F.sum("weight").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = cut(every.join(same.select("h", "k", "weight"), "h").withColumn("onward", onward).withColumn("prior", F.lead("h").over(back)).drop("k"))
    scratch.drop(rows, ids, blocks)
    # of each row: size, the end of its kept shingles, and what the rest can add to an overlap
    rest_of = F.expr(f"({percent} * n + 99) div 100 - 1")
    info = cut(ids.join(blocks.select("node").distinct(), "node", "left_semi").select("node", F.struct("n", "last_count", "last_hash", rest_of.alias("rest")).alias("d")))

    def linked(proposed: DataFrame) -> DataFrame:
        """Of each x the partner that it shares most columns with, if that can be enough and is."""
        counts = proposed.filter("nx <> ny").groupBy("nx", "ny").agg(F.sum("weight").alias("k"))
        counts = counts.join(info.select(F.col("node").alias("nx"), F.col("d").alias("x")), "nx").join(info.select(F.col("node").alias("ny"), F.col("d").alias("y")), "ny")
        counts = counts.filter(_near(F.col("x.n"), F.col("y.n"), percent) & _reach("k + x.rest", "k + y.rest", percent))
        return _links(docs, ids, counts.groupBy(F.col("nx").alias("x")).agg(F.max_by("ny", F.struct("k", -F.col("ny"))).alias("y")), percent, cut)

    # a size class spans a factor of less than 100 / percent, so its rows are near enough
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 0.999999)) if percent < 100 else F.col("n")
    first = blocks.withColumn("class", size_class)
    # every row meets the first of its column and size class, which is told to each part of the column
    part = first.groupBy("h", "class", "salt").agg(F.min("node").alias("low"))
    lead = part.groupBy(F.col("h").alias("h2"), F.col("class").alias("class2")).agg(F.min("low").alias("ny"))
    lead_of = part.join(lead, (F.col("h") == F.col("h2")) & (F.col("class") == F.col("class2"))).select("h", "class", "salt", "ny")
    star = first.join(lead_of, ["h", "class", "salt"]).select(F.col("node").alias("nx"), "ny", "weight")
    links = cut(linked(star.unionByName(blocks.filter("before is not null").select(F.col("node").alias("nx"), F.col("before").alias("ny"), "weight"))))
    for _ in range(ROUNDS):
        scratch.drop(rows, ids, blocks, info, links)
        named = _named(blocks, connected_components(links, cut, "x", "y"))
        both = cut(named.groupBy("h").agg(F.min(F.struct("component", "node")).alias("lo"), F.max(F.struct("component", "node")).alias("hi")).filter("lo.component <> hi.component"))  # a table, so that a large column's rows are split in the join
        to = named.join(both, "h").select(F.col("node").alias("nx"), F.when(F.col("component") != F.col("lo.component"), F.col("lo.node")).otherwise(F.col("hi.node")).alias("ny"), "weight")
        links = cut(links.unionByName(linked(to)).distinct())

    scratch.drop(rows, ids, blocks, info, links)
    # what is left: in each column the smaller components against all others, if it can be the first that a pair shares
    named = cut(_named(blocks, connected_components(links, cut, "x", "y")))
    by = named.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k"))
    main = cut(by.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"))
    mixed = named.join(main, "h").join(info, "node")
    a = mixed.filter("component <> main").select("h", F.col("node").alias("nx"), F.col("d").alias("x"), F.col("component").alias("cx"), F.col("onward").alias("ox"), F.col("prior").alias("px"))
    b = mixed.select("h", F.col("node").alias("ny"), F.col("d").alias("y"), F.col("component").alias("cy"), F.col("onward").alias("oy"), F.col("prior").alias("py"), "main")
    fresh = F.col("px").isNull() | F.col("py").isNull() | (F.col("px") != F.col("py"))  # else the pair has met in the column before
    apart = a.join(b, (a.h == b.h) & fresh & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("nx") < F.col("ny"))) & _near(F.col("x.n"), F.col("y.n"), percent) & _reach("least(ox, oy) + x.rest", "least(ox, oy) + y.rest", percent))
    pairs = apart.select(F.least("nx", "ny").alias("x"), F.greatest("nx", "ny").alias("y")).distinct()
    links = cut(links.unionByName(_links(docs, ids, pairs, percent, cut)).unionByName(_same_document(rows.filter(F.col("digest").isNotNull()), ids)))
    scratch.drop(rows, ids, links)
    label = connected_components(links, cut, "x", "y")

    owned = ids.select("digest", "node", "rep").join(label, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    # components of more than one set; their smallest doc_id is a table, so that a large component's rows are split in the join
    least = cut(ids.select("node", "rep").join(label, "node").groupBy("component").agg(F.min("rep").alias("least")))
    out = cut(owned.join(least, "component", "left").select("digest", "component", F.coalesce("least", "rep").alias("component_id")))
    return rows, out


def _same_document(sound: DataFrame, ids: DataFrame) -> DataFrame:
    """x, y: sets of rows that share a doc_id."""
    several = sound.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id", "a")
    others = sound.join(several, "doc_id").filter("digest <> a").select("a", "digest").distinct()
    return others.join(ids.select(F.col("digest").alias("a"), F.col("node").alias("x")), "a").join(ids.select("digest", F.col("node").alias("y")), "digest").select("x", "y")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    scratch = common.Scratch(docs.sparkSession, "jaccard", True)
    rows, sets = _classes(docs, percent, scratch)
    out = scratch.cut(rows.join(sets, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
    scratch.drop(out)
    return out


def _named(blocks: DataFrame, label: DataFrame) -> DataFrame:
    return blocks.select("h", "node", "n", "weight", "onward", "prior").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component; of rows equal in doc_id and text one.

    A component without any doc_id keeps one row; a text without words keeps its own.
    """
    scratch = common.Scratch(docs.sparkSession, "jaccard", True)
    rows, sets = _classes(docs, percent, scratch)
    rows = rows.join(sets, "digest", "left")
    own = rows.filter(F.col("digest").isNull() | (F.col("doc_id") == F.col("component_id"))).select(ROW)
    nameless = rows.filter(F.col("digest").isNotNull() & F.col("component_id").isNull()).groupBy("component").agg(F.min(ROW).alias(ROW)).select(ROW)
    keep = scratch.cut(own.unionByName(nameless).distinct())
    scratch.drop(keep)
    return docs.withColumn(ROW, _row()).join(keep, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))


_WORDS = r"[x FOR x IN regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') IF x <> '']"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
