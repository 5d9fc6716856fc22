"""Co-occurrence graphs, label propagation, betweenness, modularity, divisive communities."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

#: Edges that a worker holds at most; a larger graph takes the plan by frontiers, whose rows in one go are bounded as well.
LOCAL_EDGES, FRONTIER_ROWS = 200_000, 200_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan: a reliable checkpoint if a folder is set, else a cache whose lineage stays."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    out = df.persist()
    out.count()
    return out


def cooccurrence_edges(pairs: DataFrame, threshold: int) -> DataFrame:
    """src < dst: users who share at least ``threshold`` items.  Users with fewer items are out before they meet."""
    p = pairs.toDF("user", "item").distinct()
    enough = p.groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold).select("user")
    p = p.join(enough, "user", "left_semi")
    a, b = p.alias("a"), p.alias("b")
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.user") < F.col("b.user")))
    return met.groupBy(F.col("a.user").alias("src"), F.col("b.user").alias("dst")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= threshold).select("src", "dst")


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id)."""
    return connected_components(edges, checkpointed).select(F.col("node").alias("id"), "component")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after synchronous rounds; the most frequent label of the neighbors, the smallest of those tied."""
    both = symmetric(edges).persist()
    labels = both.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    best = Window.partitionBy("id").orderBy(F.desc("n"), "label")
    for _ in range(rounds):
        votes = both.join(labels, both.dst == labels.id).groupBy(both.src.alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        labels = checkpointed(votes.withColumn("k", F.row_number().over(best)).filter("k = 1").select("id", "label"))
    both.unpersist()
    return labels


def communities(labels: DataFrame, id: str = "id", label: str = "label") -> DataFrame:
    """members (sorted) and size of each label."""
    return labels.groupBy(label).agg(F.array_sort(F.collect_list(id)).alias("members")).select("members", F.size("members").alias("size"))


def in_order(found: DataFrame) -> DataFrame:
    """Communities by size, then by members."""
    return found.orderBy("size", "members")


def by_betweenness(edges: DataFrame) -> DataFrame:
    """Edges by betweenness, the largest first, then by their ends."""
    return edges.orderBy(F.desc("betweenness"), "src", "dst")


def _frontier_betweenness(edges: DataFrame, rows: int = FRONTIER_ROWS, share: float = 1.0) -> DataFrame:
    """Roots in blocks of so many that a block has at most ``rows`` pairs of root and node; sums of the blocks are added up."""
    both = symmetric(edges).persist()
    nodes = both.select(F.col("src").alias("root")).distinct()
    if share < 1:
        nodes = nodes.filter(F.pmod(F.xxhash64("root"), F.lit(1 << 30)) < int(share * (1 << 30)))
    n = both.select("src").distinct().count()
    blocks = max(1, -(-n * n // rows))
    out = None
    for b in range(blocks):
        found = _frontiers(both, nodes.filter(F.pmod(F.xxhash64("root", F.lit(7)), F.lit(blocks)) == b))
        if found is not None:
            out = checkpointed(found) if out is None else checkpointed(out.unionByName(found).groupBy("src", "dst").agg(F.sum("betweenness").alias("betweenness")))
    both.unpersist()
    zero = edges.select("src", "dst", F.lit(0.0).alias("betweenness"))
    if out is None:
        return zero
    # an edge that no sampled root reaches has 0
    out = out if share == 1 else zero.unionByName(out.withColumn("betweenness", F.col("betweenness") / share)).groupBy("src", "dst").agg(F.sum("betweenness").alias("betweenness"))
    return out


def _frontiers(both: DataFrame, roots: DataFrame) -> DataFrame | None:
    """All roots at once: one join for each level forward, one for each level back."""
    level = checkpointed(roots.select("root", F.col("root").alias("v"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("root", "v")
    while True:
        reached = level.join(both, level.v == both.src).groupBy("root", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = checkpointed(reached.join(seen, ["root", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("root", "v"))
    shares, credit = None, None
    for up, down in zip(levels[-2::-1], levels[:0:-1]):
        child = down if credit is None else down.join(credit, ["root", "v"], "left").withColumn("extra", F.coalesce("extra", F.lit(0.0)))
        child = child.withColumn("extra", F.lit(0.0)) if credit is None else child
        down_edges = up.select("root", F.col("v").alias("parent"), F.col("paths").alias("parent_paths")).join(both, F.col("parent") == both.src).join(child.select("root", F.col("v").alias("dst"), "paths", "extra"), ["root", "dst"])
        part = checkpointed(down_edges.select("root", "parent", "dst", ((1 + F.col("extra")) * F.col("parent_paths") / F.col("paths")).alias("share")))
        credit = part.groupBy("root", F.col("parent").alias("v")).agg(F.sum("share").alias("extra"))
        shares = part if shares is None else shares.unionByName(part)
    if shares is None:
        return None
    return shares.groupBy(F.least("parent", "dst").alias("src"), F.greatest("parent", "dst").alias("dst")).agg((F.sum("share") / 2).alias("betweenness"))


def shares_of_roots(roots, neighbors: dict) -> dict:
    """Sum over the roots of each directed edge's share of shortest paths, by breadth-first search and credits back."""
    out: dict = {}
    for root in roots:
        level, paths, parents, order, queue = {root: 0}, {root: 1.0}, {root: []}, [], deque([root])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in neighbors.get(v, ()):
                if w not in level:
                    level[w], paths[w], parents[w] = level[v] + 1, 0.0, []
                    queue.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
                    parents[w].append(v)
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in parents[w]:
                share = credit[w] * paths[v] / paths[w]
                credit[v] += share
                edge = (v, w) if v < w else (w, v)
                out[edge] = out.get(edge, 0.0) + share
    return out


def _local_betweenness(edges: DataFrame, listed: list) -> DataFrame:
    """Roots dealt to tasks, each with the whole edge list, whose size the caller has checked."""
    spark = edges.sparkSession
    sent = spark.sparkContext.broadcast(listed)
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        neighbors: dict = {}
        for a, b in sent.value:
            neighbors.setdefault(a, []).append(b)
            neighbors.setdefault(b, []).append(a)
        for frame in frames:
            found = shares_of_roots(frame["root"].tolist(), neighbors)
            yield pd.DataFrame([(a, b, s) for (a, b), s in found.items()], columns=["src", "dst", "share"])

    roots = symmetric(edges).select(F.col("src").alias("root")).distinct().repartition(max(spark.sparkContext.defaultParallelism, 1))
    return roots.mapInPandas(run, f"src {kind}, dst {kind}, share double").groupBy("src", "dst").agg((F.sum("share") / 2).alias("betweenness"))


def edge_betweenness(edges: DataFrame, local_edges: int = LOCAL_EDGES, share: float = 1.0) -> DataFrame:
    """src, dst, betweenness: each pair of nodes shares one unit over its shortest paths.

    With ``share`` below 1 a graph over ``local_edges`` edges is estimated from
    that share of the roots, dealt by hash: the sum over n sampled roots has a
    relative error of about 1 / sqrt(n) for an edge that most roots use.
    """
    edges = edges.select("src", "dst").persist()
    listed = edges.limit(local_edges + 1).collect() if edges.count() <= local_edges else None  # at most local_edges pairs
    if listed is not None:
        return _local_betweenness(edges, [tuple(r) for r in listed])
    out = _frontier_betweenness(edges, share=share)
    edges.unpersist()
    return out


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, q: the sum over communities of inner edges / m - (degrees / 2 m)^2.  labels: id, community."""
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    a, b = labels.toDF("src", "c"), labels.toDF("dst", "d")
    inner = edges.join(a, "src").join(b, "dst").filter("c = d").groupBy("c").agg(F.count(F.lit(1)).alias("inner_edges"))
    deg = degrees(edges).join(labels.toDF("id", "c"), "id").groupBy("c").agg(F.sum("degree").alias("deg"))
    parts = deg.join(inner, "c", "left").crossJoin(F.broadcast(m))  # m is one row
    return parts.agg(F.sum(F.coalesce("inner_edges", F.lit(0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("q"))


def divisive_communities(edges: DataFrame, score_initial: bool = False, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, float]:
    """(id, community) of the best modularity while the edges of highest betweenness are cut, and that modularity.

    A graph of at most ``local_edges`` edges is held; betweenness of the
    components that a cut touched is computed by tasks in parallel.  A larger
    one stays in tables: the same steps as joins, a few jobs for each cut.
    """
    spark = edges.sparkSession
    if edges.count() > local_edges:
        return _divisive_tables(edges, score_initial)
    listed = [tuple(r) for r in edges.select("src", "dst").collect()]
    kind = edges.schema["src"].dataType.simpleString()
    alive: dict = {}
    for a, b in listed:
        alive.setdefault(a, set()).add(b)
        alive.setdefault(b, set()).add(a)
    degree, m = {v: len(n) for v, n in alive.items()}, len(listed)

    def parts() -> dict:
        label: dict = {}
        for v in sorted(alive):
            if v not in label:
                label[v], stack = v, [v]
                while stack:
                    for w in alive[stack.pop()]:
                        if w not in label:
                            label[w] = v
                            stack.append(w)
        return label

    def quality(label: dict) -> float:
        inner, deg = {}, {}
        for v, c in label.items():
            deg[c] = deg.get(c, 0) + degree[v]
        for a, b in listed:
            if label[a] == label[b]:
                inner[label[a]] = inner.get(label[a], 0) + 1
        return sum(inner.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in deg.items())

    label = parts()
    best = (quality(label), label) if score_initial and m else (float("-inf"), label)
    known: dict = {}
    touched, left = set(alive), m
    while left:
        fresh = {}
        groups: dict = {}
        for v in touched:
            groups.setdefault(label[v], []).append(v)
        many = [(v,) for g in groups.values() if len(g) > 500 for v in g]
        for g in groups.values():
            if len(g) <= 500:
                fresh |= shares_of_roots(g, alive)
        if many:  # large components: roots dealt to the executors
            large = {label[v] for (v,) in many}
            now = spark.createDataFrame([(a, b) for a in alive for b in alive[a] if a < b and label[a] in large], f"src {kind}, dst {kind}")
            fresh |= {(r.src, r.dst): 2 * r.betweenness for r in edge_betweenness(now, local_edges).collect()}
        known = {e: s for e, s in known.items() if e[0] not in touched} | fresh
        worst = max(round(s, 9) for s in known.values())
        cut = [e for e, s in known.items() if round(s, 9) == worst]
        hit = {label[a] for a, _ in cut}
        touched = {v for v in alive if label[v] in hit}
        for a, b in cut:
            alive[a].discard(b)
            alive[b].discard(a)
            known.pop((a, b))
        left -= len(cut)
        label = parts()
        q = quality(label)
        if q > best[0] + 1e-12:
            best = (q, label)
    rows = sorted(best[1].items())
    return spark.createDataFrame(rows, f"id {kind}, community {kind}"), best[0] if m else 0.0


def _divisive_tables(edges: DataFrame, score_initial: bool = False) -> tuple[DataFrame, float]:
    """The divisive search over tables: after a cut, betweenness and components are found anew only for the components that it touched."""
    edges = checkpointed(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    nodes = checkpointed(symmetric(edges).select(F.col("src").alias("id")).distinct())
    found = checkpointed(components(edges))
    labels = found.select("id", F.col("component").alias("community"))
    q = modularity(edges, labels).first().q
    best = (q, labels) if score_initial and q is not None else (float("-inf"), labels)
    known = checkpointed(edge_betweenness(edges, 0))
    while not known.isEmpty():
        worst = F.round("betweenness", 9)
        top = known.agg(F.max(worst)).first()[0]
        cut = checkpointed(known.filter(worst == top))
        hit = cut.join(labels, cut.src == labels.id).select("community").distinct()
        touched = checkpointed(labels.join(hit, "community", "left_semi").select("id"))
        rest = known.filter(worst != top).select("src", "dst", "betweenness")
        inside = rest.join(touched, rest.src == touched.id, "left_semi")
        same = rest.join(touched, rest.src == touched.id, "left_anti")
        fresh = checkpointed(inside.select("src", "dst"))
        parts = components(fresh) if not fresh.isEmpty() else fresh.select(F.col("src").alias("id"), F.col("dst").alias("component"))
        split = touched.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("community"))
        labels = checkpointed(labels.join(touched, "id", "left_anti").unionByName(split))
        known = checkpointed(same.unionByName(edge_betweenness(fresh, 0)) if not fresh.isEmpty() else same)
        q = modularity(edges, labels).first().q
        if q > best[0] + 1e-12:
            best = (q, labels)
    return nodes.join(best[1], "id"), best[0] if best[0] > float("-inf") else 0.0
