"""Average linkage over a table of edges, without a matrix.

Average linkage is reducible: a cluster that two others form is no nearer to a third than the nearer of the two was. So all pairs that are
each other's nearest can merge at once, and the tree is the one that merging the closest pair of all, one after the other, gives. A round is
an aggregate (each cluster's nearest), a self-join of it (who is mutual) and a join that hands the edges on, summing those that meet; pairs
without an edge are at a known far distance and only counted. Ties go to the lower ids, in either way of merging.

Components of few members are linked by a matrix in one task each, larger ones by rounds; which one is a question of cost alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.operators.components import checkpointed

#: Members of a component that a task links by a matrix (2 MB).
SMALL = 512


def average_linkage(d: np.ndarray, cuts: list[float], size: np.ndarray | None = None) -> list[np.ndarray]:
    """For each cut the cluster of every row, as the place of its first member. Merges at a cut's height are made. size: members that a row stands for."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if size is None else size.astype(float)
    owner = np.arange(n)
    out: dict[float, np.ndarray] = {}
    waiting = sorted(cuts)
    while waiting:
        flat = int(d.argmin()) if n else 0
        i, j = divmod(flat, n) if n else (0, 0)
        height = d[i, j] if n else np.inf
        while waiting and height > waiting[0]:
            out[waiting.pop(0)] = owner.copy()
        if not waiting:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i
    return [out[c] for c in cuts]


def linked(nodes: DataFrame, edges: DataFrame, cuts: dict[str, float], far: float = 1.0, small: int = SMALL) -> DataFrame:
    """id and for each cut the least id of its cluster, of every node. nodes: id, component, weight (members that it stands for); edges: component, id_a, id_b
    (id_a < id_b) and d of all pairs of a component that are nearer than far."""
    sizes = checkpointed(nodes.groupBy("component").agg(F.count(F.lit(1)).alias("members")))
    large = sizes.where(F.col("members") > small).select("component")
    few = lambda rows: rows.join(large, "component", "left_anti")
    own = in_tasks(few(nodes), few(edges), cuts, far)
    if large.isEmpty():
        return own
    many = lambda rows: rows.join(large, "component", "left_semi")
    return own.unionByName(in_rounds(many(nodes), many(edges), cuts, far, small))


def in_tasks(nodes: DataFrame, edges: DataFrame, cuts: dict[str, float], far: float) -> DataFrame:
    """linked(), a matrix a component."""
    names, id_type = list(cuts), nodes.schema["id"].dataType.simpleString()
    alone = nodes.select("component", F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.col("weight").cast("double").alias("d"))
    every = edges.select("component", "id_a", "id_b", F.col("d").cast("double").alias("d")).unionByName(alone)  # a node's own entry is its weight

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["id_a"] == frame["id_b"]].sort_values("id_a")
        ids, pairs = own["id_a"].to_numpy(), frame[frame["id_a"] != frame["id_b"]]
        d = np.full((len(ids), len(ids)), far)
        x, y = np.searchsorted(ids, pairs["id_a"]), np.searchsorted(ids, pairs["id_b"])
        d[x, y] = d[y, x] = pairs["d"]
        cut = average_linkage(d, [cuts[c] for c in names], own["d"].to_numpy())
        return pd.DataFrame({"id": ids} | {c: ids[f] for c, f in zip(names, cut, strict=True)})

    return every.groupBy("component").applyInPandas(run, f"id {id_type}, " + ", ".join(f"{c} {id_type}" for c in names))


def twins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, first of every node: the least of those at distance 0 from it that are as far as it is from all others.

    In whatever order these merge, what comes of it is the same; merging them by rounds would take a round for each. Told by two sums of hashes
    over a node's edges and itself."""
    ends = edges.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "d").unionByName(edges.select(F.col("id_b").alias("id"), F.col("id_a").alias("other"), "d"))
    ends = ends.unionByName(nodes.select("id", F.col("id").alias("other"), F.lit(0.0).alias("d")))
    mark = lambda salt: F.sum(F.xxhash64(F.lit(salt), "other", F.col("d") + 0.0).cast("decimal(38,0)")).alias(f"mark{salt}")
    marks = ends.groupBy("id").agg(mark(1), mark(2))
    first = marks.groupBy("mark1", "mark2").agg(F.min("id").alias("first"))
    return marks.join(first, ["mark1", "mark2"]).select("id", "first")


def _height(far: float) -> Column:
    pairs = F.col("na") * F.col("nb")
    return (F.col("s") + F.lit(far) * (pairs - F.col("c"))) / pairs


def _handed_on(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges between the clusters that their ends belong to now, summed. moved: node, to, n (members) of every node that has merged."""
    for x in "ab":
        own = moved.select(F.col("node").alias(x), F.col("to").alias("to"), F.col("n").alias("n"))
        edges = edges.join(own, x, "left").withColumns({x: F.coalesce("to", x), f"n{x}": F.coalesce("n", f"n{x}")}).drop("to", "n")
    swap = lambda p, q: F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q))
    turned = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), swap("na", "nb").alias("na"), swap("nb", "na").alias("nb"), "s", "c")
    return turned.groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def in_rounds(nodes: DataFrame, edges: DataFrame, cuts: dict[str, float], far: float, small: int = SMALL) -> DataFrame:
    """linked(), round by round over all components at once: about as many rounds as the logarithm of a component's size, more where nearest neighbours form
    long chains or many pairs are equally far. What is left when no more than `small` clusters are is linked by a matrix."""
    alike = checkpointed(twins(nodes, edges))
    own = alike.select("id", F.col("first").alias("cluster"))
    sizes = checkpointed(alike.join(nodes.select("id", "weight"), "id").groupBy("first").agg(F.sum("weight").alias("n")))
    moved = checkpointed(alike.join(sizes, "first").select(F.col("id").alias("node"), F.col("first").alias("to"), "n"))
    weighed = edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "d").join(nodes.select(F.col("id").alias("a"), F.col("weight").alias("na")), "a").join(nodes.select(F.col("id").alias("b"), F.col("weight").alias("nb")), "b")
    now = checkpointed(_handed_on(weighed.withColumn("c", F.col("na") * F.col("nb")).withColumn("s", F.col("d") * F.col("c")), moved))
    sizes = sizes.select(F.col("first").alias("cluster"), "n")
    left, rounds = sizes.count(), 0
    ascending = sorted(cuts, key=cuts.__getitem__)
    out = nodes.select("id")
    while ascending and left > small:
        name = ascending[0]
        near = now.select(_height(far).alias("d"), "a", "b", (F.col("na") + F.col("nb")).alias("n")).where(F.col("d") <= cuts[name])
        pair = F.struct("d", "a", "b", "n")
        best = near.select(F.col("a").alias("x"), pair.alias("m")).unionByName(near.select(F.col("b").alias("x"), pair.alias("m"))).groupBy("x").agg(F.min("m").alias("m"))
        mutual = checkpointed(best.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("m.a", "m.b", "m.n"))
        merged = mutual.count()
        if not merged:
            out = checkpointed(out.join(own.select("id", F.col("cluster").alias(name)), "id"))
            ascending.pop(0)
            continue
        left, rounds = left - merged, rounds + 1
        moved = mutual.select(F.col("a").alias("node"), F.col("a").alias("to"), "n").unionByName(mutual.select(F.col("b").alias("node"), F.col("a").alias("to"), "n"))
        now = checkpointed(_handed_on(now, moved))
        gone = mutual.select(F.col("b").alias("cluster"), F.col("a").alias("to"))
        own = own.join(gone, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
        kept = sizes.join(gone, "cluster", "left_anti").join(mutual.select(F.col("a").alias("cluster"), F.col("n").alias("more")), "cluster", "left")
        sizes = kept.select("cluster", F.coalesce("more", "n").alias("n"))
        if not rounds % 4:  # plans grow by a join a round
            own, sizes = checkpointed(own), checkpointed(sizes)
    if ascending:
        rest = in_tasks(sizes.select(F.col("cluster").alias("id"), F.lit(0).alias("component"), F.col("n").alias("weight")), now.select(F.lit(0).alias("component"), F.col("a").alias("id_a"), F.col("b").alias("id_b"), _height(far).alias("d")), {c: cuts[c] for c in ascending}, far)
        out = out.join(own.join(rest.withColumnRenamed("id", "cluster"), "cluster").drop("cluster"), "id")
    return out.select("id", *cuts)
