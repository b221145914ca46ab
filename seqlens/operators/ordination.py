"""Principal coordinates and neighbour joining of distance tables.

Coordinates of few rows come from a matrix in one task, those of more from joins. Neighbour joining needs the whole matrix at once, so it states how many
rows it takes and refuses more."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.operators.components import checkpointed

MAX_ORDINATION = 5000
MAX_TREE = 1000
#: Vectors of a subspace, rounds at most, and what an eigenvalue may change in the last, as a share of the first.
WIDTH, ROUNDS, TOLERANCE = 8, 60, 1e-11


def principal_coordinates(d: np.ndarray, axes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on the first axes of the double-centred matrix, and the share of each among positive eigenvalues."""
    n = len(d)
    centre = np.eye(n) - np.ones((n, n)) / n
    value, vector = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    order = np.argsort(-value)
    value, vector = value[order], vector[:, order]
    positive = value[value > 0]
    kept = min(axes, len(positive))
    out = np.zeros((n, axes))
    out[:, :kept] = vector[:, :kept] * np.sqrt(positive[:kept])
    share = np.zeros(axes)
    share[:kept] = positive[:kept] / positive.sum() if len(positive) else 0
    return out, share


def neighbour_joining(ids: list[str], d: np.ndarray) -> str:
    """The tree in Newick form: at each step the pair of least net divergence is joined."""
    nodes, d = list(ids), d.astype(float).copy()
    if len(nodes) == 1:
        return f"{nodes[0]};"
    while len(nodes) > 2:
        n = len(nodes)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n))
        to_i = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        made = (d[i] + d[j] - d[i, j]) / 2
        name = f"({nodes[i]}:{to_i:.6f},{nodes[j]}:{d[i, j] - to_i:.6f})"
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.vstack([np.column_stack([d[np.ix_(keep, keep)], made[keep]]), np.append(made[keep], 0.0)])
        nodes = [nodes[k] for k in keep] + [name]
    return f"({nodes[0]}:{d[0, 1] / 2:.6f},{nodes[1]}:{d[0, 1] / 2:.6f});"


def _matrix(frame: pd.DataFrame, far: float) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([frame["id_a"], frame["id_b"]]))
    d = np.full((len(ids), len(ids)), far)
    np.fill_diagonal(d, 0.0)
    x, y = np.searchsorted(ids, frame["id_a"]), np.searchsorted(ids, frame["id_b"])
    d[x, y] = d[y, x] = frame["d"]
    return ids, d


def _bounded(pairs: DataFrame, most: int) -> DataFrame:
    n = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().count()
    if n > most:
        raise ValueError(f"{n} rows; this operator takes {most}")
    return pairs.select("id_a", "id_b", "d").withColumn("one", F.lit(0))


def ordination(pairs: DataFrame, far: float = 1.0, id_type: str = "long", most: int = MAX_ORDINATION) -> DataFrame:
    """id, x, y, share_x, share_y: the first two principal coordinates of a distance table (id_a, id_b, d; absent pairs are far apart), each turned so that its
    coordinate of greatest size is positive (ties: that of the lowest id).

    Up to `most` rows go to one task as a matrix, and a share is that of the sum of positive eigenvalues. More rows are never brought together: the same axes come from a subspace that
    the centred matrix is applied to again and again as a join (subspace_axes()), and a share is that of the trace, which equals the sum where no eigenvalue is negative."""
    if pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().count() > most:
        return subspace_axes(pairs, far)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, d = _matrix(frame, far)
        xy, share = principal_coordinates(d)
        xy = xy * np.where(np.take_along_axis(xy, np.abs(np.round(xy, 9)).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        return pd.DataFrame({"id": ids, "x": xy[:, 0], "y": xy[:, 1], "share_x": share[0], "share_y": share[1]})

    return pairs.select("id_a", "id_b", "d", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, f"id {id_type}, x double, y double, share_x double, share_y double")


def centred(pairs: DataFrame, far: float = 1.0) -> DataFrame:
    """id_a, id_b, b (id_a <= id_b) of the double-centred matrix of squared distances, for the pairs of a distance table and each row with itself.

    b = -(d^2 - mean of row a - mean of row b + mean of all) / 2; means are grouped sums in which pairs that are absent count as far apart."""
    square = F.pow(F.col("d"), F.lit(2)) - far * far
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"), square.alias("s"))
    sums = checkpointed(ends.groupBy("id").agg(F.sum("s").alias("s")))
    n, total = sums.agg(F.count(F.lit(1)), F.sum("s")).first()
    means = sums.select("id", ((F.col("s") + far * far * (n - 1)) / n).alias("mean"))
    grand = ((total or 0.0) / n + far * far * (n - 1)) / n if n else 0.0
    every = pairs.select("id_a", "id_b", F.pow(F.col("d"), F.lit(2)).alias("q")).unionByName(sums.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("q")))
    a, b = (means.select(F.col("id").alias(f"id_{x}"), F.col("mean").alias(f"mean_{x}")) for x in "ab")
    return every.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", (-0.5 * (F.col("q") - F.col("mean_a") - F.col("mean_b") + F.lit(grand))).alias("b"))


def subspace_axes(pairs: DataFrame, far: float = 1.0, axes: int = 2, width: int = WIDTH, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """ordination() without a matrix: a subspace of `width` vectors, a column each, meets the table of pairs by two joins a round; what goes to the driver are the sums of products of
    vectors, width by width of them. Rounds end when no leading eigenvalue changes by more than the tolerance's share of the first."""
    names = [f"v{i}" for i in range(width)]
    made = [f"u{i}" for i in range(width)]
    pairs = checkpointed(pairs.select("id_a", "id_b", (F.pow(F.col("d"), F.lit(2)) - far * far).alias("s")))
    ids = checkpointed(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
    start = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5

    def less_mean(rows: DataFrame, columns: list[str]) -> DataFrame:
        mean = rows.agg(*[F.avg(c) for c in columns]).first()
        return rows.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(columns, mean, strict=True)})

    def products(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        return np.array(rows.agg(*[F.sum(F.col(x) * F.col(y)) for x in left for y in right]).first(), float).reshape(len(left), len(right))

    def turned(columns: list[str], m: np.ndarray, to: list[str]) -> list:
        return [functools.reduce(lambda x, y: x + y, [F.col(c) * F.lit(float(w)) for c, w in zip(columns, m[:, j], strict=True)]).alias(t) for j, t in enumerate(to)]

    def orthonormal(rows: DataFrame, columns: list[str]) -> DataFrame:
        value, vector = np.linalg.eigh(products(rows, columns, columns))
        sound = value > value.max() * 1e-14  # of fewer dimensions than vectors, the rest is nothing but rounding
        m = np.where(sound, vector / np.sqrt(np.where(sound, value, 1.0)), 0.0)
        return rows.select("id", *turned(columns, m, names))

    now = checkpointed(less_mean(ids.select("id", *[start(i).alias(v) for i, v in enumerate(names)]), names))
    before = None
    for _ in range(rounds):
        now = checkpointed(orthonormal(now, names))
        a, b = (now.select(F.col("id").alias(f"id_{x}"), *names) for x in "ab")
        of = lambda side, other: pairs.join(side, other).select(F.col("id_b" if other == "id_a" else "id_a").alias("id"), *[(F.col("s") * F.col(v)).alias(u) for v, u in zip(names, made, strict=True)])  # noqa: E731, B023
        summed = of(a, "id_a").unionByName(of(b, "id_b")).groupBy("id").agg(*[F.sum(u).alias(u) for u in made])
        # the vectors' sums are 0, so all pairs at the far distance give each but a multiple of itself
        applied = now.join(summed, "id").select("id", *names, *[(-0.5 * (F.col(u) - far * far * F.col(v))).alias(u) for u, v in zip(made, names, strict=True)])
        applied = checkpointed(less_mean(checkpointed(applied), made))
        inner = products(applied, names, made)
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-value)
        value, vector = value[order], vector[:, order]
        lead = value[:axes]
        if before is not None and np.abs(lead - before).max() <= tolerance * max(abs(lead[0]), 1e-300):
            break
        before = lead
        now = applied.select("id", *[F.col(u).alias(v) for u, v in zip(made, names, strict=True)])
    kept = np.maximum(value[:axes], 0.0)
    found = checkpointed(applied.select("id", *turned(names, vector[:, :axes] * np.sqrt(kept), names[:axes])))
    n, total = ids.count(), pairs.agg(F.sum("s")).first()[0]
    trace = total / n + far * far * (n - 1) / 2
    signs = found.agg(*[F.min_by(v, F.struct(-F.round(F.abs(F.col(v)), 9), F.col("id"))) for v in names[:axes]]).first()
    xy = [F.col(v) * F.lit(-1.0 if s < 0 else 1.0) for v, s in zip(names[:axes], signs, strict=True)]
    share = [F.lit(float(k / trace) if trace > 0 else 0.0) for k in kept]
    return found.select("id", xy[0].alias("x"), xy[1].alias("y"), share[0].alias("share_x"), share[1].alias("share_y"))


def tree(pairs: DataFrame, far: float = 1.0, most: int = MAX_TREE) -> DataFrame:
    """newick: one row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, d = _matrix(frame, far)
        return pd.DataFrame({"newick": [neighbour_joining([str(i) for i in ids], d)]})

    return _bounded(pairs, most).groupBy("one").applyInPandas(run, "newick string")
