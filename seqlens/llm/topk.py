"""Exact nearest vectors by inner product, by selection from histograms (operator 12).

Vectors become whole numbers and are kept as blocks of rows; a stated set of queries, in blocks of its own, meets every block of
candidates in a grid of lanes, by an equi-join of block and lane. No score is stored. Each pass scores everything anew and counts, for every query,
the scores in BINS equal parts of the range in which the kth best must lie; the counts of all lanes are added up, and the part that
holds the kth best becomes the next range, until it is a single number. A last pass keeps what scores above that number, and of
what equals it the smallest ids that are needed.

A lane tells its highest parts only, down to its own kth best score: below that no kth best of all can lie. So a query sends at
most k rows a lane in each pass, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import checkpointed, map_batches

K = 20
SCALE = 64
#: Parts of a range in one pass.
BINS = 256
#: Queries of a block, on average, and candidates of a lane.
QUERY_ROWS = 2048
LANE_ROWS = 8192
#: Bytes of a block of queries or a lane, on average.
LANE_BYTES = 16 << 20
#: Rows of a block at most.
BLOCK_ROWS = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision, as array<long> (beyond long: its limits). Null for a vector that is null or has a null or
    non-finite component (one that overflows when scaled is not finite)."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(scaled, lambda x: F.floor(x).cast("long")))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of components; shorter vectors end in zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def pack(m: np.ndarray) -> tuple[bytes, int]:
    """A matrix's rows one after the other, and the bytes of a component: two where these hold all."""
    small = not m.size or (m.min() >= -(1 << 15) and m.max() < 1 << 15)
    return m.astype(np.int16 if small else np.int64).tobytes(), 2 if small else 8


def unpack(packed: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(packed, np.int16 if width == 2 else np.int64).reshape(rows, len(packed) // (width * rows))


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exactly; beyond long: its limits. Of vectors of unequal length the shorter ends in zeros."""
    n = min(q.shape[1], c.shape[1])
    q, c = q[:, :n], c[:, :n]
    largest = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (q, c)]
    most = n * largest[0] * largest[1]
    if most < 1 << 24:  # whole numbers up to there are exact in either kind of float
        return (q.astype(np.float32) @ c.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if most <= MOST:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, LEAST, MOST).astype(np.int64) if exact.size else np.zeros((len(q), len(c)), np.int64)


def blocks(vectors: DataFrame, id_col: str, vector_col: str, scale: int, block_rows: int) -> DataFrame:
    """block, ids, m, width, norm: vectors by up to block_rows (BLOCK_ROWS at most), ascending by id (null ids last), written to the shared folder.

    A row's number is its block's times BLOCK_ROWS and its place there; norm is the greatest length of a vector."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), whole(vectors[vector_col], scale).alias("v")).where("v IS NOT NULL")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                part = batch.slice(at, block_rows)
                part = part.take(pc.array_sort_indices(part.column(0), null_placement="at_end"))
                m = matrix(part.column(1))
                packed, width = pack(m)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                norm = float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max()) if m.size else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([packed], pa.binary()), pa.array([width], pa.int32()), pa.array([norm])], ["block", "ids", "m", "width", "norm"])
                number += 1

    return checkpointed(map_batches(rows, gather, "block long, ids array<bigint>, m binary, width int, norm double"))


def query_blocks(own: DataFrame, every: int, query_rows: int) -> tuple[DataFrame, int]:
    """qb, rows, ids, m, width: the queries among all blocks (ids divisible by every), ascending by number, dealt by a hash of it into blocks of query_rows on average; and how many blocks."""
    each = own.select("block", "m", "width", F.size("ids").alias("rows"), F.posexplode("ids").alias("place", "id")).where(F.col("id") % every == 0)
    long = (F.length("m") / F.col("rows")).cast("int")
    picked = checkpointed(each.select((F.col("block") * BLOCK_ROWS + F.col("place")).alias("row"), "id", F.substring("m", F.col("place") * long + 1, long).alias("v"), "width"))
    total, size = picked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("v").cast("long")), F.lit(0))).first()
    parts = max(1, math.ceil(total / query_rows), math.ceil(size / LANE_BYTES))

    def gather(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        own = own.sort_by("row")
        vectors = [np.frombuffer(v, np.int16 if w == 2 else np.int64) for v, w in zip(own["v"].to_pylist(), own["width"].to_pylist(), strict=True)]
        m = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        packed, width = pack(m)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own[c].combine_chunks()) for c in ("row", "id")]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *lists, pa.array([packed], pa.binary()), pa.array([width], pa.int32())], ["qb", "rows", "ids", "m", "width"])

    dealt = picked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    return checkpointed(dealt.groupBy("qb").applyInArrow(gather, "qb int, rows array<bigint>, ids array<bigint>, m binary, width int")), parts


def scored(asked: pa.Table, lane: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """For every block of a lane: scores of a block's queries (rows) by its vectors (columns), what takes part (not a query's own row), and the vectors' ids."""
    own = numbers(asked, "rows")
    q = unpack(asked["m"][0].as_py(), asked["width"][0].as_py(), len(own))
    for block, ids, packed, width in zip(lane["block"].to_pylist(), lane["ids"], lane["m"].to_pylist(), lane["width"].to_pylist(), strict=True):
        m = unpack(packed, width, len(ids))
        score = inner(q, m)
        part = np.ones(score.shape, bool)
        place = own - block * BLOCK_ROWS
        here = np.flatnonzero((place >= 0) & (place < len(m)))
        part[here, place[here]] = False
        yield score, part, ids.values


def numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def count_parts(span: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogroups of a query block (with lo and need of its queries) and a lane: row, part, n of the highest parts, each width wide, of the range of span numbers from lo on."""

    def run(asked: pa.Table, lane: pa.Table) -> pa.Table:
        names, kinds = ["row", "part", "n"], (pa.int64(), pa.int32(), pa.int64())
        if not len(asked) or not len(lane):
            return pa.table([pa.array([], k) for k in kinds], names)
        row, lo, need = numbers(asked, "rows"), numbers(asked, "lo"), numbers(asked, "need")
        total = np.zeros(len(row) * BINS, np.int64)
        base = (np.arange(len(row)) * BINS)[:, None]
        for score, part, _ in scored(asked, lane):
            above = score.view(np.uint64) - lo.view(np.uint64)[:, None]  # true for scores from lo on, whatever the range
            part &= (score >= lo[:, None]) & (above <= np.uint64(span - 1))
            if width > 1:
                above //= np.uint64(width)
            total += np.bincount((base + above.view(np.int64))[part], minlength=len(total))
        falling = total.reshape(len(row), BINS)[:, ::-1]
        higher = falling.cumsum(axis=1) - falling
        i, j = np.nonzero((falling > 0) & (higher < need[:, None]))
        return pa.table([pa.array(c, k) for c, k in zip((row[i], BINS - 1 - j, falling[i, j]), kinds, strict=True)], names)

    return run


def take_best(asked: pa.Table, lane: pa.Table) -> pa.Table:
    """For the same cogroups, when lo is the kth best score: row, query_id, score, vec_id of all that score more, and of those that score as much need, the least ids."""
    names, kinds = ["row", "query_id", "score", "vec_id"], (pa.int64(),) * 4
    if not len(asked) or not len(lane):
        return pa.table([pa.array([], k) for k in kinds], names)
    row, query, lo, need = (numbers(asked, c) for c in ("rows", "ids", "lo", "need"))
    found = []
    for score, part, ids in scored(asked, lane):
        level = (score == lo[:, None]) & part
        level &= level.cumsum(axis=1) <= need[:, None]  # a block's vectors ascend by id
        i, j = np.nonzero(level | ((score > lo[:, None]) & part))
        found.append(pa.table([pa.array(c, pa.int64()) for c in (row[i], query[i], score[i, j])] + [ids.take(pa.array(j))], names))
    return pa.concat_tables(found)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE, query_rows: int = QUERY_ROWS, lane_rows: int = LANE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every row whose id is divisible by every, with every other row, ties to the smaller id.

    Components are floor(scale * x). Rows with a null vector or one with a null or non-finite component take no part. A row with a null id asks nothing and is found
    like others, after them in ties. Repeated rows each ask and are each found, also by each other. With fewer than k others all are returned; a table
    without two such rows gives none. An empty vector, and what a shorter one lacks, counts as zeros. A score beyond long is the nearest long.
    Vectors of any length are taken whole. Other columns are not read."""
    own = blocks(vectors, id_col, vector_col, scale, block_rows)
    rows, norm, size = own.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.max("norm"), F.sum(F.length("m").cast("long"))).first()
    need = min(k, rows - 1)
    if need <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, query_parts = query_blocks(own, every, query_rows)
    lanes = max(1, math.ceil(rows / lane_rows), math.ceil(size / LANE_BYTES))
    # a lane is at most LANE_BYTES on average, and there are as many copies of a vector as blocks of queries
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane")
    right = own.select("block", "ids", "m", "width", lane, F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("qb")).groupBy("qb", "lane")

    def grid(state: DataFrame):
        lists = state.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("row", "lo", "need"))).alias("all")).select("qb", F.col("all.lo").alias("lo"), F.col("all.need").alias("need"))
        every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
        return asked.join(lists, "qb").select("qb", "rows", "ids", "m", "width", "lo", "need", every_lane).groupBy("qb", "lane").cogroup(right)

    bound = min(math.ceil(norm * norm * (1 + 1e-9)) + 1, 1 << 63)  # no inner product is greater than the product of lengths
    state = asked.select("qb", F.explode("rows").alias("row"), F.lit(-bound).cast("long").alias("lo"), F.lit(need).cast("long").alias("need"))
    span = min(2 * bound + 1, 1 << 64)
    while span > 1:
        width = -(-span // BINS)
        counted = grid(state).applyInArrow(count_parts(span, width), "row long, part int, n long").groupBy("row", "part").agg(F.sum("n").alias("n"))
        falling = counted.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "n")), asc=False).alias("parts"))
        state = checkpointed(state.join(falling, "row").select("qb", "row", narrowed(width).alias("s")).select("qb", "row", "s.lo", "s.need"))
        span = width
    found = grid(state).applyInArrow(take_best, "row long, query_id long, score long, vec_id long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def narrowed(width: int) -> Column:
    """lo of the part that holds the needth best score (parts: falling, with their counts), and how many are needed of that part."""
    first = F.struct(F.lit(-1).alias("part"), F.col("need").alias("need"))
    held = F.aggregate("parts", first, lambda at, x: F.when((at["part"] >= 0), at).when(x["n"] >= at["need"], F.struct(x["part"].alias("part"), at["need"].alias("need"))).otherwise(F.struct(F.lit(-1).alias("part"), (at["need"] - x["n"]).alias("need"))))
    exact = F.col("lo").cast("decimal(38,0)") + held["part"].cast("decimal(38,0)") * F.lit(width).cast("decimal(38,0)")
    return F.struct(exact.cast("long").alias("lo"), held["need"].alias("need"))


ORACLE_SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {K}"""
