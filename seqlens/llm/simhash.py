"""SimHash near-duplicates by a segment-popcount embedding (operator 2).

A 64-bit fingerprint is mapped to its popcounts over 32 segments of 2 bits. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a range join under it loses no link. Within 3,
one half of the vector (16 coordinates) is within 1: each distinct fingerprint lies in one grid cell for each half, and
visits the cells one step up in each coordinate; two fingerprints within 1 in a half then meet in a cell. What meets is
verified exactly. Components follow from the links by star contraction.

Only distinct fingerprints are joined, so copies cost nothing beyond one count. In a cell, links are searched from
one node to those not yet reached, so a cell gives a spanning forest, not all its pairs. A cell with more than
`CELL_ROWS` homes or visitors is dealt out in blocks, each pair of blocks to a task of its own. Of evenly spread
fingerprints the fullest cell holds 2^-16 and a cell meets 1.5 * 10^-7 of all on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import by_verdict, checkpointed, id_text, map_batches
from seqlens.operators.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS, SEGMENT_BITS = 32, 2
HALF = SEGMENTS // 2
CELL_ROWS = 16_384
#: Sizes of a cell up to which all cells of a batch are compared together.
SMALL_CELL = 128
BATCH = 1 << 17

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, the highest bits first."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: 1 - SHINGLE - 1] + 1).tolist()]
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            made = np.frombuffer(b"".join(map(fingerprint, texts.to_pylist())), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(made)], ["doc_id", "fp"])

    source = id_text(docs, id_col, text_col)
    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def popcount(fp: Column, segment: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * segment).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))).cast("long")


def coordinate(cell: Column, i: int) -> Column:
    return F.shiftright(cell, 2 * i).bitwiseAND(F.lit(3).cast("long"))


def stepped(cell: Column, i: int) -> Column:
    """The cell one step up in a coordinate."""
    return cell + F.lit(1 << (2 * i)).cast("long")


def cells(fps: DataFrame) -> DataFrame:
    """cell, visitor, fp: each fingerprint at home and as a visitor, in the grid of either half."""
    homes = []
    for h in range(2):
        home = F.lit(h << (2 * HALF)).cast("long")
        for i in range(HALF):
            home = home + popcount(F.col("fp"), h * HALF + i) * F.lit(1 << (2 * i)).cast("long")
        homes.append(home)
    at = F.explode(F.array(*homes)).alias("home")
    home = F.col("home")
    steps = [F.when(coordinate(home, i) < SEGMENT_BITS, F.struct(stepped(home, i).alias("cell"), F.lit(True).alias("visitor"))) for i in range(HALF)]
    own = F.struct(home.alias("cell"), F.lit(False).alias("visitor"))
    return fps.select("fp", at).select("fp", F.explode(F.array_compact(F.array(own, *steps))).alias("at")).select("at.cell", "at.visitor", "fp")


def heavy_cells(rows: DataFrame, cell_rows: int) -> DataFrame:
    """cell, homes, visitors of the cells that may have more than cell_rows of either.

    Only homes are counted over all rows. A cell's visitors are the homes of the up to HALF cells one step below; those of cells with few
    homes come to cell_rows together at most, so the others alone are added up."""
    many = checkpointed(rows.where("NOT visitor").groupBy("cell").agg(F.count(F.lit(1)).alias("homes")).where(F.col("homes") > max(1, cell_rows // HALF)))
    cell = F.col("cell")
    steps = [F.when(coordinate(cell, i) < SEGMENT_BITS, stepped(cell, i)) for i in range(HALF)]
    sent = many.select(F.explode(F.array_compact(F.array(*steps))).alias("cell"), F.lit(0).cast("long").alias("homes"), F.col("homes").alias("visitors"))
    own = many.select("cell", "homes", F.lit(0).cast("long").alias("visitors"))
    both = own.unionByName(sent).groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
    # homes that were too few to be listed and visitors from such cells: cell_rows more at most
    return both.where((F.col("homes") > cell_rows) | (F.col("visitors") > cell_rows)).select("cell", (F.col("homes") + F.lit(cell_rows // HALF)).alias("homes"), (F.col("visitors") + F.lit(cell_rows)).alias("visitors"))


def dealt(rows: DataFrame, cell_rows: int) -> DataFrame:
    """rows with a part: 0, or for heavy cells one part for each pair of blocks of homes and each pair of a block of homes and one of
    visitors."""
    heavy = checkpointed(heavy_cells(rows, cell_rows))
    zero = F.lit(0).cast("long")
    if heavy.isEmpty():
        return rows.withColumn("part", zero)
    count = lambda c: F.greatest(F.ceil(F.col(c) / F.lit(cell_rows)), F.lit(1).cast("long"))
    homes, visitors = F.col("blocks"), F.col("visitor_blocks")
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("visitor"), visitors).otherwise(homes))
    upto = lambda n: F.sequence(zero, n - 1)
    mixed = lambda i, j: homes * homes + i * visitors + j
    with_homes = F.transform(upto(homes), lambda j: F.least(mine, j) * homes + F.greatest(mine, j))
    with_visitors = F.transform(upto(visitors), lambda j: mixed(mine, j))
    to_homes = F.transform(upto(homes), lambda i: mixed(i, mine))
    parts = F.when(homes.isNull(), F.array(zero)).when(F.col("visitor"), to_homes).otherwise(F.concat(with_homes, with_visitors))
    joined = rows.join(heavy.select("cell", count("homes").alias("blocks"), count("visitors").alias("visitor_blocks")), "cell", "left")
    return joined.select("cell", "visitor", "fp", F.explode(parts).alias("part"))


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of the links a-b."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def large_cell(fp: np.ndarray, visitor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one cell, homes first: every node is compared once with those not reached yet."""
    homes = int((~visitor).sum())
    open_ = np.arange(len(fp))
    out_a, out_b = [], []
    queue: list[int] = []
    start = 0
    reached = np.zeros(len(fp), bool)
    while queue or start < homes:
        if queue:
            i = queue.pop()
        else:
            i, start = start, start + 1
            if reached[i]:
                continue
            reached[i] = True
            open_ = open_[~reached[open_]]
        among = open_ if i < homes else open_[: np.searchsorted(open_, homes)]
        near = among[np.bitwise_count(fp[among] ^ fp[i]) <= bits]
        if len(near):
            reached[near] = True
            open_ = open_[~reached[open_]]
            queue += near.tolist()
            out_a.append(np.full(len(near), fp[i]))
            out_b.append(fp[near])
    empty = np.zeros(0, fp.dtype)
    return np.concatenate(out_a or [empty]), np.concatenate(out_b or [empty])


def links_of(cell: np.ndarray, visitor: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links within whole cells; rows sorted by cell, homes before visitors."""
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(edge, len(cell)))
    group = np.repeat(np.arange(len(edge)), size)
    small = np.flatnonzero((size[group] <= SMALL_CELL) & ~visitor)
    last = (edge + size)[group]
    found_a, found_b = [], []
    step = 1
    rows = small
    while len(rows := rows[rows + step < last[rows]]):
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + step]) <= bits]
        found_a.append(fp[near])
        found_b.append(fp[near + step])
        step += 1
    for g in np.flatnonzero(size > SMALL_CELL):
        own = slice(edge[g], edge[g] + size[g])
        a, b = large_cell(fp[own], visitor[own], bits)
        found_a.append(a)
        found_b.append(b)
    if not found_a:
        return []
    return spanning(np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64))


def links(fps: DataFrame, bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: links that connect the same fingerprints as all pairs of distinct fps within `bits` do."""
    if not 0 <= bits <= 3:
        raise ValueError("the grid's reach of one step for either half holds up to 3 bits")
    rows = dealt(cells(fps), cell_rows)
    near = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "visitor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            cell, part, visitor, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))
            cut = len(cell) if final else (int(change[-1]) + 1 if len(change) else 0)
            if cut:
                key = np.cumsum(np.concatenate([[0], (cell[1:cut] != cell[: cut - 1]) | (part[1:cut] != part[: cut - 1])]))
                found = links_of(key, visitor[:cut], fp[:cut].view(np.uint64), bits)
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])
            held = [(cell[cut:], part[cut:], visitor[cut:], fp[cut:])] if cut < len(cell) else []
            n = len(cell) - cut

        limit = BATCH
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append((columns[0], columns[1], columns[2].astype(bool), columns[3]))
            n += batch.num_rows
            if n >= limit:
                yield from flush(False)
                limit = BATCH + 2 * n
        if held:
            yield from flush(True)

    return near.select("cell", "part", "visitor", "fp").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """doc_id, fp, component (a fingerprint that stands for it), component_id of every row."""
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = connected_components(links(nodes.select("fp"), bits), "a", "b").withColumnRenamed("node", "fp")
    own = nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = own.join(names, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component", "component_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id that links of at most `bits` differing bits reach.

    Texts that are null or without words have fingerprint zero and link like any other. Rows with equal fingerprints, copies and
    repeated rows among them, are one node. A null doc_id never names a component unless no member has an id. A long text is read whole, in time and
    memory in proportion to it; an empty table gives no row; other columns are not read."""
    return grouped(docs, id_col, text_col, bits).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns as they are, for each component: the one with its least id.

    Rows decide, not ids: where one id has several texts, each of these stays or goes with its own component. Of several rows of a component
    with its least id (copies, or near copies under one id), and of a component whose rows have no ids, the first read stays;
    rows without an id go where another of their component has one."""
    found = checkpointed(grouped(docs, id_col, text_col, MAX_BITS))
    stands = F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id")))
    verdict = F.when(F.col("doc_id").isNull(), "rows").when(stands == 0, "goes").when(F.count(F.lit(1)) == 1, "stays").otherwise("rows")
    verdicts = found.groupBy("doc_id").agg(verdict.alias("verdict"))

    def chosen(rows: DataFrame) -> DataFrame:
        of_fp = found.select("fp", "component", "component_id").distinct()
        own = fingerprints(rows, "row", text_col).withColumnRenamed("doc_id", "row").join(rows.select("row", F.col(id_col).alias("id")), "row").join(of_fp, "fp")
        return own.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("row"))

    return by_verdict(docs, verdicts, chosen, id_col)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
