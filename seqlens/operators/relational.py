"""Relational building blocks of labelling, merging and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions import metadata
from seqlens.operators.components import checkpointed


#: Columns of a crosstab, as of Spark's own pivot.
MAX_COLUMNS = 10_000


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order: an aggregate, so a hot key is cut down before the shuffle."""
    rest = [c for c in rows.columns if c not in order]
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(*[F.col("_r")[c].alias(c) for c in rows.columns])


def merge_newest(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and prior rows whose key no new row has."""
    return prior.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_prior(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Prior rows, and new rows whose key no prior row has."""
    return merge_newest(new, prior, key)


def without_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known neither as it is nor without its version."""
    known = known.select(F.col(key).alias("_k")).distinct()
    bare = known.select(metadata.bare_accession(F.col("_k")).alias("_k")).distinct()
    rest = rows.join(known, rows[key] == F.col("_k"), "left_anti")
    return rest.join(bare, metadata.bare_accession(rest[key]) == F.col("_k"), "left_anti")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with a dimension's value, or the default."""
    return rows.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with each one's place (from 1) in the order of all, which names no row twice.

    Rows are dealt out by ranges and sorted there; a row's place is its place in its range after the sizes of the ranges before. Only these sizes, one a partition,
    come to the driver, and no task holds more than a range."""
    at, start = "_at", "_start"
    own = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    sizes = sorted(own.groupBy(part.alias("p")).count().collect())
    starts = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    offsets = rows.sparkSession.createDataFrame(starts, f"_part long, {start} long")
    placed = own.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row for each partition
    return placed.withColumn(name, F.col(at).bitwiseAND((1 << 33) - 1) + F.col(start) + 1).select(*rows.columns, name)


def counts(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def shares(rows: DataFrame, key: str, name: str = "n", share: str = "pct") -> DataFrame:
    """Each value's count and its share of all in per cent. The total is a scalar subquery."""
    own = counts(rows, key, name=name)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return own.select(key, name, (F.lit(100.0) * F.col(name) / total).alias(share))


def top_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return counts(rows, key).orderBy(F.desc("n"), key).limit(n)


def top_with_other(rows: DataFrame, key: str, n: int, other: str = "Other") -> DataFrame:
    """Counts of the n most frequent values and of all others together."""
    top = top_keys(rows, key, n).select(F.col(key).alias("_top"))
    named = counts(rows, key).join(F.broadcast(top), F.col(key) == F.col("_top"), "left")  # n rows
    return named.groupBy(F.coalesce("_top", F.lit(other)).alias(key)).agg(F.sum("n").alias("n"))


def in_top(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the n most frequent."""
    return rows.join(F.broadcast(top_keys(rows, key, n).select(key)), key, "left_semi")  # n rows


def pivot_counts(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A row for each value of row, a column for each of values, counts, 0 where there are none."""
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def crosstab(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by row and by each column value that occurs, in order; more than MAX_COLUMNS values are refused."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_COLUMNS} values")
    seen = sorted(r[0] for r in found)
    return pivot_counts(rows, row, column, seen)


def counted_grid(rows: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n: counts of every pair of a value of row and one of column (not null), zeros too. rows are read once: all comes from their counts by pair, which are written."""
    own = checkpointed(counts(rows, row, column))
    values = own.where(F.col(column).isNotNull()).select(column).distinct()
    grid = own.select(row).distinct().crossJoin(values)  # of counted values, not of rows
    found = own.select(F.col(row).alias("_row"), F.col(column).alias("_column"), "n")
    joined = grid.join(found, grid[row].eqNullSafe(found["_row"]) & (grid[column] == found["_column"]), "left")
    return joined.select(row, column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def reindexed(rows: DataFrame, domain: DataFrame, key: str, value: str) -> DataFrame:
    """A row for each key of the domain, value 0 where rows have none."""
    return domain.select(key).join(rows.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def dense_range(rows: DataFrame, column: str) -> DataFrame:
    """Every whole number from the least to the greatest of a column."""
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias(column))


def dense_counts(rows: DataFrame, number: str, key: str) -> DataFrame:
    """Counts of each pair of a number in the whole range and a key that occurs."""
    ends = [rows.agg(f(number)).scalar() for f in (F.min, F.max)]
    grid = rows.where(F.col(number).isNotNull()).select(key).distinct().select(key, F.explode(F.sequence(*ends)).alias(number))
    own = counts(rows, number, key)
    return grid.join(own, [number, key], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def stacked(rows: DataFrame, over: str, order: str, value: str) -> DataFrame:
    """With base: what stands below each value of a stack."""
    below = Window.partitionBy(over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum(value).over(below), F.lit(0)).cast("bigint"))


def top_values(rows: DataFrame, key: str, column: str, n: int, name: str) -> DataFrame:
    """key, name: the n most frequent values of a column as "value:count; ...", ties by value."""
    own = counts(rows, key, column)
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), column))).where(F.col("_r") <= n)
    listed = F.sort_array(F.collect_list(F.struct("_r", F.concat(F.coalesce(column, F.lit("")), F.lit(":"), F.col("n").cast("string")).alias("t"))))
    return ranked.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias(name))


def shared_keys(rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, labels: keys that more than one label has, their labels sorted."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels")).where(F.size("labels") > 1)


def shared_pairs(rows: DataFrame, key: str, label: str, n: int | None = None) -> DataFrame:
    """label_a, label_b, shared: how many keys two labels share, the n most first. A key's labels are few and distinct."""
    pairs = shared_keys(rows, key, label).select(F.explode(F.flatten(F.transform("labels", lambda a: F.transform(F.filter("labels", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    own = pairs.groupBy(F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b")).agg(F.count(F.lit(1)).alias("shared"))
    return own if n is None else own.orderBy(F.desc("shared"), "label_a", "label_b").limit(n)


def blocks(counted: DataFrame, label: str, order: list[Column], n: str = "n") -> DataFrame:
    """label, first, last, tick: where each label's run starts and ends in an axis sorted by label, and its middle.

    counted has a row for each label, so the window sorts labels, not rows."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(n).over(before), F.lit(0)).cast("bigint")
    return counted.select(label, first.alias("first"), (first + F.col(n)).alias("last"), F.floor((first + first + F.col(n)) / 2).cast("bigint").alias("tick"))


def runs(rows: DataFrame, part: list[str], order: list[str], label: str) -> DataFrame:
    """part, run, label, n: stretches of equal labels in each part's order."""
    w = Window.partitionBy(*part).orderBy(*order)
    changed = (F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))).cast("int")
    return rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w)).groupBy(*part, "run", label).agg(F.count(F.lit(1)).alias("n"))


def _times(weight: str | None) -> Column:
    """How many rows a group of rows stands for."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")


def quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], weight: str | None = None) -> DataFrame:
    """keys, n and for each name of points the value at that share of a key's rows, interpolated between neighbours. Nulls don't count. weight: a column of
    how many rows one stands for.

    Exact: rows are counted by key and value, dealt out by ranges of both and summed within a range; what a key has in ranges before is
    added. So no task holds all values of a key, as an aggregate's buffer would."""
    part, v = "_part", "_v"
    own = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias(v)).agg(_times(weight).alias("_c"))
    dealt = checkpointed(own.repartitionByRange(*keys, v).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(*keys, part).agg(F.sum("_c").alias("_t"))  # about a row for each partition and key
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.select(*keys, part, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(*keys)).alias("n"))
    here = Window.partitionBy(part, *keys).orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_lower", F.coalesce(F.sum("_c").over(here), F.lit(0)))
    same = F.lit(True)
    for k in (*keys, part):
        same = same & ranked[k].eqNullSafe(totals[k])
    low = F.col("_lower") + F.col("_before")
    placed = ranked.join(totals, same).select(*[ranked[k] for k in keys], v, "n", low.alias("_low"), (low + F.col("_c")).alias("_high"))
    at = lambda i: F.max(F.when((F.col("_low") <= i) & (F.col("_high") > i), F.col(v)))
    picked = []
    for name, p in points.items():
        h = F.lit(p) * (F.col("n") - 1)
        picked += [at(F.floor(h)).alias(f"_{name}_a"), at(F.ceil(h)).alias(f"_{name}_b")]
    found = placed.groupBy(*keys, "n").agg(*picked)

    def between(name: str, p: float) -> Column:
        h = F.lit(p) * (F.col("n") - 1)
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        return F.when(F.floor(h) == F.ceil(h), a).otherwise((F.ceil(h) - h) * a + (h - F.floor(h)) * b)

    return found.select(*keys, "n", *[between(name, p).cast("double").alias(name) for name, p in points.items()])


def five_numbers(rows: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """Minimum, quartiles and maximum, interpolated between neighbours."""
    return quantiles(rows, [key], value, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, weight)


def cliffs_delta(rows: DataFrame, group: str, a: str, b: str, value: str, weight: str | None = None) -> DataFrame:
    """delta = (#a > b - #a < b) / (n_a n_b) over all pairs of a row of group a and one of group b; null if either has none. weight: a column of how many rows one stands for.

    Exact, from ranks: rows are counted by value, dealt out by ranges of value and summed within a range; the totals of ranges
    before it are added. So no pair is formed and no task gets more than a range."""
    own = rows.where(F.col(group).isin(a, b)).groupBy(F.col(value).alias("v")).agg(*[F.coalesce(F.sum(F.when(F.col(group) == g, F.lit(1) if weight is None else F.col(weight))), F.lit(0)).cast("long").alias(n) for g, n in ((a, "na"), (b, "nb"))])
    dealt = checkpointed(own.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("nb").alias("t")).select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("lower", F.coalesce(F.sum("nb").over(w), F.lit(0))).join(F.broadcast(totals), "part")  # a row for each partition
    exact = lambda c: c.cast("decimal(19,0)")  # noqa: E731 - products of numbers of pairs are beyond long
    greater = F.sum(exact(F.col("na")) * exact(F.col("lower") + F.col("before")))
    sums = ranked.agg(greater.alias("gt"), F.sum(exact(F.col("na")) * exact(F.col("nb"))).alias("eq"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    pairs = exact(F.col("na")) * exact(F.col("nb"))
    delta = (F.col("gt") + F.col("gt") + F.col("eq") - pairs).cast("double") / pairs.cast("double")
    return sums.select(F.when(pairs > 0, delta).alias("delta"), "na", "nb")
