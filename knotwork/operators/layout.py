"""Scans, ranks, balanced ranges and bins over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Thresholds, of 8 bytes each, up to which they are broadcast.
FEW = 100_000


def _ordered_parts(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """df dealt by ranges of order, with the range's number as _part. Written
    once, so that a row's range never changes between two looks at it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def _offsets(parts: DataFrame, value: Column) -> DataFrame:
    """(_part, _before): what all earlier ranges add up to. One row for each range."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("_part").agg(value.alias("_own")).select("_part", F.coalesce(F.sum("_own").over(w), F.lit(0)).alias("_before"))


def exclusive_scan(df: DataFrame, order: str, value: str, name: str = "prefix") -> DataFrame:
    """df with the sum of value over all rows before, in the order of a unique column.

    Two levels: sums within ranges of the order, and sums of ranges (one row
    for each), so no task sees more than its range.
    """
    held = _ordered_parts(df, [F.col(order)])
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = held.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(F.broadcast(_offsets(held, F.sum(value))), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with 0-based places in the given order, ties broken arbitrarily."""
    held = _ordered_parts(df, order)
    inner = held.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return inner.join(F.broadcast(_offsets(held, F.count("*"))), "_part").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def magnitude_scan(hist: DataFrame, x: str, descending: bool, **sums: Column) -> DataFrame:
    """hist (one row for each value of x >= 0) with sums over the rows before, in
    the order of x. Values are dealt by magnitude, 32 ranges for each doubling, so
    no window holds all of them and no sample is taken; ranges are some thousands
    at most, and their totals are broadcast."""
    part = F.when(F.col(x) > 0, F.floor(F.log2(F.col(x).cast("double")) * 32)).otherwise(-1_000_000)
    hist = hist.withColumn("_part", part)
    way = F.desc if descending else F.asc
    inside = Window.partitionBy("_part").orderBy(way(x)).rowsBetween(Window.unboundedPreceding, -1)
    total = hist.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    across = Window.orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(across), F.lit(0)).alias(f"_t_{k}") for k in sums))
    hist = hist.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{k}") for k, c in sums.items()))
    hist = hist.join(F.broadcast(total), "_part")
    drop = ["_part", *(f"_t_{k}" for k in sums), *(f"_i_{k}" for k in sums)]
    return hist.withColumns({k: F.col(f"_i_{k}") + F.col(f"_t_{k}") for k in sums}).drop(*drop)


def range_search(scanned: DataFrame, order: str, value: str, thresholds: DataFrame, above: bool = False) -> DataFrame:
    """(t, at): for each different one of thresholds(t) the first place whose value is
    at least t, or above it; null if there is none. The values ascend with order.

    Values and thresholds are put in one order and dealt by ranges of it. The first
    value after a threshold is in its range, or is the first of a later range that
    has any; of these there is one for each range.
    """
    points = scanned.select(F.col(value).alias("x"), F.lit(1 if not above else 0).alias("kind"), F.col(order).alias("at"))
    asked = thresholds.select(F.col("t").alias("x")).where("x is not null").distinct().select("x", F.lit(0 if not above else 1).alias("kind"), F.lit(None).cast(scanned.schema[order].dataType).alias("at"))
    held = _ordered_parts(points.unionByName(asked), [F.col("x"), F.col("kind"), F.col("at")])
    after = Window.partitionBy("_part").orderBy("x", "kind", "at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = held.groupBy("_part").agg(F.min("at").alias("_own")).select("_part", F.min("_own").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    found = held.withColumn("_in", F.min("at").over(after)).where(F.col("kind") == (0 if not above else 1)).join(F.broadcast(later), "_part")
    return found.select(F.col("x").alias("t"), F.coalesce("_in", "_later").alias("at"))


def lower_bound(scanned: DataFrame, order: str, value: str, thresholds: DataFrame) -> DataFrame:
    """(t, at): for each of thresholds(t) the first place whose value is at least t,
    null if there is none. The values ascend with order. Few thresholds are
    broadcast, many are searched in ranges."""
    if thresholds.limit(FEW + 1).count() > FEW:
        return thresholds.join(range_search(scanned, order, value, thresholds), "t", "left")
    hit = scanned.join(F.broadcast(thresholds), F.col(value) >= F.col("t"))
    return thresholds.join(hit.groupBy("t").agg(F.min(order).alias("at")), "t", "left")


def balanced_ranges(work: DataFrame, parts: int, weight: str = "flop") -> DataFrame:
    """work(i, weight) with the part that each row falls in: contiguous ranges
    of about equal weight. A row belongs to the part in which the weight
    before it falls."""
    total = work.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    share = max(-(-total // parts) if isinstance(total, int) else (total + parts - 1) / parts, 1e-12)
    scanned = exclusive_scan(work, "i", weight, "prefix")
    return scanned.withColumn("part", F.least(F.floor(F.col("prefix") / F.lit(share)), F.lit(parts - 1)).cast("long"))


def range_of(column: str, firsts: list[int]) -> Column:
    """Number of the range of ascending firsts that a value is in; by halving."""
    if len(firsts) < 2:
        return F.lit(0)
    literal = F.expr(f"cast(split('{','.join(map(str, firsts))}', ',') as array<bigint>)")
    widths = F.array(*(F.lit(1 << k) for k in reversed(range(len(firsts).bit_length()))))
    return F.aggregate(widths, F.lit(0), lambda at, w: F.when(F.coalesce(F.get(literal, at + w) <= F.col(column), F.lit(False)), at + w).otherwise(at))


def orbit(nexts: DataFrame, first: int) -> DataFrame:
    """(i): the places reached from first by nexts(i, to), first included, by pointer
    doubling: a pass doubles both the steps that a place knows and the places
    reached, so passes are the logarithm of their number. Places only go up."""
    spark = nexts.sparkSession
    steps = materialize(nexts.where("to is not null").select("i", "to"))
    reached = spark.range(first, first + 1).toDF("i")
    n = 1
    while True:
        more = reached.join(steps, "i").select(F.col("to").alias("i"))
        reached = materialize(reached.unionByName(more))
        found = reached.count()
        if found < 2 * n:
            return reached
        n = found
        steps = materialize(steps.join(steps.select(F.col("i").alias("to"), F.col("to").alias("_to")), "to").select("i", F.col("_to").alias("to")))


def greedy_blocks(work: DataFrame, blocks: int, weight: str = "flop") -> DataFrame:
    """work(i, weight) with the block that each row falls in: a block takes rows in
    order until its weight is more than the whole part of an even share, and the
    row that does it is its last.

    A block that starts with some row is followed by the first row that has more
    than a share and that row's own prefix before it; this is found for all rows
    at once, and the starts that follow from the first row by pointer doubling.
    """
    held = materialize(exclusive_scan(work, "i", weight, "prefix"))
    first, total = held.agg(F.min("i"), F.max(F.col("prefix") + F.col(weight))).first()
    if first is None:
        return held.withColumn("block", F.lit(0).cast("long")).drop("prefix")
    rows = held.withColumn("t", F.col("prefix") + F.lit(total // blocks))
    nexts = rows.join(range_search(held, "i", "prefix", rows.select("t"), above=True), "t").select("i", F.col("at").alias("to"))
    starts = orbit(nexts, first).select("i", F.lit(1).cast("long").alias("_start"))
    marked = held.join(starts, "i", "left").fillna(0, ["_start"])
    return exclusive_scan(marked, "i", "_start", "_starts").withColumn("block", F.col("_starts") + F.col("_start") - 1).drop("prefix", "_start", "_starts")


def bin_id(flop: Column, n_cols: int, smallest: int = 8) -> Column:
    """0 for an empty row, else 1 + the least t with min(flop, n_cols) <= smallest * 2^t."""
    size = F.least(flop, F.lit(n_cols))
    return F.when(flop == 0, 0).otherwise((F.greatest(F.lit(0.0), F.ceil(F.log2(size / smallest))) + 1).cast("int"))


def next_pow2(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(x.cast("double"))))).cast("long")


def first_appearance_ids(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, id): 0-based numbers of keys in the order of their first line."""
    first = df.groupBy(key).agg(F.min(line).alias("_line"))
    return global_rank(first, [F.col("_line"), F.col(key)], "id").select(key, "id")


def keep_first(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Of rows with equal keys the one with the smallest line; pre-aggregated."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(line)).alias("_one")).select(*keys, "_one.*")


def remap_dense(df: DataFrame, *columns: str) -> DataFrame:
    """df with each column's values replaced by their 0-based ascending places."""
    from ..matrix import dense_ids

    for c in columns:
        own = dense_ids(df, c)
        df = df.join(own, c).withColumn(c, F.col("rank")).drop("rank")
    return df


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k rows with the largest values, ties to the smaller tie column."""
    return df.orderBy(F.desc(by), tie).limit(k)


def ordered(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    """df in the order of columns, ties by all others: triples by (i, j), pairs of key
    and value by either, up or down."""
    way = F.desc if descending else F.asc
    return df.orderBy(*(way(c) for c in columns), *(c for c in df.columns if c not in columns))


def sort_dedup(df: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """The distinct rows of columns in their order, and how many others were dropped."""
    kept = df.select(*columns).distinct()
    return ordered(kept, *columns), df.count() - kept.count()
