"""Seeded synthetic graphs as DataFrames; the same seed gives the same graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import SparseMatrix

#: Quadrant probabilities a, b, c of the usual graph families.
PRESETS = {"er": (0.25, 0.25, 0.25), "g500": (0.57, 0.19, 0.19), "ssca": (0.60, 0.13, 0.13), "default": (0.45, 0.22, 0.22)}


def unit(*key: Column | int) -> Column:
    """A uniform number in [0, 1) by hash of the key."""
    return F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in key)), F.lit(1 << 52)) / float(1 << 52)


def _axis(scale: int, p: float, seed: int, side: int) -> Column:
    """Bits drawn with probability 1 - p each, highest first."""
    return sum(((unit(F.col("id"), seed, side, level) >= p).cast("long") * (1 << (scale - 1 - level)) for level in range(scale)), F.lit(0).cast("long"))


def _joint(scale: int, a: float, b: float, c: float, seed: int, noise: float) -> tuple[Column, Column]:
    """Quadrants drawn jointly. After each level every probability moves by up to the
    share noise of itself and all are scaled to one again; the next level goes on
    from there."""
    state = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), *(F.lit(float(p)).alias(k) for k, p in zip("abcd", (a, b, c, 1 - a - b - c), strict=True)))

    def level(s: Column, k: Column) -> Column:
        u = unit(F.col("id"), seed, 3, k)
        bit = F.pow(F.lit(2.0), F.lit(scale - 1) - k).cast("long")
        down = u >= s["a"] + s["b"]
        right = ((u >= s["a"]) & ~down) | (u >= s["a"] + s["b"] + s["c"])
        moved = [s[x] * (1 + noise * (2 * unit(F.col("id"), seed, 7 + n, k) - 1)) for n, x in enumerate("abcd")]
        total = sum(moved[1:], moved[0])
        return F.struct((s["i"] + down.cast("long") * bit).alias("i"), (s["j"] + right.cast("long") * bit).alias("j"), *((m / total).alias(x) for m, x in zip(moved, "abcd", strict=True)))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(scale - 1)), state, level)
    return end["i"], end["j"]


def weights(m: SparseMatrix, low: float = 0.0, high: float = 1.0, seed: int = 0) -> SparseMatrix:
    """m with uniform values from low to high, by a hash of the place."""
    return m.with_df(m.df.select("i", "j", (F.lit(float(low)) + (high - low) * unit(F.col("i"), F.col("j"), seed, 11)).alias("v")))


def rmat(spark: SparkSession, scale: int, edges: int, preset: str | tuple[float, float, float] = "default", seed: int = 0, self_loops: bool = False, duplicates: bool = False, undirected: bool = False, joint: bool = False, noise: float = 0.05) -> SparseMatrix:
    """edges edges over 2^scale vertices. joint draws quadrants together with
    noise; else each axis is halved on its own. Without duplicates or self
    loops more is drawn until enough distinct edges are there."""
    a, b, c = PRESETS[preset] if isinstance(preset, str) else preset
    n = 1 << scale
    most = n * n - (0 if self_loops else n)
    if undirected:
        most = (n * (n - 1)) // 2 + (n if self_loops else 0)
    if not duplicates and edges > most:
        raise ValueError(f"only {most} distinct edges are possible")

    def draw(start: int, end: int) -> DataFrame:
        ids = spark.range(start, end)
        x, y = _joint(scale, a, b, c, seed, noise) if joint else (_axis(scale, a + b, seed, 0), _axis(scale, a + c, seed, 1))
        e = ids.select("id", x.alias("i"), y.alias("j"))
        if not self_loops:
            e = e.where("i <> j")
        if undirected:
            e = e.select("id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        return e

    size = edges
    for _ in range(40):
        got = draw(0, size)
        if not duplicates:
            got = got.groupBy("i", "j").agg(F.min("id").alias("id"))
        n_got = got.count()
        if n_got >= edges:
            return SparseMatrix(got.orderBy("id").limit(edges).select("i", "j", F.lit(1.0).alias("v")), n, n)
        size = int(size * max(1.2, 1.1 * edges / max(1, n_got)))
    raise ValueError("too few distinct edges could be drawn; lower edges or choose flatter probabilities")


def gnm(spark: SparkSession, n: int, m: int, seed: int = 0) -> SparseMatrix:
    """m uniform pairs, with replacement."""
    pick = lambda k: F.floor(unit(F.col("id"), seed, k) * n).cast("long")
    return SparseMatrix(spark.range(m).select(pick(0).alias("i"), pick(1).alias("j"), F.lit(1.0).alias("v")), n, n)


def gnp(spark: SparkSession, n: int, p: float, seed: int = 0) -> SparseMatrix:
    """Each ordered pair with probability p: per row geometric gaps between the
    columns taken, so work follows the edges and not the pairs."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    # enough gaps to pass n columns but for a chance below 1e-12; a gap is a row, and a column their sum so far
    draws = min(n, int(n * p + 8 * math.sqrt(n * p) + 40))
    gaps = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("k"))
    gaps = gaps.withColumn("gap", (F.floor(F.log(1 - unit(F.col("i"), F.lit(seed), F.col("k"))) / math.log(1 - p)) + 1).cast("long"))
    upto = Window.partitionBy("i").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = gaps.select("i", (F.sum("gap").over(upto) - 1).alias("j")).where(F.col("j") < n)
    return SparseMatrix(e.withColumn("v", F.lit(1.0)), n, n)


def ssca2(spark: SparkSession, scale: int, max_parallel: int = 3, between: float = 0.5, seed: int = 0) -> SparseMatrix:
    """Cliques of up to 2^(scale / 3) vertices with parallel edges, and edges
    between cliques at distances 2^t with probability between / 2^t."""
    from ..operators.layout import exclusive_scan

    n, most = 1 << scale, max(1, 1 << (scale // 3))
    sizes = spark.range(n).select(F.col("id").alias("c"), (1 + F.floor(unit(F.col("id"), seed, 1) * most)).cast("long").alias("n"))
    cliques = exclusive_scan(sizes, "c", "n", "first").where(F.col("first") < n).withColumn("n", F.least("n", F.lit(n) - F.col("first")))
    members = cliques.select("c", "n", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    inside = members.select("c", F.col("first"), (F.col("first") + F.col("k")).alias("i"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("j")).where("i <> j")
    times = 1 + F.floor(unit(F.col("i"), F.col("j"), seed, 2) * max_parallel)
    inside = inside.select("i", "j", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).select("i", "j")
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    across = members.select((F.col("first") + F.col("k")).alias("i"), "first", "n", F.explode(steps).alias("t"))
    across = across.withColumn("j", (F.col("i") + F.pow(F.lit(2.0), "t").cast("long")) % n).where((F.col("j") < F.col("first")) | (F.col("j") >= F.col("first") + F.col("n")))
    across = across.where(unit(F.col("i"), F.col("t"), seed, 3) < between / F.pow(F.lit(2.0), "t")).select("i", "j")
    return SparseMatrix(inside.unionByName(across).withColumn("v", F.lit(1.0)), n, n)
