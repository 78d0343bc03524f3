"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is wanted target / source_size times. The whole part
is taken at once; the fractions are rounded in pairs: two documents trade
words until one of their fractions is 0 or 1, at odds that keep every
document's expectation, and the other goes on. Words are conserved by each trade.

A document larger than its partners can't be decided by one of them. So those
that hold more than 1 / ``LARGE`` of their source, fewer than ``LARGE``, go first,
the largest first, and each trades with all the smaller documents of the source
at once: these have one fraction in common, so they are one partner of all their
words, and the trade changes their common fraction. The others are folded in
buckets of about ``fan`` documents, one task each, to one residual; the residuals
of ``fan`` buckets are folded the same way, and so on up to one for each source,
which is drawn. So a source misses its target by less than 1 / ``LARGE`` of its
size, or by less than its smallest document if all are large, unless one document
outweighs what all others can give.

Rows equal in doc_id, source and text are a unit of n rows: of n fractions p,
the whole part of n * p is taken at once, and what is left is one fraction that
trades like any other document's. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Inverse of the share of a source from which a document is large.
LARGE = 1024
#: Number of sources up to which their table (24 bytes each) is broadcast.
FEW_SOURCES = 200_000


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes(source, source_size) with target: shares of the total by weight,
    weights repeating over sources by code point with null last. A target stops
    at ``most`` times its source, and the excess goes to the others by weight.

    The level at which sources fill rises pass by pass: with it, those full are
    known, and what they leave raises it for the others, until no more fill. A
    pass is an aggregation whose four numbers reach the driver; the one window
    numbers the sources where they are few, and two-level ranks do beyond that.
    """
    order = F.col("source").asc_nulls_last()
    if sizes.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)
    else:
        from ..operators.layout import global_rank

        ranked = global_rank(sizes, [order], "place")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    df = materialize(ranked.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap")))
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("w") * level
        n, total, held, weight = df.agg(F.count_if(~full), F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        after = max(level, (total - held) / weight) if n and weight else level
        if after <= level * (1 + 1e-15):
            break
        level = after
    return df.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


_EPS = "1e-9"
_UNIT = "named_struct('w', {0}.w, 'doc_id', {0}.doc_id, 'tie', {0}.tie, 'p', {1})"
_STATE = "struct<has:boolean,c:struct<w:double,doc_id:bigint,tie:bigint,p:double>,out:array<struct<w:double,doc_id:bigint,tie:bigint,p:double>>>"


def _fold(units: str, seed: int) -> str:
    """SQL that folds an array of units to {has, c: residual, out: decided}."""
    a = "least(x.w * (1 - x.p), s.c.w * s.c.p)"
    b = "least(s.c.w * (1 - s.c.p), x.w * x.p)"
    draw = f"(pmod(xxhash64(s.c.doc_id, s.c.tie, x.doc_id, x.tie, {seed}), 4503599627370496) / 4503599627370496D)"
    trade = f"transform(array(named_struct('a', {a}, 'b', {b})), t -> named_struct('t', t, 'up', {draw} * (t.a + t.b) < t.b))[0]"
    # up: the new one gains what the carried one gives
    after = f"transform(array({trade}), z -> named_struct('pc', if(z.up, s.c.p - z.t.a / s.c.w, s.c.p + z.t.b / s.c.w), 'px', if(z.up, x.p + z.t.a / x.w, x.p - z.t.b / x.w)))"
    done = "({0} < " + _EPS + " or {0} > 1 - " + _EPS + ")"
    c, x = _UNIT.format("s.c", "y.pc"), _UNIT.format("x", "y.px")
    step = (
        f"transform({after}, y -> named_struct("
        f"'has', not ({done.format('y.pc')} and {done.format('y.px')}), "
        f"'c', if({done.format('y.pc')}, {x}, {c}), "
        f"'out', concat(s.out, if({done.format('y.pc')}, array({c}), array()), if({done.format('y.px')}, array({x}), array()))))[0]"
    )
    start = f"cast(named_struct('has', false, 'c', null, 'out', array()) as {_STATE})"
    return f"aggregate({units}, {start}, (s, x) -> cast(if(s.has, {step}, named_struct('has', true, 'c', x, 'out', s.out)) as {_STATE}))"


def _settle(units: str, seed: int) -> str:
    """SQL that lets each of an array of large units trade with all smaller ones:
    {mass, p: words of the small ones and their common fraction, out: the large
    ones as they end}. Those with a fraction of their own (u is false) come first."""
    state = "struct<mass:double,p:double,out:array<struct<w:double,doc_id:bigint,tie:bigint,p:double>>>"
    at = "transform(array(named_struct('m', if(x.u, s.mass - x.w, s.mass), 'q', if(x.u, s.p, x.p))), y -> named_struct('m', y.m, 'q', y.q, 'a', least(x.w * (1 - y.q), y.m * s.p), 'b', least(y.m * (1 - s.p), x.w * y.q)))"
    draw = f"(pmod(xxhash64(x.doc_id, x.tie, {seed}, 'large'), 4503599627370496) / 4503599627370496D)"
    step = (
        f"transform(transform({at}, z -> named_struct('z', z, 'up', {draw} * (z.a + z.b) < z.b)), t -> named_struct("
        "'mass', t.z.m, 'p', if(t.z.m > 0, greatest(0D, least(1D, if(t.up, s.p - t.z.a / t.z.m, s.p + t.z.b / t.z.m))), s.p), "
        "'out', concat(s.out, array(named_struct('w', x.w, 'doc_id', x.doc_id, 'tie', x.tie, 'p', if(t.up, t.z.q + t.z.a / x.w, t.z.q - t.z.b / x.w))))))[0]"
    )
    return f"aggregate({units}, cast(named_struct('mass', mass, 'p', p, 'out', array()) as {state}), (s, x) -> cast({step} as {state}))"


def _known(sources: DataFrame) -> DataFrame:
    """A row for each source, broadcast where these are few."""
    return F.broadcast(sources) if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else sources


def decide(units: DataFrame, seed: int = 0, fan: int = 128) -> DataFrame:
    """units(doc_id, tie, source, size, rows, source_size, target) with copies: how
    often the mix takes the rows of a unit, all together. Reruns agree; seed
    chooses another draw."""
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(factor)
    factor = F.when(F.abs(factor - near) < 1e-12, near).otherwise(factor)
    wanted = factor * F.col("rows")
    whole = F.floor(wanted + F.lit(float(_EPS)))
    units = units.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), wanted - whole))
    # without words a document has nothing to trade
    open_ = (F.col("p") > float(_EPS)) & (F.col("size") > 0)
    keys = ["doc_id", "tie", "source", "size", "rows", "source_size", "target"]
    shut = units.where(~open_).select(*keys, F.when(F.col("size") > 0, F.col("whole")).otherwise(F.floor(factor) * F.col("rows")).cast("long").alias("copies"))

    wide = units.where(open_)
    even = F.col("rows") == 1
    n = wide.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.coalesce(F.sum(F.when(even, F.col("size"))), F.lit(0)).cast("double").alias("mass"), F.coalesce(F.max(F.when(even, F.col("p"))), F.lit(0.0)).alias("common"))
    most = n.agg(F.max("n")).first()[0]
    if not most:
        return shut
    same = F.col("source").eqNullSafe(F.col("_source"))
    beside = wide.join(_known(n), same)
    large = F.col("size") * LARGE > F.col("all")
    first = F.sort_array(F.collect_list(F.struct(even.alias("u"), (-F.col("size")).alias("less"), "doc_id", "tie", F.col("size").cast("double").alias("w"), "p")))
    settled = beside.where(large).groupBy("source").agg(first.alias("units"), F.max("mass").alias("mass"), F.max("common").alias("p"))
    settled = materialize(settled.select("source", F.expr(_settle("units", seed)).alias("f")))
    rest = beside.where(~large).drop("_source").join(_known(settled.select(F.col("source").alias("_source"), F.col("f.p").alias("after"))), same, "left")
    rest = rest.select("source", "n", F.struct(F.col("size").cast("double").alias("w"), "doc_id", "tie", F.when(even, F.coalesce("after", "p")).otherwise(F.col("p")).alias("p")).alias("unit"))
    rest = rest.unionByName(settled.select("source", F.explode("f.out").alias("unit")).join(_known(n.select("_source", "n")), same).select("source", "n", "unit"))
    loose = F.col("unit.p").between(float(_EPS), 1 - float(_EPS))
    rest = materialize(rest)
    bucket = F.pmod(F.xxhash64("unit.doc_id", "unit.tie", F.lit(seed)), F.ceil(F.col("n") / fan))
    level = rest.where(loose).select("source", bucket.alias("bucket"), "unit")
    decided = [rest.where(~loose).select("source", "unit")]
    for depth in range(1 + max(0, math.ceil(math.log(max(1, math.ceil(most / fan)), fan) - 1e-9))):
        folded = level.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = materialize(folded.select("source", "bucket", F.expr(_fold("units", seed + depth)).alias("f")))
        decided.append(folded.select("source", F.explode("f.out").alias("unit")))
        level = folded.where("f.has").select("source", F.floor(F.col("bucket") / fan).alias("bucket"), F.col("f.c").alias("unit"))
    draw = F.pmod(F.xxhash64("unit.doc_id", "unit.tie", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    decided.append(level.select("source", F.expr("unit").withField("p", F.when(draw < F.col("unit.p"), 1.0).otherwise(0.0)).alias("unit")))
    more = reduce(DataFrame.unionByName, (d.select(F.col("source").alias("s2"), F.col("unit.doc_id").alias("d2"), F.col("unit.tie").alias("t2"), F.round("unit.p").cast("long").alias("extra")) for d in decided))
    mine = (F.col("tie") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("source").eqNullSafe(F.col("s2"))
    return shut.unionByName(wide.join(more, mine).select(*keys, (F.col("whole") + F.col("extra")).cast("long").alias("copies")))


def tie_of(docs: DataFrame) -> Column:
    """Digest of the text, which with doc_id and source tells rows apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 0) -> DataFrame:
    """(doc_id, tie, source, size, rows, source_size, target, copies), one row for
    each different doc_id, source and text of docs; ``rows`` counts its rows, and
    copies is for all of them together. Null or blank texts have size 0 and are
    taken as often as the whole part of their source's factor says."""
    units = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of().alias("size"), tie_of(docs).alias("tie"))
    units = materialize(units.groupBy("doc_id", "tie", "source", "size").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    if goal.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        goal = F.broadcast(goal)
    units = units.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return decide(units, seed)


def _share(copies: Column, rows: Column, k: Column) -> Column:
    """What the k-th of equal rows (from 0) gets of their copies."""
    return F.floor(copies / rows).cast("long") + (k < copies % rows).cast("long")


def op6(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of every document.

    Null, empty and blank texts have size 0 and nothing is taken. Texts count
    whole, however long. Repeated rows are rounded as one unit and get a row each,
    whose copies differ by one at most. Rows without doc_id are told apart by
    their texts, those without source are a source of their own, the last. Ties
    between documents are settled by hashes, so reruns agree. An empty table
    gives no rows; other columns aren't looked at.
    """
    each = mix(docs).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * _share(F.col("copies"), F.col("rows"), F.col("k"))).alias("taken"))


def stage(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all or repeated).

    Of rows equal in doc_id, source and text, which one is taken once more than
    the others is open. Null and blank texts are kept as op6 counts them. Columns
    of docs may have any name; an empty table stays empty.
    """
    row, words = unused("tie", docs), unused("copies", docs)
    taken = mix(docs, weights, most).where("copies > 0").select("doc_id", "tie", "source", "copies", "rows")
    d, t, s, c, n = (unused(x, docs, taken) for x in ("d", "t", "s", "c", "n"))
    taken = taken.select(F.col("doc_id").alias(d), F.col("tie").alias(t), F.col("source").alias(s), F.col("copies").alias(c), F.col("rows").alias(n))
    same = (F.col(row) == F.col(t)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s))
    found = docs.withColumn(row, tie_of(docs)).join(taken, same)
    own = [quoted(x) for x in docs.columns]
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col(words)))
    single = found.where(F.col(n) == 1).withColumn(words, F.col(c))
    out = single.withColumn(row, repeat).select(*own)
    several = taken.where(F.col(n) > 1)
    if several.isEmpty():
        return out
    # equal rows are numbered range by range, so that no task has all of a large unit
    several = materialize(found.where(F.col(n) > 1)).withColumn(s, F.spark_partition_id())
    unit = [row, F.col("doc_id"), F.col("source")]
    counts = several.groupBy(*unit, s).agg(F.count("*").alias(words))
    before = Window.partitionBy(*unit).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(row).alias("u0"), F.col("doc_id").alias("u1"), F.col("source").alias("u2"), F.col(s).alias("u3"), F.coalesce(F.sum(words).over(before), F.lit(0)).alias("u4"))
    held = [c2 for c2 in first.columns if c2 in {x.lower() for x in several.columns}]
    first = first.withColumnsRenamed({x: unused(f"u{x}", several) for x in held})
    u0, u1, u2, u3, u4 = (F.col(x) for x in first.columns)
    numbered = several.withColumn(t, F.row_number().over(Window.partitionBy(*unit, s).orderBy(F.lit(0))) - 1)
    numbered = numbered.join(first, (F.col(row) == u0) & F.col("doc_id").eqNullSafe(u1) & F.col("source").eqNullSafe(u2) & (F.col(s) == u3))
    numbered = numbered.withColumn(words, _share(F.col(c), F.col(n), F.col(t) + u4)).where(F.col(words) > 0)
    return out.unionByName(numbered.withColumn(row, repeat).select(*own))
