"""Set-similarity joins by exact prefix filters.

A row's columns are a set. Columns are ordered by how many rows have them, rare
ones first. Two rows that must share ``least`` columns have one in common among the
first n - least + 1 of each, and two among the first n - least + 2: so only these
prefixes are indexed, by single columns (of the longer prefixes, where a pair has to
meet twice, unless that meets much more often) or by pairs of columns, whichever is
expected to meet less often, and a column that very many rows have is last in all
of them and stays out. Pairs that
meet often enough are looked at once more by length and by what can follow the
place at which they first met, and counted by their arrays.

Rows with the same columns are one class from the start, so copies are never
joined with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..storage import materialize


def classes(a: SparseMatrix) -> tuple[DataFrame, DataFrame]:
    """(c, n, ks, rows) of each class of rows with the same columns, ks rare ones
    first and c the smallest row; and its members (i, c)."""
    p = a.df.select("i", "j").distinct()
    often = p.groupBy("j").agg(F.count("*").alias("f"))
    ordered = p.join(often, "j").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("f", "j"))).alias("s"))
    rows = materialize(ordered.select("i", F.col("s.j").alias("ks")))
    sets = materialize(rows.groupBy("ks").agg(F.min("i").alias("c"), F.count("*").alias("rows")))
    return sets.select("c", F.size("ks").alias("n"), "ks", "rows"), rows.join(sets, "ks").select("i", "c")


def _least(n: Column, overlap: int, jaccard: float | None) -> Column:
    """Columns that a row of n shares with any other that is similar to it."""
    few = F.lit(max(1, overlap))
    # a share that is whole but for its rounding is taken as whole
    return few if jaccard is None else F.greatest(few, F.ceil(F.lit(jaccard) * n - 1e-9).cast("int"))


def similar_classes(sets: DataFrame, overlap: int = 1, jaccard: float | None = None, keys: int | None = None) -> DataFrame:
    """(c, d, overlap, jaccard): pairs c < d of classes(c, n, ks) that share at least so
    many columns and reach the similarity. keys: index single columns (1) or
    pairs of them (2, for an overlap of 2 or more); without it what is cheaper."""
    least = _least(F.col("n"), overlap, jaccard)
    sets = sets.where(F.col("n") >= least)
    # rest: columns of the row from the place of the key on
    prefix = lambda times: F.least(F.col("n"), F.col("n") - least + times)
    times = 2 if overlap >= 2 else 1
    index = sets.select("c", "n", F.posexplode(F.slice("ks", F.lit(1), prefix(times))).alias("at", "key"))
    if times == 2:
        # pairs that meet by a single column of the shorter and of the longer prefixes, against rows of an index of pairs
        pairs = lambda f: F.coalesce(F.sum(F.col(f) * (F.col(f) - 1) / 2), F.lit(0))
        counted = index.groupBy("key").agg(F.count("*").alias("f"), F.count_if(F.col("at") < prefix(1)).alias("g"))
        twice, once = counted.agg(pairs("f"), pairs("g")).first()
        if twice > 2 * once:  # a frequent column stands at the end of the longer ones
            times, index = 1, index.where(F.col("at") < prefix(1))
        if keys is None:
            rows = sets.agg(F.coalesce(F.sum(prefix(2).cast("double") * (prefix(2) - 1) / 2), F.lit(0.0))).first()[0]
            keys = 2 if rows < (once if times == 1 else twice) else 1
    keys = keys or 1
    index = index.select("key", "c", (F.col("n") - F.col("at")).alias("rest"), "n")
    if keys == 2:
        first = sets.withColumn("p", F.slice("ks", F.lit(1), prefix(2))).select("c", "n", "p", F.posexplode("p").alias("at", "one"))
        both = first.where(F.col("at") + 1 < F.size("p")).select("c", "n", "at", "one", F.posexplode(F.slice("p", F.col("at") + 2, F.size("p"))).alias("more", "two"))
        index = both.select(F.xxhash64("one", "two").alias("key"), "c", (F.col("n") - F.col("at") - F.col("more") - 1).alias("rest"), "n")
        times = 1
    if jaccard is None:
        index = index.drop("rest", "n")  # enough follows wherever a prefix is met
    x, y = index, index.withColumnsRenamed({"c": "d", "rest": "left", "n": "m"})
    met = x.join(y, "key").where("c < d")
    if jaccard is None:
        found = met.groupBy("c", "d").agg(F.count("*").alias("met")) if times > 1 else met.select("c", "d").distinct()
    else:
        # where they first met, what follows must be enough
        met = met.where((F.col("n") >= F.col("m") * F.lit(jaccard) - 1e-9) & (F.col("m") >= F.col("n") * F.lit(jaccard) - 1e-9))
        need = F.greatest(F.lit(max(1, overlap)), F.ceil(F.lit(jaccard / (1 + jaccard)) * (F.col("n") + F.col("m")) - 1e-9).cast("int"))
        spare = F.lit(keys - 1) + F.least("rest", "left") - need
        found = met.groupBy("c", "d").agg(F.count("*").alias("met"), F.max(spare).alias("spare")).where("spare >= 0")
    if times > 1:
        found = found.where(F.col("met") >= times)
    found = found.select("c", "d")
    own = sets.select("c", F.col("ks").alias("kc"))
    other = sets.select(F.col("c").alias("d"), F.col("ks").alias("kd"))
    both = found.join(own, "c").join(other, "d").select("c", "d", F.size(F.array_intersect("kc", "kd")).cast("long").alias("overlap"), (F.size("kc") + F.size("kd")).alias("all"))
    both = both.withColumn("jaccard", F.col("overlap") / (F.col("all") - F.col("overlap"))).where(F.col("overlap") >= overlap)
    if jaccard is not None:
        both = both.where(F.col("jaccard") >= jaccard)
    return both.select("c", "d", "overlap", "jaccard")


def set_similarity(a: SparseMatrix, overlap: int = 1, jaccard: float | None = None) -> DataFrame:
    """(i, j, overlap, jaccard) of row pairs i < j that share at least so many
    columns and reach the similarity (an extension; the pattern counts)."""
    sets, members = classes(a)
    found = similar_classes(sets, overlap, jaccard)
    if sets.where("rows > 1").isEmpty():
        return found.withColumnsRenamed({"c": "i", "d": "j"})
    mine, yours = members.select("c", F.col("i").alias("p")), members.select(F.col("c").alias("d"), F.col("i").alias("q"))
    apart = found.join(mine, "c").join(yours, "d").select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "overlap", "jaccard")
    alike = sets.where((F.col("rows") > 1) & (F.col("n") >= overlap)).select("c", F.col("n").cast("long").alias("overlap"), F.lit(1.0).alias("jaccard"))
    within = alike.join(mine, "c").join(members.select("c", F.col("i").alias("q")), "c").where("p < q").select(F.col("p").alias("i"), F.col("q").alias("j"), "overlap", "jaccard")
    return apart.unionByName(within)


def similarity_links(a: SparseMatrix, overlap: int = 1, jaccard: float | None = None) -> DataFrame:
    """(i, c, links): each row that has columns, the smallest row with the same ones,
    and with how many other rows it is similar. Copies aren't paired."""
    sets, members = classes(a)
    found = similar_classes(sets, overlap, jaccard)
    both = found.select("c", "d").unionByName(found.select(F.col("d").alias("c"), F.col("c").alias("d")))
    others = both.join(sets.select(F.col("c").alias("d"), "rows"), "d").groupBy("c").agg(F.sum("rows").alias("links"))
    own = F.when(F.col("n") >= overlap, F.col("rows") - 1).otherwise(0)
    total = sets.join(others, "c", "left").select("c", (own + F.coalesce("links", F.lit(0))).alias("links"))
    return members.join(total, "c").select("i", "c", "links")
