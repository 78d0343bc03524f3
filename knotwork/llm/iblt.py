"""Document fingerprints as invertible Bloom lookup sketches.

A document is the set of digests of its paragraphs: its lines, and the first
24, next 96, next 384 and then each 1,536 characters of a line apart, so that an
edit in a long line leaves the rest alone. A sketch has 2^k parts of three rows
of sixteen cells; the upper bits of a digest choose its part, twelve others its
cell in each row. A cell holds the exclusive or of its digests, so a version
is subtracted by the same operation, and what both share vanishes. The low 24
bits of a digest are a check hash of the others, by which a cell with one digest
left is told. Taking that digest out of its other cells frees the next, until
the sketch is empty: what was taken out are the digests in which the versions
differ. Sketches that do not come out empty are built again twice as large.

The returned fingerprint is the sketch at the size that the number of digests
asks for, all cells with all bits, so two of equal size can be subtracted and
peeled by whoever holds them.

All of it is DataFrame and SQL functions. The text crosses the network once,
to stand beside the next document's; the rest happens within a row, in time
that grows as n log n with its digests, and leaves nothing on disk.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROWS, COLUMNS = 3, 16
CELLS = ROWS * COLUMNS
#: Digests a part should hold; tries, each twice as large, before the exact difference; most bits of a part's number.
LOAD, TRIES, BITS = 16, 8, 24
#: Most ranges that rows are dealt over to find the next document, and equal rows that one task writes out.
RANGES, PIECE = 20_000, 10_000
_CHECK = (1 << 24) - 1


def paragraphs(text: str) -> str:
    """SQL for the sorted set of paragraph digests of a text column: 40 bits of a
    hash, and 24 bits of a check hash of these."""
    rest = "if(length(x) > 504, regexp_extract_all(substr(x, 505), '(?s)(.{1,1536})', 1), array())"
    cut = f"concat(array(substr(x, 1, 24), substr(x, 25, 96), substr(x, 121, 384)), {rest})"
    units = f"filter(flatten(transform(split({text}, '\n'), x -> {cut})), x -> x <> '')"
    return f"array_sort(array_distinct(transform({units}, x -> transform(array(xxhash64(x) & {~_CHECK}L), h -> h | (xxhash64(h) & {_CHECK}L))[0])))"


def bits_of(digests: str) -> str:
    """SQL for the bits that number the parts of an array's sketch."""
    return f"if(size({digests}) <= {LOAD}, 0, least({BITS}, cast(ceil(log2(size({digests}) / {LOAD}.0)) as int)))"


def cells_of(digests: str) -> str:
    """SQL for the cells of an array of digests of one part: four bits of a
    digest choose its cell in each row."""
    shifts, columns = (f"array({', '.join(map(str, x))})" for x in ([24 + 4 * r for r in range(ROWS)], range(COLUMNS)))
    return f"flatten(transform({shifts}, j -> transform({columns}, c -> aggregate({digests}, 0L, (a, d) -> if((shiftright(d, j) & {COLUMNS - 1}) = c, a ^ d, a)))))"


def sketch(digests: str, bits: str) -> str:
    """SQL for the cells of a sorted array of digests, part after part. Upper
    bits number the parts, so each is a slice, found by halving."""
    part = "cast(shiftright(get(y.s, at + w - 1), 64 - y.b) as int) + shiftleft(1, y.b - 1)"
    below = f"aggregate(y.w, 0, (at, w) -> if(at + w <= size(y.s) and {part} < {{}}, at + w, at))"
    slices = f"transform(sequence(0, shiftleft(1, y.b) - 1), q -> slice(y.s, {below.format('q')} + 1, {below.format('q + 1')} - {below.format('q')}))"
    steps = f"filter(transform(sequence(30, 0, -1), i -> shiftleft(1, i)), i -> i <= size({digests}))"
    many = f"transform(array(named_struct('s', {digests}, 'b', {bits}, 'w', {steps})), y -> flatten(transform({slices}, g -> {cells_of('g')})))[0]"
    return f"if({bits} = 0, {cells_of(digests)}, {many})"


def peel(cells: str) -> str:
    """SQL for the digests recovered from one part's cells of a difference, null
    if some stay mixed."""
    pure = f"array_distinct(filter(s.k, k -> k <> 0 and (k & {_CHECK}L) = (xxhash64(k & {~_CHECK}L) & {_CHECK}L)))"
    state = "struct<k:array<bigint>,out:array<bigint>,done:boolean>"
    step = f"transform(array({pure}), p -> if(size(p) = 0, named_struct('k', s.k, 'out', s.out, 'done', true), named_struct('k', zip_with(s.k, {cells_of('p')}, (u, v) -> u ^ v), 'out', concat(s.out, p), 'done', false)))[0]"
    start = f"cast(named_struct('k', {cells}, 'out', array(), 'done', false) as {state})"
    left = f"aggregate(sequence(1, {CELLS + 1}), {start}, (s, r) -> if(s.done, s, cast({step} as {state})))"
    return f"transform(array({left}), z -> if(exists(z.k, k -> k <> 0), null, z.out))[0]"


def differing(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """SQL for the digests in which the sorted sets a and b differ: their sketches
    are subtracted and peeled, at the size of the larger one and then twice as
    large again and again, until they come out. The given sketches have the size
    of their own sets, and are taken as they are where that is the size asked for."""
    state = "struct<ok:boolean,d:array<bigint>>"
    both = f"greatest({bits_of(a)}, {bits_of(b)})"
    at = [f"if(t = 0 and y2.m = {bits_of(x)}, {held}, {sketch(x, 'least(30, y2.m + t)')})" for x, held in ((a, sketch_a), (b, sketch_b))]
    parts = f"transform(sequence(0, cast(size(k0) / {CELLS} as int) - 1), i -> {peel(f'slice(k0, i * {CELLS} + 1, {CELLS})')})"
    once = f"transform(array(zip_with({at[0]}, {at[1]}, (u, v) -> u ^ v)), k0 -> transform(array({parts}), f -> if(exists(f, o -> o is null), named_struct('ok', false, 'd', array()), named_struct('ok', true, 'd', flatten(f))))[0])[0]"
    tries = f"aggregate(sequence(0, {TRIES - 1}), cast(named_struct('ok', false, 'd', array()) as {state}), (v0, t) -> if(v0.ok, v0, cast({once} as {state})))"
    # digests alike in every bit that places them
    exact = f"concat(array_except({a}, {b}), array_except({b}, {a}))"
    return f"transform(array(named_struct('m', {both})), y2 -> transform(array({tries}), e -> if(e.ok, e.d, {exact}))[0])[0]"


def likeness(a: str, b: str, differ: str) -> Column:
    """Shared digests over all; 1 for two empty sets, which have no cells."""
    n = F.size(a) + F.size(b)
    d = F.size(differ)
    return F.when(n == 0, 1.0).otherwise((n - d) / (n + d).cast("double"))


def fingerprint(digests: str, cells: str) -> Column:
    """The number of digests and the list of all cells; equal texts have equal
    fingerprints, and sketches of equal size are subtracted cell by cell."""
    return F.concat(F.size(digests), F.lit(":"), F.translate(F.col(cells).cast("string"), "[] ", ""))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and key and tie, which put rows in order: a null doc_id last,
    rows of one doc_id by a hash of their texts."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))


def _marks(keyed: DataFrame) -> tuple[list[int], int, int]:
    """Approximate quantiles of key, in how many parts they cut the rows, and the rows."""
    n = min(RANGES, 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks, rows = keyed.select(F.percentile_approx("key", [k / n for k in range(1, n)], F.lit(20 * n)), F.count("*")).first()
    return marks or [], n, rows


def heavy_rows(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """keyed(doc_id, text, key, tie) with one row of each that is repeated for more than
    a range's share, and (doc_id, text, copies): those rows with the number of their
    others, each of which has a copy as next; None if there are none. A row repeated
    for two shares has a key that two quantiles fall on; only such keys are counted."""
    marks, parts, rows = _marks(keyed)
    keys = [k for k, n in Counter(marks).items() if n > 1]
    if not keys:
        return keyed, None
    often = keyed.where(F.col("key").isin(keys)).groupBy("key", "tie").agg(F.count("*").alias("n")).where(F.col("n") > max(1.0, rows / parts))
    often = materialize(often)  # fewer than the parts
    if often.isEmpty():
        return keyed, None
    one = keyed.join(F.broadcast(often), ["key", "tie"]).groupBy("key", "tie").agg(*(F.any_value(c).alias(c) for c in ("doc_id", "text", "n")))
    one = materialize(one)
    rest = keyed.join(F.broadcast(often.select("key", "tie")), ["key", "tie"], "left_anti").select(*keyed.columns)
    return rest.unionByName(one.select(*keyed.columns)), one.select("doc_id", "text", (F.col("n") - 1).alias("copies"))


def beside_next(docs: DataFrame) -> DataFrame:
    """(range, doc_id, text, next_text): next is the next lower doc_id, after the last
    the first. Rows with equal doc_id are ordered by a hash of their texts; a
    null doc_id comes last. Equal rows have each other or the next as next."""
    return _beside(_keyed(docs))


def _beside(docs: DataFrame) -> DataFrame:
    """Rows are dealt by ranges of doc_id taken from approximate quantiles, so
    neighbours meet in one shuffle of the texts; a doc_id that several quantiles
    fall on has so many ranges, by the hashes. The first row of every range
    follows the last of the range before.
    """
    marks, _, _ = _marks(docs)
    cuts = sorted(set(marks))
    if cuts:
        # one literal each, and the number of cuts below key by halving
        listed = lambda x: F.expr(f"cast(split('{','.join(map(str, x))}', ',') as array<bigint>)")
        times = {c: marks.count(c) for c in cuts}
        most = max(times.values()) + 1
        widths = listed([1 << k for k in reversed(range(len(cuts).bit_length()))])
        table, often = listed(cuts), listed([times[c] for c in cuts])
        below = F.aggregate(widths, F.lit(0).cast("long"), lambda at, w: F.when(F.coalesce(F.get(table, (at + w - 1).cast("int")) < F.col("key"), F.lit(False)), at + w).otherwise(at))
        docs = docs.withColumn("below", below.cast("int"))
        hot = F.coalesce((F.get(table, F.col("below")) == F.col("key")) & (F.get(often, F.col("below")) > 1), F.lit(False))
        sub = F.expr("shiftright(tie, 33) + 1073741824L") * F.get(often, F.col("below"))
        place = ((F.lit(len(cuts)) - F.col("below")) * 2 + F.when(hot, 0).otherwise(1)) * most + F.when(hot, F.shiftright(sub, 31)).otherwise(0)
        docs = docs.withColumn("range", place.cast("long")).drop("below")
    else:
        docs = docs.withColumn("range", F.lit(0).cast("long"))
    order = Window.partitionBy("range").orderBy(F.desc("key"), "tie")
    firsts = docs.groupBy("range").agg(F.min(F.struct(F.bitwise_not("key").alias("down"), "tie")).alias("one"))
    firsts = materialize(firsts.select("range", "one.*"))  # one row for each range: some 2 * n at most
    ring = Window.orderBy("range")
    after = firsts.select(F.col("range").alias("_range"), F.coalesce(F.lead("range").over(ring), F.first("range").over(ring)).alias("follows"))
    heads = docs.join(F.broadcast(firsts.select(F.col("range").alias("_r"), F.bitwise_not("down").alias("_k"), F.col("tie").alias("_t"))), (F.col("range") == F.col("_r")) & (F.col("key") == F.col("_k")) & (F.col("tie") == F.col("_t")))
    heads = heads.groupBy("range").agg(F.any_value("text").alias("head"))
    heads = after.join(heads, F.col("follows") == F.col("range")).select("_range", "head")
    lead = docs.withColumn("next_text", F.lead("text").over(order))
    # one text for each range
    return lead.join(heads, F.col("range") == F.col("_range")).select("range", "doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_chars, edited_sha256 of
    the text with its last third replaced by the start of the next document's,
    both fingerprints, the likeness to the edited and to the next text, and
    edited_digests, the paragraph digests in which text and edited text differ.
    Null texts count as empty."""
    rows, heavy = heavy_rows(_keyed(docs))
    found = _compared(_beside(rows))
    if heavy is None:
        return found
    # what a row is beside its copy is found once, and written by several tasks
    piece = F.lit(PIECE).cast("long")
    parts = _compared(heavy.withColumn("next_text", F.col("text")), "copies").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, piece)))
    parts = parts.repartition("doc_id", "fingerprint", "part")
    return found.unionByName(parts.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.least(piece, F.col("copies") - F.col("part"))))).drop("copies", "part"))


def _compared(both: DataFrame, *more: str) -> DataFrame:
    """What fingerprints() returns for rows (doc_id, text, next_text), and the columns ``more``."""
    both = both.withColumn("n", F.length("text"))
    k = F.floor(F.col("n") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - k), F.substring("next_text", F.lit(1), k)))
    sets = both.select("doc_id", *more, F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(F.expr(paragraphs(c)).alias(a) for c, a in (("text", "_a"), ("edited", "_e"), ("next_text", "_x"))))
    held = sets.select("*", *(F.expr(sketch(c, bits_of(c))).alias(f"_s{c}") for c in ("_a", "_e", "_x")))
    found = held.select("*", *(F.expr(differing("_a", c, "_s_a", f"_s{c}")).alias(f"_d{c}") for c in ("_e", "_x")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("_a", "_s_a").alias("fingerprint"), fingerprint("_e", "_s_e").alias("edited_fingerprint"),
        likeness("_a", "_e", "_d_e").alias("near_edited"), likeness("_a", "_x", "_d_x").alias("near_next"), F.col("_d_e").alias("edited_digests"), *more,
    )


def op9(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness.

    Null counts as empty; two empty texts are alike (1.0). Texts count whole,
    however long. Rows with equal doc_id follow each other by a hash of their
    texts, rows without doc_id come last; repeated rows get a row each and stand
    beside each other. A lone row is its own next. An empty table gives no rows;
    other columns aren't looked at.
    """
    return fingerprints(docs).drop("edited_digests")
