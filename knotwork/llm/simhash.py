"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Its low 46 bits are two words of the perfect binary
Golay code (23 bits, covering radius 3); pairs of code words are the anchors.
Every fingerprint is at home at the anchor that its two words decode to, at
most 3 bits away in either word. A fingerprint within ``radius`` bits of it
lies within 3 + radius bits of that anchor, so each fingerprint is sent to all
anchors that near (the excess over 3, summed over both words, being at most
radius), and residents are compared with visitors anchor by anchor. No pair is
missed, since it meets at either one's home. Sent rows grow in proportion to
the distinct fingerprints (about 60 each), whatever their number.

At a similarity of 0.8 some ten of 64 bits differ, beyond what a covering can
promise. For that, stage() takes fingerprints of 256 bits, covers eight parts
of 46 bits each by such anchors, compares all 256 bits at the anchors, and the
shingle sets of all pairs that the bits don't tell apart. Bits alone link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, materialize, quoted, unused

WORD_BITS, CHECK_BITS, COVER = 23, 11, 3
#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GENERATOR = 0b110001110101
MASK = (1 << WORD_BITS) - 1
#: Words of 64 bits of a wide fingerprint, and bits up to which two texts are
#: compared. At a Jaccard similarity of 0.8 some 39 differ, with a standard
#: deviation of 6.
WIDE, DIFFER = 4, 54
#: Rows, of 20 bytes each, up to which a list of rows is broadcast.
FEW = 1_000_000


def _digests(text: str | None, shingle: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i : len(words) - shingle + 1 + i] for i in range(shingle)), strict=True))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, 42) for g in grams], dtype="<u8")


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 16384):
        ones += np.unpackbits(h[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of ASCII-lower-cased word shingles, repeats included.

    No words (or null): 0. Fewer words than a shingle: the whole sequence.
    """
    return _majority(_digests(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - CHECK_BITS)), r)
    return r


@lru_cache(maxsize=4)
def errors(radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By excess 0..radius: (start by syndrome, error words) of the errors of
    weight up to 3 (excess 0) or 3 + excess that lead to a code word."""
    levels = {0: np.zeros(1, dtype=np.int64)}
    for weight in range(1, COVER + radius + 1):
        below = levels[weight - 1]
        grown = [below[(below >> bit) == 0] | (1 << bit) for bit in range(WORD_BITS)]
        levels[weight] = np.concatenate(grown)
    out = []
    for excess in range(radius + 1):
        e = np.concatenate([levels[w] for w in range(COVER + 1)]) if excess == 0 else levels[COVER + excess]
        s = syndrome(e)
        order = np.argsort(s, kind="stable")
        out.append((np.searchsorted(s[order], np.arange((1 << CHECK_BITS) + 1)), e[order]))
    return out


def _spread(rows: np.ndarray, table: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once for every error of its syndrome, and those errors."""
    start, words = table
    n = start[s + 1] - start[s]
    at = np.repeat(start[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(rows, n), words[at]


def anchors_of(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) for every anchor that a fingerprint is sent to."""
    u = fp.view(np.uint64)
    a, b = (u & np.uint64(MASK)).astype(np.int64), (u >> np.uint64(WORD_BITS) & np.uint64(MASK)).astype(np.int64)
    sa, sb, tables = syndrome(a), syndrome(b), errors(radius)
    rows, anchors, home = [], [], []
    for x in range(radius + 1):
        r1, e1 = _spread(np.arange(len(fp)), tables[x], sa)
        for y in range(radius + 1 - x):
            r2, e2 = _spread(np.arange(len(r1)), tables[y], sb[r1])
            row = r1[r2]
            rows.append(row)
            anchors.append((a[row] ^ e1[r2]) >> CHECK_BITS << (WORD_BITS - CHECK_BITS) | (b[row] ^ e2) >> CHECK_BITS)
            home.append(np.full(len(row), x + y == 0))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def _stars(anchor: np.ndarray, fp: np.ndarray, rep: np.ndarray, home: np.ndarray, radius: int, doubt: int = -1, block: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Links found at whole anchors (rows sorted by anchor), thinned to (node,
    smallest node of its set): the same connection with fewer rows than members.
    Then which rows are in doubt: they have a partner at more than radius but at
    most ``doubt`` bits that the links found so far don't connect with them."""
    ids, at = np.unique(rep, return_inverse=True)
    label = np.arange(len(ids))
    unsure = np.zeros(len(anchor), dtype=bool)
    begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[begin, len(anchor)])
    first, count = np.repeat(begin, size)[home], np.repeat(size, size)[home]
    residents, done = np.flatnonzero(home), 0
    while done < len(residents):
        # as many residents as give about block comparisons, one at least
        upto = done + max(1, int(np.searchsorted(np.cumsum(count[done : done + block]), block)))
        n = count[done:upto]
        for low in range(0, int(n.max()), block):
            m = np.minimum(np.maximum(n - low, 0), block)
            i = np.repeat(residents[done:upto], m)
            j = np.repeat(first[done:upto] + low, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            bits = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64))
            bits = bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.uint16)
            near = (bits <= radius) & (i != j)
            x, y = at[i[near]], at[j[near]]
            while True:  # smallest label over each link, then over chains of labels
                moved = label.copy()
                least = np.minimum(label[x], label[y])
                np.minimum.at(moved, label[x], least)
                np.minimum.at(moved, label[y], least)
                moved = moved[moved[moved]]
                if (moved == label).all():
                    break
                label = moved
            if doubt > radius:
                far = (bits > radius) & (bits <= doubt)
                i, j = i[far], j[far]
                apart = label[at[i]] != label[at[j]]
                unsure[i[apart]] = unsure[j[apart]] = True
        done = upto
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]], unsure


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in fps(fp) exactly as
    all links at ``radius`` or fewer differing bits would."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 64 << 10):
            fp = b.column("fp").to_numpy()
            row, anchor, home = anchors_of(fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            x, y, _ = _stars(anchor, fp, fp, home, radius)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "fp", "home")]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last anchor may go on
            held = [x[cut:] for x in part]
            if cut:
                yield found(*(x[:cut] for x in part))
        if held is not None:
            yield found(*held)

    sent = fps.select("fp").mapInArrow(send, "anchor int, fp long, home boolean")
    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of fingerprints
    that differ in ``radius`` bits at most. Null or empty texts have the
    fingerprint 0 and link like any other. Repeated rows are kept. Rows without
    doc_id link, too, and others are reached through them; only a component of
    such rows alone has no component_id.
    """
    fps = materialize(fingerprints(docs, shingle))
    # a fingerprint is the node, so rows of any doc_id, or none, take part
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(reps, radius)).withColumnRenamed("node", "fp")
    named = reps.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document, by three-word shingles and 2 bits.

    Null and empty texts have the fingerprint 0 and link like any other. Texts
    are read whole, however long. Ties: the smallest doc_id names a component.
    Repeated rows get a row each; rows without doc_id link and are named like
    others, null only if no doc_id can be reached. An empty table gives no rows;
    other columns aren't looked at.
    """
    found = near_duplicates(docs, shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(text: str | None, shingle: int) -> np.ndarray:
    """SimHash of 64 * WIDE bits over the distinct shingles, so that the bits
    follow the Jaccard similarity of the sets, whatever is repeated."""
    return _wide(np.unique(_digests(text, shingle)))


def _wide(h: np.ndarray) -> np.ndarray:
    out = np.zeros(WIDE, dtype=np.uint64)
    for k in range(WIDE if len(h) else 0):
        out[k] = _majority(h)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
        h ^= h >> np.uint64(33)
    return out


def tie_of(docs: DataFrame) -> Column:
    """Digest of the text, which with doc_id tells rows apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def wide_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, tie, f0, f1, ..., key) as signed longs, one row per row of docs;
    tie is a digest of the text and key one of the set of shingles."""
    names = [f"f{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            grams = [np.unique(_digests(t, shingle)) for t in b.column("text").to_pylist()]
            fp = np.array([[*_wide(h), xxhash.xxh64_intdigest(h.tobytes())] for h in grams], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WIDE + 1))], ["doc_id", "tie", *names, "key"])

    return docs.select(F.col("doc_id").cast("long"), tie_of(docs).alias("tie"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tie long, " + ", ".join(f"{k} long" for k in (*names, "key")))


def wide_links(reps: DataFrame, radius: int = 1, differ: int = DIFFER) -> DataFrame:
    """Rows (anchor, node, f0, ...) of those of reps(f0, ..., rep), with rep as the
    node, that have a partner of up to ``differ`` bits at that anchor, equal ones
    included: they need a comparison of the texts there.

    Low and high 46 bits of each word are covered apart, with anchors of their
    own. Pairs within ``radius`` bits in any of these share an anchor for sure,
    and farther ones often do, so all rows of an anchor are compared.
    """
    names = [f"f{k}" for k in range(WIDE)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 128 << 10):
            for k, name in enumerate(names):
                word = b.column(name).to_numpy().view(np.uint64)
                for half, part in enumerate((word, word >> np.uint64(64 - 2 * WORD_BITS))):
                    row, anchor, _ = anchors_of(np.ascontiguousarray(part), radius)
                    row, anchor = pa.array(row), (2 * k + half << 2 * (WORD_BITS - CHECK_BITS)) + anchor
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), *(b.column(c).take(row) for c in ("rep", *names))], ["anchor", "rep", *names])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(anchor: np.ndarray, rep: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
            # a radius of -1: no bits are a link
            _, _, unsure = _stars(anchor, np.stack(words, axis=1), rep, np.ones(len(anchor), dtype=bool), -1, differ)
            yield pa.RecordBatch.from_arrays([pa.array(x[unsure]) for x in (anchor, rep, *words)], ["anchor", "node", *names])

        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "rep", *names)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last anchor may go on
            held = [x[cut:] for x in part]
            if cut:
                yield from found(*(x[:cut] for x in part))
        if held is not None:
            yield from found(*held)

    sent = reps.mapInArrow(send, "anchor int, rep long, " + ", ".join(f"{k} long" for k in names))
    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "anchor int, node long, " + ", ".join(f"{k} long" for k in names))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, grams) of texts(node, text): sorted distinct shingle digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1 << 20):
            sets = [np.unique(_digests(t, shingle).view(np.int64)) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def sets_of(rows: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Shingle sets of the documents in rows(node, doc_id, tie), by node."""
    texts = docs.select(F.col("doc_id").cast("long").alias("own"), tie_of(docs).alias("tie"), F.col("text").cast("string").alias("text"))
    texts = texts.join(rows, (texts["tie"] == rows["tie"]) & texts["own"].eqNullSafe(rows["doc_id"])).select("node", "text")
    # rows equal in doc_id and text are one
    return materialize(shingle_sets(texts.groupBy("node").agg(F.min("text").alias("text")), shingle))


def set_bytes(sets: DataFrame) -> DataFrame:
    """(node, bytes): about the memory that a document's set takes."""
    return sets.select("node", (F.size("grams") * 8 + 100).cast("long").alias("bytes"))


def _merged(label: np.ndarray, side: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], least: float, differ: int) -> list[tuple[int, int]]:
    """Positions of pairs with sets as similar as ``least`` that join rows of
    different labels: no more than connect what all such pairs would. Where
    side has two values, only pairs across are looked at."""
    size, label, out = np.array([len(x) for x in sets]), label.copy(), []
    across = (side != side[0]).any()
    for i in range(len(sets) - 1):
        near = np.bitwise_count((fp[i] ^ fp[i + 1 :]).view(np.uint64)).sum(axis=1, dtype=np.uint16) <= differ
        near &= (label[i + 1 :] != label[i]) & (size[i + 1 :] >= least * size[i]) & (size[i] >= least * size[i + 1 :])
        if across:
            near &= side[i + 1 :] != side[i]
        for j in np.flatnonzero(near) + i + 1:
            if label[i] == label[j]:
                continue
            one, other = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            found = np.searchsorted(other, one)
            both = np.count_nonzero(other[np.minimum(found, len(other) - 1)] == one) if len(one) else 0
            if both >= least * (len(one) + len(other) - both):
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def alike(doubtful: DataFrame, sets: DataFrame, least: float, differ: int = DIFFER, block: int = 16 << 20) -> DataFrame:
    """Edges (a, b) between rows of doubtful(anchor, node, label, bytes, f0, ...) of an
    anchor with different labels, up to ``differ`` bits and shingle sets of a
    Jaccard similarity of ``least`` or more, as many as connect all of these.

    The sets travel to the anchors, where pairs are compared in place. An anchor
    with more than ``block`` bytes of sets is dealt over blocks by node, and
    each two blocks meet in a group of their own, so that none grows with it.
    """
    names = [f"f{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def found() -> pa.RecordBatch:
            node, label, side = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
            pairs = _merged(label, side, np.array([r[3] for r in rows], dtype=np.int64), [r[4] for r in rows], least, differ)
            return pa.RecordBatch.from_arrays([pa.array(node[[p[k] for p in pairs]], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            grams = b.column("grams")
            values, at = grams.values.to_numpy(), grams.offsets.to_numpy()
            fp = np.stack([b.column(k).to_numpy() for k in names], axis=1)
            for k, (anchor, low, high, node, label, side) in enumerate(zip(*(b.column(c).to_pylist() for c in ("anchor", "low", "high", "node", "label", "side")), strict=True)):
                if (anchor, low, high) != key:
                    if len(rows) > 1:
                        yield found()
                    key, rows = (anchor, low, high), []
                rows.append((node, label, side, fp[k], values[at[k] : at[k + 1]].copy()))
        if len(rows) > 1:
            yield found()

    # near rows share many anchors: of those with the very same rows one is enough
    hashed = F.xxhash64("node")
    same = [F.count("*").alias("rows"), F.min("node").alias("first"), F.bit_xor(hashed).alias("digest"), F.sum(F.pmod(hashed, F.lit(1 << 40))).alias("total")]
    anchors = doubtful.groupBy("anchor").agg(F.sum("bytes").alias("bytes"), F.min("label").alias("least"), F.max("label").alias("most"), *same)
    anchors = anchors.where("least <> most").groupBy("rows", "first", "digest", "total").agg(F.min("anchor").alias("anchor"), F.max("bytes").alias("bytes"))
    anchors = anchors.select("anchor", F.ceil(F.col("bytes") / block).cast("int").alias("n"))
    dealt = doubtful.join(anchors, "anchor").withColumn("side", F.pmod(F.xxhash64("node"), "n").cast("int"))
    # a lone block meets itself; of several, each two meet, and a block's own pairs are looked at in groups (k, k)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "anchor", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "label", "side", *names)
    keys = ["anchor", "low", "high"]
    held = dealt.join(sets, "node")
    return held.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, shingle: int = 5, radius: int = 1, least: float = 0.8) -> DataFrame:
    """(doc_id, tie, node, label) for every different (doc_id, text) of docs: as near_duplicates(),
    but linked at a Jaccard similarity of ``least`` or more. Rows with the same
    shingles are one node; of the others, wide fingerprints tell the pairs far from
    it, and all that are left are compared by their shingles. label is a node
    of the row's group, the same for all of the group."""
    names = [*(f"f{k}" for k in range(WIDE)), "key"]
    fps = materialize(wide_fingerprints(docs, shingle))
    one = F.min_by(F.struct("doc_id", "tie"), F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("one")
    nodes = materialize(fps.groupBy(*names).agg(one).withColumn("node", F.monotonically_increasing_id()))
    doubtful = materialize(wide_links(nodes.withColumnRenamed("node", "rep"), radius))
    wanted = nodes.join(doubtful.select("node").distinct(), "node", "left_semi").select("node", "one.*")
    sets = sets_of(wanted, docs, shingle)
    known = materialize(doubtful.withColumn("label", F.col("node")).join(set_bytes(sets), "node", "left"))  # read twice below
    label = components(alike(known, sets, least))
    named = nodes.join(label, "node", "left").select(*names, "node", F.coalesce("label", "node").alias("label"))
    return fps.join(named, names).select("doc_id", "tie", "node", "label")


def stage(docs: DataFrame, shingle: int = 5, radius: int = 1, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates: the smallest doc_id's.

    A row is told by doc_id and text: rows of one doc_id with different texts are
    different documents. Among rows of a group with the same smallest doc_id, the
    one with the smallest digest of its text stays, and of rows equal in both,
    one (which of them, if other columns differ, is open). Rows without doc_id
    come last, so they stay only in groups of their own. Null and empty texts are
    one group. Columns of docs may have any name; an empty table stays empty.
    """
    found = materialize(similar(docs, shingle, radius, least))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "tie")
    kept = found.groupBy("label").agg(F.min(first).alias("one"), F.count("*").alias("rows"))
    kept = kept.select(F.col("one.doc_id").alias("id"), F.col("one.tie").alias("tie"))
    often = found.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id2"), F.col("tie").alias("tie2"))
    kept = materialize(kept.join(often, (F.col("tie") == F.col("tie2")) & F.col("id").eqNullSafe(F.col("id2")), "left").select("id", "tie", F.col("tie2").isNotNull().alias("repeated")))
    id_, tie, n = unused("id", docs, kept), unused("tie", docs, kept), unused("repeated", docs)
    chosen = kept.select(F.col("id").alias(id_), F.col("tie").alias(tie), F.col("repeated").alias(n))
    row = unused("row", docs)
    with_tie = docs.withColumn(row, tie_of(docs))
    same = (F.col(row) == F.col(tie)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    own = [quoted(c) for c in docs.columns]
    single = with_tie.join(chosen.where(~F.col(n)), same, "left_semi").select(*own)
    repeated = chosen.where(F.col(n))
    if repeated.isEmpty():
        return single
    few = repeated.limit(FEW + 1).count() <= FEW
    several = with_tie.join(F.broadcast(repeated) if few else repeated, same, "left_semi").dropDuplicates(["doc_id", row])
    return single.unionByName(several.select(*own))
