"""Removal of repeated substrings by prefix-free parsing.

A byte has to go if a string of ``length`` bytes that covers it also starts
anywhere else. The texts are parsed into phrases by rolling-hash triggers: in
every window of ``window`` positions the smallest hash of 8 bytes is a trigger,
so two equal strings of ``length`` bytes are cut at the same places, whatever
stands around them. A phrase here is the run of start positions whose window
has the same trigger; its content reaches from the first of them to ``length``
bytes after the last.

The dictionary is the set of distinct phrases with their counts, the parse is
the list of phrases by document. A start position repeats exactly if

* its phrase occurs twice (all positions of such a phrase repeat), or
* its phrase is met once, but another phrase with the same text after the
  trigger (its context) has the same ``length`` bytes at the same distance
  from the trigger. Only such phrases, at the borders of repeated passages,
  are resolved position by position.

The suffixes of the dictionary's border phrases are put in order, context by
context, by their bytes: a suffix array, in which a string repeats if it has
``length`` bytes in common with its neighbour. Phrases of different contexts
have no string in common, so these arrays together are the order of all of
them, and no task holds more than one context of at most ``GROUP`` suffixes.
The phrases of larger contexts (passages that thousands of texts quote, each in
other words) have the digest of each string instead, which are brought together
by aggregations that combine before they shuffle. Whole phrases are told by
digests, too, of 96 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize

LENGTH, WINDOW, GRAM = 400, 128, 8
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are looked at together, and most suffixes of a context that one task puts in order (52 MB at 400 bytes each).
PIECE, GROUP = 1 << 19, 1 << 17


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=4)
def _held_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power(base, n), _power(pow(base, -1, 1 << 64), n)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _held_powers(base, max(PIECE + (1 << 16), 1 << (n.bit_length() if n > PIECE + (1 << 16) else 0)))
    return up[:n], down[:n]


class Digests:
    """96-bit digests of any substring of a buffer, each in constant time.

    Two sums over mixed 8-byte grams times powers of odd bases, modulo 2^64.
    Buffers have no more than a piece and its overlap.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        x = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate([data, np.zeros(GRAM, dtype=np.uint8)])
        for k in range(GRAM):
            x |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        x *= _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        self.grams = x
        self.down, self.sums = [], []
        for k, base in enumerate(_BASES):
            if k:
                x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            up, down = _powers(base, n)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(x * up, out=sums[1:])
            self.down.append(down)
            self.sums.append(sums)

    def __call__(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """The first 64 bits of the digests of data[start:end], at least GRAM bytes
        each, or 64 bits of which upper() takes the other 32."""
        sums = self.sums[which]
        out = (sums[end - GRAM + 1] - sums[start]) * self.down[which][start]
        out ^= out >> np.uint64(31)
        out *= _MIX
        return out ^ out >> np.uint64(33)


def upper(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
    return np.frombuffer(b"".join(raws), dtype=np.uint8), np.r_[np.int64(0), ends]


def groups(raws: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours that have about size bytes together, one at least."""
    at = 0
    while at < len(raws):
        upto, held = at, 0
        while upto < len(raws) and (upto == at or held + len(raws[upto]) <= size):
            held += len(raws[upto])
            upto += 1
        yield at, upto
        at = upto


def phrases(data: np.ndarray, bounds: np.ndarray, length: int, window: int) -> tuple[Digests, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, document, first start, last start, trigger) of all phrases of the
    documents data[bounds[i]:bounds[i + 1]]; positions count from the buffer's start."""
    dig = Digests(data)
    n = len(data)
    key = dig.grams & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    step, best = 1, key
    while step < window:  # smallest key of the window that starts at each position
        more = min(step, window - step)
        best = np.concatenate([np.minimum(best[: n - more], best[more:]), best[n - more :]]) if n > more else best
        step += more
    trigger = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(np.arange(n) + length <= bounds[1:][doc])  # where a whole string starts
    if not len(start):
        return (dig, *(np.zeros(0, dtype=np.int64) for _ in range(4)))
    t = trigger[start]
    new = np.r_[True, (t[1:] != t[:-1]) | (doc[start[1:]] != doc[start[:-1]])]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(start)] - 1
    return dig, doc[start[at]], start[at], start[last], t[at]


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(owner row, flat elements) of a list column."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), n), column.flatten()


def keyed(docs: DataFrame) -> DataFrame:
    """doc and tie tell rows apart. Rows equal in both doc_id and text share
    them, which is harmless: each counts, and they lose the same bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def parse(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(context, phrase, more_phrase, doc, tie, at): the parse of every document of
    keyed(). at is 1024 * first start + number of further starts, in bytes from
    the document's start; phrase and more_phrase are its digest.

    A long text is parsed piece by piece: the next piece begins with the last
    phrase of the one before, which may go on.
    """
    names = ["context", "phrase", "more_phrase", "doc", "tie", "at"]

    def rows(doc: pa.Array, tie: pa.Array, raws: list[bytes], offset: int, more: bool) -> tuple[pa.RecordBatch, int]:
        """The phrases of some texts, or of a piece without its last phrase, and where that starts."""
        data, bounds = joined(raws)
        dig, own, first, last, at = phrases(data, bounds, length, window)
        rest = 0
        if more:
            rest = int(first[-1])
            own, first, last, at = (x[:-1] for x in (own, first, last, at))
        shape = (at - first).astype(np.uint64) * _MIX ^ (last - first).astype(np.uint64)
        whole = [(dig(first, last + length, 0) + shape).view(np.int64), upper(dig(first, last + length, 1) + shape)]
        where = (first - bounds[own] + offset) << 10 | (last - first)
        own = pa.array(own)
        return pa.RecordBatch.from_arrays([pa.array(dig(at, at + (length - window + 1), 0).view(np.int64)), *map(pa.array, whole), doc.take(own), tie.take(own), pa.array(where)], names), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, PIECE):
            raws = encoded(b.column("text").to_pylist())
            for lo, hi in groups(raws, piece):
                doc, tie = b.column("doc").slice(lo, hi - lo), b.column("tie").slice(lo, hi - lo)
                at, raw = 0, raws[lo]
                while hi == lo + 1 and len(raw) - at > 2 * piece:
                    found, rest = rows(doc, tie, [raw[at : at + piece + length]], at, True)
                    yield found
                    at += rest
                yield rows(doc, tie, [raw[at:]] if at else raws[lo:hi], at, False)[0]

    return docs.select("doc", "tie", "text").where(F.octet_length("text") >= length).mapInArrow(run, "context long, phrase long, more_phrase int, doc long, tie long, at long")


def _picked(by_doc: DataFrame, docs: DataFrame, found: Callable, schema: str, piece: int) -> DataFrame:
    """What found(texts, owner of each pick, its start, the picks) gives for the texts of
    docs with picks by_doc(doc, tie, at). Texts are handed out in groups, a long one
    by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, PIECE):
            raws = encoded(b.column("text").to_pylist())
            row, flat = _lists(b.column("at"))
            edges = np.searchsorted(row, np.arange(len(raws) + 1))
            for lo, hi in groups(raws, piece):
                some = slice(int(edges[lo]), int(edges[hi]))
                yield from found(raws[lo:hi], row[some] - lo, flat.slice(some.start, some.stop - some.start), b.column("doc").slice(lo, hi - lo), b.column("tie").slice(lo, hi - lo))

    # the columns of the last join, so that the texts are shuffled once for all
    return docs.join(by_doc, ["doc", "tie"]).select("doc", "tie", "doc_id", "text", "at").mapInArrow(run, schema)


def strings_at(borders: DataFrame, docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(string, more_string, ref): the digest of every string that starts in a phrase of
    borders(class, n, doc, tie, at); ref is 2048 * class + 2 * start in it, and 1
    more if the phrase is met once."""

    def digests(part: list[bytes], own: np.ndarray, start: np.ndarray, ref: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, bounds = joined(part)
        dig, begin = Digests(data), bounds[own] + start
        for k in range(0, len(begin), 1 << 16):
            x = begin[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(dig(x, x + length, 0).view(np.int64)), pa.array(upper(dig(x, x + length, 1))), pa.array(ref[k : k + (1 << 16)])], ["string", "more_string", "ref"])

    def found(raws: list[bytes], row: np.ndarray, picks: pa.StructArray, doc: pa.Array, tie: pa.Array) -> Iterator[pa.RecordBatch]:
        ids, at, met = (picks.field(k).to_numpy() for k in ("class", "at", "n"))
        n = (at & 1023) + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own, start, ref = np.repeat(row, n), np.repeat(at >> 10, n) + step, np.repeat(ids * 2048 + (met == 1), n) + 2 * step
        if len(raws) > 1 or len(raws[0]) <= 2 * piece:
            yield from digests(raws, own, start, ref)
            return
        for k in range(0, len(raws[0]), piece):
            here = (start >= k) & (start < k + piece)
            if here.any():
                yield from digests([raws[0][k : k + piece + length]], own[here], start[here] - k, ref[here])

    by_doc = borders.groupBy("doc", "tie").agg(F.collect_list(F.struct("class", "at", "n")).alias("at"))
    return _picked(by_doc, docs, found, "string long, more_string int, ref long", piece)


def repeated_starts(contents: list[bytes], starts: list[int], length: int) -> np.ndarray:
    """Which of the first starts[k] positions of each content begin a string of
    length bytes that begins at another of all these positions, too: all suffixes,
    as far as length bytes, in order, and compared with their neighbours."""
    rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(c, dtype=np.uint8), length)[:n] for c, n in zip(contents, starts, strict=True)])
    suffix = rows.view(np.dtype((np.void, length))).ravel()
    order = np.argsort(suffix, kind="stable")
    equal = np.empty(len(order) + 1, dtype=bool)
    equal[0] = equal[-1] = False
    for k in range(0, len(order) - 1, 1 << 14):
        upto = min(len(order) - 1, k + (1 << 14))
        equal[k + 1 : upto + 1] = (rows[order[k + 1 : upto + 1]] == rows[order[k:upto]]).all(axis=1)
    out = np.empty(len(order), dtype=bool)
    out[order] = equal[1:] | equal[:-1]
    return out


def resolved(borders: DataFrame, docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(doc, tie, at): starts in phrases met once of borders(context, n, doc, tie, at) of
    strings that another phrase of the context has, or the phrase itself elsewhere."""
    names = ["context", "doc", "tie", "at", "once", "content"]

    def cut(raws: list[bytes], row: np.ndarray, picks: pa.StructArray, doc: pa.Array, tie: pa.Array) -> Iterator[pa.RecordBatch]:
        at = picks.field("at").to_numpy()
        for k in range(0, len(at), 1024):
            some = slice(k, k + 1024)
            content = [raws[r][x >> 10 : (x >> 10) + (x & 1023) + length] for r, x in zip(row[some].tolist(), at[some].tolist(), strict=True)]
            own = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([picks.field("context").slice(k, 1024), doc.take(own), tie.take(own), pa.array(at[some]), pa.array(picks.field("n").to_numpy()[some] == 1), pa.array(content, pa.binary())], names)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[list[int]] = [[], [], []]

        def done() -> None:
            starts = [(r[3] & 1023) + 1 for r in held]
            repeat, at = repeated_starts([r[5] for r in held], starts, length), 0
            for (_, doc, tie, first, once, _), n in zip(held, starts, strict=True):
                if once:
                    for step in np.flatnonzero(repeat[at : at + n]).tolist():
                        out[0].append(doc)
                        out[1].append(tie)
                        out[2].append(((first >> 10) + step) << 10)
                at += n
            held.clear()

        def written() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc", "tie", "at"])
            for x in out:
                x.clear()
            return batch

        for b in bounded(batches, PIECE):
            for r in zip(*(b.column(k).to_pylist() for k in names), strict=True):
                if held and held[0][0] != r[0]:
                    done()
                held.append(r)
            yield written()
        if held:
            done()
        yield written()

    by_doc = borders.groupBy("doc", "tie").agg(F.collect_list(F.struct("context", "at", "n")).alias("at"))
    contents = _picked(by_doc, docs, cut, "context long, doc long, tie long, at long, once boolean, content binary", piece)
    return contents.repartition("context").sortWithinPartitions("context").mapInArrow(order, "doc long, tie long, at long")


def repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """(doc, tie, at): starts (first and number of more, as parse() packs them) of
    the strings of length bytes that also start anywhere else.

    The parse is made twice, since it is cheaper to hash the texts again than to
    write its rows, of which there is one for some sixty bytes of text.
    """
    found = parse(docs, length, window, piece)
    # small beside the parse, and apart so that the join can split a hot context
    contexts = materialize(found.groupBy("context").count().where("count > 1").select("context"))
    met = materialize(found.join(contexts, "context"))
    keys = ["context", "phrase", "more_phrase"]
    classes = met.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc", "tie", "at")).alias("one"))
    classes = materialize(classes.select(*keys, "n", "one.*").withColumn("class", F.monotonically_increasing_id()))
    often = classes.where("n > 1").select(*keys)
    out = met.join(often, keys).select("doc", "tie", "at")

    # borders: phrases that share their context with others; of a repeated one
    # a member is enough, for those met once to find
    mixed = classes.groupBy("context").agg(F.count("*").alias("phrases"), F.min("n").alias("least"), F.sum(F.col("at") % 1024 + 1).alias("size")).where("phrases > 1 and least = 1")
    borders = materialize(classes.join(mixed.select("context", "size"), "context").drop("phrase", "more_phrase"))
    out = out.unionByName(resolved(borders.where(F.col("size") <= group), docs, length, piece))
    large = borders.where(F.col("size") > group)
    if large.isEmpty():
        return out
    strings = strings_at(large, docs, length, piece)
    twice = strings.groupBy("string", "more_string").agg(F.min("ref").alias("low"), F.max("ref").alias("high")).where("low <> high").select("string", "more_string")
    hit = strings.where("ref % 2 = 1").join(twice, ["string", "more_string"]).select(F.expr("ref div 2048").alias("class"), F.expr("ref % 2048 div 2").alias("step"))
    single = large.where("n = 1").select("class", "doc", "tie", "at")
    return out.unionByName(hit.join(single, "class").select("doc", "tie", (F.expr("(at div 1024 + step) * 1024")).alias("at")))


def removed_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:], len(s)] - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed,
    spans (array of removed byte ranges), n_spans, kept (the rest as binary).

    Null text counts as empty. Texts shorter than ``length`` bytes lose
    nothing. Rows equal in doc_id and text count as two documents.
    """
    if not GRAM + window <= length or window > 1024 or piece < length + 2 * window:
        raise ValueError("window + 8 may not exceed length, nor window 1024, and a piece holds length + 2 * window")
    docs = keyed(docs)
    marks = repeats(docs, length, window, piece, group).groupBy("doc", "tie").agg(F.collect_list("at").alias("at"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1 << 20):
            row, flat = _lists(b.column("at"))
            edges, at = np.searchsorted(row, np.arange(b.num_rows + 1)), flat.to_numpy(zero_copy_only=False)
            spans, removed, kept, size = [], [], [], []
            for k, raw in enumerate(encoded(b.column("text").to_pylist())):
                size.append(len(raw))
                own = at[edges[k] : edges[k + 1]]
                if not len(own):
                    spans.append([])
                    removed.append(0)
                    kept.append(raw)
                    continue
                first = own >> 10
                s, e = removed_spans(first, first + (own & 1023) + length)
                removed.append(int((e - s).sum()))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                kept.append(b"".join(raw[x:y] for x, y in zip(np.r_[0, e], np.r_[s, len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    joined_ = docs.join(marks, ["doc", "tie"], "left").select("doc_id", "text", "at")
    out = joined_.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("n_spans", F.size("spans").cast("long"))


def op7(docs: DataFrame) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes.

    Null counts as empty. Texts are read whole, in pieces, however long. Repeated
    rows count each as a document, so both lose all that fills 400 bytes; rows
    without doc_id are told apart by their texts. There are no ties: all copies
    go. An empty table gives no rows; other columns aren't looked at. ``repeated``
    marks documents that lose anything.
    """
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))
