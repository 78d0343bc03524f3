"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments, each ``edits`` + 1 characters
after the last, so that of any excerpt of segment - edits characters or more one
segment lacks no more than ``edits`` characters. A stretch of a document
within ``edits`` edits of a segment of m characters shares m - q + 1 - q *
edits character q-grams with it, all on diagonals that lie at most ``edits``
apart. Shared q-grams are counted in overlapping bands of diagonals, bands
that reach the bound are verified by banded alignment, and the others can't
hold a match. Texts are compared in lower case, with anything but letters and
digits as one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_SHIPPED_BYTES, bounded, check_shipped, materialize, quoted, unused

Q, SEGMENT, RATE = 8, 64, 0.08
_FILTER_BITS = 22
#: Characters searched together.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """By code point: the lower-case letter or digit, a space for the rest."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            out[c] = ord(ch.lower()[0])
    return out


def normal(texts: list[str | None], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, their bounds). A space follows each text, and
    after that ``gap`` times code point 0, which no text has then."""
    tail = b" \0\0\0" + b"\0\0\0\0" * gap
    raw = [(t or "").encode("utf-32-le", "surrogatepass") + tail for t in texts]
    cp = _plain()[np.frombuffer(b"".join(raw), dtype=np.uint32)] if raw else np.zeros(0, dtype=np.uint32)
    ends = np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)
    keep = np.r_[True, (cp[1:] != 32) | (cp[:-1] != 32)] if len(cp) else np.zeros(0, dtype=bool)
    keep[(ends - [len(r) // 4 for r in raw]).astype(np.int64)] = True  # a text's own first space
    for k in range(gap + 1 if len(ends) else 0):
        keep[ends - 1 - k] = True
    for k in range(gap if len(ends) else 0):
        cp[ends - 1 - k] = 0
    return cp[keep], np.r_[np.int64(0), np.cumsum(keep)[ends - 1]] if len(ends) else np.zeros(1, dtype=np.int64)


def grams(cp: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position (the last q - 1 left out)."""
    n = len(cp) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = cp[:n].astype(np.uint64)
    for k in range(1, q):
        h *= _BASE
        h += cp[k : k + n]
    return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """Segments of the items and their q-grams."""

    q: int
    items: np.ndarray  # item of each segment
    start: np.ndarray  # of each segment in chars
    length: np.ndarray
    edits: np.ndarray
    chars: np.ndarray
    keys: np.ndarray  # sorted distinct gram hashes
    first: np.ndarray  # bounds of each key's entries
    position: np.ndarray  # of each entry in chars; the segments that hold it follow from their bounds
    filter: np.ndarray  # which upper hash bits occur

    @property
    def least(self) -> np.ndarray:
        return self.length - self.q + 1 - self.q * self.edits


def build(items: list[tuple[int, str | None]], q: int = Q, segment: int = SEGMENT, rate: float = RATE) -> Index:
    """Items that have fewer than q characters are left out: no q-gram tells
    them. An item of at most ``segment`` characters is one segment."""
    chars, bounds = normal([t for _, t in items])
    own, start, length, spans = [], [], [], []
    step = min(int(segment * rate), (segment - q) // q) + 1
    for (item, _), lo, hi in zip(items, bounds[:-1], bounds[1:] - 1, strict=True):
        while lo < hi and chars[lo] == 32:
            lo += 1
        while hi > lo and chars[hi - 1] == 32:
            hi -= 1
        if hi - lo < q:
            continue
        at = [lo] if hi - lo <= segment else [*range(lo, hi - segment, step), hi - segment]
        spans.append((lo, hi - lo - q + 1))
        own += [item] * len(at)
        start += at
        length += [min(segment, hi - lo)] * len(at)
    m, s = np.array(length, dtype=np.int64), np.array(start, dtype=np.int64)
    h = grams(chars, q)
    lo, n = np.array(spans, dtype=np.int64).reshape(-1, 2).T
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    key = h[at] if len(at) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(q, np.array(own, dtype=np.int64), s, m, np.minimum((m * rate).astype(np.int64), (m - q) // q), chars, keys, np.r_[first, len(key)].astype(np.int64), at[order], seen)


def _aligned(cp: np.ndarray, ix: Index, seg: np.ndarray, at: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Fewest edits that turn each segment into a stretch of cp, its diagonals
    between at and at + band."""
    best = np.full(len(seg), 1 << 20)
    for m, k in {(int(a), int(b)) for a, b in zip(ix.length[seg], band, strict=True)}:
        own = np.flatnonzero((ix.length[seg] == m) & (band == k))
        for lo in range(0, len(own), 4096):
            part = own[lo : lo + 4096]
            pattern = ix.chars[ix.start[seg[part]][:, None] + np.arange(m)]
            place = at[part][:, None] + np.arange(m + k + 1)
            text = np.where((place >= 0) & (place < len(cp)), cp[np.clip(place, 0, len(cp) - 1)], 0)
            d = np.zeros((len(part), k + 1), dtype=np.int32)
            for i in range(m):
                new = d + (text[:, i : i + k + 1] != pattern[:, i : i + 1])
                new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
                # insertions run along the band: a prefix minimum on a slope
                slope = np.arange(k + 1)
                d = np.minimum.accumulate(new - slope, axis=1) + slope
            best[part] = d.min(1)
    return best


def search(ix: Index, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, segment) of all segments that have a match within one text.

    Between texts lie more foreign characters than any segment may have edits,
    so no alignment reaches from one into another.
    """
    return _search(ix, *normal(texts, int(ix.edits.max(initial=0)) + 1))


def search_long(ix: Index, text: str, piece: int) -> set[int]:
    """Segments that have a match in a long text, of which a piece at a time is
    looked at, after the end of the one before."""
    held, found = np.zeros(0, dtype=np.uint32), set()
    for at in range(0, len(text), piece):
        cp = normal([text[at : at + piece]])[0][:-1]
        cp = cp[1:] if len(held) and len(cp) and held[-1] == cp[0] == 32 else cp
        cp = np.concatenate([held, cp])
        found.update(_search(ix, cp, np.array([0, len(cp)]))[1].tolist())
        held = cp[max(0, len(cp) - 2 * int((ix.length + ix.edits).max(initial=1))) :]
    return found


def _search(ix: Index, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(cp) < ix.q or not len(ix.keys):
        return none
    h = grams(cp, ix.q)
    p = np.flatnonzero(ix.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int32)])
    if not len(p):
        return none
    # a match has the least of all bounds of hits within the longest stretch
    need, reach = max(1, int(ix.least.min())), int((ix.length + ix.edits).max())
    near = np.zeros(len(p), dtype=bool)
    if len(p) >= need:
        dense = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] <= reach)
        step = np.zeros(len(p) + 1, dtype=np.int64)
        np.add.at(step, dense, 1)
        np.add.at(step, dense + need, -1)
        near = np.cumsum(step[:-1]) > 0
    p = p[near]
    k = np.searchsorted(ix.keys, h[p])
    exact = (k < len(ix.keys)) & (ix.keys[np.minimum(k, len(ix.keys) - 1)] == h[p])
    p, k = p[exact], k[exact]
    n = ix.first[k + 1] - ix.first[k]
    entry = np.repeat(ix.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    position, p = ix.position[entry], np.repeat(p, n)
    low = np.searchsorted(ix.start + ix.length - ix.q, position)
    n = np.searchsorted(ix.start, position, "right") - low
    seg = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    diagonal = np.repeat(p - position, n) + ix.start[seg]
    wide = ix.edits[seg] + 1
    low = np.floor_divide(diagonal, wide)
    # bands of two widths, each starting one width after the last
    seg2, band = np.r_[seg, seg], np.r_[low, low - 1] + 1
    key = seg2 * (len(cp) + 2 * SEGMENT + 2) + band + SEGMENT
    key, count = np.unique(key, return_counts=True)
    seg, band = key // (len(cp) + 2 * SEGMENT + 2), key % (len(cp) + 2 * SEGMENT + 2) - SEGMENT - 1
    good = count >= ix.least[seg]
    seg, band = seg[good], band[good]
    if not len(seg):
        return none
    wide = ix.edits[seg] + 1
    edits = _aligned(cp, ix, seg, band * wide - ix.edits[seg], 2 * wide + 2 * ix.edits[seg])
    ok = edits <= ix.edits[seg]
    seg, at = seg[ok], (band * wide)[ok]
    doc = np.searchsorted(bounds, np.clip(at + ix.length[seg] // 2, 0, len(cp) - 1), "right") - 1
    return doc, seg


def _marked(docs: DataFrame, ix: Index, name: str) -> DataFrame:
    """docs with the items and segments found in the text as a struct column of that name."""
    shipped = docs.sparkSession.sparkContext.broadcast(ix)
    own = docs.columns
    kind = T.StructType([T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("segments", T.ArrayType(T.LongType()))])
    text = next(c for c in own if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for b in bounded(batches, PIECE):
            texts = b.column(own.index(text)).cast(pa.string()).to_pylist()
            long = {k: t for k, t in enumerate(texts) if t and len(t) > PIECE}
            hits: dict[int, set[int]] = {k: search_long(index, t, PIECE) for k, t in long.items()}
            for d, s in zip(*(x.tolist() for x in search(index, [None if k in long else t for k, t in enumerate(texts)])), strict=True):
                hits.setdefault(d, set()).add(s)
            items = pa.array([sorted({int(index.items[s]) for s in hits.get(k, ())}) for k in range(b.num_rows)], pa.list_(pa.int64()))
            segments = pa.array([sorted(hits.get(k, ())) for k in range(b.num_rows)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([items, segments], ["item_ids", "segments"])], [*own, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def _found(docs: DataFrame, benchmark: DataFrame, q: int, segment: int, rate: float, most: int) -> tuple[DataFrame, str]:
    """docs with a struct column (item_ids, n_segments), and its name."""
    name = unused("found", docs)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    step = min(int(segment * rate), (segment - q) // q) + 1
    # an index takes some 48 bytes a character, and its segments 32 each
    cost = 48 + 32 // step + 1
    n = max(1, math.ceil(total * cost / most * (1 if total * cost <= most else 1.5)))
    if n == 1:
        found = _marked(docs, build(sorted(map(tuple, items.distinct().collect())), q, segment, rate), name)
        return found.withColumn(name, F.struct(F.col(name)["item_ids"].alias("item_ids"), F.size(F.col(name)["segments"]).alias("n_segments"))), name
    # a benchmark beyond the bound goes in slices: each is a pass over the texts, written before the next
    out = docs.withColumn(name, F.struct(F.array().cast("array<long>").alias("item_ids"), F.lit(0).alias("n_segments")))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        size = part.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        check_shipped(size * cost, "a slice of the benchmark's index")
        new = unused("more", out)
        more = _marked(out, build(sorted(map(tuple, part.distinct().collect())), q, segment, rate), new)
        both = F.struct(F.array_sort(F.array_union(F.col(name)["item_ids"], F.col(new)["item_ids"])).alias("item_ids"), (F.col(name)["n_segments"] + F.size(F.col(new)["segments"])).alias("n_segments"))
        out = materialize(more.withColumn(name, both).drop(new))
    return out, name


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, segment: int = SEGMENT, rate: float = RATE, most: int = MAX_SHIPPED_BYTES) -> DataFrame:
    """docs with item_ids (sorted ids of benchmark items of which a segment has
    a match in the text) and n_segments, one row per row of docs.

    The benchmark's index is sent to the executors if it takes ``most`` bytes at
    most. Beyond that the items are dealt over slices by a hash of their ids,
    and the texts are searched slice by slice. Null texts match nothing; null
    item ids are ignored. Columns of docs with these names are replaced.
    """
    found, name = _found(docs, benchmark, q, segment, rate, most)
    return found.select(*(quoted(c) for c in docs.columns if c.lower() not in ("item_ids", "n_segments")), f"{name}.*")


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in every document.

    A null or empty text holds none. Very long texts are searched whole, in
    pieces that overlap by more than a segment. Repeated rows get a row each,
    an item found twice counts once, items with equal text are all reported, an
    empty benchmark finds nothing, an empty table gives no rows, and other
    columns aren't looked at.
    """
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "n_segments")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a passage of the benchmark. Rows without
    text or doc_id, repeated rows and columns of any name are treated alike."""
    found, name = _found(docs, benchmark, Q, SEGMENT, RATE, MAX_SHIPPED_BYTES)
    return found.where(F.size(F.col(name)["item_ids"]) == 0).select(*map(quoted, docs.columns))
