"""Periodic runs of words by partition refinement.

A run of period p is a stretch of words, each equal to the one p places before,
that no neighbour extends. Positions are put in classes of equal words, and
classes are refined level by level: two positions are of one class at level p if
the p words from either are the same. Level p + 1 follows from level p by the
classes of the next positions, and of the parts that a class fell into at level
p all but the largest are enough to tell them apart, since the largest is what
is left (smaller half); so a position is looked at some log n times at most,
however long the repeats are. Within a class positions are linked in order.
Neighbours at a distance equal to the level are a square: p words that stand
twice in a row. As they are neighbours the p words are no power of shorter ones,
and squares that start side by side make a run of smallest period p.

The words of many texts are refined together, level by level, in arrays; texts
share no class, and the end of each text is a word of its own. A text leaves once
the level is more than its longest period can be.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import bounded, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Shortest run in words and in periods, and bytes of text that are refined together (or one text).
WORDS, TIMES, PIECE = 6, 4, 4 << 20
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


class Refinement:
    """Classes of positions by equal factors, linked in order within each class.

    ``word`` and ``text`` number the word and the text of each position, ``end`` is the
    place after its text's last word, and ``deepest`` the last level at which it is
    of interest. The members of a class stand together in ``members``, from ``start``
    of its label on. Level 1 stands when it is made.

    A position whose text has fewer words left than the level is in some class
    with those that it was equal to before. It comes after all others of its class
    and so is no neighbour between two of them.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray, end: np.ndarray, deepest: np.ndarray):
        n = len(word)
        self.end = end
        self.deepest, self.level, self.classes = deepest, 1, 0
        self.next, self.before, self.label, self.start, self.size, self.place = (np.full(n, -1) for _ in range(6))
        self.gaps: dict[int, list[np.ndarray]] = defaultdict(list)
        self.members = np.lexsort((word, text))
        self.place[self.members] = np.arange(n)
        word, text = word[self.members], text[self.members]
        new = _changes(word) | _changes(text)
        self._form(self.members, new, np.flatnonzero(new), np.arange(new.sum()))
        # of each text all classes but one, and that of its end, tell the next level apart
        self.small = self.members[_all_but_largest(new, text)]
        self.small = self.small[self.small < end[self.small]]

    def _form(self, at: np.ndarray, new: np.ndarray, start: np.ndarray, label: np.ndarray) -> None:
        """Classes of positions that ascend within each, one from each new on."""
        first = np.flatnonzero(new)
        sizes = _spans(first, len(at))
        self.start[label], self.size[label], self.label[at] = start, sizes, np.repeat(label, sizes)
        self.classes = max(self.classes, int(label.max(initial=-1)) + 1)
        self.before[at[first]], self.next[at[first + sizes - 1]] = -1, -1
        low, high = at[:-1][~new[1:]], at[1:][~new[1:]]
        self.next[low], self.before[high] = high, low
        self._note(low)

    def _note(self, at: np.ndarray) -> None:
        """Remember positions by the distance to their neighbour, for that level."""
        gap = self.next[at] - at
        keep = (gap >= self.level) & (gap <= self.deepest[at])
        at, gap = at[keep], gap[keep]
        if len(at):
            order = np.argsort(gap, kind="stable")
            at, gap = at[order], gap[order]
            cut = np.flatnonzero(_changes(gap)).tolist()
            for g, a, b in zip(gap[cut].tolist(), cut, [*cut[1:], len(at)], strict=True):
                self.gaps[g].append(at[a:b])

    def squares(self) -> np.ndarray:
        """Positions at which the words of this level stand twice in a row."""
        if self.level not in self.gaps:
            return np.zeros(0, dtype=np.int64)
        at = np.concatenate(self.gaps.pop(self.level))
        return at[(self.next[at] - at == self.level) & (at + 2 * self.level <= self.end[at])]

    def later(self) -> np.ndarray:
        """Once no class is split any more: the positions of squares of all levels from
        this one on, each of as many words as the neighbour is away."""
        at = np.concatenate([x for some in self.gaps.values() for x in some]) if self.gaps else np.zeros(0, dtype=np.int64)
        gap = self.next[at] - at
        return at[(gap >= self.level) & (gap <= self.deepest[at]) & (at + 2 * gap <= self.end[at])]

    def refine(self) -> bool:
        """From this level to the next one; False if no class is split from here on."""
        at = self.small - 1
        at = at[at >= 0]
        at = at[(self.size[self.label[at]] > 1) & (self.deepest[at] > self.level)]
        by, parent = self.label[at + 1], self.label[at]
        order = np.lexsort((at, by, parent))
        at, by, parent = at[order], by[order], parent[order]
        first, new = _changes(parent), _changes(parent) | _changes(by)
        taken = _spans(np.flatnonzero(first), len(at))
        parts = np.add.reduceat(new, np.flatnonzero(first)) if len(at) else taken
        split = np.repeat((taken < self.size[parent[first]]) | (parts > 1), taken)
        at, by, parent, first, new = (x[split] for x in (at, by, parent, first, new))
        if not len(at):
            return False
        self.level += 1
        heads = np.flatnonzero(first)
        taken = _spans(heads, len(at))
        old, begin = parent[heads], self.start[parent[heads]]
        left = self.size[old] - taken

        # what is left keeps its class, and its links reach over those that go
        chain = at[np.lexsort((at, parent))]
        heads_of = np.ones(len(chain), dtype=bool)
        np.not_equal(self.next[chain[:-1]], chain[1:], out=heads_of[1:])
        ends = np.roll(heads_of, -1)
        p, q = self.before[chain[heads_of]], self.next[chain[ends]]
        self.next[p[p >= 0]], self.before[q[q >= 0]] = q[p >= 0], p[q >= 0]
        bridged = p[(p >= 0) & (q >= 0)]

        # those that go move to the end of their class's members, part after part
        tail = np.repeat(begin + left, taken)
        slots = tail + np.arange(len(at)) - np.repeat(heads, taken)
        early = np.sort(self.place[at[self.place[at] < tail]])
        held = self.members[slots]
        order = np.argsort(at)
        where = np.minimum(np.searchsorted(at[order], held), len(at) - 1)
        stays = at[order][where] != held
        moved = held[stays][np.argsort(slots[stays], kind="stable")]
        self.members[early], self.place[moved] = moved, early
        self.members[slots], self.place[at] = at, slots
        self.size[old] = left

        # fresh labels, but for the first part of a class of which nothing is left
        label = np.where(first[new] & (np.repeat(left, taken)[new] == 0), parent[new], -1)
        fresh = label < 0
        label[fresh] = self.classes + np.arange(fresh.sum())
        self._form(at, new, slots[new], label)
        self._note(bridged)

        # all parts but a largest one, be that what is left
        sizes = _spans(np.flatnonzero(new), len(at))
        most = np.maximum.reduceat(sizes, np.flatnonzero(first[new]))
        rest = np.repeat(left >= most, taken)
        small = _all_but_largest(new[~rest], parent[~rest])
        lesser = np.flatnonzero((left < most) & (left > 0))
        many = left[lesser]
        others = np.arange(many.sum()) + np.repeat(begin[lesser] - (np.cumsum(many) - many), many)
        self.small = np.concatenate([at[rest], at[~rest][small], self.members[others]])
        return True


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value isn't the one before it."""
    out = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _spans(at: np.ndarray, n: int) -> np.ndarray:
    """Distances from each place to the next one, and from the last one to n."""
    out = np.empty(len(at), dtype=np.int64)
    np.subtract(at[1:], at[:-1], out=out[:-1])
    out[-1:] = n - at[-1:]
    return out


def _all_but_largest(new: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which of the positions are of a part, one from each new on, that is not the
    largest of its parent (a first one of those equally large)."""
    at = np.flatnonzero(new)
    sizes, of = _spans(at, len(new)), parent[at]
    best = np.lexsort((-sizes, of))
    keep = np.ones(len(at), dtype=bool)
    keep[best[_changes(of[best])]] = False
    return np.repeat(keep, sizes)


def runs_of(word: np.ndarray, text: np.ndarray, end: np.ndarray, n_words: np.ndarray, words: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, period) of all runs of at least ``words`` words and ``times``
    periods, by position and then period. Positions of a text are followed by one
    of its end, with a word of its own; end and n_words are those of each position's text."""
    at, p = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if len(word) and times >= 2:
        parts = Refinement(word, text, end, n_words // times)
        more = True
        while more:
            at.append(parts.squares())
            p.append(np.full(len(at[-1]), parts.level))
            more = parts.refine()
        at.append(parts.later())
        p.append(parts.next[at[-1]] - at[-1])
    at, p = np.concatenate(at), np.concatenate(p)
    order = np.lexsort((at, p))
    at, p = at[order], p[order]
    # a square at each place and at the one before is one run; a square may be found twice
    cut = _changes(p)
    cut[1:] |= at[1:] > at[:-1] + 1
    start, period, last = at[cut], p[cut], at[np.roll(cut, -1)]
    length = last - start + 2 * period
    keep = length >= np.maximum(words, times * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Words:
    """The words of a column of texts: where they stand among the bytes of all."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        space, n = _SPACE[self.data], len(self.data)
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        inside = offsets[(offsets > 0) & (offsets < n)]  # no word goes from one text into the next
        begins[inside] |= ~space[inside]
        ends[inside - 1] |= ~space[inside - 1]
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(column))
        letters = self.data[~space]
        upto = np.r_[0, np.cumsum(self.length)]
        held = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(upto), pa.py_buffer(letters)])
        self.number = held.dictionary_encode().indices.to_numpy().astype(np.int64)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        size = self.length[kept] + 1
        upto = np.r_[0, np.cumsum(size)]
        step = np.arange(upto[-1]) + np.repeat(self.start[kept] - upto[:-1], size)
        out = np.r_[self.data, np.uint8(0)][step]
        out[upto[1:] - 1] = 0x20
        n = np.r_[0, np.cumsum(np.bincount(self.text[kept], minlength=len(self.count)))]
        ends = upto[n]
        # without the space after each text's last word
        some = np.diff(ends) > 0
        last = ends[1:][some] - 1
        short = ends - np.r_[0, np.cumsum(some)]
        return pa.Array.from_buffers(pa.large_string(), len(self.count), [None, pa.py_buffer(short), pa.py_buffer(np.delete(out, last))])


def _found(column: pa.Array, words: int, times: int) -> tuple[pa.Array, pa.Array]:
    held = Words(column)
    n = held.count
    first = np.r_[0, np.cumsum(n + 1)]  # of each text's positions; the last is its end
    text = np.repeat(np.arange(len(n)), n + 1)
    word = np.full(len(text), -1)
    at = np.arange(len(held.number)) + held.text
    word[at] = held.number
    start, length, period = runs_of(word, text, (first[1:] - 1)[text], n[text], words, times)
    gone = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.flatnonzero(np.cumsum(gone)[at] == 0)
    of = text[start]
    fields = [pa.array(x) for x in (start - first[of], length, period)]
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(n)))].astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return runs, held.joined(kept)


def periodic_runs(docs: DataFrame, words: int = WORDS, times: int = TIMES) -> DataFrame:
    """docs with runs, array of (start, length, period) by start and then period, of
    all runs of at least ``words`` words and ``times`` periods (2 or more), and
    collapsed, the words that stay if of each run only the first period does,
    joined by one space. Null texts count as empty."""
    runs, collapsed = unused("runs", docs), unused("collapsed", docs)
    own = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, PIECE):
            column = b.column(own.index("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, *_found(column.fill_null(""), words, times)], [*own, runs, collapsed])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(runs, RUNS), StructField(collapsed, StringType())]))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text, or for one id of ten, by its crc32, its words with the end replaced
    by repeats of a stretch: from word a on, each is that of (i - a) % p further."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    # words, a and p once for each text, not once for each word
    held = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n"), (g % F.greatest(F.size(w), F.lit(1))).alias("a")))
    held = F.transform(held, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"), (F.floor((x["n"] - x["a"]) / (g % 8 + 3)) + 1).alias("p")))
    word = lambda x, i: F.get(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))
    edited = F.transform(held, lambda x: F.when(x["n"] > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: word(x, i)), " ")).otherwise(""))
    return F.when(h % 10 == 0, edited[0]).otherwise(text)


def op12(docs: DataFrame) -> DataFrame:
    """Periodic runs of every document's words, one id in ten with a repeated tail.

    Null, empty and blank texts have no words and no run: n_runs 0, four nulls, and
    the digests of the empty string. Texts count whole, however long. Rows without
    doc_id have no repeated tail. Repeated rows get a row each. Of runs equally
    long the one that starts first is reported, then the one of smaller period. An
    empty table gives no rows; other columns aren't looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(repeated_tail(text, F.col("doc_id").cast("long")), text).alias("text"))
    found = periodic_runs(rows)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.q")
    return found.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
