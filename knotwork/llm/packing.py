"""Token ids, packed by best fit decreasing.

Texts are encoded by a public byte-level vocabulary, split without loss into
segments of at most ``length`` ids, and packed into rows of ``length`` ids. A
partition is packed in windows of a bounded number of ids: the segments of a
window, longest first, each go to the row with the least room that still
holds it, found by a segment tree over capacities. Rows carry the id matrix's
row, the cumulative lengths of their segments, and positions that restart at
each segment. Nothing is shuffled; a lost task is done again with equal rows.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

LENGTH, WINDOW = 2048, 4_000_000
#: Characters that are encoded at once, and where a longer text is cut.
PIECE = 1 << 20
_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")


def default_vocabulary() -> str:
    """Where the installed public tokenizers keep their byte-level vocabulary."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.submodule_search_locations:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"
    return os.path.join(spec.submodule_search_locations[0], "byte_bpe_50k.tiktoken")


class Encoder:
    """Ordinary encoding; the free id after the last of the vocabulary ends a document."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text. A long one is encoded in pieces that end between a letter and
        a space with a letter after it, where byte-level vocabularies never join;
        without such a place in a piece it is cut anyhow, which loses nothing."""
        out, at = [], 0
        while len(text) - at > 2 * PIECE:
            m = _CUT.search(text, at + PIECE, at + 2 * PIECE)
            upto = m.start() + 1 if m else at + PIECE
            out.append(np.array(self.bpe.encode_ordinary(text[at:upto]), dtype="<i4"))
            at = upto
        out.append(np.array(self.bpe.encode_ordinary(text[at:] if at else text), dtype="<i4"))
        return np.concatenate(out) if at else out[0]


class Rooms:
    """Rows by free room: a segment tree over capacities 0..length that finds
    the smallest capacity of at least n that some row has."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = np.zeros(2 * self.size, dtype=np.int64).tolist()
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(row, room) of the best fit, taken out, or None."""
        at, count = self.size + n, self.count
        if not count[at]:
            # up to the first right sibling that isn't empty, then down its left side
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Indices of sizes by row. Every size is 1 to length."""
    rooms, rows = Rooms(length), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        got = rooms.take(n)
        if got is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = got
        rows[row].append(k)
        if room > n:
            rooms.put(row, room - n)
    return rows


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Little-endian 32-bit integers, cut at bounds, as a binary column."""
    raw = np.ascontiguousarray(flat, dtype="<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds.astype(np.int64)).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def pack(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, vocabulary: str | None = None, binary: bool = False) -> DataFrame:
    """Packed rows of docs(doc_id, text): pack_id, doc_ids and segments (which
    segment of its document) in row order, ids, cumulative lengths (from 0 to
    the number of ids), positions.

    Each document is its ids and an end id; a null or empty text is the end id
    alone. A document longer than ``length`` is split into segments, all full
    but the last. pack_id is unique and depends on how the input is split. With
    binary, ids, cumulative and positions are little-endian 32-bit integers in
    binary columns, after n_ids: a row of the id matrix is filled with padding by
    whoever reads it, at no cost on disk.
    """
    path = vocabulary or default_vocabulary()
    if length < 1:
        raise ValueError("length must be positive")
    lists = pa.list_(pa.int32())
    names = ["pack_id", "doc_ids", "segments", *(["n_ids"] if binary else []), "ids", "cumulative", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path)
        end = np.array([encode.end], dtype="<i4")
        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 33
        segments: list[np.ndarray] = []
        owner: list[int | None] = []
        number: list[int] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            sizes = np.array([len(s) for s in segments])
            rows = best_fit_decreasing(sizes, length)
            for lo in range(0, len(rows), 256):
                part = rows[lo : lo + 256]
                flat = np.concatenate([segments[k] for row in part for k in row])
                n = np.array([int(sizes[row].sum()) for row in part])
                bounds = np.r_[0, np.cumsum(n)].astype(np.int32)
                cumulative = [np.r_[0, np.cumsum(sizes[row])].astype(np.int32) for row in part]
                each = np.concatenate([sizes[row] for row in part])
                positions = (np.arange(len(flat)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)
                first = [pa.array(np.arange(made + lo, made + lo + len(part))), pa.array([[owner[k] for k in row] for row in part], pa.list_(pa.int64())), pa.array([[number[k] for k in row] for row in part], lists)]
                if binary:
                    ends = np.r_[0, np.cumsum([len(c) for c in cumulative])]
                    yield pa.RecordBatch.from_arrays([*first, pa.array(n.astype(np.int32)), _binary(flat, bounds), _binary(np.concatenate(cumulative), ends), _binary(positions, bounds)], names)
                    continue
                yield pa.RecordBatch.from_arrays([*first, pa.ListArray.from_arrays(bounds, pa.array(flat)), pa.array(cumulative, lists), pa.ListArray.from_arrays(bounds, pa.array(positions))], names)
            made += len(rows)
            segments.clear()
            owner.clear()
            number.clear()
            held = 0

        for b in bounded(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                for k, at in enumerate(range(0, len(ids), length)):
                    segments.append(ids[at : at + length])
                    owner.append(doc)
                    number.append(k)
                held += len(ids)
                if held >= window:
                    yield from packed()
        if segments:
            yield from packed()

    kind = "binary" if binary else "array<int>"
    schema = f"pack_id long, doc_ids array<long>, segments array<int>, {'n_ids int, ' if binary else ''}ids {kind}, cumulative {kind}, positions {kind}"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def write_binary(docs: DataFrame, path: str, **options) -> None:
    """The packs of docs in binary columns as Parquet, one file for each task."""
    pack(docs, binary=True, **options).write.mode("errorifexists").parquet(path)


def op2(docs: DataFrame) -> DataFrame:
    """All documents as packed rows of 2,048 ids, in binary columns.

    A null or empty text is its end id alone. Long texts are split without loss.
    Repeated rows are packed each, rows without doc_id have null in doc_ids. Of
    segments of equal length the earlier goes first, and of rows with equal room
    the one that got it last is filled. An empty table gives no rows; other
    columns aren't looked at.
    """
    return pack(docs, binary=True)
