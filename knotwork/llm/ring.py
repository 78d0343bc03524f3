"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``PLACES`` places. Each shard stands at ``VNODES`` of them, hashed
from its number alone, and a key goes to the first shard at or after the place
that its text hashes to. A shard takes no more than its capacity: keys that
overflow a full shard continue clockwise to the next one with room. A key is a
text, so rows of equal texts stand beside each other on the ring and stay
together unless a shard becomes full within them; a group larger than a shard
continues into the next ones, as it must.

Along the ring rows are ordered by hash, then doc_id. A shard takes its own rows
first, those that others pass on with the room that these leave, so a row only
moves if its shard is full. Where all stands is known once the rows at each
place are counted: ``plan`` goes around the ring over these counts, twice at most,
and gives ranges of the order with their shards. The counts are one number for
each of the ``PLACES``, however many rows there are. Each row then looks up the
range that holds its place in the order.

Equal rows are one unit with a count until the end, so a row that makes up a
third of a table is one row of the sort; texts are read once and never
shuffled. All work on rows is DataFrame and SQL functions.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layout import exclusive_scan
from .common import materialize

PLACES, VNODES = 1 << 16, 64
#: Equal rows that one task writes out.
PIECE = 1 << 18


def vnodes(shards: int, each: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, in order; those of a shard depend on its
    number alone. Two at one place stand there in the order of shards."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % PLACES
    return sorted((at(s, v), s) for s in range(shards) for v in range(each))


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may take: an even share, by slack more. Without slack the
    first shards take one more each until all rows fit."""
    if slack > 0:
        return [math.ceil(n / shards * (1 + slack))] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def plan(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int]]:
    """(first row, shard, slot of that row) of the ranges of the order of rows, from
    the number of rows at each place, clockwise from the last node on."""
    room, queue, taken = list(room), deque(), []
    turn = turned(nodes)
    own = [0] * len(nodes)
    ends = [(place + turn) % PLACES for place, _ in nodes]
    for place, n in counts.items():
        own[bisect.bisect_left(ends, place)] += n

    def take(shard: int, first: int, n: int) -> int:
        n = min(n, room[shard])
        if n:
            taken.append((first, n, shard))
            room[shard] -= n
        return n

    over, first = [], 0
    for (_, shard), n in zip(nodes, own, strict=True):
        done = take(shard, first, n)
        over.append((first + done, n - done))
        first += n
    for lap in range(2):
        for (_, shard), more in zip(nodes, over, strict=True):
            while queue and room[shard]:
                at, n = queue.popleft()
                done = take(shard, at, n)
                if done < n:
                    queue.appendleft((at + done, n - done))
            if more[1] and not lap:
                queue.append(more)
    out, slots = [], [0] * len(room)
    for at, n, shard in sorted(taken):
        out.append((at, shard, slots[shard]))
        slots[shard] += n
    return out


def turned(nodes: list[tuple[int, int]]) -> int:
    """What is added to a place so that the last node has the last place: rows after
    it belong to the first node, and come first."""
    return PLACES - 1 - nodes[-1][0]


def _listed(x: list[int]) -> Column:
    """One literal for many longs."""
    return F.expr(f"cast(split('{','.join(map(str, x))}', ',') as array<bigint>)")


def _range_of(row: Column, firsts: list[int]) -> Column:
    """Index of the last of ascending firsts (the first is 0) that is at most row, by halving."""
    widths, table = _listed([1 << k for k in reversed(range(len(firsts).bit_length()))]), _listed(firsts)
    return F.aggregate(widths, F.lit(0).cast("long"), lambda at, w: F.when(F.coalesce(F.get(table, (at + w).cast("int")) <= row, F.lit(False)), at + w).otherwise(at)).cast("int")


def shards(docs: DataFrame, n_shards: int = 24, slack: float = 0.0, each: int = VNODES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size (bytes of the text and 8),
    text_crc32, shard and slot, the row's number in its shard from 0. Null texts
    count as empty. A shard holds no more than its even share of the rows, by
    slack more; without slack counts are at most one apart."""
    nodes = vnodes(n_shards, each)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.xxhash64(text)
    place = F.pmod(F.shiftrightunsigned(h, 48) + turned(nodes), F.lit(PLACES)).cast("int")
    key = F.struct(place.alias("place"), h.alias("h"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    units = materialize(docs.select(key.alias("at")).groupBy("at").agg(F.count("*").alias("n")))
    counts = units.groupBy(F.col("at.place").alias("place")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    total = sum(r["n"] for r in counts)
    ranges = plan({r["place"]: r["n"] for r in counts}, nodes, capacities(total, n_shards, slack)) or [(0, 0, 0)]
    placed = exclusive_scan(units, "at", "n", "row")
    # equal rows one by one, those of a large unit from several tasks
    placed = placed.select("at", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("k"))
    if max((r["most"] for r in counts), default=0) > PIECE:
        placed = placed.repartition("at", "k")
    placed = placed.select("at", F.explode(F.sequence(F.col("row") + F.col("k"), F.col("row") + F.least("n", F.col("k") + PIECE) - 1)).alias("row"))
    placed = placed.withColumn("range", _range_of(F.col("row"), [x[0] for x in ranges]))
    first, shard, slot = (F.get(_listed(list(x)), F.col("range")) for x in zip(*ranges, strict=True))
    return placed.select("at.doc_id", "at.size", "at.text_crc32", shard.cast("int").alias("shard"), (slot + F.col("row") - first).alias("slot"))


def op13(docs: DataFrame) -> DataFrame:
    """Every document's shard of 24 by the law ``rows``: counts at most one apart.

    Null texts count as empty ones (size 8, crc 0). Texts count whole, however
    long. Repeated rows get a slot each. Equal texts stand together unless their
    shard is full; rows without doc_id are the first of them. Ties in the hash of
    different texts go by doc_id, size and crc32. An empty table gives no rows;
    other columns aren't looked at.
    """
    got = shards(docs)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
