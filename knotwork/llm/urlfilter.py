"""URL rules in a sorted digest array.

The 64-bit xxhash keys of all rules lie sorted in one file, the rules' full
strings in a second, their offsets in a third. Spark ships the files to each
executor once; its workers memory-map them, so a node holds one copy in the
page cache. All candidate keys of a batch of urls (suffixes of the host by
label times prefixes of the path, of the lengths that rules have) are looked
up by one vectorised binary search, and a hit counts only if the stored string
is the candidate itself.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_SHIPPED_BYTES, bounded

SEED = 0
#: The rules of op3, as (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1)
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def key_of(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"), SEED)


class DigestArray:
    """Rules by digest; opens the files of a folder by mapping them."""

    def __init__(self, folder: str, prefix: str):
        path = lambda k: os.path.join(folder, f"{prefix}.{k}")
        self.keys = np.memmap(path("keys"), dtype=np.uint64, mode="r")
        self.offsets = np.memmap(path("offsets"), dtype=np.int64, mode="r")
        self.verdicts = np.memmap(path("verdicts"), dtype=np.uint8, mode="r")
        self.strings = np.memmap(path("strings"), dtype=np.uint8, mode="r")
        self.lengths = np.fromfile(path("lengths"), dtype=np.int64)

    @staticmethod
    def write(rules: Iterable[tuple[str, str]], folder: str, prefix: str, salt=key_of) -> int:  # noqa: ANN001
        """Write the files; a rule given with both verdicts blocks. Bytes written."""
        last: dict[str, str] = {}
        for v, r in rules:
            last[r] = max(v, last.get(r, v))
        items = sorted((salt(r), r.encode("utf-8", "surrogatepass"), v) for r, v in last.items())
        if bad := {v for *_, v in items} - {"allow", "block"}:
            raise ValueError(f"unknown verdicts {sorted(bad)}")
        parts = {
            "keys": np.array([k for k, *_ in items], dtype=np.uint64),
            "offsets": np.cumsum([0, *(len(s) for _, s, _ in items)], dtype=np.int64),
            "verdicts": np.array([v == "block" for *_, v in items], dtype=np.uint8),
            "strings": np.frombuffer(b"".join(s for _, s, _ in items), dtype=np.uint8),
            "lengths": np.unique(np.array([len(r) - r.index("/") for r in last], dtype=np.int64)),
        }
        for k, v in parts.items():
            with open(os.path.join(folder, f"{prefix}.{k}"), "wb") as f:
                f.write(v.tobytes() or (b"\0" * 8 if k != "lengths" else b""))  # an empty file can't be mapped
        return sum(v.nbytes for v in parts.values())

    def probe(self, hosts: list[str], paths: list[str], salt=key_of) -> list[tuple[str, str] | None]:  # noqa: ANN001
        """The longest fitting (rule, verdict) of each url, or None."""
        out: list[tuple[str, str] | None] = [None] * len(hosts)
        if len(self.offsets) < 2 or not len(self.lengths):
            return out
        of, rules = [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host or not path:
                continue
            ends = [path[:n] for n in self.lengths[: np.searchsorted(self.lengths, len(path), "right")]]
            at = 0
            while True:
                for e in ends:
                    of.append(k)
                    rules.append(host[at:] + e)
                if (at := host.find(".", at) + 1) == 0:
                    break
        keys = np.array([salt(r) for r in rules], dtype=np.uint64)
        place = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero((place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == keys)):
            want, at = rules[i].encode("utf-8", "surrogatepass"), int(place[i])
            while at < len(self.keys) and self.keys[at] == keys[i]:  # equal keys: compare the strings
                if self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes() == want:
                    best = out[of[i]]
                    if best is None or len(rules[i]) > len(best[0]):
                        out[of[i]] = (rules[i], "block" if self.verdicts[at] else "allow")
                    break
                at += 1
        return out


def ship(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Send the array to all executors, also those that join later; its prefix."""
    # the driver serves the files from here until it ends
    folder, prefix = tempfile.mkdtemp(prefix="rules-"), f"rules-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    n = DigestArray.write(rules, folder, prefix)
    if n > MAX_SHIPPED_BYTES:
        shutil.rmtree(folder)
        raise ValueError(f"the rules take {n} bytes; match_by_join() has no such limit")
    for k in ("keys", "offsets", "verdicts", "strings", "lengths"):
        spark.sparkContext.addFile(os.path.join(folder, f"{prefix}.{k}"))
    return prefix


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """pages(page_id, url) with host, path, rule and verdict, one row per row.

    A rule is ``host/path``; it fits its host and all subdomains if the url's
    path starts with its path, and the longest that fits decides. Without one
    (a null url, no ://, no path) rule is null and verdict is ``default``.
    """
    prefix = ship(pages.sparkSession, rules)
    host, path = split_url(F.col("url").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = DigestArray(SparkFiles.getRootDirectory(), prefix)
        for b in bounded(batches):
            found = rows.probe(b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def match_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same result for rules(rule, verdict) of any number: candidates meet
    the rules in a shuffled join on their digest and are then compared."""
    host, path = split_url(F.col("url").cast("string"))
    pages = pages.select(F.monotonically_increasing_id().alias("_row"), F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    keyed = rules.groupBy("rule").agg(F.max("verdict").alias("own")).withColumn("key", F.xxhash64("rule"))
    ends = [r[0] for r in keyed.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().orderBy("n").collect()]  # lengths of paths, few
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = F.array(*map(F.lit, ends)) if ends else F.array().cast("array<int>")
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = pages.select("_row", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))).alias("asked"))
    hit = asked.withColumn("key", F.xxhash64("asked")).join(keyed, "key").where("asked = rule")
    best = hit.groupBy("_row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "own")).alias("best"))
    return pages.join(best, "_row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.own", F.lit(default)).alias("verdict"))


def op3(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every url by RULES.

    A null url, or one without ://, has an empty host and path, no rule and the
    verdict allow. Urls are read whole, however long. Of fitting rules the longest
    decides; a rule given with both verdicts blocks. Repeated rows and rows
    without page_id get a row each, an empty table gives none, and other columns
    aren't looked at.
    """
    return filter_urls(pages.select("page_id", "url"), RULES)
