"""Clusters, periodic runs and shards against brute force, and odd rows."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from knotwork.llm import centroids, periods, queries, ring

D = "/root/testdata/sf0.001"


def test_clusters_by_sql(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = c.execute(queries.oracle_sql()["op11_centroid_clusters"])
    columns = [x[0] for x in want.description]
    got = queries.queries()["op11_centroid_clusters"](spark, D)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and got.count() > 100


def lloyd(rows, k, rounds):
    """rows of (vec_id, integers): (cluster, distance) of each, with every distance."""
    q = np.array([x for _, x in rows])
    order = sorted(range(len(rows)), key=lambda r: (hashlib.sha256(f"3:{rows[r][0]}".encode()).hexdigest() if rows[r][0] is not None else "~", rows[r][1]))
    c = q[order[:k]].copy()
    for _ in range(rounds):
        near = ((q[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in set(near.tolist()):
            c[j] = q[near == j].sum(0) // (near == j).sum()
    d = ((q[:, None] - c[None]) ** 2).sum(2)
    return list(zip(d.argmin(1).tolist(), d.min(1).tolist(), strict=True)), c


def test_clusters_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(int(k % 50) if k else None, (rng.normal(size=64) * (1 + k % 3)).tolist()) for k in range(60)] + [(100 + k, [0.25] * 64) for k in range(30)]
    bad = [(900, None), (901, [0.0] * 63), (902, [None] + [0.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    rows = spark.createDataFrame([(i, x, "a", 7) for i, x in good + bad], "vec_id long, embedding array<double>, cluster string, norms int")
    whole = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in good]
    want, last = lloyd(whole, 8, 10)
    got = centroids.op11(rows).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter((i, *w) for (i, _), w in zip(whole, want, strict=True))
    far = Counter()
    for c, d in want:
        far[c] += d
    assert all(r["cluster_inertia"] == far[r["cluster"]] and r["inertia"] == sum(far.values()) for r in got)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, last[r["cluster"]])).encode()).hexdigest() for r in got)
    assert centroids.op11(rows.where("vec_id >= 900")).count() == 0 == centroids.op11(rows.limit(0)).count()
    few = centroids.op11(rows.where("vec_id in (3, 4)").dropDuplicates(["vec_id"])).collect()
    assert len(few) == 2 and all(r["distance"] == 0 for r in few)
    wide = centroids.op11(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>"))
    assert wide.where("distance = 0").count() == 3


@pytest.mark.parametrize("scale", [1, 1 << 10, 1 << 26])
def test_bounds_are_bounds(scale):
    """No squared distance is below its bound, and few exact ones are taken."""
    rng = np.random.default_rng(scale)
    q = np.clip(np.rint(rng.normal(size=(400, 64)) * scale), -centroids.MOST, centroids.MOST).astype(np.int64)
    held = centroids.Centroids.of(q[::50].copy())
    low = held.bounds(q, *centroids.compress(q))
    exact = ((q[:, None] - held.q[None]) ** 2).sum(2)
    assert (low <= exact).all()
    cluster, distance, tried = held.nearest(q, *centroids.compress(q))
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert scale == 1 or tried.mean() < 2


def test_screening_of_the_given_vectors(spark):
    """Of eight centroids a vector is held against fewer than two exactly."""
    got = centroids.cluster(spark.read.parquet(f"{D}/embeddings.parquet"))
    assert got.vectors.agg(F.avg("n_exact")).first()[0] < 2


def runs(w, words=6, times=4):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] == w[i + p]:
                j = i
                while j + p < len(w) and w[j] == w[j + p]:
                    j += 1
                n = j - i + p
                if n >= max(words, times * p) and not any(all(w[k] == w[k + q] for k in range(i, i + n - q)) for q in range(1, p)):
                    out.append((i, n, p))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("words,times", [(6, 4), (2, 2)])
def test_runs_by_definition(words, times):
    random.seed(times)
    for _ in range(40):
        texts = []
        for _ in range(random.randint(1, 12)):
            kind = random.random()
            if kind < 0.4:
                t = [random.choice("ab") for _ in range(random.randint(0, 60))]
            elif kind < 0.7:
                b = [random.choice("abc") for _ in range(random.randint(1, 9))]
                t = [random.choice("abc") for _ in range(5)] + b * random.randint(2, 8) + b[: random.randint(0, len(b))] + [random.choice("abc") for _ in range(6)]
            elif kind < 0.8:
                t = ["é"] * random.randint(0, 40)
            else:
                t = [random.choice("abcdefghij") for _ in range(80)] * random.randint(1, 2)
            texts.append(random.choice(["", " ", "\n"]) + random.choice([" ", "  ", "\t"]).join(t) + random.choice(["", " "]))
        got, left = periods._found(pa.array(texts), words, times)
        for t, r, c in zip(texts, got.to_pylist(), left.to_pylist(), strict=True):
            want = runs(t.split(), words, times)
            assert [(x["start"], x["length"], x["period"]) for x in r] == want
            assert c == collapsed(t.split(), want)


def test_fibonacci_word_and_long_texts():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    got, _ = periods._found(pa.array([" ".join(b), "x " * 50_000, " ".join(str(k % 9_000) for k in range(40_000))]), 2, 2)
    fib, one, long = got.to_pylist()
    assert [(x["start"], x["length"], x["period"]) for x in fib if x["period"] < 60] == [r for r in runs(list(b), 2, 2) if r[2] < 60]
    assert one == [{"start": 0, "length": 50_000, "period": 1}] and long == [{"start": 0, "length": 40_000, "period": 9_000}]


def test_every_position_is_looked_at_some_log_n_times():
    """Smaller half: what refinement touches grows as n log n, whatever repeats."""
    random.seed(5)
    for n in (1_000, 8_000):
        block = [random.randrange(40) for _ in range(n // 2)]
        word = np.array([*block, 99, *block, -1])
        parts = periods.Refinement(word, np.zeros(len(word), dtype=np.int64), np.full(len(word), len(word) - 1), np.full(len(word), n // 4))
        touched, more = 0, True
        while more:
            touched += len(parts.small)
            more = parts.refine()
        assert parts.level > n // 8 and touched < 2 * n * np.log2(n)


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    return w


def test_periodic_runs_of_documents(spark, docs, odd, empty):
    short = docs.where("length(text) < 4000")
    for frame in (short, odd.where("doc_id <> 5 or doc_id is null")):
        want = Counter()
        for r in frame.collect():
            w = planted(r["doc_id"], r["text"])
            found = runs(w)
            best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
            longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in found), collapsed(w, found))]
            want[(r["doc_id"], len(found), *longest, *digest)] += 1
        assert Counter(map(tuple, periods.op12(frame).collect())) == want
    assert periods.op12(short).where("n_runs > 0").count() > 3
    long = periods.op12(odd.where("doc_id = 5")).first()
    assert long["n_runs"] == 1 and long["period"] == 12 and long["length"] == 48_000
    assert periods.op12(empty).count() == 0
    kept = periods.periodic_runs(odd.withColumn("runs", F.lit(1)))
    assert kept.columns == [*odd.columns, "runs", "runs_", "collapsed"] and kept.count() == odd.count()


def sharded(rows, shards, slack):
    """Places of rows (doc_id, text) by walking around the ring row by row."""
    nodes, room = ring.vnodes(shards), ring.capacities(len(rows), shards, slack)
    h = lambda r: xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    last = nodes[-1][0]
    rows = sorted(rows, key=lambda r: (((h(r) >> 48) - last - 1) % ring.PLACES, signed(h(r)), (r[0] is not None, r[0] or 0)))
    own, over, got, queue = defaultdict(list), {}, [], []
    for r in rows:
        own[next((k for k, (at, _) in enumerate(nodes) if at >= h(r) >> 48), 0)].append(r)
    for k, (_, s) in enumerate(nodes):
        keep = own[k][: room[s]]
        room[s] -= len(keep)
        got += [(r[0], r[1], s) for r in keep]
        over[k] = own[k][len(keep) :]
    for lap in range(2):
        for k, (_, s) in enumerate(nodes):
            while queue and room[s]:
                r = queue.pop(0)
                got.append((r[0], r[1], s))
                room[s] -= 1
            queue += over[k] if not lap else []
    assert not queue
    return Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s) for i, t, s in got)


@pytest.mark.parametrize("shards,slack", [(24, 0.0), (5, 0.0), (7, 0.25), (1, 0.0)])
def test_ring_row_by_row(spark, shards, slack):
    """A third of the rows have one text, and a sixth are one row."""
    random.seed(shards)
    rows = [(k, f"text {random.randrange(150)}") for k in range(300)] + [(1000 + k, "a copy") for k in range(200)] + [(7, "the row")] * 100 + [(None, "x"), (None, None), (3, ""), (3, None)]
    got = ring.shards(spark.createDataFrame(rows, "doc_id long, text string"), shards, slack).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == sharded(rows, shards, slack)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) <= (max(sizes) if not slack else -(-len(rows) * (1 + slack) // shards))
    assert slack or max(sizes) - min(sizes) <= 1


def test_large_units_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ring, "PIECE", 10)
    rows = [(1, "one")] * 95 + [(k, str(k)) for k in range(40)]
    got = ring.op13(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)


def test_ring_moves_little_and_keeps_groups(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    place = lambda n, slack: {r["doc_id"]: r["shard"] for r in ring.shards(d, n, slack).collect()}
    loose, grown = place(24, 0.25), place(25, 0.25)
    assert sum(loose[i] != grown[i] for i in loose) < 0.08 * len(loose)
    tight, grown = place(24, 0.0), place(25, 0.0)
    assert sum(tight[i] != grown[i] for i in tight) < 0.2 * len(tight)
    got = ring.op13(d).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"), F.count("*").alias("rows")).where("rows > 1")
    assert got.where("n > 1").count() <= 0.1 * got.count()


def test_shards_odd_rows(spark, odd, empty):
    got = ring.op13(odd)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    r = got.collect()
    assert len(r) == odd.count() and {x["law"] for x in r} == {"rows"} and all(x["grown_shard"] is None for x in r)
    assert {(x["doc_id"], x["size"], x["text_crc32"]) for x in r} >= {(1, 8, 0), (2, 8, 0), (9, 9, zlib.crc32(b"x"))}
    assert ring.op13(empty).count() == 0


def test_mix_with_one_long_document_a_source(spark):
    """Targets are met whatever one long document does, and it keeps its expectation."""
    from knotwork.llm import mixing

    random.seed(8)
    sizes = [20_000] + [random.randrange(200, 1_000) for _ in range(140)]
    rows = [(s * 1000 + k, f"s{s:03d}", n) for s in range(90) for k, n in enumerate(sizes)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("text", F.expr("repeat('w ', int(n))"))
    got = [r.asDict() for r in mixing.op6(d).join(d.select("doc_id", "source"), "doc_id").collect()]
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    assert all(abs(sum(r["taken"] for r in x) - x[0]["target"]) < 0.01 * x[0]["target"] for x in by.values())
    for w in range(3):  # sources of equal weight have equal targets
        same = [x for k, x in enumerate(v for _, v in sorted(by.items())) if k % 3 == w]
        factor = same[0][0]["target"] / same[0][0]["source_size"]
        for long in (True, False):
            taken = [r["taken"] / r["size"] for x in same for r in x if (r["size"] == 20_000) == long]
            assert abs(np.mean(taken) - factor) < 5 * (0.5 / len(taken) ** 0.5 if long else 0.02)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_heavily_repeated_rows_of_fingerprints(spark, monkeypatch):
    """A row that makes up a third of the table, and empty texts without id, are written
    by several tasks, with the rows that a walk over all rows gives."""
    from knotwork.llm import iblt

    monkeypatch.setattr(iblt, "PIECE", 7)
    rows = [(k, f"line {k}\n" * 9) for k in range(60)] + [(30, "the row\nof many copies\n" * 5)] * 50 + [(None, "")] * 40 + [(None, None)] * 3
    got = iblt.op9(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_next"], 9), r["fingerprint"])
    out = Counter(key(r) for r in got.collect())
    monkeypatch.setattr(iblt, "heavy_rows", lambda keyed: (keyed, None))
    assert out == Counter(key(r) for r in iblt.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(out.values()) == len(rows)


def test_mixture_by_a_plain_version(docs):
    """Proportions and the set of languages against expectation-maximisation written
    trigram by trigram."""
    from math import log

    from knotwork.llm import langid

    m = langid.learn(docs)
    some = [r["text"] for r in docs.where("length(text) between 200 and 700").limit(12).collect()]
    texts = [*some[:6], *(a[:300] + " " + b[:200] for a, b in zip(some, some[6:], strict=False))]
    _, _, share, _ = m.infer(texts)
    for text, got in zip(texts, share, strict=True):
        _, bucket, n = langid.grams([text])
        p = np.exp(m.logp[bucket].astype(np.float64) - m.logp[bucket].max(1, keepdims=True).astype(np.float64))

        def fit(active):
            pi = [1 / len(active) if k in active else 0.0 for k in range(len(m.langs))]
            for _ in range(m.rounds):
                new = [m.prior / len(active) if k in active else 0.0 for k in range(len(m.langs))]
                for row, times in zip(p, n, strict=True):
                    whole = sum(pi[k] * row[k] for k in active)
                    for k in active:
                        new[k] += times * pi[k] * row[k] / whole
                pi = [x / (n.sum() + m.prior) for x in new]
            return pi, sum(t * log(sum(pi[k] * row[k] for k in active)) for row, t in zip(p, n, strict=True))

        active = set(range(len(m.langs)))
        best, value = None, -np.inf
        while active:
            pi, ll = fit(active)
            penalised = ll - m.penalty * np.log(n.sum() + 1) * len(active)
            if penalised > value:
                best, value = pi, penalised
            active = active - {min(active, key=lambda k: pi[k])}
        assert np.allclose(best, got, atol=1e-3)


def test_toxicity_of_held_out_rows(spark):
    """With few toxic documents to learn from: ranks are far better than chance, and
    hardly a clean document is flagged."""
    from knotwork.llm import toxicity

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = toxicity.op8(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    toxic, clean = r[r["toxic"] == 1]["score"].to_numpy(), r[r["toxic"] == 0]["score"].to_numpy()
    assert len(toxic) > 5 and (toxic[:, None] > clean[None]).mean() > 0.8
    assert (clean >= 0.3).mean() < 0.05 and (toxic >= 0.3).mean() > 0.3
