"""The ten operators against brute force, round trips and held-out accuracy."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from knotwork.llm import decontam, htmltext, iblt, langid, mixing, packing, simhash, substrings, toxicity, urlfilter


def labels_of(spark, n=9):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, n)], "doc_id long, toxic int, quality int")


def test_language_held_out(docs):
    r = langid.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r["lang"] == r["lang_pred"]).mean() > 0.97
    assert r["score"].between(0, 1).all()


def test_language_mixture_and_odd_rows(docs, odd, empty):
    m = langid.learn(docs)
    one = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500").select("lang", "text").collect()}
    _, _, share, _ = m.infer([one["en"][:1500] + " " + one["de"][:700]])
    got = dict(zip(m.langs, share[0], strict=True))
    assert got["en"] > got["de"] > 0.1 and got["fr"] == 0
    r = {(x["doc_id"], x["lang_pred"]) for x in langid.op1(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= r and len(langid.op1(odd).collect()) == odd.count()
    assert langid.op1(empty).count() == 0
    assert langid.identify(odd, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_simhash_brute_force(spark):
    random.seed(5)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(random.choice(words) for _ in range(60)) for _ in range(60)]
    for k in range(120):
        t = texts[k % 60].split()
        t[random.randrange(60)] = "edit"
        texts.append(" ".join(t))
    texts += ["", None, "One", "one", "A b", texts[0]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = simhash.near_duplicates(d).toPandas().sort_values("doc_id")
    fp = np.array([simhash.fingerprint(t, 3) for t in texts], dtype=np.uint64)
    assert (fp.view(np.int64) == r["fp"].to_numpy()).all()
    near, label = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2, np.arange(len(fp))
    while True:
        new = np.where(near, label[None], len(fp)).min(1)
        if (new == label).all():
            break
        label = new
    assert (label == r["component_id"].to_numpy()).all() and len(set(label)) < len(set(fp.tolist()))


def test_fingerprint_by_definition(spark):
    text = "The QUICK brown fox\tjumps over the lazy dog again"
    w = text.lower().split()
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text, 3) == want


def test_simhash_odd_rows(odd, empty):
    r = simhash.op4(odd)
    assert r.count() == odd.count() and r.where("fingerprint = '0000000000000000'").count() == 3
    assert simhash.op4(empty).count() == 0
    kept = simhash.stage(odd)
    assert kept.columns == odd.columns and [x["doc_id"] for x in kept.where("doc_id in (6, 7)").collect()] == [6]
    assert kept.where("doc_id is null").count() == 1


def removal(texts, n):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[k : k + n] for r in raws for k in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - n + 1):
            if count[r[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        runs = sum(1 for k in range(len(r)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substrings_at_production_parameters(spark):
    """400 bytes and windows of 128, over texts that share long passages."""
    random.seed(9)
    pool = ["".join(random.choice("abcdefgh é") for _ in range(random.randrange(200, 900))) for _ in range(12)]
    texts = ["".join(random.choice(pool) + random.choice(["", "", str(random.random())]) for _ in range(random.randrange(1, 6))) for _ in range(40)] + ["z" * 401, "z" * 400, "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op7(d).collect()}
    want = removal(texts, 400)
    assert [got[k] for k in range(len(texts))] == want and sum(x[1] for x in want) > 0


def test_substrings_in_pieces(spark):
    """Texts longer than a piece are parsed as if they were whole."""
    random.seed(4)
    pool = ["".join(random.choice("abé ") for _ in range(random.randrange(30, 200))) for _ in range(12)]
    texts = ["".join(random.choice(pool) for _ in range(random.randrange(1, 30))) + str(k) for k in range(20)] + ["x" * 2500, "ab" * 900]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for piece, group in ((200, 1 << 17), (700, 40)):  # and suffixes in order, or digests where a context has many
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove_repeats(d, 64, 24, piece, group).collect()}
        assert [got[k] for k in range(len(texts))] == removal(texts, 64)


def test_order_of_suffixes_by_definition():
    random.seed(2)
    contents = ["".join(random.choice("ab") for _ in range(n)).encode() for n in (40, 35, 60, 16)] + [b"\0" * 30, b"\0" * 17]
    starts = [len(c) - 15 for c in contents]
    strings = [c[k : k + 16] for c, n in zip(contents, starts, strict=True) for k in range(n)]
    assert substrings.repeated_starts(contents, starts, 16).tolist() == [strings.count(x) > 1 for x in strings]


@pytest.mark.parametrize("seed", range(3))
def test_substrings_brute_force(spark, seed):
    random.seed(seed)
    pool = ["".join(random.choice("abé ") for _ in range(random.randrange(30, 200))) for _ in range(12)]
    texts = ["".join(random.choice(pool) for _ in range(random.randrange(1, 6))) + str(k) for k in range(40)] + ["x" * 300, "ab" * 200, "", None, pool[0] * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove_repeats(d, 64, 24).collect()}
    assert [got[k] for k in range(len(texts))] == removal(texts, 64)


def test_substrings_odd_rows(odd, empty):
    r = substrings.op7(odd).collect()
    assert len(r) == odd.count() and next(x for x in r if x["doc_id"] == 5)["n_removed"] == next(x for x in r if x["doc_id"] == 5)["n_bytes"]
    assert substrings.op7(empty).count() == 0


def test_toxicity(spark, docs, odd, empty):
    plain = ["house", "garden", "water", "reading", "morning", "table", "window", "simple", "number", "letter"] * 3
    m = toxicity.fit_words(["idiot", "moron", "stupid", "trash"], plain)
    assert (m.words(["idiot", "i.d.i.o.t", "idiiot", "stu-pid"]) > 0).all() and (m.words(["garden", "the", "tablet"]) < 0).all()
    assert "idiot" in toxicity.tokens("you i d i o t there")
    labels = labels_of(spark)
    r = toxicity.op8(odd, labels).collect()
    assert len(r) == odd.count() and all(0 <= x["score"] <= 1 for x in r)
    assert toxicity.op8(odd, labels.limit(0)).where("score > 0.01").count() == 0
    assert toxicity.op8(empty, labels).count() == 0


def test_subsequence_kernel_by_definition():
    def kernel(s, t):
        def feature(x):
            out = Counter()
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                        out[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        a, b = feature(s), feature(t)
        return sum(v * b[g] for g, v in a.items())

    for word in ("banana", "abcabc"):
        ((_, _, _, norm),) = toxicity.subsequences([word])
        assert norm[0] == pytest.approx(kernel(word, word) ** 0.5)


def test_mixing(spark, docs, odd, empty):
    r = mixing.op6(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    g = r.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), own=("source_size", "first"), most=("size", "max"))
    assert g["target"].sum() == pytest.approx(r["size"].sum())
    assert ((g["taken"] - g["target"]).abs() <= g["most"]).all() and (g["target"] <= 3 * g["own"] + 1e-9).all()
    assert (r["taken"] <= 3 * r["size"]).all()
    assert mixing.op6(docs).exceptAll(mixing.op6(docs)).count() == 0
    assert mixing.op6(odd).count() == odd.count() and mixing.op6(empty).count() == 0
    assert mixing.stage(odd).columns == odd.columns
    copies = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.stage(docs).count() == copies


def test_mixing_keeps_expectation(spark):
    d = spark.createDataFrame([(k, "w " * (1 + k % 7), "a" if k < 300 else "b") for k in range(400)], "doc_id long, text string, source string")
    want = mixing.mix(d).selectExpr("avg(target / source_size)").first()[0]
    got = np.mean([mixing.mix(d, seed=s).selectExpr("avg(copies)").first()[0] for s in range(4)])
    assert got == pytest.approx(want, abs=0.05)


def units(x):
    return {y for line in x.split("\n") for y in (line[:24], line[24:120], line[120:504], *(line[k : k + 1536] for k in range(504, len(line), 1536))) if y}


def peeled(one, other):
    """Likeness of two fingerprints of equal size from the strings alone, None if they don't peel."""
    (n, a), (m, b) = ((int(x.split(":")[0]), [int(v) for v in x.split(":")[1].split(",")]) for x in (one, other))
    low, wide = (1 << 24) - 1, 1 << 64
    check = lambda h: xxhash.xxh64_intdigest((h % wide).to_bytes(8, "little"), 42) & low
    total = 0
    for part in range(len(a) // iblt.CELLS):
        k = [x ^ y for x, y in zip(a[part * iblt.CELLS : (part + 1) * iblt.CELLS], b[part * iblt.CELLS : (part + 1) * iblt.CELLS], strict=True)]
        while any(k):
            pure = next((v for v in k if v and v & low == check(v & ~low)), None)
            if pure is None:
                return None
            total += 1
            for r in range(iblt.ROWS):
                k[r * iblt.COLUMNS + (pure >> (24 + 4 * r) & 15)] ^= pure
    return (n + m - total) / (n + m + total) if n + m else 1.0


def test_sketch_fingerprints(spark, docs, odd, empty):
    r = iblt.op9(docs).toPandas().set_index("doc_id").sort_index(ascending=False)
    texts = docs.toPandas().set_index("doc_id")["text"].sort_index(ascending=False)
    again = {"near_edited": 0, "near_next": 0}
    for k, (doc, x) in enumerate(texts.items()):
        y = texts.iloc[(k + 1) % len(texts)]
        n = len(x) // 3
        e = x[: len(x) - n] + y[:n]
        assert r["edited_sha256"][doc] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"][doc] == len(x)
        a, b, c = units(x), units(e), units(y)
        assert r["near_edited"][doc] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"][doc] == pytest.approx(len(a & c) / len(a | c))
        # the returned sketches, subtracted and peeled by hand, say the same
        for name, other in (("near_edited", r["edited_fingerprint"][doc]), ("near_next", r["fingerprint"].iloc[(k + 1) % len(texts)])):
            if r["fingerprint"][doc].count(",") == other.count(",") and (got := peeled(r["fingerprint"][doc], other)) is not None:
                assert got == pytest.approx(r[name][doc])
                again[name] += 1
    assert again["near_edited"] > 0.8 * len(texts) and again["near_next"] > 0.2 * len(texts)
    q = iblt.op9(odd)
    assert q.count() == odd.count() and q.where("near_next is null or near_edited is null").count() == 0
    assert q.where("doc_id in (6, 7)").select("fingerprint").distinct().count() == 1
    assert iblt.op9(empty).count() == 0


def test_sketch_retries_and_digests(spark):
    """Crowded sketches come out after tries twice as large, and give the digests themselves."""
    a, b = list(range(0, 300 << 34, 1 << 34)), list(range(150 << 34, 450 << 34, 1 << 34))
    h = lambda x: f"transform(array({','.join(str(v) + 'L' for v in x)}), h -> (xxhash64(h) & -16777216L))"
    pair = spark.range(1).selectExpr(f"{h(a)} as a", f"{h(b)} as b").selectExpr(*(f"array_sort(transform({c}, h -> h | (xxhash64(h) & 16777215L))) as {c}" for c in "ab"))
    load, iblt.LOAD = iblt.LOAD, 100
    try:
        df = pair.selectExpr("*", *(f"{iblt.sketch(c, iblt.bits_of(c))} as s{c}" for c in "ab")).selectExpr("a", "b", f"{iblt.differing('a', 'b', 'sa', 'sb')} as d")
        r = df.first()
    finally:
        iblt.LOAD = load
    assert len(r["d"]) == 300 and set(r["d"]) == set(r["a"]) ^ set(r["b"])


def test_next_document_with_a_hot_id(spark):
    rows = [(7 if k % 3 else k, f"text {k}") for k in range(600)] + [(None, f"n {k}") for k in range(100)] + [(8, "same")] * 30
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    ranked = sorted((-(2**63) * -1 if r[0] is None else -r[0], r[2], r[1]) for r in d.select("doc_id", "text", F.xxhash64("text")).collect())
    want = Counter((ranked[k][2], ranked[(k + 1) % len(ranked)][2]) for k in range(len(ranked)))
    got = iblt.beside_next(d)
    assert Counter((r["text"], r["next_text"]) for r in got.collect()) == want
    assert got.groupBy("range").count().agg(F.max("count")).first()[0] < 200


PAGE = """<html><head><title>no</title></head><body><header><h1>Site</h1></header><nav><a href=/>menu</a></nav><div class="cookie-notice">We use cookies</div>
<div id=main><div class="post-123 content"><h1>Title &amp; more</h1><p>First para  with
 <a href=x>link</a> here. <p>Second &eacute; para<ul><li>one<li>two</ul><form><input>send</form><script>if (a<b) {}</script></div>
<div class="comments"><p>a long reader comment that must not appear in the text at all</p></div></div><aside>side</aside><footer>foot</footer>"""


def test_main_text(spark, empty):
    want = "Title & more\nFirst para with link here.\nSecond é para\none\ntwo"
    d = spark.createDataFrame([(1, "http://a.com/x", PAGE), (2, "http://a.com/y", PAGE.replace("123", "77")), (3, None, None), (4, "q", ""), (5, "http://a.com/z", "<p>only <b>this")], "page_id long, url string, html string")
    r = {x["page_id"]: x["text"] for x in htmltext.op10(d).collect()}
    assert r == {1: want, 2: want, 3: "", 4: "", 5: "only this"}
    assert htmltext.op10(d.limit(0)).count() == 0


def test_consensus_wins_over_a_page(spark):
    body = "<article><p>short</p></article><section><p>%s</p></section>"
    pages = [(k, "http://h.com/a", "<article>" + "<p>some longer text of the article</p>" * 9 + "</article><section><p>tail</p></section>") for k in range(5)] + [(9, "http://h.com/b", body % ("odd long section " * 20))]
    r = {x["page_id"]: x["text"] for x in htmltext.op10(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert r[9] == "short"


def test_url_rules(spark):
    urls = ["http://Www.Example.com/en/x", "https://a.example.com/en/1?q", "http://example.com", "http://x.org/net/es/", "ftp://b.net/es/9#f", None, "no scheme/", "http://notexample.com/en/", "http://com/", "://net/fr/", "http://example.com?x/y"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    r = {x["page_id"]: (x["rule"], x["verdict"]) for x in urlfilter.op3(d).collect()}
    assert r == {0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("net/es/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("com/", "allow"), 8: ("com/", "allow"), 9: ("net/fr/", "block"), 10: (None, "allow")}
    rules = spark.createDataFrame([(b, a) for a, b in urlfilter.RULES], "rule string, verdict string")
    assert urlfilter.match_by_join(d, rules).exceptAll(urlfilter.op3(d)).count() == 0
    assert urlfilter.op3(d.limit(0)).count() == 0 and urlfilter.filter_urls(d, []).where("verdict <> 'allow'").count() == 0


def test_digest_collisions(tmp_path):
    rules = [("block", f"h{k}.com/") for k in range(20)]
    clash = lambda r: 7
    urlfilter.DigestArray.write(rules, str(tmp_path), "t", clash)
    a = urlfilter.DigestArray(str(tmp_path), "t")
    assert a.probe(["x.h3.com", "h99.com"], ["/q", "/q"], clash) == [("h3.com/", "block"), None]


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.collect()]
    exact = {r["doc_id"] for r in docs.collect() if any(t in r["text"] for _, t in items)}
    got = {r["doc_id"] for r in decontam.op5(docs, bench).where("contaminated").collect()}
    assert exact and exact == got
    random.seed(1)
    ix = decontam.build(items)
    clean = [r["text"] for r in docs.collect() if r["doc_id"] not in got and 400 < len(r["text"]) < 3000]
    for item, text in items:
        t = list(text)
        for _ in range(len(t) // 25):
            t[random.randrange(len(t))] = "z"
        doc, seg = decontam.search(ix, [clean[0], clean[1][:200] + " " + "".join(t).upper() + " " + clean[1][200:]])
        assert set(doc) == {1} and set(ix.items[seg]) == {item}
    assert decontam.op5(odd, bench).count() == odd.count() and decontam.op5(empty, bench).count() == 0
    assert decontam.op5(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.stage(odd, bench).columns == odd.columns


def test_alignment_by_definition():
    random.seed(2)
    ix = decontam.build([(1, "abcdefghij klmnopqrst")])
    p = ix.chars[ix.start[0] : ix.start[0] + ix.length[0]]
    cp, _ = decontam.normal(["xx abcdefgij klmmnopqrst yy"])
    best = 99
    for s in range(len(cp)):
        d = list(range(len(p) + 1))
        for c in cp[s:]:
            n = [d[0] + 1]
            for k in range(len(p)):
                n.append(min(d[k] + (c != p[k]), d[k + 1] + 1, n[k] + 1))
            d = n
            best = min(best, d[-1])
    assert decontam._aligned(cp, ix, np.array([0]), np.array([0]), np.array([6]))[0] == best == 2


def test_packing(docs, odd, empty):
    enc = packing.Encoder.of(packing.default_vocabulary())
    for d in (docs, odd):
        back = {}
        for r in packing.pack(d, 512).collect():
            assert r["cumulative"][0] == 0 and r["cumulative"][-1] == len(r["ids"]) == len(r["positions"]) <= 512
            for k, (doc, seg) in enumerate(zip(r["doc_ids"], r["segments"], strict=True)):
                lo, hi = r["cumulative"][k], r["cumulative"][k + 1]
                assert r["positions"][lo:hi] == list(range(hi - lo))
                back.setdefault(doc, []).append((seg, r["ids"][lo:hi]))
        texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
        for doc, text in texts.items():
            if doc != 6:
                ids = [t for _, s in sorted(back[doc]) for t in s]
                assert ids[-1] == enc.end and enc.bpe.decode(ids[:-1]) == text
    assert packing.pack(empty).count() == 0


def test_best_fit_brute_force():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 65, 400)
    rooms, rows = [], []
    for k in np.argsort(-sizes, kind="stable"):
        fit = [x for x in range(len(rooms)) if rooms[x] >= sizes[k]]
        at = min(fit, key=lambda x: rooms[x], default=None)
        if at is None:
            rooms.append(64)
            rows.append([])
            at = len(rooms) - 1
        rooms[at] -= sizes[k]
        rows[at].append(k)
    got = packing.best_fit_decreasing(sizes, 64)
    assert len(got) == len(rows) and sorted(k for r in got for k in r) == list(range(400))
    assert all(sizes[r].sum() <= 64 for r in got)


def test_pipeline(spark, docs):
    import corpus_pipeline

    r = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    kept = {d for x in r for d in x["doc_ids"]}
    assert len(kept) > 0.5 * docs.count()
    bench = [t for _, t in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    leaks = {x["doc_id"] for x in docs.collect() if any(t in x["text"] for t in bench)}
    assert leaks and not leaks & kept


def test_simhash_stage_by_texts(spark):
    """Copies at a similarity well above 0.8 go, texts well below it stay."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(20):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 200)]
        near = [*words[:100], "changed", *words[101:]]
        half = [*words[:120], *(f"v{x}" for x in rng.integers(0, 100_000, 80))]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(half))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r[0] for r in simhash.stage(d).select("doc_id").collect()}
    assert kept == {i for i, _ in rows if i % 3 != 1}


def test_simhash_alike_over_blocks(spark):
    """Sets dealt over blocks connect the same rows as all pairs do."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(12):
        words = [f"w{k}x{x}" for x in range(60)]
        for c in range(5):
            own = [w if rng.random() > 0.025 else f"e{rng.integers(0, 10**6)}" for w in words]
            rows.append((5 * k + c, " ".join(own)))
    d = spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string")
    grams = {i: {tuple(w[x : x + 5]) for x in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                want = {i: min(want[a], want[b]) if x in (want[a], want[b]) else x for i, x in want.items()}
    doubtful = d.where("doc_id < 90").selectExpr("1 AS anchor", "doc_id AS node", "doc_id AS label", "600L AS bytes", *(f"0L AS f{k}" for k in range(simhash.WIDE)))
    for block in (1 << 20, 3000):
        edges = simhash.alike(doubtful, simhash.shingle_sets(d.withColumnRenamed("doc_id", "node"), 5), 0.8, block=block).collect()
        got = {i: i for i in grams}
        for a, b in edges:
            got = {i: min(got[a], got[b]) if x in (got[a], got[b]) else x for i, x in got.items()}
        assert got == want and len(set(want.values())) < len(want)


def test_simhash_bits_alone_link_nothing(spark):
    """Different texts under one dominant repeated line stay, whatever their bits say."""
    rng = np.random.default_rng(7)
    line = " ".join(f"line{x}" for x in range(21))
    rows = [(k, " ".join([*(f"w{x}" for x in rng.integers(0, 100_000, 200)), *[line] * 50])) for k in range(12)]
    d = spark.createDataFrame([*rows, (20, rows[3][1])], "doc_id long, text string")
    assert sorted(r[0] for r in simhash.stage(d).select("doc_id").collect()) == list(range(12))
    reps = spark.createDataFrame([(1, 2, 3, 4, 10), (1, 2, 3, 4, 11), (-1, -1, -1, -1, 12)], ", ".join(f"f{k} long" for k in range(simhash.WIDE)) + ", rep long")
    assert {r["node"] for r in simhash.wide_links(reps).collect()} == {10, 11}
    # two of three anchors hold the same rows, and the third one more
    fps = [f"0L AS f{k}" for k in range(simhash.WIDE)]
    doubtful = spark.createDataFrame([(1, 0), (1, 20), (2, 0), (2, 20), (3, 0), (3, 3), (3, 20)], "anchor int, node long").selectExpr("*", "node AS label", "600L AS bytes", *fps)
    d = spark.createDataFrame([(0, rows[3][1]), rows[3], (20, rows[3][1])], d.schema)
    edges = [set(e) for e in simhash.alike(doubtful, simhash.shingle_sets(d.withColumnRenamed("doc_id", "node"), 5), 0.8).collect()]
    assert len(edges) == 3 and {0, 20} in edges and set.union(*edges) == {0, 3, 20}


def test_simhash_repeats_do_not_hide_copies(spark):
    """A copy that repeats one line has nearly the same shingles, and goes."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 400)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[100:115] * (5, 10, 20)[k % 3]))]
    bits = [sum((int(x) ^ int(y)).bit_count() for x, y in zip(*(simhash.wide_fingerprint(t, 5) for _, t in rows[k : k + 2]), strict=True)) for k in range(0, 24, 2)]
    assert max(bits) <= simhash.DIFFER
    kept = sorted(r[0] for r in simhash.stage(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect())
    assert kept == list(range(0, 24, 2))


def test_decontamination_finds_excerpts_anywhere():
    """Verbatim excerpts of 59 characters or more, wherever they lie in the item."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    long, short = (" ".join(word() for _ in range(n)) for n in (60, 8))
    ix = decontam.build([(1, long), (2, short), (3, "tiny"), (4, long[:64])])
    around = [" ".join(word() for _ in range(40)) for _ in range(2)]
    for size in (59, 60, 64, 78):
        texts = [f"{around[0]} {long[at : at + size]} {around[1]}" for at in range(len(long) - size + 1)]
        doc, seg = decontam.search(ix, texts)
        lost = set(range(len(texts))) - set(doc[ix.items[seg] == 1].tolist())
        # an excerpt that begins or ends in a space has a character less
        assert not {at for at in lost if size > 61 or (long[at] != " " and long[at + size - 1] != " ")}
    doc, seg = decontam.search(ix, [around[0], f"{around[0]} {short} {around[1]}"])
    assert {(int(d), int(ix.items[s])) for d, s in zip(doc, seg, strict=True)} == {(1, 2)}


def clashing(df):
    """df with columns of the names that operators use on the way."""
    for k, name in enumerate(("_id", "_key", "_size", "_source", "_copies", "_words", "_copy", "_row", "tie", "row", "copies", "found", "found_", "id", "d", "t", "s", "c", "n", "u0", "repeated", "label", "node")):
        df = df.withColumn(name, F.lit(k))
    return df


def test_stages_with_clashing_columns_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the rain in spain falls mainly on the plain")], "item_id long, text string")
    for stage in (langid.stage, simhash.stage, lambda d: decontam.stage(d, bench), mixing.stage):
        wide = clashing(odd)
        assert stage(wide).columns == wide.columns
        assert stage(wide).count() == stage(odd).count()
        assert stage(clashing(empty)).count() == 0


def test_language_stage_rejects_what_no_language_explains(spark, docs):
    strange = spark.createDataFrame([(-1, "\u0436\u0449\u044a " * 30), (-2, "12 34"), (-3, None)], "doc_id long, text string")
    both = docs.unionByName(strange, allowMissingColumns=True)
    kept = {r[0] for r in langid.stage(both).select("doc_id").collect()}
    assert kept == {r[0] for r in docs.select("doc_id").collect()}


def test_language_of_long_texts_in_pieces(spark):
    text = "the house and the garden " * 200 + "\u00e9t\u00e9 " * 50
    whole = langid.grams([text, None, "a", text])
    piece, langid.PIECE = langid.PIECE, 700
    try:
        parts = langid.grams([text, None, "a", text])
    finally:
        langid.PIECE = piece
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    low = [c if c.isalpha() else " " for c in " " + text + " "]
    assert whole[2][whole[0] == 0].sum() == sum(c != " " for c in low) == whole[2][whole[0] == 3].sum()


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [(1, "one text of some eight words or so here"), (1, "quite another one that shares nothing with it at all"), (2, "a third that is as different as the others are")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.stage(d).collect()) == sorted(t for _, t in rows)
    # repeated rows and copies under another id go, the smallest id stays
    more = d.union(d).union(spark.createDataFrame([(0, rows[1][1]), (None, rows[2][1])], d.schema))
    assert sorted(r["doc_id"] for r in simhash.stage(more).collect()) == [0, 1, 2]


def test_fingerprints_without_id_link_others(spark):
    """A row without doc_id between two others makes one component of them."""
    words = [f"w{k}" for k in range(400)]
    texts, bits = [" ".join(words)], [simhash.fingerprint(" ".join(words), 3)]
    random.seed(3)
    while len(texts) < 3:  # a chain of texts at one or two bits each, the ends farther apart
        t = texts[-1].split()
        t[random.randrange(len(t))] = f"e{random.random()}"
        fp = simhash.fingerprint(" ".join(t), 3)
        if 1 <= (fp ^ bits[-1]).bit_count() <= 2 and (len(texts) < 2 or (fp ^ bits[0]).bit_count() > 2):
            texts.append(" ".join(t))
            bits.append(fp)
    d = spark.createDataFrame([(5, texts[0]), (None, texts[1]), (9, texts[2])], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.op4(d).collect()} == {5}


def test_mixing_rounds_equal_sizes_singly(spark):
    """Rows that share a null id, source and size don't share their fate."""
    rows = [(None, "w " * 10 + f"x{k}", "abc"[k % 3]) for k in range(300)] + [(1, "same words in all", "a")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = mixing.op6(d).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert len(r) == 3 and all(abs(x["taken"] - x["target"]) <= 11 for x in r)
    taken = mixing.op6(d).agg(F.sum("taken")).first()[0]
    assert mixing.stage(d).select(mixing.size_of().alias("n")).agg(F.sum("n")).first()[0] == taken


def test_mixing_targets_by_definition(spark):
    """Targets against a loop that shares the excess out again and again."""
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, "é": 0, "z": 77}
    df = spark.createDataFrame([*sizes.items(), (None, 30)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    order = [*sorted(sizes), None]
    size = {**sizes, None: 30}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(size.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert got[s] == pytest.approx(3 * size[s] if s in full else level * weight[s])


def windows_of(ix, text):
    """Segments that some stretch of a text is within their edits of, by dynamic programming."""
    cp, _ = decontam.normal([text])
    out = set()
    for s in range(len(ix.items)):
        p = ix.chars[ix.start[s] : ix.start[s] + ix.length[s]]
        d, best, slope = np.arange(len(p) + 1), len(p), np.arange(len(p) + 1)
        for c in cp:
            row = np.concatenate([[0], np.minimum(d[:-1] + (p != c), d[1:] + 1)])
            d = np.minimum.accumulate(row - slope) + slope
            best = min(best, d[-1])
        if best <= ix.edits[s]:
            out.add(s)
    return out


def test_decontamination_search_by_brute_force(spark):
    """search() against all stretches of all texts, with edits and items split over neighbours."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 8, 30])))) for k in range(12)]
    ix = decontam.build(items)
    texts = []
    for _ in range(25):
        base, t = " ".join(word() for _ in range(rng.randint(1, 30))), rng.choice(items)[1]
        lo = rng.randrange(len(t))
        x = list(t[lo : rng.randint(lo, len(t))])
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if x:
                x[rng.randrange(len(x))] = rng.choice(["", "z", "qq"])
        texts.append(rng.choice([base + " ", " "]) + "".join(x) + rng.choice([" " + base, ""]))
    for _, t in items:
        texts += [t[: len(t) // 2], t[len(t) // 2 :]]
    texts += [None, "", "a"]
    doc, seg = decontam.search(ix, texts)
    assert set(zip(doc.tolist(), seg.tolist(), strict=True)) == {(k, s) for k, t in enumerate(texts) for s in windows_of(ix, t)}
    long = " ".join(texts[k] or "" for k in range(20))
    for piece in (64, 300, 5000):
        assert decontam.search_long(ix, long, piece) == set(decontam.search(ix, [long])[1].tolist())
    # neither the partition nor the slicing of the benchmark matters
    d, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontam.find(d.repartition(1), bench).drop("text").collect()))
    assert one == sorted(map(tuple, decontam.find(d.repartition(7), bench).drop("text").collect()))
    assert one == sorted(map(tuple, decontam.find(d, bench, most=60_000).drop("text").collect()))


def test_packing_of_repeated_rows_and_binary(spark, odd, tmp_path):
    """The binary columns hold all rows' ids, repeated rows included."""
    enc = packing.Encoder.of(packing.default_vocabulary())
    path = str(tmp_path / "packs")
    packing.write_binary(odd, path, length=64)
    found = []
    for r in spark.read.parquet(path).collect():
        ids, cum, pos = (np.frombuffer(r[k], dtype="<i4") for k in ("ids", "cumulative", "positions"))
        assert r["n_ids"] == len(ids) == cum[-1] == len(pos) <= 64
        for k, (doc, seg) in enumerate(zip(r["doc_ids"], r["segments"], strict=True)):
            part = ids[cum[k] : cum[k + 1]]
            assert (pos[cum[k] : cum[k + 1]] == np.arange(len(part))).all()
            found.append((doc, seg, part.tobytes()))
    want = []
    for r in odd.collect():
        ids = np.concatenate([enc(r["text"] or ""), [enc.end]]).astype("<i4")
        want += [(r["doc_id"], k, ids[at : at + 64].tobytes()) for k, at in enumerate(range(0, len(ids), 64))]
    assert Counter(found) == Counter(want)
    assert packing.op2(odd).columns == ["pack_id", "doc_ids", "segments", "n_ids", "ids", "cumulative", "positions"]


def test_packing_of_long_texts_in_pieces(docs):
    enc = packing.Encoder.of(packing.default_vocabulary())
    text = " ".join(r["text"] for r in docs.limit(20).collect())
    whole, piece = enc(text), packing.PIECE
    packing.PIECE = 1000
    try:
        assert (enc(text) == whole).all() and enc.bpe.decode(enc("é\n" * 3000).tolist()) == "é\n" * 3000
    finally:
        packing.PIECE = piece


def test_url_rules_twice_repeated_and_long(spark):
    rules = [("block", "a.com/"), ("allow", "a.com/"), ("allow", "b.com/x/")]
    d = spark.createDataFrame([(1, "http://q.a.com/" + "z" * 100_000), (2, "http://b.com/x/y"), (2, "http://b.com/x/y"), (None, None)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS _row")
    got = sorted(map(str, urlfilter.filter_urls(d, rules).select("page_id", "rule", "verdict").collect()))
    table = spark.createDataFrame([(b, a) for a, b in rules], "rule string, verdict string")
    assert got == sorted(map(str, urlfilter.match_by_join(d, table).select("page_id", "rule", "verdict").collect()))
    assert len(got) == 4 and "block" in got[0]


def test_main_text_keeps_titles_and_paragraphs(spark):
    """Names of classes alone remove no heading, paragraph or lone section of an article."""
    page = "<body><header>site</header>{}<footer>f</footer></body>"
    bodies = [
        ("<article><h1 class='article-header'>Real title</h1><p>and some text</p></article>", "Real title\nand some text"),
        ("<article><p class='related-work'>first</p><section class='search'><p>on searching</p></section><p>last of them all</p></article>", "first\non searching\nlast of them all"),
        ("<article><header><h1>Title</h1></header><p>text of it</p></article>", "Title\ntext of it"),
    ]
    d = spark.createDataFrame([(k, f"http://h{k}.org/", page.format(b)) for k, (b, _) in enumerate(bodies)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.op10(d).collect()} == {k: t for k, (_, t) in enumerate(bodies)}


def test_main_text_drops_the_template_of_a_host(spark):
    """A suspect box on most pages of a host goes, one on a single page of many stays."""
    page = "<body><article><p>{}</p><div class='related'><p>see {}</p></div>{}</article></body>"
    rows = [(k, "http://t.org/x", page.format(f"the text of page {k} as it is", k, "<section class='search'><p>only here</p></section>" if k == 3 else "")) for k in range(6)]
    d = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("host", F.lit(1)).withColumn("winner", F.lit(2))
    got = {r["page_id"]: r["text"] for r in htmltext.op10(d.union(d.where("page_id = 0"))).collect()}
    assert got == {k: f"the text of page {k} as it is" + ("\nonly here" if k == 3 else "") for k in range(6)}


@pytest.mark.parametrize("pages", [1, 2, 10])
def test_main_text_without_clear_furniture(spark, pages):
    """Comments, notices and adverts go on hosts of any size, however few of its pages have them."""
    extra = ["<div class='comments'><p>nice one</p><p>me too</p></div>", "<section class='cookie-notice'><p>we use some</p></section>", "<div id='advert'>buy it</div>", "<ul class='menu'><li><a href='/'>home</a></li><li><a href='/b'>b</a></li></ul>", "<div class='promo'><p>join</p></div>"]
    rows = [(k, "http://c.org/x", f"<body><article><h1>Title {k}</h1><p>the first block of page {k}</p>{extra[k % 5] if k % 3 == 0 else ''}<p>and its last one</p></article></body>") for k in range(pages)]
    got = {r["page_id"]: r["text"] for r in htmltext.op10(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nthe first block of page {k}\nand its last one" for k in range(pages)}


def test_main_text_keeps_formulas_and_lists_of_links(spark):
    """An article's own list of links stays; the host's menu in the same container goes."""
    page = "<body><main><ul class='top'><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><h1>Paper {0}</h1><p>as <math><mi>x</mi></math> holds, it is <output>{0}</output>.</p>{1}</main></body>"
    sources = "<h2>Sources</h2><ul class='refs'><li><a href='/1'>Paper one</a></li><li><a href='/2'>Paper two</a></li></ul>"
    rows = [(k, "http://p.org/", page.format(k, sources if k < 2 else "")) for k in range(5)]
    rows += [(9, "http://single.org/", "<body><div><a href='/'>a</a> <a href='/b'>b</a></div><article><p>the article</p>" + sources + "</article></body>")]
    got = {r["page_id"]: r["text"] for r in htmltext.op10(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    tail = "\nSources\nPaper one\nPaper two"
    assert got == {k: f"Paper {k}\nas x holds, it is {k}." + (tail if k < 2 else "") for k in range(5)} | {9: "the article" + tail}


PIECES = re.compile(r"<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<footer>.*?</footer>|<head>.*?</head>", re.S)


def test_main_text_by_a_plain_extractor(spark):
    """The given pages: what furniture leaves, cut at the tags of blocks."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        source = re.sub(r"<br>", " ", PIECES.sub("", r["html"] or ""))
        parts = re.split(r"</?(?:article|body|html|h1|p|ul|li|div)[^>]*>", source)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        want[r["page_id"]] = "\n".join(x for x in lines if x and x != "<!DOCTYPE html>")
    assert {r["page_id"]: r["text"] for r in htmltext.op10(pages).collect()} == want


def test_main_text_of_deep_and_long_pages(spark):
    import time

    began = time.time()
    assert htmltext.extract("<div>" * 10_000 + "deep" + "</div>" * 10_000, None, None) == "deep"
    assert len(htmltext.extract("<article>" + "<p>text of a block</p>" * 20_000 + "</article>", None, None).split("\n")) == 20_000
    assert time.time() - began < 10


def test_hosts_beyond_the_broadcast(spark):
    """Winners come by a join, or broadcast for large hosts, with the same result."""
    rows = [(k, f"http://h{k % 5 if k < 40 else k}.org/", f"<article><p>page {k}</p></article>") for k in range(60)]
    d = spark.createDataFrame([*rows, (None, None, "<p>x</p>")], "page_id long, url string, html string")
    want = sorted(map(str, htmltext.op10(d).collect()))
    many, htmltext.MANY = htmltext.MANY, 10
    try:
        assert sorted(map(str, htmltext.op10(d).collect())) == want
    finally:
        htmltext.MANY = many


def test_sentence_kernel_by_definition():
    """Features and decisions of the machine against a kernel computed word by word."""

    def phi(word):
        out = Counter()
        for p in toxicity.pieces(word):
            own = Counter()
            for i in range(len(p)):
                for j in range(i + 1, len(p)):
                    for k in range(j + 1, min(len(p), i + toxicity.SPAN)):
                        own[p[i] + p[j] + p[k]] += toxicity.DECAY ** (k - i + 1)
            norm = sum(v * v for v in own.values()) ** 0.5
            for g, v in own.items():
                out[g] += v / norm
        return out

    bad = [frozenset(["you", "stupid", "fellow"]), frozenset(["what", "idiots"]), frozenset(["stupidity", "again"])]
    plain = [frozenset(["fair", "weather", "today"]), frozenset(["what", "garden"]), frozenset(["again", "some", "water"])]
    m = toxicity.fit(bad, plain)
    weight = {}
    for c, w in zip(m.codes.tolist(), m.weights.tolist(), strict=True):
        weight["".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0))] = w
    text = "You stupid fellow! What a garden. st u p i d"
    (own, value), = m.decisions([text], {})
    for s, v in zip(own, value, strict=True):
        assert v == pytest.approx(m.bias + sum(c * weight.get(g, 0.0) for word in s for g, c in phi(word).items()), abs=1e-5)
    assert (next(m.decisions([" ".join(s) for s in bad], {}))[1] > 0).all() and value[0] > 0 > value[1]


def test_pipeline_on_odd_rows_and_the_empty_table(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for k, docs in enumerate((clashing(odd), empty)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{k}-{name}"
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(out)
            docs = spark.read.parquet(out)
            assert name == "token_packs" or docs.columns == columns
            assert not (k and docs.count())
        if not k:
            kept = [d for r in docs.collect() for d in r["doc_ids"]]
            # null, empty, blank and letterless texts go, and the copies of 6
            assert kept and not {1, 2, 3, 4, 7} & set(kept)


def test_labels_given_twice_or_missing(spark, docs):
    """Of several labels of a document the largest counts; null ids and labels are ignored."""
    labels = spark.createDataFrame([(k, 0) for k in range(40)] + [(3, 1), (3, 1), (5, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    r = toxicity.op8(docs, labels).collect()
    assert len(r) == docs.count() and all(0 <= x["score"] <= 1 for x in r)


def test_texts_are_scored_together_as_one_by_one():
    m = toxicity.fit_words(["idiot", "moron", "stupid", "trash"], ["table", "window", "garden", "river", "little", "people"])
    texts = [None, "", " \n ", "You idiot! idiot idiot, you idiot. Idiot", "a river\nand the river the river the river the garden the", "i d i o t s and m-o-r-o-n everywhere: table", "ünï çødé \U0001f600\U0001f600x idi\U0001f600ot", "x" * 60 + " idiot" * 7]
    known = {}
    want = [m.summary(own, value, known) for own, value in m.decisions(texts, known)]
    assert np.allclose(m.features(texts, {}), want, atol=1e-12) and len({tuple(x) for x in want}) > 4
    assert m.features([], {}).shape == (0, 4) and m.features([None], {}).tolist() == [[m.bias, 0, m.bias, 0]]
    # a table by letters gives what the search among subsequences does
    assert m._dense()[1] is not None
    plain = toxicity.Model(m.codes, m.weights, m.bias)
    plain.__dict__["_held"] = (None, None, 0)
    words = ["idiots", "gardener", "aaaaab", "çødé", "m"]
    assert np.allclose(m.weigh(words), plain.weigh(words), atol=1e-12)
