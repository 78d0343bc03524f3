"""Language identification as inference of a multilingual mixture.

Each language is a smoothed distribution over hashed character trigrams of
letters (word borders included). A document is a mixture of languages: its
proportions are fitted by expectation-maximisation over its trigram counts.
The set of languages is chosen by penalised likelihood: from all languages the
weakest is taken out again and again, and of the sets passed the one with the
best log likelihood less ``penalty * languages * log(trigrams)`` is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, check_shipped, held_out, quoted, unused

BUCKET_BITS = 16
UNKNOWN = "und"
MAX_LANGUAGES = 500
#: Characters that are looked at together, and cells (trigrams x languages) held at once.
PIECE, CELLS = 1 << 20, 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, 0 for anything else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def _buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, bucket) of the trigrams around the letters of text, its first and
    last character being no more than neighbours. Anything but a letter is a border."""
    cp = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    at = np.flatnonzero(cp[1:-1]) + 1
    h = cp[at - 1] * np.uint32(0x9E3779B1) ^ cp[at] * np.uint32(0x85EBCA77) ^ cp[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return at, h >> np.uint32(32 - BUCKET_BITS)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[at, len(key)])
    return key[at] >> BUCKET_BITS, key[at] & ((1 << BUCKET_BITS) - 1), n


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of letter trigrams, sorted by document.

    A trigram is a letter with its neighbours; whatever isn't a letter counts as
    a border. A long text is read in pieces that overlap by a character.
    """
    doc, bucket, count = [], [], []

    def add(part: tuple[np.ndarray, np.ndarray, np.ndarray], first: int) -> None:
        for out, x in zip((doc, bucket, count), (part[0] + first, *part[1:]), strict=True):
            out.append(x.astype(np.int64))

    at = 0
    while at < len(texts):
        if len(texts[at] or "") > PIECE:
            text, total = texts[at], np.zeros(1 << BUCKET_BITS, dtype=np.int64)
            for lo in range(0, len(text), PIECE):
                part = (text[lo - 1] if lo else " ") + text[lo : lo + PIECE + 1] + ("" if lo + PIECE < len(text) else " ")
                total += np.bincount(_buckets(part)[1], minlength=1 << BUCKET_BITS)
            held = np.flatnonzero(total)
            add((np.zeros(len(held), dtype=np.int64), held, total[held]), at)
            at += 1
            continue
        upto, size = at, 0
        while upto < len(texts) and size + len(texts[upto] or "") <= PIECE and upto - at < 1 << 15:
            size += len(texts[upto] or "") + 1
            upto += 1
        upto = max(upto, at + 1)
        ends = np.cumsum([len(t or "") + 1 for t in texts[at:upto]])
        place, found = _buckets(" " + "".join(f"{t or ''} " for t in texts[at:upto]) + " ")
        own = np.searchsorted(ends, place - 1, "right").astype(np.uint32)
        add(_counted(own << np.uint32(BUCKET_BITS) | found), at)
        at = upto
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (doc, bucket, count))


@dataclass
class Mixture:
    """Trigram distributions of the learned languages, and how to infer."""

    langs: list[str]
    logp: np.ndarray  # buckets x languages
    penalty: float = 3.0
    prior: float = 2.0
    rounds: int = 12

    def _fit(self, p: np.ndarray, n: np.ndarray, at: np.ndarray, which: np.ndarray, active: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log likelihood) of the documents with the languages in active."""
        total = np.add.reduceat(n, at)
        pi = active / active.sum(1, keepdims=True)
        alpha = active * self.prior / active.sum(1, keepdims=True)
        for _ in range(rounds):
            r = pi[which]
            r *= p
            r *= (n / r.sum(1))[:, None]
            pi = (np.add.reduceat(r, at, axis=0) + alpha) / (total + self.prior)[:, None]
        r = pi[which]
        r *= p
        return pi, np.add.reduceat(n * np.log(r.sum(1)), at)

    def infer(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, proportions, gain). Score is the language's proportion when
        all languages take part, drawn toward equal shares for short texts. gain
        is the mean log likelihood of a trigram over that of no language at all,
        in which every trigram is as likely as any other."""
        doc, bucket, n = grams(texts)
        lang, score, gain = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        share = np.zeros((len(texts), len(self.langs)))
        if not len(doc) or not self.langs:
            return lang, score, share, gain
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        end, most = np.r_[begin[1:], len(doc)], max(1, CELLS // len(self.langs))
        first = 0
        while first < len(begin):  # as many documents as give no more than CELLS, one at least
            upto = max(first + 1, int(np.searchsorted(end, begin[first] + most, "right")))
            lo, hi = begin[first], end[upto - 1]
            self._infer(doc[lo:hi], bucket[lo:hi], n[lo:hi], lang, score, share, gain)
            first = upto
        return lang, score, share, gain

    def _infer(self, doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, lang: list[str], score: np.ndarray, share: np.ndarray, gain: np.ndarray) -> None:
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ids = doc[at]
        which = np.repeat(np.arange(len(ids)), np.diff(np.r_[at, len(doc)]))
        p = self.logp[bucket]
        peak = p.max(1)
        p = np.exp(p - peak[:, None])
        n = n.astype(np.float64)
        total = np.add.reduceat(n, at)
        base = np.add.reduceat(n * peak, at)
        cost = self.penalty * np.log(total + 1)
        active = np.ones((len(ids), len(self.langs)))
        full, ll = self._fit(p, n, at, which, active, self.rounds)
        best, best_value, best_ll, pi = full, ll - cost * len(self.langs), ll, full
        for _ in range(len(self.langs) - 1):
            weakest = np.where(active > 0, pi, np.inf).argmin(1)
            active[np.arange(len(ids)), weakest] = 0
            pi, ll = self._fit(p, n, at, which, active, self.rounds)
            value = ll - cost * active.sum(1)
            better = value > best_value
            best, best_value, best_ll = np.where(better[:, None], pi, best), np.where(better, value, best_value), np.where(better, ll, best_ll)
        top = best.argmax(1)
        share[ids] = best
        score[ids] = np.clip(full[np.arange(len(ids)), top], 0, 1)
        gain[ids] = (best_ll + base) / total + np.log(1 << BUCKET_BITS)
        for k, t in zip(ids, top, strict=True):
            lang[k] = self.langs[t]


def learn(docs: DataFrame, per_language: int = 4000, smooth: float = 0.5, **options) -> Mixture:
    """Learn from docs(doc_id, text, lang), rows without a language left out.

    The sample is bounded: about ``per_language`` different rows of each language,
    chosen by a hash of doc_id and text alike at every size. Only trigram counts
    by language reach the driver, at most 65,536 for each language.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = dict(known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different values of lang")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n)))) if counts else F.create_map()
    sample = known.where(draw < share[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"]).select("lang", "text") if counts else known.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, PIECE):
            names, of = np.unique(np.array(b.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            doc, bucket, n = grams(b.column("text").to_pylist())
            key, place = np.unique(of[doc].astype(np.int64) << BUCKET_BITS | bucket, return_inverse=True)
            total = np.bincount(place, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[key >> BUCKET_BITS]), pa.array((key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)), pa.array(total)], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((1 << BUCKET_BITS, len(langs)), smooth)
    for k, name in enumerate(langs):
        own = rows[rows["lang"] == name]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    logp = np.log(table / table.sum(0)).astype(np.float32) if langs else table.astype(np.float32)
    check_shipped(logp.nbytes, "the language model")
    return Mixture(langs, logp, **options)


FOUND = "lang_pred string, score double, lang_share map<string,double>, gain double"


def _with_found(docs: DataFrame, model: Mixture, name: str) -> DataFrame:
    """docs with what is inferred from the text as a struct column of that name."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def infer(text):  # noqa: ANN001, ANN202
        import pandas as pd

        m = shipped.value
        out: list[tuple] = []
        at, size = 0, 0
        values = [t if isinstance(t, str) else None for t in text]
        for k in range(len(values) + 1):
            if k == len(values) or size > PIECE:
                lang, score, share, gain = m.infer(values[at:k])
                kept = [{m.langs[j]: float(s[j]) for j in np.flatnonzero(s > 0.01)} for s in share]
                out += zip(lang, score, kept, gain, strict=True)
                at, size = k, 0
            if k < len(values):
                size += len(values[k] or "")
        return pd.DataFrame(out, columns=["lang_pred", "score", "lang_share", "gain"])

    return docs.select(*map(quoted, docs.columns), infer(F.col("text").cast("string")).alias(name))


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """docs with lang_pred, score, lang_share (map of the kept languages to
    their proportions) and gain (see Mixture.infer), one row per row.

    A null text, or one without letters, is ``und`` with score 0 and an empty
    map; so is every text if no language was learned. Languages with equal
    proportions: the first by name. Columns of docs with these names are
    replaced, whatever their case.
    """
    own, found = [quoted(c) for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_share", "gain")], unused("found", docs)
    return _with_found(docs, model, found).select(*own, f"{found}.*")


def op1(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out.

    Null, empty or letterless text: ``und`` with score 0. Very long texts are
    read whole, in pieces. Ties: the first language by name. Repeated rows get a
    row each, rows without doc_id are never held out, an empty table gives no
    rows, and other columns of docs aren't looked at.
    """
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_share")


def stage(docs: DataFrame, languages: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """docs without the rows that no learned language explains: those without
    letters, and those whose letter trigrams are less likely in the best mixture
    than if all trigrams were alike (``gain`` of ``least`` or less). If languages
    are given, rows of others go, too.

    The empty set of languages is one of the sets that the likelihood chooses
    from, so to say. Rows with null or empty text go; repeated rows, rows without
    doc_id and columns of any name are treated alike; an empty table stays empty.
    """
    found = unused("found", docs)
    keep = (F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.gain") > least)
    if languages:
        keep &= F.col(f"{found}.lang_pred").isin(languages)
    return _with_found(docs, learn(docs.where(~held_out())), found).where(keep).select(*map(quoted, docs.columns))
