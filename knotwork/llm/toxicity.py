"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two words sums lambda^(span) over all their common subsequences
of three characters, gaps allowed, so a word with inserted or repeated
characters stays close to the word it hides; that of two sentences sums the
normalised kernels of their words. Landmark sentences give the Nystroem features
of a sentence, and a linear support vector machine on them tells sentences of
toxic documents from those of clean ones. Since kernel, features and machine are
linear in the subsequences, the trained model folds into one weight for each of
them, and a sentence's decision into a sum over its words.

A label holds for a document, and most sentences of a toxic one are clean. So
the machine is trained again with the sentences of each toxic document that the
machine before found worst, and the worst ones of clean documents against them. A
document's score comes from its sentences' decisions by a logistic model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, held_out, materialize, quoted

DECAY, SPAN, LONGEST = 0.6, 9, 24
#: Longest sentence in words; longer ones are cut.
WORDS = 5
#: Characters of texts that are scored together.
PIECE = 1 << 20
_SPELLED = re.compile(r"(?<!\S)\w(?:[\s.\-_*]+\w(?!\w)){2,}(?!\w)")
_ALIEN = re.compile(r"[\W_]+")


_END = re.compile(r"[.!?:;]+\s+|[\r\n]+")


def split_lines(text: str | None) -> list[str]:
    """Lower-cased text at the ends of sentences and lines; words spelled out in
    single letters are put together."""
    return _END.split(_SPELLED.sub(lambda m: _ALIEN.sub("", m.group()), text.lower())) if text else []


def sentences(text: str | None) -> list[frozenset[str]]:
    """Distinct lower-cased words of each sentence; words spelled out in single
    letters count as one."""
    out = []
    for line in split_lines(text):
        words = line.split()
        out += [frozenset(words[k : k + WORDS]) for k in range(0, len(words), WORDS)]
    return out


def tokens(text: str | None) -> set[str]:
    """Distinct words of all sentences."""
    return set().union(*sentences(text))


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n characters, and their decayed weights."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(found, dtype=np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def pieces(word: str) -> list[str]:
    """What the kernel sees of a token: letters and digits between border
    marks, long tokens as overlapping windows."""
    own = "^" + _ALIEN.sub("", word) + "$"
    if len(own) <= LONGEST:
        return [own] if len(own) > 4 else []
    return [own[k : k + LONGEST] for k in range(0, len(own) - LONGEST // 2, LONGEST // 2)]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By word length: (places in words, codes of their subsequences, weights,
    norms under the kernel)."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        here = np.flatnonzero(size == n)
        at, weight = _triples(int(n))
        for lo in range(0, len(here), 2048):
            own = here[lo : lo + 2048]
            c = np.frombuffer("".join([words[k] for k in own]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64).reshape(len(own), n)
            code = (c[:, at[:, 0]] << 42) | (c[:, at[:, 1]] << 21) | c[:, at[:, 2]]
            # equal subsequences of a word beside each other: places of its characters among all, and the triple below
            small = np.unique(c, return_inverse=True)[1].reshape(c.shape)
            key = np.sort((small[:, at[:, 0]] << 42) | (small[:, at[:, 1]] << 26) | (small[:, at[:, 2]] << 10) | np.arange(len(at)), axis=1)
            sorted_code, w = key >> 10, weight[key & 1023]
            new = np.c_[np.ones(len(own), dtype=bool), sorted_code[:, 1:] != sorted_code[:, :-1]]
            first = np.flatnonzero(new)
            squares = np.add.reduceat(w.ravel(), first) ** 2
            norm = np.sqrt(np.bincount(first // code.shape[1], squares, minlength=len(own)))
            yield own, code, weight, norm


@dataclass
class Model:
    """Weights by subsequence, and the logistic model of documents."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    logistic: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0, 0.0]))

    def weigh(self, tokens: list[str]) -> np.ndarray:
        """What each token adds to the decision of a sentence."""
        out = np.zeros(len(tokens))
        parts, of = [], []
        for k, t in enumerate(tokens):
            for p in pieces(t):
                parts.append(p)
                of.append(k)
        if not parts or not len(self.codes):
            return out
        value = np.empty(len(parts))
        letter, table, n = self._dense()
        for own, code, weight, norm in subsequences(parts):
            if table is None:
                place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                found = np.where(self.codes[place] == code, self.weights[place], 0.0)
            else:
                found = table[(letter[code >> 42] * n + letter[code >> 21 & 0x1FFFFF]) * n + letter[code & 0x1FFFFF]]
            value[own] = (found @ weight) / norm
        np.add.at(out, np.array(of), value)
        return out

    def _dense(self) -> tuple[np.ndarray, np.ndarray | None, int]:
        """The weights as a table by three letters, if the subsequences have few letters:
        places of characters (0: in none), the table, its side."""
        if "_held" not in self.__dict__:
            parts = [self.codes >> 42, self.codes >> 21 & 0x1FFFFF, self.codes & 0x1FFFFF]
            known = np.unique(np.concatenate(parts))
            n, letter, table = len(known) + 1, np.zeros(1 << 21, dtype=np.int32), None
            letter[known] = np.arange(1, n)
            if n <= 128:
                table = np.zeros(n**3)
                table[(letter[parts[0]] * n + letter[parts[1]]) * n + letter[parts[2]]] = self.weights
            self.__dict__["_held"] = letter, table, n
        return self.__dict__["_held"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def words(self, tokens: list[str]) -> np.ndarray:
        """The machine's decision for each token as a sentence of its own."""
        return self.weigh(tokens) + self.bias

    def _meet(self, words: set[str], known: dict[str, float]) -> None:
        """known with all of words."""
        new = list(words.difference(known))
        if len(known) + len(new) > 400_000:  # only a cache: forgotten words are scored again
            known.clear()
            new = list(words)
        known.update(zip(new, self.weigh(new).tolist(), strict=True))

    def decisions(self, texts: list[str | None], known: dict[str, float]) -> Iterator[tuple[list[frozenset[str]], np.ndarray]]:
        """Sentences of each text and the machine's decisions for them."""
        found = [sentences(t) for t in texts]
        self._meet(set().union(*(s for own in found for s in own)), known)
        for own in found:
            yield own, np.array([sum(map(known.__getitem__, s)) for s in own]) + self.bias

    def summary(self, own: list[frozenset[str]], value: np.ndarray, known: dict[str, float]) -> tuple[float, float, float, float]:
        """What the logistic model sees of a document: the largest decision for a
        sentence and the log of 1 + number of toxic ones; the same for its
        distinct words, each as a sentence of its own."""
        alone = np.fromiter(map(known.__getitem__, set().union(*own)), dtype=np.float64) + self.bias
        return float(value.max(initial=self.bias)), float(np.log1p(np.count_nonzero(value > 0))), float(alone.max(initial=self.bias)), float(np.log1p(np.count_nonzero(alone > 0)))

    def features(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """summary() of each text, all texts together."""
        flat, lines, owner = [], [], []
        for k, text in enumerate(texts):
            for line in split_lines(text):
                if words := line.split():
                    flat += words
                    lines.append(len(words))
                    owner.append(k)
        out = np.zeros((len(texts), 4))
        out[:, 0] = out[:, 2] = self.bias
        if not flat:
            return out
        self._meet(set(flat), known)
        value = np.fromiter(map(known.__getitem__, flat), dtype=np.float64, count=len(flat))
        n, line = np.array(lines), np.array(owner)
        # sentences: at most WORDS words of a line each, without repeats
        many = -(-n // WORDS)
        own, first = np.repeat(line, many), np.repeat(np.cumsum(n) - n, many)
        first = first + WORDS * (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many))
        end = np.minimum(first + WORDS, np.repeat(np.cumsum(n), many))
        place = first[:, None] + np.arange(WORDS)
        each = np.where(place < end[:, None], value[np.minimum(place, len(value) - 1)], 0.0)
        total = each.sum(axis=1)
        pairs = [(a, b) for b in range(WORDS) for a in range(b)]
        for k in np.flatnonzero(np.any([(each[:, a] == each[:, b]) & (each[:, a] != 0) for a, b in pairs], axis=0)).tolist():
            total[k] = sum(map(known.__getitem__, frozenset(flat[first[k] : end[k]])))
        total += self.bias
        np.maximum.at(out[:, 0], own, total)
        out[:, 1] = np.log1p(np.bincount(own[total > 0], minlength=len(texts)))
        text, alone = np.repeat(line, n), value + self.bias
        np.maximum.at(out[:, 2], text, alone)
        toxic = np.flatnonzero(alone > 0).tolist()
        distinct = {(int(text[k]), flat[k]) for k in toxic}
        out[:, 3] = np.log1p(np.bincount([k for k, _ in distinct], minlength=len(texts)) if distinct else 0)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[np.ones(len(features)), features] @ self.logistic
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_words(positive: list[str], negative: list[str], landmarks: int = 400, cost: float = 30.0) -> Model:
    """The machine for sentences of one word each."""
    return fit([frozenset([w]) for w in positive], [frozenset([w]) for w in negative], landmarks, cost)


def fit(positive: list[frozenset[str]], negative: list[frozenset[str]], landmarks: int = 400, cost: float = 30.0) -> Model:
    """Nystroem features from the first sentences of both classes, then a
    linear machine with squared hinge loss, folded into subsequence weights."""
    split = lambda many: [x for s in many if (x := sorted({p for w in s for p in pieces(w)}))]
    positive, negative = split(positive), split(negative)
    if not positive or not negative:
        return Model()
    every, marks = positive + negative, positive[: landmarks // 2] + negative[: landmarks // 2]
    words = sorted({p for s in every for p in s})
    at = {w: k for k, w in enumerate(words)}
    own_marks: dict[int, list[int]] = {}
    for k, s in enumerate(marks):
        for w in s:
            own_marks.setdefault(at[w], []).append(k)
    codes = np.unique(np.concatenate([np.unique(code) for _, code, _, _ in subsequences([words[k] for k in own_marks])]))
    table = np.zeros((len(codes), len(marks)), dtype=np.float32)
    ids = list(own_marks)
    for own, code, weight, norm in subsequences([words[k] for k in ids]):
        for i, k in enumerate(own):
            place = np.searchsorted(codes, code[i])
            for mark in own_marks[ids[k]]:
                np.add.at(table[:, mark], place, (weight / norm[i]).astype(np.float32))
    rows = np.zeros((len(words), len(marks)), dtype=np.float32)
    for own, code, weight, norm in subsequences(words):
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        met = codes[place] == code
        for i, k in enumerate(own):
            rows[k] = (weight[met[i]] / norm[i]).astype(np.float32) @ table[place[i][met[i]]]

    def kernel(many: list[list[str]]) -> np.ndarray:
        flat = np.array([at[w] for s in many for w in s])
        begin = np.cumsum([0, *(len(s) for s in many[:-1])])
        return np.add.reduceat(rows[flat], begin, axis=0).astype(np.float64)

    value, vector = np.linalg.eigh(kernel(marks) + 1e-6 * np.eye(len(marks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    x = np.c_[kernel(every) @ root, np.ones(len(every))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    each = np.where(y > 0, len(y) / (2 * len(positive)), len(y) / (2 * len(negative)))
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.r_[np.ones(x.shape[1] - 1), 1e-3]) / cost
    for _ in range(30):
        on = y * (x @ w) < 1
        part = x[on] * each[on, None]
        new = np.linalg.solve(ridge + part.T @ x[on], part.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return Model(codes, table @ (root @ w[:-1]), float(w[-1]))


def fit_documents(model: Model, features: np.ndarray, toxic: np.ndarray) -> None:
    x = np.c_[np.ones(len(features)), features]
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(b)), x.T @ (toxic - p) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    model.logistic = b


def _scored(sample: DataFrame, model: Model, run, schema: str):  # noqa: ANN001, ANN202
    """Rows that run(text's sentences, decisions, label) gives over sample(text, toxic), at the driver."""
    shipped = sample.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in bounded(batches, PIECE):
            texts, labels = b.column("text").to_pylist(), b.column("toxic").to_pylist()
            rows = [r for (own, value), label in zip(shipped.value.decisions(texts, cache), labels, strict=True) for r in run(own, value, label, cache)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], names)

    return sample.mapInArrow(go, schema).toPandas()


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = 3000, clean_docs: int = 6000, each: int = 4, most: int = 4000, rounds: int = 3) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, toxic).

    The sample is bounded: about ``toxic_docs`` and ``clean_docs`` labelled
    rows, drawn by a hash of doc_id, are joined to the texts. ``each`` sentences of
    each of these, drawn by hash (more where labels are few), train the first machine, and ``rounds`` times
    more the worst ones of each do; at most ``most`` of a class train at once.
    With no toxic or no clean label, every document gets the score of the only
    class or 0. Of several labels of a document the largest counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {int(k): c for k, c in known.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        model = Model()
        model.logistic = np.array([30.0 if n.get(1) else -30.0, 0.0, 0.0, 0.0, 0.0])
        return model
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, toxic_docs / n[1]).otherwise(clean_docs / n[0])
    # at most about 9,000 rows of two numbers, by the draw above; of rows with equal doc_id and text one
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known.where(draw < share)), "doc_id")
    sample = materialize(sample.dropDuplicates(["doc_id", "text"]).select("text", "toxic"))

    few = {k: max(each, most // max(1, n[k])) for k in (0, 1)}

    def drawn(own: list[frozenset[str]], value: np.ndarray, label: int, known: dict[str, float]) -> list[tuple]:
        keyed = sorted((xxhash.xxh64_intdigest(t), t) for t in {" ".join(sorted(s)) for s in own})
        return [(label, t, 0.0) for _, t in keyed[: few[label]]]

    def worst(own: list[frozenset[str]], value: np.ndarray, label: int, known: dict[str, float]) -> list[tuple]:
        order = sorted(range(len(own)), key=lambda k: (-value[k], " ".join(sorted(own[k]))))
        return [(label, " ".join(sorted(own[k])), float(value[k])) for k in order[: 2 if label == 1 else 1]]

    def parted(rows) -> tuple[list, list]:  # noqa: ANN001
        """Distinct sentences of toxic and of clean documents, each with its
        largest decision; a sentence that clean documents have, too, is clean."""
        best = rows.groupby(["toxic", "text"])["value"].max().reset_index()
        clean = best[best["toxic"] == 0]
        bad = best[(best["toxic"] == 1) & ~best["text"].isin(clean["text"])]
        return [sorted(zip(x["value"], x["text"], strict=True), key=lambda r: (-r[0], xxhash.xxh64_intdigest(r[1]))) for x in (bad, clean)]

    schema = "toxic int, text string, value double"
    as_set = lambda rows: [frozenset(t.split()) for _, t in rows]
    bad, plain = parted(_scored(sample, Model(), drawn, schema))
    plain = plain[:most]
    model = fit(as_set(bad[:most]), as_set(plain))
    for _ in range(rounds):
        seen, hard = parted(_scored(sample, model, worst, schema))
        # witnesses by hash, so that landmarks are spread over all of them
        seen = sorted((x for x in seen if x[0] > -0.5), key=lambda r: xxhash.xxh64_intdigest(r[1])) or seen
        model = fit(as_set(seen[:most]), as_set(hard[:100] + plain[: most // 2] + hard[100 : most // 2]))
    got = _scored(sample, model, lambda own, value, label, known: [(label, *model.summary(own, value, known))], "toxic int, top double, many double, word double, words double")
    fit_documents(model, got[["top", "many", "word", "words"]].to_numpy(), got["toxic"].to_numpy().astype(float))
    # the sample holds the classes at other rates than the labels do
    prior = np.log(n[1] / n[0]) - np.log(max(1, (got["toxic"] == 1).sum()) / max(1, (got["toxic"] == 0).sum()))
    model.logistic[0] += prior
    return model


_cache: dict[int, dict[str, float]] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1), one row per row; null and empty texts get the
    score of a text without insults. A column named score is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    own = [quoted(c) for c in docs.columns if c.lower() != "score"]

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, cache = shipped.value, _cache.setdefault(shipped.id if hasattr(shipped, "id") else 0, {})
        for s in batches:
            texts, out, at, size = [t if isinstance(t, str) else None for t in s], [], 0, 0
            for k in range(len(texts) + 1):
                if k == len(texts) or size > PIECE:
                    out.append(m.probability(m.features(texts[at:k], cache)))
                    at, size = k, 0
                if k < len(texts):
                    size += len(texts[k] or "")
            yield pd.Series(np.concatenate(out))

    return docs.select(*own, run(F.col("text").cast("string")).alias("score"))


def op8(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score of every document, learned from the labelled rows that aren't held out.

    Null and empty texts score as a text without any toxic sentence. Texts are
    read whole, however long. Repeated rows get a row each, all of the same
    score; rows without doc_id are never held out. Without labels of both classes
    all scores are alike. An empty table gives no rows; other columns aren't
    looked at. Ties at the threshold count as toxic.
    """
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
