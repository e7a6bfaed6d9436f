"""Toxicity by multiple-instance learning (operator 6).

Only documents are labelled; sentences are the instances. A sentence's score is logistic in the words it
holds, a document's score is the noisy-or of its sentences' scores, and the words' weights are fitted to
the documents' labels through it. Words that can matter are found first, by counts in toxic and other
labelled documents of the sample: all that LEAST_DOCS toxic documents hold and that stand out there. None of them is left
out, so there are as many as the sample, whose size is bounded, has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import small_batches, staged
from plumbline.llm.supervise import SAMPLE, labelled

#: Evidence: toxic documents that must hold a word, or beginning of words, and its least log lift among them, before it is weighed.
LEAST_DOCS, LEAST_LIFT = 8, 0.7
ROUNDS, RATE, DECAY, START = 200, 0.3, 0.003, -6.0
#: A sentence of at least this score is reported as offending.
OFFENDING = 0.5

#: Bytes of a word that make its beginning.
STEMS = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*")
BREAKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def split(text: str) -> set[bytes]:
    """Lower-cased words without ASCII marks around or within."""
    return set(text.lower().encode().translate(BREAKS).split())


def of_word(word: bytes) -> list[bytes]:
    """A word and its beginnings, which endings do not change."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) >= k)]


def features(text: str) -> set[bytes]:
    return {f for w in split(text) for f in of_word(w)}


class Known(dict):
    """For each word met so far those of its features that a vocabulary has."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) > 1 << 20:
            self.clear()
        found = self[word] = tuple(f for f in of_word(word) if f in self.vocabulary)
        return found

    def sentences(self, text: str) -> tuple[int, list[tuple[int, int, list[bytes]]]]:
        """The number of sentences, and ``(start, end, features)`` of those with known ones, in order."""
        hits = {w: f for w in split(text) if (f := self[w])}
        if not hits:
            return sum(map(bool, map(str.strip, re.split(r"[.!?\n]+", text)))), []
        n, found = 0, []
        for m in SENTENCE.finditer(text):
            n += 1
            here = [hits[w] for w in split(m[0]) if w in hits]
            if here:
                found.append((m.start(), m.end(), sorted({f for fs in here for f in fs})))
        return n, found


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]

    def score(self, text: str, known: Known | None = None) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score and ``(start, end, score)`` of offending sentences. known: of the weighed words, kept from text to text."""
        n, found = (Known(self.weights) if known is None else known).sentences(text)
        scored = [(s, e, sigmoid(self.bias + sum(self.weights[f] for f in fs))) for s, e, fs in found]
        clean = (n - len(scored)) * np.log1p(-sigmoid(self.bias)) + sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in scored)
        return float(-np.expm1(clean)), [x for x in scored if x[2] >= OFFENDING]


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-z)))


def fit(bags: list[tuple[int, int, list[list[int]]]], first: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> tuple[float, np.ndarray]:
    """bags: ``(label, sentences without weighed words, the others' words)``; returns bias and weights.

    Full-batch AdaGrad on the likelihood of the noisy-or, from the words' log lifts, ``first``.
    """
    n_words = len(first)
    label = np.array([y for y, _, _ in bags], np.float64)
    plain = np.array([n for _, n, _ in bags], np.float64)
    doc = np.array([d for d, (_, _, s) in enumerate(bags) for _ in s], np.int64)
    sizes = [len(x) for _, _, s in bags for x in s]
    word = np.array([w for _, _, s in bags for x in s for w in x], np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    w, seen = np.append(first, START), np.full(n_words + 1, 0.1)
    for _ in range(rounds):
        z = np.clip(w[n_words] + np.bincount(sentence, w[word], len(sizes)), -30, 30)
        p, rest = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[n_words]))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + plain * np.log1p(-rest)
        whole = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(label > 0, (1 - whole) / whole, -1.0)
        by_sentence = pull[doc] * p
        slope = np.bincount(word, by_sentence[sentence], n_words + 1) - decay * w
        slope[n_words] = by_sentence.sum() + (pull * plain).sum() * rest
        seen += slope**2
        w += rate * slope / np.sqrt(seen)
    return float(w[n_words]), w[:n_words]


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` documents with labels for which ``training``, a condition on ``doc_id``, holds.

    An id that stands several times, in ``docs`` or ``labels``, counts once. Texts of any length count as a whole. Without toxic documents, or without others, the model weighs no word and its bias gives the labels' smoothed share.
    """
    small_batches(docs.sparkSession)
    known = staged(labelled(docs, labels, label_col, training, sample=sample).select("text", (F.col("label") > 0).alias("toxic")), "labelled")
    toxic, others = known.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not toxic or not others:
        share = (toxic + 0.5) / (toxic + others + 1) if toxic else 1e-3
        return Model(float(np.log(share / (1 - share))), {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (Counter(), Counter())
        for b in batches:
            for text, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sides[bad].update(features(text))
        good, bad = sides
        kept = sorted(bad)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([bad[w] for w in kept]), pa.array(np.zeros(len(kept), np.int64))], names=["word", "bad", "good"])
        kept = sorted(good)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array(np.zeros(len(kept), np.int64)), pa.array([good[w] for w in kept])], names=["word", "bad", "good"])

    counted = known.mapInArrow(count, "word binary, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = F.log((F.col("bad") + 1.0) / (toxic + 2.0)) - F.log((F.col("good") + 1.0) / (others + 2.0))
    chosen = counted.where(F.col("bad") >= LEAST_DOCS).where(lift > LEAST_LIFT)
    top = chosen.orderBy("word").select("word", lift.alias("lift")).collect()
    vocabulary = [bytes(r[0]) for r in top]
    number = {w: i for i, w in enumerate(vocabulary)}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(number)
        for b in batches:
            plain, held = [], []
            for text in b.column(0).to_pylist():
                n, found = known.sentences(text)
                held.append([[number[f] for f in fs] for _, _, fs in found])
                plain.append(n - len(found))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(plain, pa.int64()), pa.array(held, pa.list_(pa.list_(pa.int32())))], names=["toxic", "plain", "held"])

    bags = known.mapInArrow(bag, "toxic boolean, plain long, held array<array<int>>").toArrow().to_pylist()
    rows = sorted((int(x["toxic"]), x["plain"], x["held"]) for x in bags)
    bias, weights = fit(rows, np.array([r[1] for r in top]))
    return Model(bias, {w: float(x) for w, x in zip(vocabulary, weights, strict=True)})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, offending)`` for every row; ``offending`` has start, end (code points) and score of the sentences at fault.

    A text without sentences, null or empty, scores zero; a text of any length is scored as a whole. Repeated rows get equal scores. An empty
    table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.weights)
        for b in batches:
            found = [model.score(text or "", known) for text in b.column(1).to_pylist()]
            at = [[{"start": s, "end": e, "score": p} for s, e, p in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.float64()), pa.array(at, spans)], names=["id", "score", "offending"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, score double, offending array<struct<start:long,end:long,score:double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more; a null text is kept."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.weights)
        for b in batches:
            yield b.filter(pa.array([model.score(text or "", known)[0] < threshold for text in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
