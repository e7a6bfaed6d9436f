"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 1).

One pass over the texts gives each document a few statistics. Trees are fitted on the driver to a bounded
sample of labelled documents: features are cut into at most BINS bins, gradients are summed by bin, and
each level splits every node at once. The forest is flattened into arrays of complete binary trees, and
all rows of a batch walk down all trees by array indexing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import binaries, small_batches
from plumbline.llm.supervise import SAMPLE, labelled

TREES, DEPTH, RATE, BINS, L2, LEAST = 80, 4, 0.15, 64, 1.0, 5.0

STATISTICS = (
    "log_words", "mean_word", "distinct_share", "top_word_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "bang_share", "pipe_share", "stop_rate", "comma_rate", "log_line", "distinct_lines", "wide_share", "long_words",
)
MARKS = np.frombuffer(b"#$%&*^~<>=_/\\{}[]@", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The document's statistics, in the order of STATISTICS; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum() / 2)
    return [
        np.log1p(n),
        size / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        seen[65:91].sum() / letters,
        seen[48:58].sum() / size,
        seen[MARKS].sum() / size,
        seen[33] / n,
        seen[124] / n,
        (seen[46] + seen[63]) / n,
        seen[44] / n,
        np.log1p(n / len(lines)),
        len(set(lines)) / len(lines),
        seen[128:].sum() / size,
        sum(len(w) > 24 for w in counts) / len(counts),
    ]


@dataclass
class Forest:
    """Complete trees of one depth: node k's children are 2k+1 and 2k+2; leaves follow the inner nodes."""

    start: float
    features: np.ndarray  # tree x inner node
    cuts: np.ndarray  # tree x inner node; a row goes right if its value is larger
    values: np.ndarray  # tree x leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, c, v in zip(self.features, self.cuts, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boosting of the logistic loss. Without both labels the forest is empty and scores their smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if len(set(y.tolist())) < 2:
        return Forest(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin b: edge b-1 < value <= edge b
    total = np.full(len(y), start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.full(nodes, 1e-9)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                slot = local * bins + binned[:, f]
                gs = np.bincount(slot, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(slot, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = 0
                gain = gain[:, : len(e)]
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + nodes][better] = f
                cut[first : first + nodes][better] = e[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        total += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(start, np.array(features), np.array(cuts), np.array(values))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in binaries(column)], np.float64).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on about ``sample`` documents with labels for which ``training``, a condition on ``doc_id``, holds.

    An id that stands several times, in ``docs`` or ``labels``, counts once. Texts of any length count as a whole. Without both
    labels the forest scores their smoothed share; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array(list(_matrix(b.column(0))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1)], names=["x", "y"])

    found = labelled(docs, labels, label_col, training, sample=sample).select("text", "label").mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    y = (found.column("y").to_numpy() > 0).astype(np.float64)
    order = np.lexsort((y, *x.T))  # rows come in any order; sums do not depend on it now
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have statistics of zero and are scored like others, texts of any length as a whole. Repeated rows get equal scores.
    An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(_matrix(b.column(1))))], names=["id", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, score double")
