"""Language-model scoring by a weighted backoff automaton (operator 4).

States are the root, the words and the pairs of words that training texts hold. The root has an arc for every word; a
word state one for each word that follows it somewhere, a pair state likewise. An arc's probability is
smoothed by the next shorter state's, ``(count + weight * shorter) / (count of the state + weight)``, and a state's
failure arc carries what is left for all other words, ``weight / (count of the state + weight)``; so the
probabilities out of a state sum to one. A text is walked from left to right: each word takes the arc of the longest
state that has one, after the failure arcs of longer ones.

All words, pairs and triples of the corpus are counted (``blocks.py``), none is cut off by a threshold, and nothing of
that is sent to every task. Triples are asked for
only where both of their pairs stand twice in all texts: any other triple stands where its rare pair does, and nowhere
else. Each block then walks its texts through that part of the automaton that they can reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import ANSWERED, ASKED, ASKED_SCHEMA, BLOCK_BYTES, answer, answers, asked, column_of, counted, in_blocks, table, texts_of
from plumbline.llm.shared import fold, shuffles_removed, small_batches, staged

#: The token after a text's last word. No word can hold a newline.
END = b"\n"
#: Weights of the shorter state in an arc of a word state and of a pair state.
WORD_WEIGHT, PAIR_WEIGHT = 400.0, 4.0
SEED = 42
#: Tokens that are walked at once.
STRETCH = 1 << 16
#: Ranges of a block's question that leave a task together.
BATCH_RANGES = 32


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words and the end token."""
    found = text.lower().split()
    found.append(END)
    return found


END_HASH = np.uint64(xxhash.xxh64_intdigest(END, SEED))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes, order told apart. Of n n-grams about n * n / 2 ** 65 pairs share one."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Tokens:
    """The tokens of a block's texts: hashes of words and pairs, and where texts start."""

    def __init__(self, texts: Iterator[bytes], learn: np.ndarray):
        number: dict[bytes, int] = {}
        ids, sizes = [], []
        for text in texts:
            found = words(text)
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
            sizes.append(len(found))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number, repeat(SEED)), np.uint64, len(number))
        self.word = hashes[np.concatenate(ids)] if ids else np.empty(0, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(learn, self.sizes)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.first] = END_HASH
        self.pair = paired(before, self.word)
        self.later = np.ones(len(self.word), bool)  # tokens that have a pair before them
        self.later[self.first] = False

    def triples(self, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens whose triple is to be counted, and those triples. again: whether a token's pair stands twice."""
        at = np.flatnonzero(self.later[1:] & again[1:] & again[:-1]) + 1
        return at, paired(self.pair[at - 1], self.word[at])


def _read(docs: pa.Table) -> Tokens:
    return Tokens(texts_of(docs), column_of(docs, "training").to_numpy(zero_copy_only=False))


def places(values: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct values in order."""
    return np.unique(values, return_inverse=True)[1].astype(np.int32)


def counts(tokens: Tokens, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in training texts of each token's word, of the pair and the triple that it ends."""
    learnt, again = answers(found, 2)
    place = places(tokens.pair)
    c2, again = learnt[place], again[place]
    del learnt, place
    c3 = (tokens.learn & tokens.later).astype(np.int64)  # a triple of a pair that stands once stands once
    at, values = tokens.triples(again)
    c3[at] = answers(found, 3)[0][places(values)]
    del at, values, again
    return answers(found, 1)[0][places(tokens.word)], c2, c3


def walk(tokens: Tokens, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, total: int, distinct: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every token at the root, and along the automaton, left to right.

    c1, c2, c3: counts of each token's word, of the pair and the triple that it ends; texts: the number of training
    texts, the count of the state in which a text starts. No step depends on more than the two tokens before it, so all of
    a stretch are taken at once.
    """
    n = len(c1)
    base, along = np.empty(n), np.empty(n)
    starts = np.zeros(n, bool)
    starts[tokens.first] = True
    for i in range(0, n, STRETCH):
        here, before = slice(i, min(i + STRETCH, n)), slice(max(i - 1, 0), min(i + STRETCH, n) - 1)
        root = (c1[here] + 0.5) / (total + 0.5 * (distinct + 1))
        of_word, of_pair = np.zeros(len(root)), np.zeros(len(root))  # counts of the states before each token
        of_word[i == 0 :], of_pair[i == 0 :] = c1[before], c2[before]
        of_word[starts[here]], of_pair[starts[here]] = texts, 0
        base[here] = np.log10(root)
        arc = (c2[here] + WORD_WEIGHT * root) / (of_word + WORD_WEIGHT)
        out = np.where(c2[here] > 0, np.log10(arc), np.log10(WORD_WEIGHT / (of_word + WORD_WEIGHT)) + base[here])
        arc = (c3[here] + PAIR_WEIGHT * 10**out) / (of_pair + PAIR_WEIGHT)
        along[here] = np.where(c3[here] > 0, np.log10(arc), np.log10(PAIR_WEIGHT / (of_pair + PAIR_WEIGHT)) + out)
    return base, along


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", block_range: tuple[int, int] = BLOCK_BYTES) -> DataFrame:
    """Score every whole text under a model of the texts for which the condition ``training`` holds.

    Returns ``(id, training, n_tokens, n_known, train_tokens, base_score, score)``: tokens with the end
    token, those that training texts hold, tokens of all training texts, log10 probability by smoothed
    word counts alone, and that of the automaton. One row per row of ``docs``. A null or empty text is its
    end token alone; a text of any length is one row of one block. A null ``training`` is false. Without training texts
    every word has probability one by the formula. Repeated rows count and are scored as often as they stand. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    blocks, parts = in_blocks(narrow, block_range, block_range[1])  # a block is a row, so no task needs another's

    def ask_of(docs: pa.Table) -> Iterator[pa.RecordBatch]:
        tokens, block = _read(docs), docs.column("block")[0].as_py()
        for length, values in ((1, tokens.word), (2, tokens.pair)):
            keys, _, learnt, everywhere = counted(values, tokens.learn)
            for rows in batched(asked(block, length, keys, learnt, everywhere, parts), BATCH_RANGES):
                yield from table(list(rows), ASKED_SCHEMA).to_batches()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from ask_of(pa.Table.from_batches([b.slice(i, 1)]))

    def ask_triples(docs: pa.Table, found: pa.Table) -> pa.Table:
        tokens, block = _read(docs), docs.column("block")[0].as_py()
        at, values = tokens.triples(answers(found, 2)[1][places(tokens.pair)])
        keys, _, learnt, everywhere = counted(values, tokens.learn[at])
        return table(list(asked(block, 3, keys, learnt, everywhere, parts)), ASKED_SCHEMA)

    with shuffles_removed(spark):
        answered = staged(blocks.mapInArrow(ask, ASKED).groupBy("part").applyInArrow(answer, ANSWERED), "counts", "zstd")
    of_blocks = answered.where("block >= 0")
    total, distinct = answered.where("block < 0 and length = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    texts = blocks.agg(F.coalesce(F.sum(F.size(F.filter("training", lambda x: x))), F.lit(0))).first()[0]
    triples = blocks.groupBy("block").cogroup(of_blocks.where("length = 2").groupBy("block")).applyInArrow(ask_triples, ASKED)
    with shuffles_removed(spark):
        of_triples = staged(triples.groupBy("part").applyInArrow(answer, ANSWERED), "triples", "zstd").where("block >= 0")

    def scored(docs: pa.Table, found: pa.Table) -> pa.Table:
        tokens = _read(docs)
        c1, c2, c3 = counts(tokens, found)
        base, along = walk(tokens, c1, c2, c3, total, distinct, texts)
        n, first = len(tokens.sizes), tokens.first
        values = [column_of(docs, "id"), column_of(docs, "training"), tokens.sizes, np.add.reduceat((c1 > 0).astype(np.int64), first), np.full(n, total, np.int64), np.add.reduceat(base, first), np.add.reduceat(along, first)]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], names=names)

    names = ["id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    both = blocks.groupBy("block").cogroup(of_blocks.unionByName(of_triples).groupBy("block"))
    return both.applyInArrow(scored, f"id {key}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def documents_scores(docs: DataFrame) -> DataFrame:
    found = score(docs, fold("doc_id", 5) != 1)
    return found.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
