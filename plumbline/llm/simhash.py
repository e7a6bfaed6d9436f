"""SimHash near-duplicates by a Gray-order hierarchical index (operator 7).

One pass over the texts gives 64-bit fingerprints; equal fingerprints are one node from then on. A pair within the
radius agrees on a whole block out of ``radius + 1``; so fingerprints are dealt out once by each block, values of a
block together, and every bucket that this makes is searched through an index of its own. There, fingerprints are sorted
by the Gray rank of the block and then of the rest; neighbours are factored into nodes that keep the bits
that all below share; and a search adds up differences from node to node and leaves a whole group as soon as they
exceed the radius, touch the block, or the group hangs together with the one who asks already. Each bucket
yields a forest of links, never all pairs; the forests are merged into connected components by distributed
contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.graph import components
from plumbline.llm.shared import binaries, joined, small_batches, staged

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints that a task searches at a time. A block's value that more share is dealt out again by the blocks of the
#: other bits; what is larger even then is cut into chunks and each pair of chunks is searched, so that no link is lost.
CHUNK = 8192
#: Children of a node of the index, and members of its lowest nodes.
FAN = 16
#: Fingerprints that walk down the index together.
BATCH = 128
#: Shingles hashed at a time.
STEP = 1 << 16
#: Values that are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    total = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, STEP):
        part = words[at : at + STEP + size - 1]
        n = len(part) - size + 1
        shingles = part if size == 1 else map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(n, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > total).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: one row per document, the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter(map(fingerprint, binaries(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind.simpleString()}, fp long")


# --- the index -----------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence: neighbours in it differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under nodes of FAN children that keep the bits shared below them.

    exact: bits in which what is found must agree with the one who asks; the order goes by them first.
    """

    def __init__(self, codes: np.ndarray, exact: int = 0):
        self.exact = np.uint64(exact)
        self.order = np.lexsort((gray_rank(codes), gray_rank(codes & self.exact)))
        self.codes = codes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # lowest first: (shared bits' mask, pattern)
        first, mask = self.codes, np.full(len(codes), ~np.uint64(0))
        while len(first) > FAN:
            starts = np.arange(0, len(first), FAN)
            head = first[starts]
            differ = np.bitwise_or.reduceat(first ^ np.repeat(head, FAN)[: len(first)], starts)
            mask = ~differ & np.bitwise_and.reduceat(mask, starts)
            first = head
            self.levels.append((mask, first & mask))

    def spans(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and largest label below each node, level by level, the fingerprints' own first."""
        found = [(label, label)]
        for mask, _ in self.levels:
            starts = np.arange(0, len(found[-1][0]), FAN)
            found.append((np.minimum.reduceat(found[-1][0], starts), np.maximum.reduceat(found[-1][1], starts)))
        return found

    def search(self, asking: np.ndarray, radius: int, spans: list[tuple[np.ndarray, np.ndarray]], later: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places ``(who asks, who is found)`` of other labels within the radius; ``later``: found after who asks only.

        A child's shared bits include its parent's, so differences only add up on the way down.
        """
        top = len(self.levels)
        width = len(spans[top][0])
        who, at = np.repeat(asking, width), np.tile(np.arange(width), len(asking))
        label = spans[0][0]
        for level in range(top, -1, -1):
            low, high = spans[level]
            mine = label[who]
            stay = (low[at] != mine) | (high[at] != mine)
            if later:
                stay &= (at + 1) * FAN**level > who + 1
            who, at = who[stay], at[stay]
            mask, pattern = self.levels[level - 1] if level else (None, self.codes)
            differ = self.codes[who] ^ pattern[at]
            if level:
                differ &= mask[at]
            stay = (np.bitwise_count(differ) <= radius) & ((differ & self.exact) == 0)
            who, at = who[stay], at[stay]
            if level:
                who, at = np.repeat(who, FAN), (at[:, None] * FAN + np.arange(FAN)).ravel()
                real = at < len(spans[level - 1][0])
                who, at = who[real], at[real]
        return who, at


def link_forest(codes: np.ndarray, radius: int = RADIUS, exact: int = 0) -> np.ndarray:
    """For each distinct code one that links of at most ``radius`` bits, none of them in ``exact``, reach: the same for all it reaches."""
    index = GrayIndex(codes, exact)
    label = np.arange(len(codes))
    for start in range(0, len(codes), BATCH):
        who, at = index.search(np.arange(start, min(start + BATCH, len(codes))), radius, index.spans(label), later=True)
        while True:
            a, b = label[who], label[at]
            if (a == b).all():
                break
            parent = np.arange(len(codes))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
    out = np.empty(len(codes), np.uint64)
    out[index.order] = index.codes[label]
    return out


def blocks(bits: list[int], count: int) -> list[int]:
    """``count`` masks that share out the bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(bits, count)]


def masks(radius: int) -> dict[tuple[int, int], int]:
    """The bits of block b by (b, -1), and of b and the s-th block of the others by (b, s)."""
    found = {}
    for b, mask in enumerate(blocks(list(range(64)), radius + 1)):
        found[b, -1] = mask
        for s, more in enumerate(blocks([x for x in range(64) if not mask >> x & 1], radius + 1)):
            found[b, s] = mask | more
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(codes: DataFrame, radius: int, chunk: int) -> DataFrame:
    """``(block, sub, bucket, a, c, fp)``: what is searched together; sub is -1 unless a block's value was dealt out again."""
    of = masks(radius)
    under = codes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(of[b, -1]))) for b in range(radius + 1)])).alias("block", "value"))
    buckets = max(1, 2 * codes.count() // chunk)
    hot = staged(under.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > chunk // 2).select("block", "value"), "hot")
    few = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    nothing = F.lit(0)
    cold = under.join(few, ["block", "value"], "left_anti").select("block", F.lit(-1).alias("sub"), F.pmod(F.xxhash64("value"), F.lit(buckets)).alias("bucket"), nothing.alias("a"), nothing.alias("c"), "fp")
    if hot.isEmpty():
        return cold
    of_block = [F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(of[b, s]))) for s in range(radius + 1)]) for b in range(radius + 1)]
    again = under.join(few, ["block", "value"], "left_semi").select("fp", "block", F.posexplode(F.element_at(F.array(*of_block), F.col("block") + 1)).alias("sub", "bucket"))
    sizes = again.groupBy("block", "sub", "bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cuts"))
    cut = (
        again.join(sizes, ["block", "sub", "bucket"])
        .withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    )
    return cold.unionByName(cut.select("block", "sub", "bucket", F.least("cut", "other").alias("a"), F.greatest("cut", "other").alias("c"), "fp"))


def links(codes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``(u, v)``: a forest of links between the distinct values of column ``fp``."""
    key = ["block", "sub", "bucket", "a", "c"]
    of = masks(radius)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: np.ndarray, exact: int) -> pa.RecordBatch:
            label = link_forest(group, radius, exact)
            moved = label != group
            return pa.RecordBatch.from_arrays([pa.array(x[moved].view(np.int64)) for x in (group, label)], names=["u", "v"])

        held: list[np.ndarray] = []  # the last group may go on in the next batch
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)
            fps = b.column(5).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for s, e in zip(starts, np.r_[starts[1:], len(fps)], strict=True):
                if last is not None and not np.array_equal(keys[s], last):
                    yield out(np.concatenate(held), of[last[0], last[1]])
                    held = []
                held.append(fps[s:e])
                last = keys[s]
        if held:
            yield out(np.concatenate(held), of[last[0], last[1]])

    dealt = _buckets(codes, radius, chunk).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(forest, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` with one row per row of ``docs``.

    Fingerprints of at most ``radius`` differing bits are linked; ``component_id`` is the smallest id
    that links reach, the document's own included. Null and empty texts have fingerprint zero and are
    linked like any other; a text of any length counts as a whole. A null id is no candidate for the smallest; a component
    of such ids alone has a null ``component_id``. Repeated rows stay. An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    fps = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = staged(fps.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    edges = staged(links(nodes.select(F.col("node").alias("fp")), radius), "links")
    of_node = least_reached(nodes, edges)
    return joined(fps.withColumnRenamed("fp", "node"), of_node, "node", nodes).select("id", F.col("node").alias("fp"), F.col("least").alias("component_id"))


def least_reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, least)``: for each row of ``nodes(node, least, n)`` the smallest ``least`` that ``edges(u, v)`` reach."""
    linked = staged(components(edges).join(nodes, "node"), "linked")
    smallest = staged(linked.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n")), "smallest")
    of_linked = joined(linked.select("node", "root"), smallest.select("root", "least"), "root", smallest).select("node", "least")
    return nodes.select("node", "least").join(linked.select("node"), "node", "left_anti").unionByName(of_linked)
