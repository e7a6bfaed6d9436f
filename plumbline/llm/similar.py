"""Near-duplicates by exact similarity of five-word shingles, the stage of the pipeline (operator 7 has its own, thin rule).

Two sets whose Jaccard similarity is at least SIMILAR share one of their first ``n // 5 + 1`` shingles in any order that holds
for all sets. Shingles of one set alone come first in that order (all shingles of the corpus are counted for it,
``blocks.py``), common ones last, so few sets meet in a shingle. Sets that meet are
candidates if their sizes and 128-bit SimHashes are near enough, which the Gray-order index of operator 7 finds out
over the SimHashes' first half. At first each set is compared only with its nearest candidate and with the one that most
others are near to, so that a group of copies costs two comparisons a member and not one a pair; then all candidates that
this left in different components, and whose SimHashes of 2048 bits are near. All comparisons are of whole sets.

The index alone cannot deal sets out: SimHashes of sets 0.8 alike differ in about 10 bits of 64, up to 20, and
with 21 blocks of three bits each set would meet most others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import BLOCK_BYTES, TWICE, TWICE_ASKED, TWICE_ASKED_SCHEMA, answer_twice, asked_twice, column_of, in_blocks, table, texts_of, twice_of
from plumbline.llm.graph import components
from plumbline.llm.shared import binaries, joined, small_batches, staged, trimmed
from plumbline.llm.simhash import BATCH, CHUNK, SEED, STEP, GrayIndex, least_reached

#: Words of a shingle; a text of fewer words is one shingle.
SHINGLE = 5
#: Jaccard similarity of near-duplicates, as a ratio; ``prefix`` needs the 5.
SIMILAR = (4, 5)
#: Differing bits of 128 up to which candidates are compared. Sets of similarity 0.8 differ in about 19, sets of
#: four and five shingles in about 24, with a deviation of 4.4; of the pairs 0.8 alike in 50,000 documents none differed in more than 31.
RADIUS = 38
#: Differing bits of the first 64 up to which the index finds candidates: 4.5 deviations beyond what 0.8 makes.
HALF = 26
#: Documents among which common shingles are counted, and the share from which one is common. Both change the
#: order of shingles only, never a result; so does BITS, the leading bits of shingles that are counted for it.
SAMPLE, COMMON, BITS = 4096, 0.002, 40
#: Differing bits of 128 up to which sets are neighbours in the choice of the one that most are near to.
TIGHT = 24
#: Words of 64 bits of the wide SimHash that candidates of different components must be near in.
WIDE = 32
#: Smallest of a set's first shingles by which a pair is told to have met in a smaller one already; and what stands for none.
FIRSTS, NONE = 16, 2**63 - 1
#: Rows that a task searches at a time, and pairs whose wide SimHashes are compared at a time.
ROWS, PAIRS = 1 << 16, 1 << 14
#: Ranges of a block's question that leave a task together.
BATCH_RANGES = 32
#: Ids that are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, max(1, len(words) - SHINGLE + 1)))


def key(found: np.ndarray) -> int:
    """The same number for equal sets; zero for the empty one."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def prefix(found: np.ndarray, shared: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Those of the set's first shingles that other sets may have; ``shared`` tells which may."""
    rest, room = found[shared], prefix_size(len(found)) - int((~shared).sum())
    rare = ~np.isin(rest, common, assume_unique=True) if len(common) else np.ones(len(rest), bool)
    return np.concatenate([rest[rare], rest[~rare]])[: max(room, 0)]


def prefix_size(n):
    return n // SIMILAR[1] + 1


def leading(found: np.ndarray) -> np.ndarray:
    return found >> np.uint64(64 - BITS) << np.uint64(64 - BITS)


def sketch(found: np.ndarray) -> np.ndarray:
    """128-bit SimHash of the set as two numbers."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(found), STEP):
        h = found[at : at + STEP]
        more = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        more = (more ^ (more >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        more ^= more >> np.uint64(32)
        ones += np.unpackbits(np.stack([h, more], 1).view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(found)).view(np.uint64)


def wide(found: np.ndarray) -> np.ndarray:
    """SimHash of the set in WIDE words of 64 bits."""
    out = np.empty(WIDE, np.uint64)
    for i in range(WIDE):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(found), STEP):
            h = (found[at : at + STEP] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * ones > len(found)).view(np.uint64)[0]
    return out


def wide_radius(n: np.ndarray) -> np.ndarray:
    """Differing bits of 2048 up to which sets of at least n shingles may be 0.8 alike: they differ in about 308, with a deviation of 16; sets of few shingles in up to 385, with one of 19."""
    return 385 + 400 // np.maximum(n, 1)


def _row(id_col: str, text_col: str) -> Column:
    """The same number for rows of equal id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _row(id_col, text_col).alias("row"))


def _sets(narrow: DataFrame) -> DataFrame:
    """``(key, hashes)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for b in batches:
            found = [shingles(x) for x in binaries(b.column(0))]
            keys = np.array([key(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["key", "hashes"])

    return narrow.select("text").mapInArrow(run, "key long, hashes array<long>")


def _common(narrow: DataFrame) -> np.ndarray:
    """Shingles that a share of COMMON of the texts hold, by a sample."""
    rows = narrow.count()
    few = narrow.sample(min(1.0, SAMPLE / max(rows, 1)), seed=SEED) if rows > SAMPLE else narrow
    least = max(2, int(COMMON * min(rows, SAMPLE)))
    found = _sets(few).select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= least)
    return np.sort(np.array([r[0] for r in found.select("h").collect()], np.int64).view(np.uint64))


def _sketches(narrow: DataFrame, common: np.ndarray) -> DataFrame:
    """``(id, row, key, n, low, high, prefix)`` of every row: the set's key, size, sketch and first shingles."""
    kind = narrow.schema["id"].dataType.simpleString()
    # a block is a row, so no task needs another's to ask
    blocks, parts = in_blocks(narrow.select("id", "row", F.coalesce("text", F.lit("")).alias("text")), chunk_bytes=BLOCK_BYTES[1])

    def read(docs: pa.Table) -> tuple[list[np.ndarray], list[int], np.ndarray]:
        trimmed()
        found = [shingles(x) for x in texts_of(docs)]
        keys = [key(x) for x in found]
        return found, keys, leading(np.concatenate(list(dict(zip(keys, found, strict=True)).values())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs = pa.Table.from_batches([b.slice(i, 1)])
                for rows in batched(asked_twice(docs.column("block")[0].as_py(), read(docs)[2], parts), BATCH_RANGES):
                    yield from table(list(rows), TWICE_ASKED_SCHEMA).to_batches()

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        found, keys, values = read(docs)
        asked_for = np.unique(values)
        del values
        again = twice_of(replies)
        firsts = [prefix(x, again[np.searchsorted(asked_for, leading(x))] if len(x) else np.empty(0, bool), common) for x in found]
        del asked_for, again
        bits = np.array([sketch(x) for x in found], np.uint64).reshape(-1, 2).view(np.int64)
        columns = [column_of(docs, "id"), column_of(docs, "row"), np.array(keys, np.uint64).view(np.int64), np.array([len(x) for x in found], np.int64), bits[:, 0].copy(), bits[:, 1].copy()]
        columns.append(pa.array([x.view(np.int64) for x in firsts], pa.list_(pa.int64())))
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["id", "row", "key", "n", "low", "high", "prefix"])

    replies = staged(blocks.mapInArrow(ask, TWICE_ASKED).groupBy("part").applyInArrow(answer_twice, TWICE), "shared")
    both = blocks.groupBy("block").cogroup(replies.groupBy("block"))
    return both.applyInArrow(run, f"id {kind}, row long, key long, n long, low long, high long, prefix array<long>")


def _members(nodes: DataFrame, chunk: int) -> DataFrame:
    """``(h, a, b, key, n, low, high)``: the sets of each shingle that several hold, large groups in pairs of chunks."""
    under = nodes.select("key", F.explode("prefix").alias("h"))
    sizes = under.groupBy("h").agg(F.count("*").alias("of")).where("of > 1")
    return (
        under.join(sizes, "h").join(nodes.select("key", "n", "low", "high"), "key")
        .withColumn("cuts", F.ceil(F.col("of") / chunk).cast("int"))
        .withColumn("cut", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("h", F.least("cut", "other").alias("a"), F.greatest("cut", "other").alias("b"), "key", "n", "low", "high")
    )


def _near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether pairs of rows are near in their wide SimHashes, and have not met in the group of a smaller shingle."""
    w = slice(8, 8 + WIDE)
    far = np.bitwise_count((p[:, w] ^ q[:, w]).view(np.uint64)).sum(1, dtype=np.int64)
    a, b = p[:, 8 + WIDE :], q[:, 8 + WIDE :]
    smaller = (a < p[:, :1]) & (a[:, :, None] == b[:, None, :]).any(2)
    return (far <= wide_radius(np.minimum(p[:, 4], q[:, 4]))) & ~smaller.any(1)


def _apart(rooted: DataFrame, narrow: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of the groups in which several components meet, with their sets' wide SimHashes and smallest first shingles."""
    group = ["h", "a", "b"]
    several = rooted.groupBy(*group).agg((F.min("root") != F.max("root")).alias("several")).where("several").select(*group)
    met = staged(rooted.join(several, group, "left_semi"), "apart")
    sets = _sets_of(met.select("key").distinct(), narrow, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wide(np.asarray(x, np.int64).view(np.uint64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["key", "wide"])

    few = F.slice(F.array_sort("prefix"), 1, FIRSTS)
    firsts = nodes.select("key", F.concat(few, F.array_repeat(F.lit(NONE), FIRSTS - F.size(few))).alias("firsts"))
    return met.join(sets.mapInArrow(run, "key long, wide binary"), "key").join(firsts, "key")


def _search(members: DataFrame, first: bool, radius: int) -> DataFrame:
    """Candidates ``(u, v, bits, degree)``.

    first: of each set in a group the nearest one, and the one that most are near to; else all of another root, u the
    larger key. bits: of 128 that differ; degree: how many are near to v.
    """
    num, den = SIMILAR
    columns = ["h", "a", "b", "key", "n", "low", "high", *([] if first else ["root", "wide", "firsts"])]
    names = ["u", "v", "bits", "degree"]

    def group(g: np.ndarray) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(g[:, 5].view(np.uint64))
        g = g[index.order]
        k, n, bits = g[:, 3], g[:, 4], g[:, 5:7].view(np.uint64)
        spans = index.spans(np.arange(len(g)) if first else np.unique(g[:, 7], return_inverse=True)[1])
        degree = np.zeros(len(g), np.int64)

        def near(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            u, v = index.search(np.arange(at, min(at + BATCH, len(g))), min(HALF, radius), spans)
            far = (np.bitwise_count(bits[u, 0] ^ bits[v, 0]) + np.bitwise_count(bits[u, 1] ^ bits[v, 1])).astype(np.int64)
            fits = (far <= radius) & (den * n[u] >= num * n[v]) & (den * n[v] >= num * n[u])
            if not first:
                fits &= k[v] < k[u]
            u, v, far = u[fits], v[fits], far[fits]
            if not first:
                fits = np.concatenate([_near(g[u[i : i + PAIRS]], g[v[i : i + PAIRS]]) for i in range(0, len(u), PAIRS)] or [np.empty(0, bool)])
                u, v, far = u[fits], v[fits], far[fits]
            return u, v, far

        if first:
            for at in range(0, len(g), BATCH):
                _, v, far = near(at)
                degree += np.bincount(v[far <= TIGHT], minlength=len(g))
        for at in range(0, len(g), BATCH):
            u, v, far = near(at)
            if first and len(u):
                by_bits, by_degree = np.lexsort((k[v], far, u)), np.lexsort((k[v], far, -degree[v], u))
                heads = [o[np.r_[True, u[o][1:] != u[o][:-1]]] for o in (by_bits, by_degree)]
                take = np.unique(np.concatenate(heads))
                u, v, far = u[take], v[take], far[take]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[u], k[v], far, degree[v])], names=names)

    def groups(g: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((g[1:, :3] != g[:-1, :3]).any(1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(g)]
        sizes = ends - starts
        two = starts[sizes == 2]
        p, q = g[two], g[two + 1]
        p, q = np.where((p[:, 3] < q[:, 3])[:, None], q, p), np.where((p[:, 3] < q[:, 3])[:, None], p, q)
        far = sum(np.bitwise_count((p[:, i] ^ q[:, i]).view(np.uint64)).astype(np.int64) for i in (5, 6))
        fits = (far <= radius) & (den * p[:, 4] >= num * q[:, 4]) & (den * q[:, 4] >= num * p[:, 4]) & (first or p[:, 7] != q[:, 7])
        p, q, far = p[fits], q[fits], far[fits]
        if not first:
            fits = _near(p, q)
            p, q, far = p[fits], q[fits], far[fits]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p[:, 3], q[:, 3], far, np.zeros(len(p), np.int64))], names=names)
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            if first or (g[s:e, 7] != g[s, 7]).any():
                yield from group(g[s:e])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        held: list[np.ndarray] = []  # the last group may go on in the next batch
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            numbers = np.stack([c.to_numpy().astype(np.int64) for c in b.columns[: 7 if first else 8]], 1)
            if not first:
                far = np.frombuffer(b"".join(b.column(8).to_pylist()), np.int64).reshape(-1, WIDE)
                numbers = np.hstack([numbers, far, b.column(9).flatten().to_numpy().reshape(-1, FIRSTS)])
            held.append(numbers)
            size += b.num_rows
            if size < ROWS:
                continue
            g = np.concatenate(held)
            cut = len(g) - int((g[:, :3] == g[-1, :3]).all(1)[::-1].argmin() or len(g))
            if cut:
                yield from groups(g[:cut])
            held, size = [g[cut:]], len(g) - cut if cut else 0
        if held:
            yield from groups(np.concatenate(held))

    dealt = members.select(columns).repartition("h", "a", "b").sortWithinPartitions("h", "a", "b")
    return dealt.mapInArrow(run, "u long, v long, bits long, degree long")


def _sets_of(keys: DataFrame, narrow: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(key, hashes)`` of the wanted keys, from one text each."""
    ids = staged(nodes.join(keys, "key", "left_semi").select(F.col("least.id").alias("wanted")).distinct(), "wanted")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return _sets(narrow.join(few, narrow["id"].eqNullSafe(few["wanted"]), "left_semi")).join(keys, "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, narrow: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(u, v)`` of the pairs whose whole sets are similar."""
    num, den = SIMILAR
    sets = staged(_sets_of(staged(pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct(), "keys"), narrow, nodes), "sets")
    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("hashes").alias("of_u")), "u").join(sets.select(F.col("key").alias("v"), F.col("hashes").alias("of_v")), "v")
    same = both.select("u", "v", F.size(F.array_intersect("of_u", "of_v")).alias("same"), (F.size("of_u") + F.size("of_v")).alias("both"))
    return same.where(den * F.col("same") >= num * (F.col("both") - F.col("same"))).select("u", "v")


def _found(docs: DataFrame, id_col: str, text_col: str, radius: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(id, row, key)``; ``(node, n)``, how many rows have a key; ``(node, least)``, the first ``(no id, id, row)`` that its links reach."""
    small_batches(docs.sparkSession)
    narrow = _narrow(docs, id_col, text_col)
    rows = staged(_sketches(narrow, _common(narrow)), "sketches")
    least = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "row")).alias("least"), F.count("*").alias("rows"))
    nodes = staged(rows.drop("id", "row").dropDuplicates(["key"]).join(least, "key"), "nodes")
    members = staged(_members(nodes, chunk), "members")
    found = _search(members, True, radius).groupBy("u").agg(F.min(F.struct("bits", "v")).alias("best"), F.max(F.struct("degree", F.negative("bits"), "v")).alias("middle"))
    both = found.select("u", F.explode(F.array("best.v", "middle.v")).alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = staged(_verified(staged(both.distinct(), "nearest"), narrow, nodes), "links")
    roots = components(edges)
    rooted = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    others = staged(_search(_apart(rooted, narrow, nodes), False, radius).select("u", "v").distinct(), "others")
    edges = staged(edges.unionByName(_verified(others, narrow, nodes)), "links")
    counted = nodes.select(F.col("key").alias("node"), "least", F.col("rows").alias("n"))
    return rows.select("id", "row", "key"), counted, least_reached(counted, edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``(id, component_id)`` with one row per row of ``docs``.

    Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked, chains
    included; ``component_id`` is the smallest id that links reach. Words are split at white space and
    lower-cased (A-Z only); texts count as a whole, however long. Null, empty and blank texts are alike. A null id is no
    candidate for the smallest. Repeated rows stay. An empty table gives an empty result; other columns are not read.
    """
    rows, nodes, least = _found(docs, id_col, text_col, radius, chunk)
    found = joined(rows.select("id", F.col("key").alias("node")), least, "node", nodes.select("node", "n"))
    return found.select("id", F.col("least.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, rows without an id last.

    Rows are told apart by id and text, so rows that share an id but not a component each stay. Of rows of
    one id in a component one stays; of rows equal in id and text any one.
    """
    rows, _, least = _found(docs, id_col, text_col, RADIUS, CHUNK)
    winners = staged(least.select(F.col("least.row").alias("row")).distinct(), "winners")
    several = staged(rows.join(winners, "row", "left_semi").groupBy("row").count().where("count > 1").select("row"), "several")
    name = "row"
    while name in docs.columns:
        name += "_"
    kept = docs.withColumn(name, _row(id_col, text_col)).join(winners.withColumnRenamed("row", name), name, "left_semi")
    if not several.isEmpty():
        again = several.withColumnRenamed("row", name)
        kept = kept.join(again, name, "left_anti").unionByName(kept.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.select(*docs.columns)
