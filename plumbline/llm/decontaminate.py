"""Benchmark decontamination by SimHash of item-sized windows (operator 10), in DataFrame functions only.

Each window as long as some item gets a SimHash. A multi-index of Hamming blocks finds the items near it: of BLOCKS
blocks of the bits, two fingerprints within RADIUS bits differ in at most ``RADIUS // BLOCKS`` in one; so each
item is entered, by length, block and value, under all values so near to its own, and a window is looked up under its own five
values. Nothing else pairs windows with items. The Hamming distance is checked next, and what remains is decided by
the exact similarity of weighted shingles.

Windows without a shingle that some item of their length may not miss are like no item, and get no fingerprint: a window
at least SIMILAR to an item misses few of its shingles, so it has one of any ``missable + 1`` of them, of which those of the
smallest hashes are looked for, whichever item they are of. That is what makes one pass over the words enough.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import staged

#: Words of a shingle; items of fewer words are one shingle.
SHINGLE = 5
#: Weighted Jaccard similarity, of shingles weighted by how often they stand, from which a window counts, as a ratio.
SIMILAR = (4, 5)
#: Differing bits up to which a window is compared exactly. Windows of similarity 0.8 differ in about 9.7 bits of 64, with a
#: deviation of 2.9, so that about one in 3,000 of those at the very threshold is beyond.
RADIUS = 19
#: Blocks of the bits. With five, an item has 1,890 entries, and a fingerprint picked at random meets one in five items of its length.
BLOCKS = 5
#: Shingles, or passages, that are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: The same for rows that carry an item's hashes.
BROADCAST_WIDE = 10_000
#: Shingles of a window that 16 bits count.
COUNTED = 65_535


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(ws: Column, size: int) -> Column:
    """Hashes of all shingles of ``size`` words, in order."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))
    return F.when(F.size(ws) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def shared(a: Column, b: Column) -> Column:
    """How many hashes two arrays have in common, repeats counted: one walk over both, sorted together."""
    tag = lambda hashes, mine: F.transform(hashes, lambda h: F.struct(h.alias("h"), F.lit(mine).alias("mine")))
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("open"), F.lit(0).alias("same"))

    def step(acc: Column, x: Column) -> Column:  # a's come after b's of the same hash: each closes one
        left = F.when(acc["h"] == x["h"], acc["open"]).otherwise(0)
        met = x["mine"] & (left > 0)
        return F.struct(
            x["h"].alias("h"),
            F.when(met, left - 1).when(x["mine"], left).otherwise(left + 1).alias("open"),
            (acc["same"] + met.cast("int")).alias("same"),
        )

    return F.aggregate(F.array_sort(F.concat(tag(a, True), tag(b, False))), start, step)["same"]


def _lane(hashes: Column, j: int, width: int) -> Column:
    """Bits j, j + width, ... of all hashes, counted side by side in one number."""
    ones = F.lit(sum(1 << at for at in range(0, 64, width)))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(ones))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash: a bit is set if more than half of the hashes have it."""
    return F.when(F.size(hashes) <= COUNTED, _simhash(hashes, 16)).otherwise(_simhash(hashes, 32))


def _simhash(hashes: Column, width: int) -> Column:
    """Bits are counted ``64 // width`` at a time, in counters of ``width`` bits side by side."""
    n = F.size(hashes).cast("long")
    lanes = F.array(*[_lane(hashes, j, width) for j in range(width)])
    most = F.lit((1 << width) - 1).cast("long")

    def bits(lane: Column, j: Column) -> Column:
        full = [F.when(2 * F.shiftrightunsigned(lane, width * k).bitwiseAND(most) > n, F.lit(1 << (width * k)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(64 // width)]
        return F.call_function("shiftleft", reduce(lambda a, b: a.bitwiseOR(b), full), j)

    return F.aggregate(F.transform(lanes, bits), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def widths() -> list[int]:
    return [64 // BLOCKS + (b < 64 % BLOCKS) for b in range(BLOCKS)]


def values(fp: Column) -> Column:
    """The fingerprint's blocks, each with its number in front."""
    parts, at = [], 0
    for b, width in enumerate(widths()):
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(b << 32)))
        at += width
    return F.array(*parts)


def _change(value: Column):
    return lambda mask: value.bitwiseXOR(mask)


def entries(fp: Column, radius: int) -> Column:
    """All values of all blocks, each with its number in front, that two fingerprints within the radius have one of: at most ``radius // BLOCKS`` bits of a block changed."""
    changed = []
    for b, width in enumerate(widths()):
        masks = [sum(1 << x for x in bits) for k in range(radius // BLOCKS + 1) for bits in combinations(range(width), k)]
        own = F.get(values(fp), b)
        changed.append(F.transform(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"), _change(own)))
    return F.concat(*changed)


def _items(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct items of one shingle size: number of words, hashes, and the least of them that a similar window has one of."""
    num, den = SIMILAR
    cut = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("ws"))
    cut = cut.where(F.size("ws") >= SHINGLE if size == SHINGLE else F.size("ws") == size)
    cut = cut.select("item_id", F.size("ws").alias("n"), shingles(F.col("ws"), size).alias("hashes")).distinct()
    keep = F.floor(F.size("hashes") * (den - num) / den).cast("int") + 1
    return cut.select("*", F.slice(F.array_sort(F.array_distinct("hashes")), 1, keep).alias("top"))


def _few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Sent to every task while it is known to be small."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _windows(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """``(id, n, start, window)``: the hashes of each window, as long as some item, that has a shingle an item of that length may not miss.

    docs: ``(id, row, text)``; equal rows give their windows once.
    """
    wanted = _few(items.select("n", F.explode("top").alias("h")).distinct())
    cut = docs.select("id", "row", words(F.col("text")).alias("ws")).where(F.size("ws") >= size)
    places = cut.select("id", "row", F.posexplode(shingles(F.col("ws"), size)).alias("pos", "h")).join(wanted, "h")
    hits = staged(places.groupBy("id", "row", "n").agg(F.array_sort(F.collect_set("pos")).alias("found")), "hits")
    holding = docs.withColumnsRenamed({"id": "of", "row": "key"}).join(_few(hits.select("id", "row").distinct()), F.col("key").eqNullSafe(F.col("row")) & F.col("of").eqNullSafe(F.col("id")), "left_semi")
    again = holding.dropDuplicates(["of", "key"]).select("of", "key", words(F.col("text")).alias("ws"))
    again = again.select("of", "key", F.size("ws").alias("of_words"), shingles(F.col("ws"), size).alias("all"))
    both = hits.join(again, F.col("row").eqNullSafe(F.col("key")) & F.col("id").eqNullSafe(F.col("of")))
    end = F.greatest(F.lit(0), F.col("of_words") - F.col("n"))

    def starts(pos: Column, i: Column) -> Column:
        """Windows that hold the shingle here and not the one found before it."""
        before = F.when(i > 0, F.least(F.get("found", i - 1), end)).otherwise(-1)
        first = F.greatest(before + 1, pos + size - F.col("n"), F.lit(0))
        last = F.least(pos, end)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    spread = both.select("id", "n", "all", F.explode(F.flatten(F.transform("found", starts))).alias("start"))
    return spread.select("id", "n", "start", F.slice("all", F.col("start") + 1, F.col("n") - size + 1).alias("window"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``(id, item_id, similarity, start, n_words)``: for each document and item the window most like the item, if similar enough.

    Words are lower-cased runs of letters and digits. A window has the item's number of words, or is
    the whole of a shorter document; ``start`` is its first word, counted from zero, the first of equally similar ones. Similarity is the
    weighted Jaccard of the shingles, so a passage is found also where its sentences stand in another order. Texts count as a
    whole, however long. Items and texts without words, null among them, match nothing. Rows of ``docs`` that repeat an id give
    one row per item, the best window of any; so do repeated items. Null ids are an id. Empty tables give an empty result;
    other columns are not read.
    """
    num, den = SIMILAR
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    n_words = F.size(words(F.col(item_text_col)))
    sizes = [r[0] for r in benchmark.select(F.least(n_words, F.lit(SHINGLE)).alias("size")).where("size > 0").distinct().collect()]  # SHINGLE at most
    found = None
    for size in sorted(sizes):
        items = staged(_items(benchmark, item_col, item_text_col, size).withColumn("item_fp", simhash(F.col("hashes"))), "items")
        windows = staged(_windows(cut, items, size).withColumn("fp", simhash(F.col("window"))), "windows")
        marked = items.select("item_id", F.col("n").alias("item_n"), "hashes", "item_fp")
        entered = items.select("n", "item_fp", F.explode(entries(F.col("item_fp"), radius)).alias("value")).distinct()
        looked = windows.select("n", "fp").distinct().select("n", "fp", F.explode(values(F.col("fp"))).alias("value"))
        met = looked.join(entered, ["n", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        near = staged(met.select(F.col("n").alias("item_n"), "fp", "item_fp").distinct().join(marked, ["item_n", "item_fp"]), "near")
        pairs = windows.join(_few(near.withColumnRenamed("fp", "near_fp"), BROADCAST_WIDE), (F.col("n") == F.col("item_n")) & (F.col("fp") == F.col("near_fp")))
        exact = pairs.select("id", "item_id", "start", "n", shared(F.col("window"), F.col("hashes")).alias("same"), (F.size("window") + F.size("hashes")).alias("both"))
        hits = exact.where(den * F.col("same") >= num * (F.col("both") - F.col("same"))).select(
            "id", "item_id", "start", F.col("n").alias("n_words"), (F.col("same") / (F.col("both") - F.col("same"))).alias("similarity")
        )
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select(F.col(id_col).alias("id")).join(benchmark.select(F.col(item_col).alias("item_id")).limit(0), F.lit(True)).where("false").select(
            "id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words")
        )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words")).alias("best")
    return found.groupBy("id", "item_id").agg(best).select("id", "item_id", "best.similarity", (-F.col("best.before")).alias("start"), "best.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id has a window like an item; rows without an id are judged together."""
    name = "bad_id"
    while name in docs.columns:
        name += "_"
    bad = staged(contaminated(docs, benchmark, id_col, text_col).select(F.col("id").alias(name)).distinct(), "contaminated")
    few = _few(bad)
    return docs.join(few, docs[id_col].eqNullSafe(few[name]), "left_anti")
