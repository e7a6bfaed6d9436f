"""Mixing sources to target weights by Poisson replication (operator 8), in DataFrame functions only.

Source s of n documents and weight w gets ``rate = total * w / (sum of weights * n)`` copies of each document
on average. A document's count inverts the Poisson distribution of that mean at a number that
its id and the seed hash to, so runs and retries agree. Rates above PIECE are sums of
independent parts, each inverted at a number of its own. Copies are dealt to partitions by a hash and put
in hash order there: a shuffle of all copies that moves each text once and cares for no source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest mean that is inverted at once.
PIECE = 8.0
#: Cumulative probabilities kept of a part: the rest of a mean of PIECE is below 1e-18.
TERMS = 48
#: Sources whose rates are sent to every task; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: Mean from which a source's copies are made in pieces of so many.
HEAVY = 512


def unit(*parts: Column) -> Column:
    """A number from zero up to one: thirteen hex digits of the md5 of the parts."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _cumulative(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... TERMS - 1, added up in that order."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, more)["all"]


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """``(source, rate, parts, cumulative)`` of each source; without weights all sources weigh the same."""
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weigh = F.lit(1.0)
    else:
        weigh = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("source").cast("string")), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("w", weigh)
    rows, mass = counts.agg(F.sum("n"), F.sum("w")).first()
    mean = F.lit(float(total if total is not None else rows or 0)) * F.col("w") / (F.lit(float(mass or 1.0)) * F.col("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE).cast("int"))
    return counts.select("source", mean.alias("rate")).withColumn("parts", parts).withColumn("cumulative", _cumulative(F.col("rate") / F.col("parts")))


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict[str, float] | None = None, total: int | None = None, seed: int = 17, copy_col: str = "copy"
) -> DataFrame:
    """Copies of ``docs`` whose sources stand in the ratio of ``weights``, about ``total`` in all, shuffled.

    Each document stands 0, 1, 2, ... times, numbered from one in ``copy_col`` (an underscore is added while a
    column of that name exists); columns of any other names stay as they are. Without ``weights`` sources weigh the same; a source
    that ``weights`` does not name weighs nothing; a null source is a source, of no name. ``total`` defaults to the number of rows.
    Rows with equal ids, null among them, get equal counts. Texts are not looked at, however long. Sources must weigh
    nothing or more. An empty table gives an empty result.
    """
    if weights and min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    while copy_col in docs.columns:
        copy_col += "_"
    own = "mix"  # starts the names of columns that are added on the way
    while any(c.lower().startswith(own) for c in [*docs.columns, copy_col]):
        own += "_"
    rate = rates(docs, source_col, weights, total)
    n_sources, most = rate.agg(F.count("*"), F.max("rate")).first()
    rate = rate.select(*[F.col(c).alias(own + c) for c in rate.columns])
    if n_sources <= BROADCAST_ROWS:
        rate = F.broadcast(rate)
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    joined = docs.join(rate, docs[f"`{source_col}`"].eqNullSafe(rate[own + "source"]))

    def inverted(acc: Column, part: Column) -> Column:
        u = unit(F.lit(str(seed)), part.cast("string"), name)
        return acc + F.size(F.filter(own + "cumulative", lambda c: c <= u))

    kept = [F.col(f"`{c}`") for c in docs.columns]
    count = F.aggregate(F.sequence(F.lit(1), F.col(own + "parts")), F.lit(0), inverted)
    counted = joined.withColumn(own + "count", count).where(F.col(own + "count") > 0)

    def copies(rows: DataFrame) -> DataFrame:
        return rows.select(*kept, F.explode(F.sequence(F.lit(1), F.col(own + "count"))).alias(copy_col))

    if (most or 0) <= HEAVY:
        out = copies(counted)
    else:  # a source of few documents: its copies are made by many tasks
        heavy = F.col(own + "rate") > HEAVY
        starts = F.explode(F.sequence(F.lit(0), F.floor((F.col(own + "count") - 1) / HEAVY).cast("int")))
        pieces = counted.where(heavy).select(*kept, F.col(own + "count"), starts.alias(own + "piece"))
        pieces = pieces.repartition(F.xxhash64(name, F.col(own + "piece")))
        first = F.col(own + "piece") * HEAVY + 1
        spread = pieces.select(*kept, F.explode(F.sequence(first, F.least(first + HEAVY - 1, F.col(own + "count")))).alias(copy_col))
        out = copies(counted.where(~heavy)).unionByName(spread)
    place = F.xxhash64(F.lit(seed), name, F.col(copy_col))
    return out.withColumn(own + "place", place).repartition(own + "place").sortWithinPartitions(own + "place").drop(own + "place")
