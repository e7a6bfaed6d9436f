"""Minimum-cost role repair of conversations (operator 9).

Legal turns are those of an automaton: an optional system turn first, then user and assistant in turn. Each
given turn may stand as it is, take another role, or join the turn before it; empty turns may be put in
between. The costs of all ways through one turn, from each state to each state, are a small matrix, and
those of a stretch of turns its min-plus product; so long conversations are cut into stretches that are worked on
in parallel, the few matrices of a conversation decide the states between stretches, and
each stretch then finds its own cheapest way. Repaired turns are numbered, merged and rendered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.shared import staged

ROLES = ("system", "user", "assistant")
#: States: start, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: Costs of joining the turn before, of an empty turn, of another role, and of another role where the given one is unknown.
MERGE, EMPTY, RELABEL, NAME = 1.0, 2.0, 3.0, 0.5
#: Turn numbers in a stretch.
STRETCH = 1024
#: Ways through one turn from one state: (state after, cost, empty role before, role, joins the turn before).
Way = tuple[int, float, str | None, str, bool]


def legal(state: int, role: str) -> bool:
    if role == "system":
        return state == START
    return state == USER if role == "assistant" else state != USER


def ways(given: str | None) -> list[list[Way]]:
    """From each state, in order of preference among equal costs: keep, join, an empty turn, another role."""
    known = given in ROLES
    out: list[list[Way]] = []
    for state in range(4):
        found: list[Way] = []
        for role in ROLES:
            cost = 0.0 if role == given else RELABEL if known else NAME
            if legal(state, role):
                found.append((AFTER[role], cost, None, role, False))
            if state == AFTER[role]:
                found.append((state, cost + MERGE, None, role, True))
            for empty in ("user", "assistant"):
                if legal(state, empty) and legal(AFTER[empty], role) and not legal(state, role):
                    found.append((AFTER[role], cost + EMPTY, empty, role, False))
        out.append(sorted(found, key=lambda w: (w[1], w[4], w[2] is not None, ROLES.index(w[3]))))
    return out


_WAYS = {r: ways(r) for r in (*ROLES, None)}


def _of(given: str | None) -> list[list[Way]]:
    return _WAYS[given if given in ROLES else None]


def role_of(given: str | None) -> str | None:
    """Trimmed and lower-cased, common other names replaced."""
    name = (given or "").strip().lower()
    # Other names of the roles.
    return {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}.get(name, name)


def stretch_costs(roles: list[str | None]) -> np.ndarray:
    """4 x 4: the least cost of a way through the turns from each state to each state."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for given in roles:
        step = np.full((4, 4), np.inf)
        for state, found in enumerate(_of(given)):
            for after, cost, *_ in found:
                step[state, after] = min(step[state, after], cost)
        total = (total[:, :, None] + step[None]).min(1)
    return total


def stretch_way(roles: list[str | None], first: int, last: int) -> list[Way]:
    """The cheapest way through the turns between two states; ties, from the last turn back, go to the smaller state before, then as ``ways`` prefers."""
    cost = [[np.inf] * 4 for _ in range(len(roles) + 1)]
    cost[0][first] = 0.0
    back: list[list] = [[None] * 4 for _ in roles]
    for i, given in enumerate(roles):
        for state in range(4):
            if cost[i][state] == np.inf:
                continue
            for way in _of(given)[state]:
                if cost[i][state] + way[1] < cost[i + 1][way[0]]:
                    cost[i + 1][way[0]] = cost[i][state] + way[1]
                    back[i][way[0]] = (state, way)
    found, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        state, way = back[i][state]
        found.append(way)
    return found[::-1]


def between(costs: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and after each stretch on the cheapest way from the start; ties to the smaller state."""
    reach = [np.where(np.arange(4) == START, 0.0, np.inf)]
    for c in costs:
        reach.append((reach[-1][:, None] + c).min(0))
    state = int(np.argmin(reach[-1]))
    found = []
    for before, c in zip(reach[-2::-1], costs[::-1], strict=True):
        earlier = int(np.argmin(before + c[:, state]))
        found.append((earlier, state))
        state = earlier
    return found[::-1]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    here, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != here:
                if here is not None:
                    yield here, rows
                here, rows = row[:keys], []
            rows.append(row)
    if here is not None:
        yield here, rows


def _stretch() -> Column:
    return F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**62)))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text, new_role, empty_before, joins, cost)``: what becomes of each distinct given turn.

    Turns of a conversation go by number (null first), then role and text. Rows that repeat all four are one
    turn. Roles are compared as ``role_of`` names them; an unknown or null role may become any at the
    cost NAME. A null text is empty. Null conversations are one conversation. Equally cheap ways are told
    apart from the last turn back: by the smaller state before it, then keeping, joining, an empty turn, another role.
    An empty table gives an empty result; other columns are not read.
    """
    conv = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.distinct().withColumn("stretch", _stretch())
    order = ["conv", "stretch", "turn", "role", "text"]

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _grouped(batches, 2):
            matrix = stretch_costs([role_of(r[3]) for r in group]).ravel().tolist()
            yield pa.RecordBatch.from_pydict({"conv": pa.array([key[0]], types[0]), "stretch": pa.array([key[1]], pa.int64()), "costs": pa.array([matrix], pa.list_(pa.float64()))})

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _grouped(batches, 1):
            found = between([np.array(r[2]).reshape(4, 4) for r in group])
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(group), types[0]), pa.array([r[1] for r in group], pa.int64()), pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())],
                names=["conv", "stretch", "before", "after"],
            )

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 2):
            way = stretch_way([role_of(r[3]) for r in group], group[0][5], group[0][6])
            columns = list(zip(*group, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], types[0]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()),
                    pa.array([w[3] for w in way]), pa.array([w[2] for w in way], pa.string()), pa.array([w[4] for w in way]), pa.array([w[1] for w in way]),
                ],
                names=["conv", "turn", "role", "text", "new_role", "empty_before", "joins", "cost"],
            )

    types = [to_arrow_type(turns.schema[conv_col].dataType)]
    dealt = rows.select("conv", "stretch", "turn", "role").repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "turn", "role")
    matrices = dealt.mapInArrow(costs, f"conv {conv}, stretch long, costs array<double>")
    ends = staged(matrices.repartition("conv").sortWithinPartitions("conv", "stretch").mapInArrow(states, f"conv {conv}, stretch long, before int, after int"), "states")
    with_ends = rows.join(ends.withColumnsRenamed({"conv": "c", "stretch": "s"}), F.col("conv").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).select(*order, "before", "after")
    again = with_ends.repartition("conv", "stretch").sortWithinPartitions(*order)
    return again.mapInArrow(chosen, f"conv {conv}, turn long, role string, text string, new_role string, empty_before string, joins boolean, cost double")


def rendered(repaired: DataFrame) -> DataFrame:
    """``(conv, turn_no, role, text, n_given, rendered)``: the repaired turns, numbered from zero; joined texts are parted by a newline.

    Stretches are numbered by themselves, and the few sums of a conversation's stretches are added up. ``rendered`` is the turn in
    chat markup, ``<|role|>``, a newline, the text and ``<|end|>``.
    """
    adds = F.when(F.col("joins"), 0).when(F.col("empty_before").isNotNull(), 2).otherwise(1)
    cut = repaired.withColumn("stretch", _stretch())
    sums = cut.groupBy(F.col("conv").alias("c"), F.col("stretch").alias("s")).agg(F.sum(adds).alias("of_stretch"))
    before = F.coalesce(F.sum("of_stretch").over(Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("c", "s", before.alias("before"))
    order = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    numbered = cut.withColumn("no", F.sum(adds).over(order).cast("long") - 1).withColumn("at", F.row_number().over(order))
    numbered = numbered.join(sums, F.col("conv").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).withColumn("no", F.col("no") + F.col("before"))
    given = numbered.groupBy("conv", F.col("no").alias("turn_no"), F.col("new_role").alias("role")).agg(F.array_sort(F.collect_list(F.struct("stretch", "at", "text"))).alias("parts"))
    given = given.select("conv", "turn_no", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.size("parts").alias("n_given"))
    empty = numbered.where("empty_before is not null").select("conv", (F.col("no") - 1).alias("turn_no"), F.col("empty_before").alias("role"), F.lit("").alias("text"), F.lit(0).alias("n_given"))
    return given.unionByName(empty).withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>")))
