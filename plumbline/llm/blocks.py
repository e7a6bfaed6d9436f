"""Counting n-grams of a whole corpus where its texts lie, for operators of this subpackage.

Texts lie in blocks of bounded size, compressed. Each block asks for its distinct n-grams as sorted 64-bit hashes,
cut into ranges; one task a range adds up the counts of all blocks and answers each block in the
order it asked in. So an n-gram costs one entry a block however often it stands, and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import binaries, shuffle_partitions, staged, trimmed

#: Least and largest bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = (1 << 20, 8 << 20)
#: Bytes of text for each range of hashes; there is at least a range for each shuffle partition.
RANGE_BYTES = 4 << 20
#: Bytes of text that are compressed together.
CHUNK_BYTES = 1 << 20


def packed(x: np.ndarray) -> bytes:
    """Eight-byte numbers, byte by byte: of sorted or small numbers most bytes are alike, and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def ranges(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Each range that sorted hashes fall in, and where."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(p), slice(cuts[p], cuts[p + 1])


ASKED = "part int, block long, length int, keys binary, learnt binary, everywhere binary"
ANSWERED = "block long, length int, part int, learnt binary, again binary, total long, distinct long"


def asked(block: int, length: int, keys: np.ndarray, learnt: np.ndarray, everywhere: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of ASKED: the block's n-grams of a length by range of their hashes."""
    for p, s in ranges(keys, parts):
        yield p, block, length, packed(keys[s]), packed(learnt[s]), packed(everywhere[s])


def counted(values: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, each value's place among them, and how often they stand in training texts and in all."""
    keys, place = np.unique(values, return_inverse=True)
    return keys, place, np.bincount(place, learn, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ASKED_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("length", pa.int32()), ("keys", pa.binary()), ("learnt", pa.binary()), ("everywhere", pa.binary())])
ANSWERED_SCHEMA = pa.schema(
    [("block", pa.int64()), ("length", pa.int32()), ("part", pa.int32()), ("learnt", pa.binary()), ("again", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())]
)


def answer(rows: pa.Table) -> pa.Table:
    """Counts of one range's n-grams over all blocks, in the order of each block's question; block -1 has the range's sums."""
    out = []
    lengths = rows.column("length").to_numpy()
    for length in np.unique(lengths).tolist():
        here = rows.filter(pa.array(lengths == length))
        keys = [unpacked(x, np.uint64) for x in here.column("keys").to_pylist()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        learnt = _summed(place, here.column("learnt"))
        again = _summed(place, here.column("everywhere")) > 1
        at = 0
        for block, part, size in zip(here.column("block").to_pylist(), here.column("part").to_pylist(), map(len, keys), strict=True):
            own = place[at : at + size]
            out.append((block, length, part, packed(learnt[own]), again[own].tobytes(), 0, 0))
            at += size
        out.append((-1, length, part, b"", b"", int(learnt.sum()), int((learnt > 0).sum())))
    return table(out, ANSWERED_SCHEMA)


def _summed(place: np.ndarray, column: pa.ChunkedArray) -> np.ndarray:
    n = np.concatenate([unpacked(x, np.int64) for x in column.to_pylist()])
    sums = np.zeros(int(place.max()) + 1, np.int64)
    np.add.at(sums, place, n)
    return sums


def answers(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts in training texts, and whether it stands twice, of the block's distinct n-grams of a length, in their order."""
    rows = rows.filter(pa.array(rows.column("length").to_numpy() == length)).sort_by("part")
    learnt = [unpacked(x, np.int64) for x in rows.column("learnt").to_pylist()]
    again = b"".join(rows.column("again").to_pylist())
    return (np.concatenate(learnt) if learnt else np.empty(0, np.int64)), np.frombuffer(again, bool)


#: A question whether hashes stand twice, without counts: eight bytes and a bit for each, and a bit in the answer.
TWICE_ASKED = "part int, block long, keys binary, more binary"
TWICE = "block long, part int, n long, again binary"
TWICE_ASKED_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
TWICE_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("again", pa.binary())])


def asked_twice(block: int, values: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of TWICE_ASKED: the block's distinct values by range, and which of them stand twice in the block itself."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    keys, more = values[at], np.diff(at, append=len(values)) > 1
    del values, first, at
    for p, s in ranges(keys, parts):
        yield p, block, packed(keys[s]), np.packbits(more[s]).tobytes()


def answer_twice(rows: pa.Table) -> pa.Table:
    """Which of one range's values stand twice over all blocks, in the order of each block's question."""
    trimmed()
    keys = [unpacked(x.as_py(), np.uint64) for x in rows.column("keys")]
    own = [k[np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)).view(bool)] for k, x in zip(keys, rows.column("more"), strict=True)]
    values = np.concatenate(keys)
    values.sort()
    twice = np.unique(np.concatenate([values[1:][values[1:] == values[:-1]], *own]))
    del values, own
    out = []
    for block, part, k in zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), keys, strict=True):
        at = np.searchsorted(twice, k)
        again = np.zeros(len(k), bool)
        inside = at < len(twice)
        again[inside] = twice[at[inside]] == k[inside]
        out.append((block, part, len(k), np.packbits(again).tobytes()))
    return table(out, TWICE_SCHEMA)


def twice_of(rows: pa.Table) -> np.ndarray:
    """Whether each of the block's distinct values, in order, stands twice."""
    rows = rows.sort_by("part")
    found = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for n, x in zip(rows.column("n").to_pylist(), rows.column("again").to_pylist(), strict=True)]
    return np.concatenate([np.empty(0, np.uint8), *found]).view(bool)


def in_blocks(rows: DataFrame, block_range: tuple[int, int] = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``rows(..., text)`` as ``(block, <array of each other column>, ends, texts)``, written, and the number of ranges to cut n-grams into.

    Texts are compressed in chunks, chunks lie in blocks; ``ends`` are the texts' ends in the chunk, in bytes. With chunks
    no smaller than the largest block, each block is one row.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = shuffle_partitions(spark)
    if rows.rdd.getNumPartitions() * 4 <= wide:  # a table in few files
        rows = rows.repartition(wide)
    block_bytes = min(max(size // (2 * wide), block_range[0]), block_range[1])
    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, of_chunk, of_block = TaskContext.get().partitionId() << 32, [], 0, 0

        def chunk() -> pa.RecordBatch:
            *columns, texts = zip(*held, strict=True)
            whole = b"".join(texts)
            arrays = [pa.array([[x.as_py() for x in c]], pa.list_(c[0].type)) for c in columns]
            ends = pa.array([np.cumsum([len(x) for x in texts])], pa.list_(pa.int64()))
            data = pa.array([pa.compress(whole, codec="zstd", asbytes=True) if whole else b""], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([block]), *arrays, ends, data], names=["block", *others, "ends", "texts"])

        for b in batches:
            for *values, text in zip(*b.columns[:-1], binaries(b.columns[-1]), strict=True):
                held.append((*values, text))
                of_chunk += len(text) + 1
                of_block += len(text) + 1
                if of_chunk >= chunk_bytes or of_block >= block_bytes:
                    yield chunk()
                    held, of_chunk = [], 0
                    if of_block >= block_bytes:
                        block, of_block = block + 1, 0
        if held:
            yield chunk()

    found = rows.select(*others, "text").mapInArrow(run, f"block long, {kinds}, ends array<long>, texts binary")
    return staged(found, "blocks"), max(wide, size // RANGE_BYTES)


def texts_of(chunks: pa.Table) -> Iterator[bytes]:
    for data, ends in zip(chunks.column("texts").to_pylist(), chunks.column("ends").to_pylist(), strict=True):
        whole, at = (pa.decompress(data, ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""), 0
        for end in ends:
            yield whole[at:end]
            at = end


def column_of(chunks: pa.Table, name: str) -> pa.Array:
    """A column of arrays, one value a text."""
    return pa.concat_arrays([x.flatten() for x in chunks.column(name).chunks])
