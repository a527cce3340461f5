"""Packing documents into training sequences (operator 9): best-fit decreasing.

Each task encodes its documents, cuts every document into full windows and one rest, and packs
the rests of a bounded buffer of documents by falling length: a segment tree over remaining
capacities finds the tightest open window that still takes the piece. Buffers are independent, so
there is no shuffle, no hot key and no state beyond one buffer; each buffer leaves about one window
partly filled. Sequence ids are unique over all tasks (task number, then a counter).

Defined results: a null or empty text is its end id alone; an empty table gives no rows; repeated
rows are packed one by one; ties of length keep the order of rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from wavefield.llm import token_ids
from wavefield.llm.common import table

WINDOW, BUFFER = 1024, 32_768
VOCABULARY, END_ID = "byte_bpe_50k.json", 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Windows with room left, by remaining capacity. A node of the tree tells whether any capacity
    below it has an open window; the leaves are the capacities 0 to the window's length."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.windows: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int, used: int) -> None:
        self.windows[capacity].append((sequence, used))
        node = self.leaves + capacity
        while node and not self.some[node]:
            self.some[node] = True
            node >>= 1

    def take(self, length: int) -> tuple[int, int, int] | None:
        """(capacity, sequence, used) of the tightest window with room for length."""
        node = self.leaves + length
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        found = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self.some[node] = False
            while node > 1:
                node >>= 1
                self.some[node] = self.some[2 * node] or self.some[2 * node + 1]
        return capacity, *found


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[tuple[int, int]], int]:
    """(sequence, offset) of each piece, and how many sequences there are; no piece is over window."""
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    room, made = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[i])
        if found is None:
            found, made = (window, made, 0), made + 1
        capacity, sequence, used = found
        places[i] = (sequence, used)
        if capacity > lengths[i]:
            room.put(capacity - lengths[i], sequence, used + lengths[i])
    return places, made


def _pieces(doc_id: pa.Array, ids: pa.ListArray, window: int, names: list[str]) -> pa.RecordBatch:
    """Every document cut into full windows and a rest."""
    at = ids.offsets.to_numpy().astype(np.int64)
    n = np.diff(at)
    many = -(-n // window)
    doc = np.repeat(np.arange(len(n)), many)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * window
    length = np.minimum(window, n[doc] - start)
    values, begin = memoryview(ids.values.to_numpy()).cast("B"), 4 * (at[doc] + start)
    crc = np.fromiter((zlib.crc32(values[a : a + size]) for a, size in zip(begin.tolist(), (4 * length).tolist(), strict=True)), np.int64, len(doc))
    return pa.record_batch([doc_id.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc])], names)


def _packer(vocabulary: str, end_id: int, window: int, buffer: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.encoder(vocabulary)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[pa.RecordBatch] = []  # pieces: doc_id, start, length, ids_crc32, doc_tokens

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for at in range(0, pieces.num_rows, buffer):
                some = pieces.slice(at, buffer)
                places, made = best_fit_decreasing(some["length"].to_pylist(), window)
                sequence, offset = np.array(places, np.int64).T
                yield from some.append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset)).to_batches()
                first += made

        for batch in token_ids.blocks(batches):
            held.append(_pieces(batch.column("doc_id"), encoder.encode_array(batch.column("text"), end_id), window, names[:5]))
            if sum(x.num_rows for x in held) >= buffer:
                yield from flush()
        if held:
            yield from flush()

    return pack


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, window: int = WINDOW, buffer: int = BUFFER) -> DataFrame:
    """One row per piece: which tokens of which document lie where in which sequence."""
    return docs.select("doc_id", "text").mapInArrow(_packer(vocabulary, end_id, window, buffer), SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces of all documents that are left."""
    return pack_documents(docs)


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
