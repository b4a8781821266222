"""Packs documents' tokens into sequences of one length, by hierarchical best fit.

Documents are encoded and cut into pieces where they are.  The pieces, a few numbers each, are dealt
evenly to leaves of about LEAF pieces, so that each leaf has a mix of the whole corpus and not the sizes of
one source.  A leaf fits its pieces, longest first, each into the fullest sequence that still has
room.  Nearly full sequences are done.  The underfull ones go up a tree whose nodes join FAN children
each, as items that are fitted again.

Two sequences of at most half the length would have been joined, so a node has at most one of those left.
Of two larger ones neither fits into the other, so whatever still can be joined is one of the small
sequences of the leaves with some larger one, and no more larger ones are of use than there are
leaves.  A node passes on as many, those with most room: they take whatever any other would take.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import bpe
from cleanloom.llm.common import cut, map_batches, tokenizer_path

#: A sequence with at most this much room is done.
SLACK = 4
FAN = 8
#: Pieces of a leaf, about.
LEAF = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = f"{PIECES}, sequence_id long, offset long, node int, done boolean"


PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, its place there): longest first, each into the bin it leaves least room in."""
    bins, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    open_rooms = 0  # bit r: there is a bin with room r
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        wide = open_rooms >> n
        if wide:
            free = n + (wide & -wide).bit_length() - 1
            k = by_room[free].pop()
            if not by_room[free]:
                open_rooms &= ~(1 << free)
        else:
            free, k = room, made
            made += 1
        bins[i], at[i] = k, room - free
        if left := free - n:
            by_room[left].append(k)
            open_rooms |= 1 << left
    return bins, at


class Rows:
    """Pieces as columns; joined, fitted and cut without a Python object for each."""

    NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

    @staticmethod
    def fit(rows: dict[str, np.ndarray], room: int) -> dict[str, np.ndarray]:
        """Fits the sequences named by sequence_id as items; a joined one keeps the id of its first item."""
        ids, first, item = np.unique(rows["sequence_id"], return_index=True, return_inverse=True)
        sizes = np.bincount(item, rows["length"], len(ids)).astype(np.int64)
        order = np.argsort(first, kind="stable")
        bins, at = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        bins[order], at[order] = best_fit(sizes[order], room)
        named = np.empty(len(ids), np.int64)
        named[bins[at == 0]] = ids[at == 0]
        return rows | {"sequence_id": named[bins[item]], "offset": rows["offset"] + at[item]}

    @staticmethod
    def filled(rows: dict[str, np.ndarray]) -> np.ndarray:
        """For each piece the length of its sequence."""
        ids, item = np.unique(rows["sequence_id"], return_inverse=True)
        return np.bincount(item, rows["length"], len(ids)).astype(np.int64)[item]

    @staticmethod
    def batch(rows: dict[str, np.ndarray], node: int, done: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(rows[n], pa.int32() if n == "piece" else pa.int64(), mask=rows["absent"] if n == "doc_id" else None) for n in Rows.NAMES]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(done), node, np.int32)), pa.array(done)], names=[*Rows.NAMES, "node", "done"])

    @staticmethod
    def take(rows: dict[str, np.ndarray], where: np.ndarray) -> dict[str, np.ndarray]:
        return {k: v[where] for k, v in rows.items()}


def pieces(key: int | None, ids: np.ndarray, room: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc) with only the first piece short."""
    size = len(ids)
    raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
    ends = [size % room] if size % room else []
    ends += range((ends or [0])[0] + room, size + 1, room)
    begin = 0
    for n, end in enumerate(ends):
        yield key, n, begin, end - begin, zlib.crc32(raw[4 * begin : 4 * end])
        begin = end


def pack(df: DataFrame, length: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Each piece of each document (null text: empty) with its place.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A document is its ids and
    end_id; longer ones are cut, and only a first piece may be short.  Repeated rows are documents of
    their own.  Only doc_id and text are read.
    """
    path = tokenizer or tokenizer_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.library_encoder(path)
        for b in batches:
            made = [p for key, ids in zip(b.column(0).to_pylist(), encoder.many(b.column(1).to_pylist()), strict=True) for p in pieces(key, np.append(ids, np.uint32(end_id)), length)]
            columns = zip(*made, strict=True) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(Rows.NAMES, columns, strict=False)], names=Rows.NAMES[:5])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut_up = cut(map_batches(rows, encoded, PIECES))
    leaves = max(1, -(-cut_up.count() // LEAF))
    level = cut(cut_up.repartition(leaves).mapInArrow(leaf(length, leaves), SCHEMA))
    ended, open_, nodes = [level.where("done")], level.where("not done"), leaves
    while nodes > 1:
        nodes = -(-nodes // FAN)
        level = cut(open_.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("node").applyInArrow(merged(length, leaves), SCHEMA))
        ended.append(level.where("done"))
        open_ = level.where("not done")
    out = open_
    for x in ended:
        out = out.unionByName(x)
    return out.drop("node", "done")


def leaf(length: int, leaves: int):
    """Fits the pieces of a partition; sequences are numbered by leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, table = TaskContext.get().partitionId(), pa.Table.from_batches(batches, PIECE_SCHEMA)
        if table.num_rows:
            rows = columns_of(table, Rows.NAMES[:5])
            rows |= {"sequence_id": (node << 36) + np.arange(table.num_rows), "offset": np.zeros(table.num_rows, np.int64)}
            yield fitted(rows, node, length, leaves)

    return run


def merged(length: int, leaves: int):
    def run(table: pa.Table) -> pa.Table:
        rows = columns_of(table, Rows.NAMES)
        order = np.lexsort((rows["offset"], rows["sequence_id"]))
        return pa.Table.from_batches([fitted(Rows.take(rows, order), table["node"][0].as_py(), length, leaves)])

    return run


def columns_of(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {n: table[n].fill_null(0).to_numpy().astype(np.int64) for n in names} | {"absent": table["doc_id"].is_null().to_numpy()}


def fitted(rows: dict[str, np.ndarray], node: int, length: int, leaves: int) -> pa.RecordBatch:
    """The sequences named in rows after one more fit; done are those that nothing can be joined to."""
    rows = Rows.fit(rows, length)
    filled = Rows.filled(rows)
    done = filled >= length - SLACK
    large = ~done & (filled > length // 2)
    passed = np.unique(np.stack([filled[large], rows["sequence_id"][large]]), axis=1)[1, :leaves]
    return Rows.batch(rows, node, done | large & ~np.isin(rows["sequence_id"], passed))
