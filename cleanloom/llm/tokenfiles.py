"""Token ids as Parquet files that can be read in parts.

A row is a document: doc_id, ids (list of int32), n_tokens, shard and start, the ids before it in
its shard.  Rows are in ascending doc_id order, each shard one range of doc_ids.  Ids are
dictionary encoded, the counters delta encoded; row groups and pages are kept small, so that the
page index lets a reader take some documents, or the counters without the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleanloom.llm import bpe
from cleanloom.llm.common import map_batches, tokenizer_path

#: What the writer is told; sizes in bytes.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#start": "false",
    "compression": "zstd",
}
#: Characters of a text that split rows of one doc_id.
TIE = 64
#: Ids in a batch that goes back to Spark.
OUT_IDS = 1 << 20


def write(df: DataFrame, path: str, end_id: int, tokenizer: str | None = None) -> None:
    """Writes the ids of every text (null: empty), each with end_id after it.

    Rows with one doc_id stand together, in the order of their texts; a null doc_id comes first.
    Only doc_id and text are read.
    """
    source = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = bpe.library_encoder(source), TaskContext.get().partitionId(), 0

        def out(keys: list, ids: list[np.ndarray], start: int) -> pa.RecordBatch:
            sizes = np.array([len(x) + 1 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            flat = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(flat), bool)
            keep[ends - 1] = False
            flat[keep] = np.concatenate(ids)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), flat)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(sizes.astype(np.int32)), pa.array(np.full(len(ids), shard, np.int32)), pa.array(start + ends - sizes)], names=["doc_id", "ids", "n_tokens", "shard", "start"])

        for b in batches:
            keys, ids, n = [], [], 0
            for key, x in zip(b.column(0).to_pylist(), encoder.many(b.column(1).to_pylist()), strict=True):
                keys.append(key)
                ids.append(x)
                n += len(x) + 1
                if n >= OUT_IDS:
                    yield out(keys, ids, start)
                    keys, ids, n, start = [], [], 0, start + n
            if keys:
                yield out(keys, ids, start)
                start += n

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one doc_id may be many, so the start of the text, which sorts as the text does, splits them too
    ranged = rows.repartitionByRange(F.asc_nulls_first("doc_id"), F.substring("text", 1, TIE)).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    made = map_batches(ranged, run, "doc_id long, ids array<int>, n_tokens int, shard int, start long")
    made.write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows as they were written; a filter on doc_id reads the pages that can hold it."""
    return spark.read.schema("doc_id long, ids array<int>, n_tokens int, shard int, start long").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): the ids in all shards before one; a row for each file, from the counters alone."""
    sums = read(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
            ends = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            sums = [zlib.crc32(flat[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(sums, pa.int64())], names=["doc_id", "n_tokens", "shard", "start", "ids_crc32"])

    rows = map_batches(read(spark, path), run, "doc_id long, n_tokens int, shard int, start long, ids_crc32 long")
    return rows.join(index(spark, path), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
