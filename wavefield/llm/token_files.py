"""Token ids as Parquet files (operator 8).

A dataset holds one row per document in ascending doc_id order: the ids as a list column with
dictionary encoding (a vocabulary of 49k ids packs into 16 bits), the metadata columns with delta
encoding, row groups and pages of set size, and page indexes, so that a reader of few documents or
of metadata alone touches few pages. Files are written by Spark's own Parquet writer, so any store
that Spark reaches will do. Positions are kept per file (`shard`); a reader adds up the few shard
totals from the metadata columns instead of a running sum over all rows.

Defined results: a null or empty text is its end id alone; null ids come first; rows of one doc_id
are ordered by a hash of the text; an empty table gives an empty dataset; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefield.llm import token_ids
from wavefield.llm.common import table, work_dir

VOCABULARY, END_ID = "word_bpe_49k.json", 2
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"

def _writer(vocabulary: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.encoder(vocabulary)
        shard, start = TaskContext.get().partitionId(), 0
        for batch in token_ids.blocks(batches):
            ids = encoder.encode_array(batch.column("text"), end_id)
            ends = ids.offsets.to_numpy().astype(np.int64)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.full(len(ids), shard, np.int32)), pa.array(start + ends[:-1]), pa.array(np.diff(ends).astype(np.int32)), ids],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encodes all documents and writes them under path, in ascending doc_id order over the shards."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts are shuffled, not ids: they are smaller. Ranges go by a hash of the text too, so that an id of very many rows
    # is dealt to many tasks, and by the row's place, so that equal rows are; the keys that are sampled stay short
    order = ["doc_id", "text_hash", "place"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "compression": "zstd",
    }
    ordered.mapInArrow(_writer(vocabulary, end_id), SCHEMA).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids. Spark reads only the
    columns that are used further on, and skips pages and row groups by filters on doc_id."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file written, never more than there were tasks
    shards = totals.select("shard", before.alias("before"))
    return files.join(F.broadcast(shards), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, offsets = memoryview(ids.values.buffers()[1] or b"").cast("B"), ids.offsets.to_pylist()
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}-tokens"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict[str, str] = {}
