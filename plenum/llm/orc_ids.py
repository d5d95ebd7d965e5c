"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are ranged by doc_id over the files, encoded inside the sorted partitions and written as one
row each. ORC stores ids as run-length encoded integers in stripes that tasks read in parallel; the row
index and the Bloom filter on doc_id let a reader skip whole row groups. The number of ids before a
document is its place in its file plus the sums of the files before, a table with a row for each file.

Null or empty text is a document of the end id alone. Null ids come first. Rows with an equal doc_id
follow each other, ordered by a hash of the text. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None, stripe: int = 16 << 20) -> None:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order; ``files``: how many, the session's shuffle partitions by default; ``stripe``: bytes of a stripe before compression."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for batch in batches:
            doc_ids = batch.column(0)
            # A few MB of text at a time bound the memory that the ids take.
            at = 0
            while at < batch.num_rows:
                ids, ends, starts, first, size = [], [0], [], at, 0
                while at < batch.num_rows and size < 8 << 20:
                    text = batch.column(1)[at].as_py() or ""
                    size += len(text)
                    starts.append(before + ends[-1])
                    ids += [np.frombuffer(enc.encode(text), enc.dtype).astype(np.int32), end]
                    ends.append(ends[-1] + len(ids[-2]) + 1)
                    at += 1
                before += ends[-1]
                n = at - first
                yield pa.record_batch(
                    [
                        doc_ids.slice(first, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(starts, pa.int64()),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        # Rows with one id, null ones too, are dealt by their texts, and equal rows by where they were read.
        .withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "h", "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "row")
        .select("doc_id", "text")
        .mapInArrow(run, SCHEMA)
        .write.options(
            **{
                "compression": "zstd",
                "orc.bloom.filter.columns": "doc_id",
                "orc.bloom.filter.fpp": "0.01",
                "orc.create.index": "true",
                "orc.row.index.stride": "1000",
                "orc.stripe.size": str(stripe),
                # Documents may be long: the writer looks at a stripe's size after so many of them.
                "orc.rows.between.memory.checks": "500",
            }
        )
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids. A filter on doc_id skips row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # A row for each file: the ids before it. Only n_tokens and part are read for it.
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import shared_folder, table

    path = shared_folder(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(read_ids(spark, path))
