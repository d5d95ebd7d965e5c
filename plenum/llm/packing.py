"""Packing without padding: each document is cut into pieces whose lengths are powers of two.

A document of T ids gives T // window full windows, then one piece for each bit of the rest, longest
first. Every piece is a sequence of its own, so no sequence crosses documents and none needs padding;
pieces of equal length share a bucket, from which batches are formed.

The work is one pass over the texts inside Spark's read tasks: no shuffle and no state between rows.
Sequence numbers hold the bucket, the task and a running number, so they need no pass of their own.

Null or empty text is a document of the end id alone. A null doc_id is kept as it is. Rows with an
equal doc_id are documents of their own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def lengths(tokens: int, window: int) -> list[int]:
    """Full windows, then the powers of two that make up the rest, longest first."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id, text). ``ids``: unsigned little-endian 32-bit integers.

    ``bucket`` is the binary logarithm of the length; ``sequence_id`` grows with it.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        numbers = [0] * window.bit_length()
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(enc.encode(text.as_py() or ""), enc.dtype).astype("<u4").tobytes() + end
                tokens, start = len(ids) // 4, 0
                for n in lengths(tokens, window):
                    bucket = n.bit_length() - 1
                    number = bucket << 58 | task << 34 | numbers[bucket]
                    numbers[bucket] += 1
                    for column, value in zip(rows, (doc_id, start, n, ids[4 * start : 4 * (start + n)], tokens, bucket, number, 0)):
                        column.append(value)
                    start += n
                size += len(ids)
                if size > 16 << 20:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names)
                    rows, size = [[] for _ in names], 0
            if rows[0]:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """A folder for each bucket, so that a reader forms batches of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
