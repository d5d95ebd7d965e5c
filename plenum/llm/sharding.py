"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by a key: 60 bits of the MD5 of the text, then the id, then a salt that tells repeated rows
apart. Shard j ends at the key below which the bytes lie nearest to its share of the whole. The keys and sizes are
written once, without texts. Each round draws a few keys at random from every open interval, counts the exact bytes
and rows below each of them across all partitions, and keeps the two that enclose the share; an interval closes when
one of its ends meets the tolerance or no key lies between them. Only then do the documents move, once: to
ranges, some for each shard, so that no task holds a shard, and each range is sorted and written as a file.
A document's slot is its place in its range's file plus the rows of the shard's ranges before.

Size: UTF-8 bytes of the text plus 8; a null text counts as an empty one. Ids may be null, which sort first, or
repeated. Copies of a text lie next to each other, and a group that is larger than a shard is cut where the share
ends, by id and then by salt. The salt follows a row's place in its partition; if that place changes between two
readings, the balance among equal rows may, but no row is lost. Other columns are kept; a column named shard, slot,
range, size or place is replaced. A shard may be empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import shared_folder, table, written

#: Bytes of a range, and the most ranges; beyond them the ranges grow.
RANGE_BYTES, MOST_RANGES = 256 << 20, 20_000
#: Keys drawn from an open interval in a round, for a shard's end and for a range's inside it.
DRAWN, DRAWN_INSIDE = 64, 8
_KEY = np.dtype([("hash", ">u8"), ("known", "u1"), ("id", ">u8"), ("salt", ">u8")])


def text_key(text: str = "text") -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")


def packed(key: np.ndarray, ids: np.ndarray, known: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys of 25 bytes whose byte order is the order of (key, id with null first, salt)."""
    flip = lambda a: a.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out = np.empty(len(key), _KEY)
    out["hash"], out["known"], out["id"], out["salt"] = flip(key), known, np.where(known, flip(ids), np.uint64(0)), flip(salt)
    return out.view(f"S{_KEY.itemsize}").ravel()


def _keys(b: pa.RecordBatch) -> np.ndarray:
    known = b.column("id").is_valid().to_numpy(zero_copy_only=False)
    return packed(b.column("key").to_numpy(), b.column("id").fill_null(0).to_numpy(), known, b.column("salt").to_numpy())


def _probes(keys: list[bytes]) -> np.ndarray:
    return np.array(keys, f"S{_KEY.itemsize}")


def histogram(slim: DataFrame, keys: list[bytes]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each of the sorted ``keys``. What a task hands on is a row for each probe that it meets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, size, rows = _probes(keys), np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, _keys(b), side="right")
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(size, at, b.column("size").to_numpy())
        met = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(met), pa.array(size[met]), pa.array(rows[met])], ["at", "size", "rows"])

    got = {r.at: (r.size, r.rows) for r in slim.mapInArrow(count, "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toLocalIterator()}
    size, rows, out = 0, 0, []
    for k in range(len(keys)):  # a key is below those that it equals
        s, r = got.get(k, (0, 0))
        size, rows = size + s, rows + r
        out.append((size, rows))
    return out


def draw(slim: DataFrame, spans: list[tuple[bytes, bytes, float]], seed: int) -> list[bytes]:
    """Keys between the ends of disjoint sorted ``spans`` (low, high, share to draw), drawn by a hash of the key."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, share = _probes([s[0] for s in spans]), _probes([s[1] for s in spans]), np.array([s[2] for s in spans])
        for b in batches:
            keys = _keys(b)
            at = np.searchsorted(low, keys, side="left") - 1
            inside = np.flatnonzero((at >= 0) & (keys < high[np.maximum(at, 0)]))
            mixed = b.column("mixed").to_numpy()[inside].view(np.uint64)
            mixed = (mixed ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            chosen = inside[(mixed ^ (mixed >> np.uint64(31))) / 2.0**64 <= share[at[inside]]]
            yield pa.record_batch([pa.array([k.ljust(_KEY.itemsize, b"\0") for k in keys[chosen].tolist()], pa.binary())], ["key"])

    return sorted({bytes(r.key) for r in slim.mapInArrow(pick, "key binary").toLocalIterator()})


def splitters(slim: DataFrame, size: int, rows: int, shares: list[tuple[int, int]], tolerance: list[int], wanted: list[int]) -> list[bytes | None]:
    """For each share (a, b) of the whole, in ascending order, the key below which the bytes lie nearest to size * a / b, the smaller of two; None is beyond the last row.

    An interval is closed when an end is within ``tolerance`` bytes, or when only one key is left in it.
    """
    first, last = b"\0" * _KEY.itemsize, b"\xff" * _KEY.itemsize
    below = {first: (0, 0), last: (size, rows)}
    far = lambda k, j: abs(below[k][0] * shares[j][1] - size * shares[j][0])
    ended: set[tuple[bytes, bytes]] = set()
    seed = 0
    while True:
        keys, sizes = zip(*sorted((k, s) for k, (s, _) in below.items()))
        ends, opened = [], {}
        for j, (a, b) in enumerate(shares):
            high = bisect_left(sizes, -(-size * a // b))
            pair = (keys[max(high - 1, 0)], keys[high])
            ends.append(min(pair, key=lambda k: (far(k, j), k)))
            if far(ends[-1], j) > tolerance[j] * b and pair not in ended:
                opened[pair] = opened.get(pair, 0) + wanted[j]
        if not opened:
            return [None if k == last else k for k in ends]
        spans = [(lo, hi, min(1.0, n / max(1, below[hi][1] - below[lo][1]))) for (lo, hi), n in sorted(opened.items())]
        seed += 1
        new = [k for k in draw(slim, spans, seed) if k not in below]
        below |= dict(zip(new, histogram(slim, new))) if new else {}
        for lo, hi, share in spans:
            if share == 1.0:  # every key between has been a probe
                own = [lo, *new[bisect_left(new, lo) : bisect_left(new, hi)], hi]
                ended.update((x, y) for x, y in zip(own, own[1:]) if x != y)


def write_shards(docs: DataFrame, path: str, shards: int = 24, tolerance: float = 0.0, range_bytes: int = RANGE_BYTES) -> None:
    """Writes ``docs`` (doc_id, text, ...) to ``path``, a folder for each shard.

    ``tolerance``: bytes by which a shard's end may miss its share, as a part of a mean shard; 0 takes the nearest key there is.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "range", "size", "place", "_key", "_salt")
    docs = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
    docs = docs.withColumn("_key", text_key()).withColumn("_salt", F.monotonically_increasing_id())
    slim = docs.select(F.col("_key").alias("key"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("_salt").alias("salt"), "size")
    slim = written(slim.withColumn("mixed", F.xxhash64("key", "id", "salt")), "keys")
    size, rows = (int(x or 0) for x in slim.agg(F.sum("size"), F.count("*")).first())
    each = max(1, -(-size // shards // max(1, range_bytes)))
    each = min(each, max(1, MOST_RANGES // shards))
    shares = [(j, shards * each) for j in range(1, shards * each)]
    outer = [j % each == 0 for j, _ in shares]
    # A range inside a shard may be half as long again: its size shows nowhere.
    slack = [int(tolerance * size / shards) if o else size // (2 * shards * each) for o in outer]
    ends = splitters(slim, size, rows, shares, slack, [DRAWN if o else DRAWN_INSIDE for o in outer]) if rows else []
    keys = [k for k in ends if k is not None]

    @pandas_udf("int")
    def range_of(key, ids, known, salt):
        return pd.Series(np.searchsorted(_probes(keys), packed(key.to_numpy(), ids.to_numpy(), known.to_numpy(), salt.to_numpy()), side="right").astype(np.int32))

    number = F.col("doc_id").cast("long")
    place = range_of("_key", F.coalesce(number, F.lit(0)), number.isNotNull(), F.xxhash64("_salt"))
    dealt = docs.withColumn("range", place).withColumn("shard", F.floor(F.col("range") / each).cast("int"))
    dealt = dealt.repartitionById(shards * each, "range").sortWithinPartitions("shard", "range", "_key", F.asc_nulls_first("doc_id"), F.xxhash64("_salt"))
    # The low 33 bits count the rows of a partition, which is one range.
    dealt = dealt.withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("_key", "_salt")
    dealt.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The documents with shard and slot. ``schema``: of the documents that were written."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    own = [f for f in schema.fields if f.name not in ("shard", "slot", "range", "size", "place")]
    more = [StructField("size", LongType()), StructField("range", IntegerType()), StructField("place", LongType()), StructField("shard", IntegerType())]
    rows = spark.read.schema(StructType(own + more)).parquet(path)
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("shard").alias("of_shard"), F.col("range").alias("of_range"), before.alias("before"))
    # At most MOST_RANGES rows, so they can be sent.
    placed = rows.join(F.broadcast(counts), (rows.shard == counts.of_shard) & (rows.range == counts.of_range))
    return placed.select(*[rows[f.name] for f in own], rows["size"], rows["shard"], (rows["place"] + F.col("before")).alias("slot"))


def op12_histogram_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_folder(spark, "shards")
    write_shards(docs, path)
    out = read_shards(spark, path, docs.schema)
    return out.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 in DuckDB: a table for each byte made by the polynomial, then a step for each byte of the text.
OP12_SQL = """
with crc as (
  select list(list_reduce([i] || range(8), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) order by i) as tab from range(256) t(i)),
d as (
  select doc_id, strlen(coalesce(text, '')) + 8 as size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as k,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as bytes from documents),
o as (
  select doc_id, size, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
    row_number() over w as r, (sum(size) over w - size)::hugeint as below, (sum(size) over ())::hugeint as total
  from d, crc window w as (order by k, doc_id nulls first rows unbounded preceding)),
cuts as (select r, below, total from o union all select count(*) + 1, sum(size)::hugeint, sum(size)::hugeint from d),
ends as (select j, arg_min(r, (abs(below * 24 - total * j), r)) as cut from cuts, range(1, 24) t(j) where total > 0 group by j),
placed as (select o.*, (select count(*) from ends where cut <= o.r) as shard from o)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard::int as shard,
  (row_number() over (partition by shard order by r) - 1)::bigint as slot, null::int as grown_shard
from placed
"""
