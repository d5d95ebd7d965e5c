"""Reversible line deduplication: an exact reference table, with sharded cuckoo filters in front.

A line's key is its text without white space at the ends, A-Z lower-cased; only keys of at least
``min_chars`` code points count. The index has three tables in one folder:

* postings: a row for each document and key, appended by each insertion;
* references: for each key the number of documents that hold it and the largest of their ids;
* filters: for each shard of the key space a cuckoo filter with the keys held by ``min_docs`` or more.

An insertion counts the new postings and adds them; a deletion takes a document's postings away and counts
the keys that it held anew, so inserting and then deleting leaves the tables as they were. Keys that cross
``min_docs`` upwards enter their shard's filter, those that cross it downwards are deleted from it: a cuckoo
filter, unlike a Bloom filter, forgets single keys. To clean documents, their lines are first held against
the filters where the texts are read; what a filter doesn't know costs no shuffle. The rest meets the
exact table, so a filter's false hits never drop a line.

Filters are broadcast while all of them together stay under ``FILTER_BYTES``; beyond that, the lines' keys are
dealt to the filters' shards, each task loads one filter at a time and lets only the keys pass that it knows. A shard
of very many lines goes to several tasks, with a copy of its filter each.

A document that is inserted again replaces what the index held of it.

Null or empty text is one empty line. A null doc_id holds no keys and keeps all its lines. Rows with an
equal doc_id are versions of one document: each of them is cleaned, and together they count once. Other
columns pass through ``clean`` unchanged, but for names that it returns itself and drop_id, drop_hi, drop_lo. An empty table gives an
empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, shared_folder, written

FILTER_BYTES = 64 << 20
#: Lines that a task probes with one shard's filter, on average.
PROBES = 1 << 22
#: Keys of a shard that its filter is sized for.
SHARD_KEYS = 1 << 18
SLOTS = 4
KEY = ["key_hi", "key_lo"]


def line_key(line: str, min_chars: int) -> bytes | None:
    """128 bits of the line's key, None for a short line."""
    import xxhash

    line = line.strip(SPACE)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


class CuckooFilter:
    """Buckets of four 16-bit marks. A mark's other bucket follows from the mark and the bucket, so marks can move and go."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((n, SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.buckets.tobytes()

    def _places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo = lo.astype(np.int64).view(np.uint64)
        mark = ((lo >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (lo & np.uint64(len(self.buckets) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return bucket ^ (np.asarray(mark, np.int64) * 0x5BD1E995 & (len(self.buckets) - 1))

    def holds(self, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(lo)
        return (self.buckets[a] == mark[:, None]).any(1) | (self.buckets[b] == mark[:, None]).any(1)

    def add(self, lo: np.ndarray) -> bool:
        """False if the filter is full; the caller then builds a larger one."""
        rng = np.random.default_rng(0)
        for mark, a, b in zip(*self._places(lo)):
            bucket = a
            for bucket in (a, b):
                if (free := np.flatnonzero(self.buckets[bucket] == 0)).size:
                    self.buckets[bucket, free[0]] = mark
                    break
            else:
                for _ in range(500):
                    slot = rng.integers(SLOTS)
                    mark, self.buckets[bucket, slot] = self.buckets[bucket, slot], mark
                    bucket = self._other(bucket, mark)
                    if (free := np.flatnonzero(self.buckets[bucket] == 0)).size:
                        self.buckets[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, lo: np.ndarray) -> None:
        for mark, a, b in zip(*self._places(lo)):
            for bucket in (a, b):
                if (at := np.flatnonzero(self.buckets[bucket] == mark)).size:
                    self.buckets[bucket, at[0]] = 0
                    break


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def postings(docs: DataFrame, min_chars: int = 40, known=None) -> DataFrame:
    """doc_id, key_hi, key_lo: a row for each document and key. ``known``: a test of keys that leaves out the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = {k for line in (text.as_py() or "").split("\n") if (k := line_key(line, min_chars))}
                keys += own
                ids += [doc_id] * len(own)
            hi, lo = _longs(keys)
            ids = np.array(ids, np.int64)
            if known is not None and len(ids):
                keep = known(hi, lo)
                ids, hi, lo = ids[keep], hi[keep], lo[keep]
            yield pa.record_batch([pa.array(ids), pa.array(hi), pa.array(lo)], ["doc_id", "key_hi", "key_lo"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key_hi long, key_lo long")


class LineIndex:
    """The tables of an index below ``path``; each change writes new tables and leaves the old ones whole."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 40, min_docs: int = 5, filter_bytes: int = FILTER_BYTES):
        self.spark, self.min_chars, self.min_docs, self.filter_bytes = spark, min_chars, min_docs, filter_bytes
        self.path = path or shared_folder(spark, "lines")
        self.version = 0
        self.shards = 1
        self._posts: list[str] = []

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{self.version}"
        df.write.mode("overwrite").parquet(path)
        return path

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, key_hi long, key_lo long").parquet(*self._posts) if self._posts else self.spark.createDataFrame([], "doc_id long, key_hi long, key_lo long")

    @property
    def references(self) -> DataFrame:
        schema = "key_hi long, key_lo long, n_docs long, keeper long"
        return self.spark.read.schema(schema).parquet(self._refs) if self.version else self.spark.createDataFrame([], schema)

    def _count(self, posts: DataFrame) -> DataFrame:
        return posts.groupBy(*KEY).agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def _shard(self):
        return F.pmod("key_hi", F.lit(self.shards)).cast("int").alias("shard")

    def insert(self, docs: DataFrame) -> None:
        """Adds the lines of documents, in place of those that the index holds of them."""
        if self.version:
            again = self.postings.select("doc_id").join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi").distinct()
            if not again.isEmpty():
                self.delete(written(again, "again"))
        self.version += 1
        posts = postings(docs, self.min_chars)
        # A document may come in several rows: its keys count once. Rows of one document that lie together were joined above.
        posts = posts.distinct() if self._repeated(docs) else posts
        old = self.references if self.version > 1 else None
        self._posts.append(self._write(posts, "postings"))
        new = self._count(self.spark.read.parquet(self._posts[-1]))
        if old is not None:
            new = old.unionByName(new).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        self._renew(old, new)

    @staticmethod
    def _repeated(docs: DataFrame) -> bool:
        return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents (doc_id) away: only keys that they held are counted anew."""
        old = self.references
        gone = doc_ids.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
        held = self.postings.join(gone, "doc_id", "left_semi").select(*KEY).distinct()
        left = self.postings.join(gone, "doc_id", "left_anti")
        self.version += 1
        path = self._write(left, "postings")
        self._posts = [path]
        again = self._count(self.postings.join(held, KEY, "left_semi"))
        self._renew(old, old.join(held, KEY, "left_anti").unionByName(again))

    def _renew(self, old: DataFrame | None, new: DataFrame) -> None:
        """Writes the references, then brings the filters up to date with the keys that crossed the bound."""
        self._refs = self._write(new, "references")
        hot = self.references.where(F.col("n_docs") >= self.min_docs).select(*KEY)
        shards = 1 << max(0, (hot.count() - 1) // SHARD_KEYS).bit_length()
        if old is None or shards > self.shards:
            self.shards = max(shards, self.shards)
            changes = hot.withColumn("up", F.lit(True))
            filters = None
        else:
            was = old.where(F.col("n_docs") >= self.min_docs).select(*KEY)
            changes = hot.join(was, KEY, "left_anti").withColumn("up", F.lit(True)).union(was.join(hot, KEY, "left_anti").withColumn("up", F.lit(False)))
            filters = self.filters

        def change(key, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            up = keys["up"].to_numpy(bool)
            f = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(2 * SHARD_KEYS if len(keys) > SHARD_KEYS else 2 * len(keys))
            f.remove(keys["key_lo"].to_numpy()[~up])
            full = not f.add(keys["key_lo"].to_numpy()[up])
            return pd.DataFrame({"shard": [key[0]], "filter": [f.dump()], "full": [full]})

        schema = "shard int, filter binary, full boolean"
        filters = filters if filters is not None else self.spark.createDataFrame([], schema)
        # A shard holds a bounded number of keys and one filter row.
        made = changes.select(self._shard(), "key_lo", "up").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(change, schema)
        self._filters = self._write(made, "filters")
        while not self.filters.where("full").isEmpty():
            # A filter overflowed: all of them again, over twice the shards.
            self.shards *= 2
            self.version += 1
            empty = self.spark.createDataFrame([], schema)
            made = hot.withColumn("up", F.lit(True)).select(self._shard(), "key_lo", "up").groupBy("shard").cogroup(empty.groupBy("shard")).applyInPandas(change, schema)
            self._filters = self._write(made, "filters")

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, filter binary, full boolean").parquet(self._filters)

    def _known(self):
        """A test of keys by all filters, None if they are too large to be sent to every task."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size > self.filter_bytes:
            return None
        blobs = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})
        shards = self.shards
        own: dict[int, CuckooFilter] = {}

        def known(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
            if not own and blobs.value:
                own.update((k, CuckooFilter.load(v)) for k, v in blobs.value.items())
            at = hi % shards
            out = np.zeros(len(hi), bool)
            for k, f in own.items():
                mine = at == k
                out[mine] = f.holds(lo[mine])
            return out

        return known

    def _probed(self, posts: DataFrame) -> DataFrame:
        """Those ``posts`` whose keys the filters know: each shard's filter comes first, then its keys stream past."""
        salts = max(1, posts.count() // (PROBES * self.shards))
        deal = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
        none = F.lit(None).cast("long")
        tables = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("place"), "filter", *(none.alias(c) for c in ("doc_id", *KEY)))
        keys = posts.select(self._shard(), deal.alias("salt"), F.lit(1).alias("place"), F.lit(None).cast("binary").alias("filter"), "doc_id", *KEY)
        dealt = tables.unionByName(keys).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "place")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, known = None, None
            for b in batches:
                at, place = b.column(0).to_numpy(), b.column(2).to_numpy()
                ids, hi, lo = (b.column(i).fill_null(0).to_numpy() for i in (4, 5, 6))
                keep = np.zeros(b.num_rows, bool)
                cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(place) != 0)) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                    if start == end:
                        continue
                    if place[start] == 0:
                        shard, known = at[start], CuckooFilter.load(b.column(3)[start].as_py())
                    elif at[start] == shard:
                        keep[start:end] = known.holds(lo[start:end])
                yield pa.record_batch([pa.array(ids[keep]), pa.array(hi[keep]), pa.array(lo[keep])], ["doc_id", *KEY])

        return dealt.mapInArrow(run, "doc_id long, key_hi long, key_lo long")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its text cleaned, and n_lines (before) and n_dropped."""
        known = self._known()
        hits = postings(docs, self.min_chars, known)
        hits = self._probed(hits) if known is None else hits
        hot = self.references.where(F.col("n_docs") >= self.min_docs)
        drop = hits.join(hot, KEY).where(F.col("doc_id") != F.col("keeper"))
        drop = drop.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set(F.struct(*KEY)).alias("drop_keys"))
        drop = drop.select("drop_id", F.transform("drop_keys", lambda k: k["key_hi"]).alias("drop_hi"), F.transform("drop_keys", lambda k: k["key_lo"]).alias("drop_lo"))
        rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "drop_id", "drop_hi", "drop_lo")]
        joined = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        joined = joined.join(drop, F.col("doc_id") == F.col("drop_id"), "left").drop("drop_id")
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, before, dropped = [], [], []
                hi, lo = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
                for i, text in enumerate(b.column(len(rest)).to_pylist()):
                    if not hi[i].is_valid:
                        texts.append(text)
                        before.append(text.count("\n") + 1)
                        dropped.append(0)
                        continue
                    out = {x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True) for x, y in zip(hi[i].as_py(), lo[i].as_py())}
                    lines = text.split("\n")
                    stay = [x for x in lines if line_key(x, min_chars) not in out]
                    texts.append("\n".join(stay))
                    before.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                yield pa.record_batch(
                    [*(b.column(i) for i in range(len(rest))), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())],
                    [*rest, "text", "n_lines", "n_dropped"],
                )

        schema = joined.select(*(F.col(f"`{c}`") for c in rest), "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
        return joined.mapInArrow(run, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark)
    index.insert(docs)
    return index.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
hot as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, h.key is not null and h.keeper <> k.doc_id as gone from keyed k left join hot h on k.key = h.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
