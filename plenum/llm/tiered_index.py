r"""Ranked lexical search over an index in tiers of falling impact.

A posting's impact is what one occurrence of its term in an item adds to the score, but for the term's weight. The index is dealt by
documents: a task turns its documents into shards of bounded postings. In a shard a term's postings are sorted by
impact: the first tier holds the highest, the next one more of them, the last one the rest, and each row keeps the
largest impact of the tiers below it, its residual. Rows lie in a folder for each tier, sorted by term. No term's
postings ever come together, however many documents hold it.

A search reads the first tier of the items' terms. In each shard it adds up what it has seen of a document, a lower
bound; with the residuals of the terms in which the document has not been seen yet, that is an upper bound. The
k-th highest lower bound over all shards is an item's bar. If every document of a shard is either scored in full or bounded below the bar, the pair
of shard and item is proven; all other pairs fall through to the next tier, and the last tier leaves nothing open. So
the result is exact.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased; null texts have none. A document or item
without an id takes no part. Every row is a document of its own, so a repeated doc_id may come twice; repeated item rows count once, and
the texts under one item_id are one item. Texts of any length are read whole, in slices. Equal scores go by doc_id. An
empty table gives no rows. Other columns are not read. Items are taken in blocks of bounded terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, written

#: Postings and documents of a shard; postings of a term in the tiers before the last; tokens that are counted at once; bytes of a slice of a text.
POSTINGS, DOCS, TIERS, TOKENS, SLICE = 1_200_000, 1 << 16, (64, 512), 1 << 19, 4 << 20
#: Terms of items that are searched at once.
BLOCK_TERMS = 500_000
_TO = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_ROWS = "shard long, tier int, term string, df int, ords binary, impacts binary, residual long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    text, at = text.translate(_TO), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else len(text)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) the documents with a term, and all terms."""
    docs = total = 0
    for b in batches:
        for text in b.column(1).cast(pa.binary()).to_pylist():
            n = sum(map(len, terms_of(text or b"")))
            docs, total = docs + (n > 0), total + n
    yield pa.record_batch([pa.array([docs]), pa.array([total])], ["docs", "terms"])


class Builder:
    """Collects the postings of a shard."""

    def __init__(self):
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0
        self.tokens: list[bytes] = []
        self.of: list[tuple[int, int]] = []

    def add(self, doc_id: int, text: bytes) -> None:
        at, n = len(self.ids), 0
        for tokens in terms_of(text):
            self.tokens += tokens
            self.of.append((at, len(tokens)))
            n += len(tokens)
            if len(self.tokens) >= TOKENS:
                self.count()
        self.ids.append(doc_id)
        self.lengths.append(n)

    def count(self) -> None:
        """Turns the tokens into postings (term << 16 | document) with their occurrences."""
        if self.tokens:
            coded = pa.array(self.tokens, pa.binary()).dictionary_encode()
            place = np.array([self.terms.setdefault(t, len(self.terms)) for t in coded.dictionary.to_pylist()])
            doc = np.repeat([d for d, _ in self.of], [n for _, n in self.of])
            key, tf = np.unique(place[coded.indices.to_numpy()] << 16 | doc, return_counts=True)
            self.parts.append((key, tf))
            self.postings += len(key)
        self.tokens, self.of = [], []

    def full(self) -> bool:
        return len(self.ids) >= DOCS or self.postings + len(self.tokens) // 2 >= POSTINGS

    def rows(self, shard: int, docs: int, terms: int, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        self.count()
        names = [c.split()[0] for c in _ROWS.split(", ")]
        one = [pa.array([shard]), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([len(self.ids)], pa.int32()), pa.array([np.array(self.ids, np.int64).tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([0])]
        yield pa.record_batch(one, names)
        if not self.parts:
            return
        key, tf = (np.concatenate(c) for c in zip(*self.parts))
        key, at = np.unique(key, return_inverse=True)
        tf = np.bincount(at, tf).astype(np.int64)
        term, doc = key >> 16, key & 0xFFFF
        m = 75 + 25 * np.array(self.lengths, np.int64) * docs // terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        tier = np.searchsorted(np.cumsum(tiers), np.arange(len(term)) - start[term], side="right")
        first = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(tier) != 0)))
        ends = np.append(first[1:], len(term))
        # The highest impact of what follows of the same term.
        residual = np.where((ends < len(term)) & (term[np.minimum(ends, len(term) - 1)] == term[first]), impact[np.minimum(ends, len(term) - 1)], 0)
        group = np.repeat(np.arange(len(first)), ends - first)
        order = np.lexsort((doc, group))
        offsets = np.append(first, len(term)).astype(np.int32)
        blob = lambda a: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets * np.int32(a.itemsize)), pa.py_buffer(a)])
        words = pa.array(list(self.terms), pa.binary()).take(pa.array(term[first])).cast(pa.string())
        columns = [
            pa.array(np.full(len(first), shard)), pa.array(tier[first].astype(np.int32)), words, pa.array((start[term[first] + 1] - start[term[first]]).astype(np.int32)),
            blob(np.ascontiguousarray(doc[order].astype(np.uint16))), blob(np.ascontiguousarray(impact[order].astype(np.uint32))), pa.array(residual),
        ]
        yield pa.record_batch(columns, names)


def index_rows(batches: Iterator[pa.RecordBatch], docs: int, terms: int, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of the index from (doc_id, text): for each shard one with its ids, at tier -1, and one for each term and tier."""
    shard, made = TaskContext.get().partitionId() << 24, Builder()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            made.add(doc_id, text or b"")
            if made.full():
                yield from made.rows(shard, docs, terms, tiers)
                shard, made = shard + 1, Builder()
    if made.ids:
        yield from made.rows(shard, docs, terms, tiers)


def build(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS) -> None:
    """Writes the index of ``docs`` (doc_id, text) to ``path``; ``tiers``: the most postings of a term that a shard puts into each tier before the last."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    stats = docs.mapInArrow(count_terms, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"))
    stats.write.parquet(f"{path}/stats")
    n, total = docs.sparkSession.read.parquet(f"{path}/stats").first()
    rows = docs.mapInArrow(lambda x: index_rows(x, n, max(1, total), tiers), _ROWS)
    rows.sortWithinPartitions("tier", "term").write.partitionBy("tier").parquet(f"{path}/postings")


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, terms, counts = [], [], []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            held: Counter = Counter()
            for tokens in terms_of(text or b""):
                held.update(tokens)
            ids += [item] * len(held)
            terms += held.keys()
            counts += held.values()
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["item_id", "term", "times"])


class Items:
    """A block of items: their terms and weights."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.terms = {t: k for k, t in enumerate(sorted({r[1] for r in rows}))}
        self.of: dict[int, list[tuple[int, int]]] = {}
        for item, term, weight in rows:
            self.of.setdefault(item, []).append((self.terms[term], weight))


class Shard:
    def __init__(self, items: Items):
        self.items, self.ids, self.open = items, np.zeros(0, np.int64), None
        self.lists: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}

    def take(self, b: pa.RecordBatch) -> None:
        for tier, term, ords, impacts, residual, item, bar in zip(*(b.column(c).to_pylist() for c in ("tier", "term", "ords", "impacts", "residual", "item_id", "bar"))):
            if tier == -2:
                self.open = self.open or {}
                self.open[item] = bar
            elif tier == -1:
                self.ids = np.frombuffer(ords, np.int64)
            else:
                self.lists.setdefault(self.items.terms[term], []).append((np.frombuffer(ords, np.uint16), np.frombuffer(impacts, np.uint32).astype(np.int64), residual))

    def scored(self, terms: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Each document's lower bound, and what the tiers below may add to it."""
        low, seen, rest = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64), 0
        for term, weight in terms:
            rows = self.lists.get(term, [])
            residual = min((r for _, _, r in rows), default=0) * weight
            rest += residual
            for ords, impacts, _ in rows:
                low[ords] += impacts * weight
                if residual:
                    seen[ords] += residual
        return low, rest - seen

    def best(self, k: int, bars: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each open item the ids, lower bounds and whether these are exact of the documents that may count, and the highest upper bound of any that isn't exact."""
        for item, bar in (self.open if self.open is not None else dict.fromkeys(self.items.of, 0)).items():
            low, missing = self.scored(self.items.of[item])
            bar = max(bar, bars.get(item, 0), 1)
            top = int((low + missing)[missing > 0].max(initial=0))
            may = np.flatnonzero(low >= bar)
            may = may[np.lexsort((self.ids[may], -low[may]))[:k]]
            if len(may) == k:
                bars[item] = max(bar, int(low[may[-1]]))
            yield item, self.ids[may], low[may], missing[may] == 0, top


def score_rows(batches: Iterator[pa.RecordBatch], items: Items, k: int) -> Iterator[pa.RecordBatch]:
    """item_id, shard, doc_id, score, exact of documents, and item_id, shard, bound, from rows sorted by (shard, tier)."""
    bars: dict[int, int] = {}
    now, shard = None, Shard(items)

    def told() -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for item, ids, low, exact, top in shard.best(k, bars):
            for column, x in zip(out, (np.full(len(ids) + 1, item), np.append(ids, -1), np.append(low, 0), np.append(exact, False), np.append(np.full(len(ids), -1), top))):
                column.append(x)
        if out[0]:
            item, ids, low, exact, top = map(np.concatenate, out)
            yield pa.record_batch([pa.array(item), pa.array(np.full(len(item), now)), pa.array(ids), pa.array(low), pa.array(exact), pa.array(top)], ["item_id", "shard", "doc_id", "score", "exact", "bound"])

    for b in batches:
        ids = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                if ids[lo] != now:
                    yield from told()
                    now, shard = ids[lo], Shard(items)
                shard.take(b.slice(lo, hi - lo))
    yield from told()


class TieredIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings = spark.read.schema(_ROWS).parquet(f"{path}/postings")
        self.docs, self.total = spark.read.parquet(f"{path}/stats").first()
        #: Pairs of shard and item that each tier was asked for, in the last search.
        self.asked: list[int] = []

    def search(self, items: DataFrame, k: int = 20, tiers: int = len(TIERS) + 1) -> DataFrame:
        """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for each of ``items`` (item_id, text). ``tiers``: of the index."""
        items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct()
        asked = items.mapInArrow(item_terms, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))
        asked = written(asked, "item-terms")
        held = self.postings.where("tier = 0").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * self.docs + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("times")
        asked = written(asked.join(held, "term").select("item_id", "term", weight.alias("weight")).where("weight > 0"), "item-weights")
        blocks = -(-asked.count() // BLOCK_TERMS)
        self.asked = [0] * tiers
        found = None
        for n in range(blocks):
            block = Items([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).collect()])
            part = self._block(block, k, tiers)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

    def _block(self, items: Items, k: int, tiers: int) -> DataFrame:
        """The scored documents of a block of items that may be among the best."""
        done, open_pairs = None, None
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        for tier in range(tiers):
            terms = self.spark.createDataFrame([(t,) for t in items.terms], "term string")  # bounded by BLOCK_TERMS
            rows = self.postings.where(f"tier between 0 and {tier}").join(F.broadcast(terms), "term", "left_semi").unionByName(self.postings.where("tier = -1"))
            rows = rows.select("shard", "tier", "term", "ords", "impacts", "residual", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("bar"))
            if open_pairs is not None:
                asked = open_pairs.selectExpr("shard", "-2 as tier", "cast(null as string) as term", "cast(null as binary) as ords", "cast(null as binary) as impacts", "0L as residual", "item_id", "bar")
                rows = rows.join(open_pairs.select("shard").distinct(), "shard", "left_semi").unionByName(asked)
            dealt = rows.repartition("shard").sortWithinPartitions("shard", "tier")
            got = written(dealt.mapInArrow(lambda x: score_rows(x, items, k), "item_id long, shard long, doc_id long, score long, exact boolean, bound long"), f"tier-{tier}")
            docs = got.where("bound = -1").drop("bound")
            everything = docs if done is None else docs.unionByName(done)
            bars = everything.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("item_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(1).alias("bar"))
            pairs = got.where("bound > 0").join(bars, "item_id", "left").withColumn("bar", F.coalesce("bar", F.lit(1))).where("bound >= bar")
            open_pairs = written(pairs.select("shard", "item_id", "bar"), f"open-{tier}")
            n = open_pairs.count()
            if tier + 1 < tiers:
                self.asked[tier + 1] += n
            proven = docs.where("exact").join(open_pairs, ["shard", "item_id"], "left_anti")
            done = proven if done is None else done.unionByName(proven)
            if not n:
                break
        return done


def op11_tiered_search(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tiered-index")
    build(table(spark, sf_dir, "documents"), path)
    return TieredIndex(spark, path).search(table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents where doc_id is not null),
total as (select count(*) filter (len(ts) > 0) as docs, sum(len(ts))::bigint as terms from lowered),
tf as (select doc_id, n, term, count(*) as tf from (select doc_id, len(ts) as n, unnest(ts) as term from lowered) group by all),
df as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term),
asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark where item_id is not null)) group by all),
scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from asked join df using (term) join tf using (term), total group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""
