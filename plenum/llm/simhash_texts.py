"""SimHash near-dedup of texts: candidates from fingerprints and minima, links by exact five-word Jaccard similarity.

A fingerprint's radius says little about a similarity of 0.8: there five-word fingerprints differ in about ten of
64 bits, and no vantage-point tree prunes at such a radius. So candidates come in two steps.

1. Fingerprints over five-word shingles are linked by the vantage-point trees of ``simhash`` at a radius of 3; each
   component of these links is a bucket of texts to be compared. Most copies meet here.
2. Of ``BANDS`` times ``ROWS`` minima of a text's shingle hashes each ``ROWS`` make a band, and texts with an equal band
   share a bucket. Two texts of similarity s miss each other with probability (1 - s^ROWS)^BANDS: 2.6e-5 at 0.8.

A bucket whose texts are in one component already is left alone. The others are compared inside tasks, on whole
shingle sets: vantage points are taken in the order of how common their shingles are in the bucket, so that the
original of many copies comes first; texts of similarity 0.8 or more join it. Further vantage points meet only texts
of other components, of a fitting size, and in a fitting ring: Jaccard distance obeys the triangle inequality, so
linked texts lie within 0.2 of each other's distance to the first vantage point. A task hands on a spanning forest
of the links, never all its pairs. Large buckets are cut into blocks of bounded bytes: first each block meets the
texts at the bucket's centre, then, where texts are still apart, each other block.

Equal shingle sets are one node before any of that, and each node's set is read from one of its texts. Texts without
words are equal; up to five words are one shingle. Null doc_id: not part of any group. Rows are told apart by
doc_id and text; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .simhash import components, links

WIDTH, BANDS, ROWS = 5, 20, 4
#: Texts and bytes of shingle sets of a block.
BLOCK, BLOCK_BYTES = 2048, 32 << 20


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    n = len(words) - width + 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, n))


def fingerprint(own: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 255):
        ones += np.unpackbits(own[at : at + 255].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0])


def bands(own: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    import xxhash

    if not len(own):
        return []
    mixed = own[None, :] * factors[:, None] + shifts[:, None]
    mixed ^= mixed >> np.uint64(32)
    least = mixed.min(1).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least)]


def sketches(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, t (a hash of the text), node (a hash of the shingle set), fp, size, bands of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(seed)
        factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        for b in batches:
            nodes, fps, sizes, cut = [], [], [], []
            for text in b.column(2):
                own = shingles(text.as_py())
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                fps.append(fingerprint(own))
                sizes.append(len(own))
                cut.append(np.array(bands(own, factors, shifts), np.uint64).view(np.int64))
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(cut, pa.list_(pa.int64()))],
                ["doc_id", "t", "node", "fp", "size", "bands"],
            )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, t long, node long, fp long, size int, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, own (the shingle set) of ``nodes`` (node, doc_id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), own], ["node", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    # By a shuffle at every size: the nodes grow with the texts.
    return rows.join(nodes.hint("merge"), ["doc_id", "t"]).select("node", "text").mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


class _Trees:
    """Components of the rows of a bucket, and the links that made them."""

    def __init__(self, comp: np.ndarray):
        self.of = np.unique(comp, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def join(self, at: int, others: np.ndarray) -> None:
        for x in others.tolist():
            a, b = self.of[at], self.of[x]
            if a != b:
                self.of[self.of == max(a, b)] = min(a, b)
                self.links.append((at, x))


def linked(comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links between the components of some texts: pairs of places; between both sides only, if there are two."""
    n, trees = len(sets), _Trees(comp)
    size = np.array([len(s) for s in sets])
    one, (values, at) = not side.any() or side.all(), np.unique(np.concatenate(sets), return_inverse=True)
    owner, ends = np.repeat(np.arange(n), size), np.append(0, np.cumsum(size))
    common = np.bincount(owner, np.bincount(at)[at], n) / np.maximum(size, 1)
    order = np.argsort(-common, kind="stable")
    waiting, ring = np.ones(n, bool), None
    for v in order.tolist():
        waiting[v] = False
        fit = waiting & (trees.of != trees.of[v]) & (np.minimum(size, size[v]) >= similar * np.maximum(size, size[v]) - 1e-9)
        fit &= True if one else side != side[v]
        if ring is not None:
            fit &= np.abs(ring - ring[v]) <= 1 - similar + 1e-9
        if not fit.any() and ring is not None:
            continue
        seen = np.zeros(len(values), bool)
        seen[at[ends[v] : ends[v + 1]]] = True
        some = np.flatnonzero(fit)
        if ring is None or 8 * len(some) > n:
            both = np.bincount(owner, seen[at], n)
        else:
            both = np.zeros(n)
            both[some] = [np.count_nonzero(seen[at[ends[i] : ends[i + 1]]]) for i in some.tolist()]
        share = both / np.maximum(size + size[v] - both, 1)
        ring = 1 - share if ring is None else ring
        trees.join(v, np.flatnonzero(fit & (share >= similar)))
        if not (trees.of != trees.of[0]).any():
            break
    return trees.links


def compare(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between nodes in sorted rows (bucket, x, y, side, comp, node, own); only one group of rows waits for the next batch."""
    held: list[tuple] = []

    def close() -> tuple[np.ndarray, np.ndarray]:
        _, side, comp, node, sets = zip(*held)
        pairs = np.array(linked(np.array(comp), np.array(side), list(sets), similar), np.int64).reshape(-1, 2)
        return np.array(node, np.int64)[pairs[:, 0]], np.array(node, np.int64)[pairs[:, 1]]

    for b in batches:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
        side, comp, node = (b.column(i).to_pylist() for i in (3, 4, 5))
        starts, flat = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy().view(np.uint64)
        for i, key in enumerate(keys):
            if held and held[0][0] != key:
                out.append(close())
                held = []
            held.append((key, side[i], comp[i], node[i], flat[starts[i] : starts[i + 1]].copy()))
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b"])
    if held:
        yield pa.record_batch([pa.array(c) for c in close()], ["a", "b"])


def _open(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, node, size, fp, comp of those ``buckets`` (bucket, node, size, fp) whose nodes are not all in one component."""
    d = buckets.withColumn("comp", F.col("node")) if labels is None else buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    d = written(d, "labelled")
    return written(d.join(d.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket"), "bucket", "left_semi"), "open")


def found_links(open_buckets: DataFrame, sets: DataFrame, similar: float, whole: bool, again: bool = False) -> DataFrame:
    """a, b: links inside the buckets. Blocks of a large bucket meet its centre, or with ``whole`` each other; small buckets are compared whole, and not ``again``."""
    sizes = open_buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("s"), *(F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") * 8 / BLOCK_BYTES)).cast("int")
    middle = sum((F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)), F.lit(0).cast("long"))
    sizes = written(sizes.select("bucket", blocks.alias("blocks"), middle.alias("middle")), "sizes")
    if again:
        sizes = sizes.where("blocks > 1")
    d = open_buckets.join(sizes, "bucket").withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).cast("int"))
    # Block 0 holds texts near the centre: those up to a distance that about a block's share has. It only decides who meets first.
    near = d.where("blocks > 1").groupBy("bucket").agg(F.percentile_approx("far", F.lit(0.02), 1000).alias("near"))
    d = d.join(near, "bucket", "left").withColumn("hash", F.xxhash64("node", F.lit(7)))
    centre = (F.col("far") <= F.col("near")) & (F.pmod("hash", F.col("blocks")) == 0)
    d = d.withColumn("block", F.when(F.col("blocks") == 1, 0).when(centre, 0).otherwise(1 + F.pmod("hash", F.col("blocks") - 1)).cast("int"))
    last = F.col("blocks") - 1
    partners = F.when(F.col("block") == 0, F.sequence(F.lit(0), last)).otherwise(F.sequence(F.lit(0), last) if whole else F.array(F.lit(0)))
    pairs = F.transform(partners, lambda j: F.struct(F.least(j, F.col("block")).alias("x"), F.greatest(j, F.col("block")).alias("y"), (j < F.col("block")).cast("int").alias("side")))
    tasks = d.select("bucket", "comp", "node", F.explode(pairs).alias("p")).select("bucket", "p.x", "p.y", "p.side", "comp", "node").join(sets, "node")
    spark = tasks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tasks.select("bucket", "x", "y", "side", "comp", "node", "own").repartition(parts, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    found = ordered.mapInArrow(lambda batches: compare(batches, similar), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similar: float = 0.8) -> DataFrame:
    """doc_id, t, keeper (the smallest doc_id of the component) of ``docs`` (doc_id, text)."""
    rows = written(sketches(docs), "sketches")
    points = written(rows.groupBy("node").agg(F.min(F.struct("doc_id", "t", "fp", "size", "bands")).alias("p")).select("node", "p.*"), "points")
    prints = points.groupBy("fp").agg(F.min("node").alias("node"))
    by_print = components(links(prints)).join(prints, "node").select("fp", F.col("component").alias("bucket"))
    close = points.join(by_print, "fp", "left").select(F.coalesce("bucket", "fp").alias("bucket"), "node", "size", "fp")
    met = points.select(F.explode("bands").alias("bucket"), "node", "size", "fp")
    shared = lambda d: written(d.join(d.groupBy("bucket").count().where("count > 1").select("bucket"), "bucket", "left_semi"), "buckets")
    close, met = shared(close), shared(met)
    asked = close.select("node").union(met.select("node")).distinct()
    sets = written(sets_of(docs, written(points.join(asked, "node", "left_semi").select("node", "doc_id", "t"), "asked")), "sets")
    edges = labels = None
    for buckets, whole, again in ((close, True, False), (met, False, False), (met, True, True)):
        still = _open(buckets, labels)
        if still.isEmpty():
            continue
        new = found_links(still, sets, similar, whole, again)
        edges = written(new if edges is None else edges.union(new), "links")
        labels = components(edges)
    labelled = points.select("node", "doc_id", F.col("node").alias("c")) if labels is None else points.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("c"))
    keepers = labelled.groupBy("c").agg(F.min("doc_id").alias("keeper"))
    return rows.join(labelled.join(keepers, "c").select("node", "keeper"), "node").select("doc_id", "t", "keeper")
