"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, exact links, components.

Fingerprints. A document's words, lower-cased, give shingles; a fingerprint bit is one if it is set in
over half of the shingles' 64-bit hashes.

Trees. Two fingerprints that differ in at most r bits agree on at least one of the choices of m - r out
of m blocks of bits. For each choice there is a tree of vantage points, by the Hamming distance over the
chosen bits: each level deals fingerprints to rings by their distance to that level's vantage point.
The triangle bound |d(x, v) - d(y, v)| <= d(x, y) says that linked fingerprints lie in the same ring of
every level in the tree of the choice on which they agree, at distance 0, so there no query crosses a
ring. A leaf is a shard; in it a vantage-point tree over all 64 bits splits at the median distance, and a
branch is compared with the other only over the margin of r bits at the boundary.

Scale. Copies meet in one group of a map-side aggregation before any tree. m grows with the number of
fingerprints, so that shards stay small. A shard over ``SHARD`` fingerprints is split on, round by round, by
the distance to a vantage point of its own over all 64 bits: a fingerprint up to the split's radius plus r goes
to the inner shard, one beyond the radius to the outer one, so those at the boundary are in both and no link is
lost. A shard that such a split doesn't shrink is cut into blocks, and each pair of blocks is a task's own query,
by one tree over both, so no group grows without bound. A shard gives a spanning forest of its links, never all its
pairs, and the components come from alternating star steps on tables in the shared folder. Fingerprints of very
many documents, at most 100,000 of them, are sent to the documents; the others are joined.

Null or empty text: no words, fingerprint zero. Null doc_id: gets a fingerprint, its component is that of
the other documents with its fingerprint. Rows with an equal doc_id count as one document each. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SHARD = 4096
#: Routed fingerprints that a search task should hold on average.
TASK_ROWS = 1 << 16
#: Blocks of bits for up to so many fingerprints; the last for any number.
BLOCKS = ((1 << 23, 1), (1 << 31, 2))
LEVELS = 8


def fingerprint(words: list[bytes], width: int, seed: int) -> int:
    import xxhash

    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = len(words) - width + 1
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    # Steps of 255 hashes keep the sums within a byte.
    for at in range(0, n, 255):
        ones += np.unpackbits(h[at : at + 255].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint((t.as_py() or "").encode().lower().split(), width, seed) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, agree: int) -> list[int]:
    """For each choice of ``agree`` out of ``blocks`` blocks of the 64 bits, the bits of the chosen blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(one, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b that differ in at most ``radius`` bits, in steps of bounded memory."""
    out_i, out_j = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        out_i.append(i + at)
        out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


class Forest:
    """Keeps those of the links that join two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, pairs) -> None:
        for x, y in zip(*(p.tolist() for p in pairs)):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((x, y))


def vantage_links(fps: np.ndarray, radius: int, forest: Forest, side: np.ndarray | None = None, leaf: int = 512) -> int:
    """Joins all pairs of ``fps`` within ``radius``, or those between both sides: a vantage-point tree whose branches meet at the boundary only. Returns how many pairs were compared."""
    compared = 0

    def meet(a: np.ndarray, b: np.ndarray, same: bool) -> None:
        nonlocal compared
        groups = [(a, b)] if side is None else [(a[~side[a]], b[side[b]]), *([] if same else [(a[side[a]], b[~side[b]])])]
        for x, y in groups:
            compared += len(x) * len(y)
            i, j = near(fps[x], fps[y], radius)
            keep = i < j if same and side is None else slice(None)
            forest.join((x[i[keep]], y[j[keep]]))

    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if side is not None and (side[at].all() or not side[at].any()):
            continue
        d = np.bitwise_count(fps[at] ^ fps[at[0]]).astype(np.int64) if len(at) > leaf else None
        if d is None or d.min() == d.max():
            meet(at, at, True)
            continue
        middle = min(int(np.median(d)), int(d.max()) - 1)
        todo += [at[d <= middle], at[d > middle]]
        # The triangle bound: a pair across the split lies within the radius of it on both sides.
        meet(at[(d <= middle) & (d > middle - radius)], at[(d > middle) & (d <= middle + radius)], False)
    return compared


def _shard(side: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> np.ndarray:
    """Links (two rows of nodes) of one shard, or of one pair of blocks of a large shard: side 0 alone, or side 0 against side 1."""
    forest = Forest(len(fp))
    vantage_links(fp.view(np.uint64), radius, forest, side.astype(bool) if side.any() else None)
    return node[np.array(forest.links, np.int64).reshape(-1, 2).T]


def search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of all shards in sorted rows (tree, leaf, x, y, side, fp, node); only the last shard waits for the next batch."""
    held = np.zeros((7, 0), np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], 1)
        ends = (np.flatnonzero((held[:4, 1:] != held[:4, :-1]).any(0)) + 1).tolist()
        if batch is None:
            ends.append(held.shape[1])
        found, at = [np.zeros((2, 0), np.int64)], 0
        for end in ends:
            if end - at > 1:
                found.append(_shard(*held[4:, at:end], radius))
            at = end
        held = held[:, at:]
        a, b = np.concatenate(found, 1)
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _best_split(hist: pd.DataFrame, radius: int) -> tuple[int, int]:
    """The radius of a split whose larger side, with its margin, is smallest, and that side's size; ``hist`` (d, n) of one shard."""
    n = np.zeros(65 + radius, np.int64)
    n[hist["d"].to_numpy()] = hist["n"].to_numpy()
    upto = np.cumsum(n)
    larger = [max(upto[min(m + radius, 64)], upto[-1] - upto[m]) for m in range(64)]
    return int(np.argmin(larger)), int(min(larger))


def _split(rows: DataFrame, radius: int, shard: int) -> DataFrame:
    """tree, leaf, fp, node, blocks of all ``rows`` (tree, leaf, fp, node) in shards of two or more; those of large shards are split by vantage points while that shrinks them."""
    done = None
    for _ in range(64):
        sizes = written(rows.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("v")).where("n > 1"), "shard_sizes")
        small = rows.join(sizes.where(F.col("n") <= shard).select("tree", "leaf"), ["tree", "leaf"]).withColumn("blocks", F.lit(1))
        done = small if done is None else done.unionByName(small)
        large = sizes.where(F.col("n") > shard)
        if large.isEmpty():
            return done
        far = rows.join(large, ["tree", "leaf"]).withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))).cast("int"))
        far = written(far, "distances")

        def plan(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
            m, left = _best_split(hist, radius)
            return pd.DataFrame({"tree": [key[0]], "leaf": [key[1]], "m": [m], "shrinks": [bool(left <= 0.8 * hist["n"].sum())]})

        # At most 65 rows for a shard.
        cuts = far.groupBy("tree", "leaf", "d").agg(F.count("*").alias("n")).groupBy("tree", "leaf").applyInPandas(plan, "tree long, leaf long, m int, shrinks boolean")
        planned = far.join(written(cuts, "splits"), ["tree", "leaf"])
        done = done.unionByName(planned.where("not shrinks").select("tree", "leaf", "fp", "node", F.ceil(F.col("n") / F.lit(shard)).cast("int").alias("blocks")))
        sides = F.array(F.when(F.col("d") <= F.col("m") + radius, 0), F.when(F.col("d") > F.col("m"), 1))
        rows = planned.where("shrinks").withColumn("side", F.explode(F.filter(sides, lambda x: x.isNotNull())))
        rows = written(rows.select("tree", F.xxhash64("leaf", "v", "side").alias("leaf"), "fp", "node"), "routed")
    raise RuntimeError("a shard did not end after 64 splits")  # each split leaves four fifths at most


def links(points: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """A spanning set (a, b) of the links between ``points`` (fp, node; fingerprints distinct)."""
    spark = points.sparkSession
    n = points.count()
    agree = next((k for most, k in BLOCKS if n <= most), 3)
    # The first fingerprints by a hash are the vantage points: a number that does not grow with the rows.
    vantage = [r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(LEVELS).collect()]
    trees = []
    for k, mask in enumerate(masks(radius + agree, agree)):
        # Seven bits hold a distance of up to 64.
        rings = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(v)).bitwiseAND(F.lit(_signed(mask)))).cast("long"), 7 * i) for i, v in enumerate(vantage)]
        trees.append(F.struct(F.lit(k).cast("long").alias("tree"), sum(rings, F.lit(0).cast("long")).alias("leaf")))
    routed = points.select("fp", "node", F.explode(F.array(*trees)).alias("t")).select("fp", "node", "t.tree", "t.leaf")
    dealt = _split(written(routed, "routed"), radius, shard)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    # A row goes to the pairs (block, j) as side 0 and to the pairs (i, block) as side 1; the pair (block, block) is the block alone.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, F.col("block")).cast("long").alias("x"), F.greatest(j, F.col("block")).cast("long").alias("y"), F.when(j < F.col("block"), 1).otherwise(0).cast("long").alias("side")),
    )
    tasks = dealt.select("tree", "leaf", "fp", "node", F.explode(pairs).alias("p")).select("tree", "leaf", "p.x", "p.y", "p.side", "fp", "node")
    # Few bytes but much work: the number of tasks follows the rows, and a number that is given isn't coalesced.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(trees) // TASK_ROWS))
    # Most shards hold a few rows: sorted rows spare each of them a group's set-up.
    ordered = tasks.repartition(parts, "tree", "leaf", "x", "y").sortWithinPartitions("tree", "leaf", "x", "y")
    found = ordered.mapInArrow(lambda batches: search(batches, radius), "a long, b long")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes in ``edges`` (a, b), by alternating star steps.

    Each round points the larger neighbours of a node at its smallest one, then the node's smaller
    neighbours; the number of rounds grows as the logarithm of the longest chain. Tables between rounds
    lie in the shared folder.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("n").agg(F.min("m").alias("least"))

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
        both = both.union(both.select("m", "n")) if large else both.select(F.greatest("n", "m").alias("n"), F.least("n", "m").alias("m"))
        low = smallest(both).withColumn("least", F.least("n", "least"))
        out = both.join(low, "n")
        if large:
            out = out.where("m > n").select(F.col("least").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("least").alias("a"), F.col("m").alias("b")).union(low.select(F.col("least").alias("a"), F.col("n").alias("b")))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    now = written(edges, "edges")
    while True:
        new = written(star(star(now, True), False), "edges")
        # The steps are at rest if each node above its component has one edge, which leads to it.
        same = now.join(new, ["a", "b"], "left_anti").isEmpty() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        now = new
        if same:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id of ``docs`` (doc_id, text)."""
    prints = written(fingerprints(docs, width, seed), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_docs")), "points")
    grouped = components(links(points.where("node is not null").select("fp", "node"), radius))
    # A fingerprint without links is a component of its own.
    labelled = written(points.join(grouped, "node", "left").select("fp", "n_docs", F.coalesce("component", "node").alias("component_id")), "components")
    # Fingerprints with over a 100,000th of all documents, so at most 100,000 rows of 24 bytes, are sent to the documents; the rest meet in a shuffle.
    most = max(1024, labelled.agg(F.sum("n_docs")).first()[0] or 0) // 100_000
    hot = F.col("n_docs") > max(1024, most)
    large = F.broadcast(labelled.where(hot).drop("n_docs"))
    one = prints.join(large, "fp")
    rest = prints.join(large.select("fp"), "fp", "left_anti").join(labelled.where(~hot).drop("n_docs"), "fp")
    return one.unionByName(rest).select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
