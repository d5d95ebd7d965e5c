"""A document classifier of supervised subword embeddings.

A text's features are its words and the byte n-grams of its words, hashed into one table of learned
vectors. A document is the mean of its features' vectors; a softmax layer on the mean gives the classes.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows, drawn by
a hash of the id: ``sample`` rows, the only bound. As the output is linear in the mean, a trained model
scores a text by one number for each hash bucket, so scoring is a vectorised pass over the bytes inside
the read tasks, over every whole text.

Words are runs of bytes other than ASCII white space; features are over UTF-8 bytes after A-Z are
lower-cased. Null or empty texts have no features: their score is that of the classes' shares. Null ids are kept and
are never in the sample. Of repeated labelled ids every row may be in the sample. Rows with equal ids are scored each; of several labels of a document the
largest counts. Texts are hashed a slice after the other, so memory doesn't grow with them. Without labels all scores are 0.5. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAMS = (3, 4, 5)
#: Bytes of a text that are hashed at a time.
SLICE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: White space among the bytes.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _scatter(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def feature_slices(text, buckets: int, size: int = SLICE) -> Iterator[np.ndarray]:
    """The hash bucket of each word and of each n-gram inside a word, for ``size`` bytes after the other of any buffer; each feature comes where it ends."""
    whole, lead = np.frombuffer(text, np.uint8), GRAMS[-1] - 1
    word, place = np.uint64(0), 0  # of the word that the last slice left open
    for at in range(0, len(whole), size):
        back = min(at, lead)
        b = _LOWER[whole[at - back : at + size]]
        blank = _BLANK[b]
        x = b.astype(np.uint64) + np.uint64(1)
        out = []
        # A polynomial hash of each n-gram; those that touch white space are none, those that end in the bytes before have been told.
        h, free = x.copy(), ~blank
        for n in range(2, GRAMS[-1] + 1):
            if len(b) < n:
                break
            h = h[:-1] * ODD + x[n - 1 :]
            free = free[:-1] & ~blank[n - 1 :]
            if n in GRAMS:
                new = max(0, back - n + 1)
                out.append(_scatter(h[new:][free[new:]] + np.uint64(n), buckets))
        # A word's hash is the sum of its bytes times powers that count from its start.
        x, blank = x[back:], blank[back:]
        edge = np.diff(np.concatenate(([0], (~blank).view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if place and (blank[0] or not len(start)):
            out.append(_scatter(np.array([word]), buckets))
            word, place = np.uint64(0), 0
        if len(start):
            powers = np.cumprod(np.full(int((end - start).max()) + 1, ODD))
            own = np.arange(len(x)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(x)]))))
            weighed = np.where(blank, np.uint64(0), x * powers[np.minimum(own, len(powers) - 1)])
            hashes = np.add.reduceat(weighed, start)
            if place:
                hashes[0] = np.uint64((int(word) + int(hashes[0]) * pow(int(ODD), place, 1 << 64)) % (1 << 64))
            if end[-1] == len(x):
                word, place = hashes[-1], int(end[-1] - start[-1]) + (place if len(start) == 1 else 0)
                hashes = hashes[:-1]
            else:
                word, place = np.uint64(0), 0
            out.append(_scatter(hashes, buckets))
        yield np.concatenate([np.zeros(0, np.int64), *out])
    if place:
        yield _scatter(np.array([word]), buckets)


def features(text, buckets: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *feature_slices(text, buckets)])


def bag(text, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often they come: at most a row for each bucket, however long the text."""
    total = np.zeros(buckets, np.int64)
    for part in feature_slices(text, buckets):
        total += np.bincount(part, minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """``weight``: for each bucket the difference of the two classes' outputs; ``bias`` likewise."""

    weight: np.ndarray
    bias: float

    def score(self, text) -> float:
        total, n = 0.0, 0
        for f in feature_slices(text, len(self.weight)):
            total, n = total + float(self.weight[f].sum()), n + len(f)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(docs: list, labels: list[int], buckets: int = 1 << 16, size: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 0) -> Model:
    """Stochastic gradient descent over ``docs``, texts or their ``bag``s, one at a time, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    if not len(y):
        return Model(np.zeros(buckets), 0.0)
    vectors = rng.uniform(-1, 1, (buckets, size)) / size
    out, bias = np.zeros((2, size)), np.log((np.bincount(y, minlength=2) + 1) / (len(y) + 2))
    bags = [d if isinstance(d, tuple) else bag(d, buckets) for d in docs]
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            now = rate * (1 - done / steps)
            done += 1
            ids, n = bags[i]
            if not len(ids):
                continue
            share = (n / n.sum())[:, None]
            mean = (vectors[ids] * share).sum(0)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = p @ out
            out -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            # The mean's gradient is shared out by the features' parts, scaled as if each document had 100 features.
            vectors[ids] -= now * np.minimum(share * 100, 1.0) * step
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, buckets: int = 1 << 16, **how) -> Model:
    """Trains on ``sample`` rows at most of ``docs`` (doc_id, text) with ``labels`` (doc_id, label 0 or 1): those whose ids, then texts, have the smallest hashes.

    Tasks count the features; the driver gets a row's counts, not its text.
    """
    own = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most ``sample`` ids, so they are broadcast.
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text").cast("string")).join(F.broadcast(own), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column("text").cast(pa.binary())):
                at, n = bag(text.as_buffer() if text.is_valid else b"", buckets)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int32()))
                yield pa.record_batch([*(b.column(c).slice(k, 1) for c in ("doc_id", "h", "label")), one(at), one(n)], ["doc_id", "h", "label", "at", "n"])

    counted = rows.mapInArrow(count, "doc_id long, h long, label int, at array<int>, n array<int>")
    # Repeated ids may give more rows, so the bound holds for these; each task keeps its first rows only.
    first = counted.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample).toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    bags = [(at.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64)) for at, n in zip(first["at"], first["n"])]
    return train(bags, first["label"].to_pylist(), buckets=buckets, **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(t.as_buffer() if t.is_valid else b"") for t in b.column(1).cast(pa.binary())]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
