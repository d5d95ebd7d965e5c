"""Byte-level BPE by ranks, with texts cut into overlapping chunks.

A text is cut into chunks of ``chunk`` code points, each with ``overlap`` more at its end, and each
chunk is pre-tokenised alone, in parallel over Spark's tasks. A match of the pattern depends only on the
text from its start, so once two neighbours have a boundary at the same place in their overlap they agree
from there on: there they are stitched. The piece of each chunk between its two stitches is encoded in
parallel; a document's ids are the pieces' ids in a row. Where neighbours share no boundary (one match
longer than the overlap), they are joined and pre-tokenised again from the last sure boundary.
Decoding joins the bytes of the ids, so bytes that are no valid UTF-8 alone are kept.

Texts of one chunk need no stitching and never leave their task. Only texts over a chunk are shuffled.

Null or empty text gives no ids. A null doc_id is kept. Rows with an equal doc_id are documents of their
own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A boundary is sure if so many code points of the chunk follow; more than any alternative of the pattern looks ahead.
AHEAD = 16
MEMORY = 400_000


class Codec:
    """Encodes each match of the pattern separately; keeps the ids of pieces met before, up to a bound."""

    def __init__(self, ranks_path: str, pattern: str, memory: int = MEMORY):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def matches(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def bounds(self, text: str, start: int = 0) -> np.ndarray:
        """The ends of all matches from ``start`` on."""
        return np.fromiter((m.end() for m in self.pattern.finditer(text, start)), np.int64)

    def between(self, text: str, start: int, end: int) -> list[str]:
        """The matches from ``start`` to the boundary ``end``. The pattern sees what follows ``end``: it may look ahead."""
        out = []
        for m in self.pattern.finditer(text, start):
            if m.start() >= end:
                break
            out.append(m[0])
        return out

    def encode(self, pieces: list[str]) -> bytes:
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > self.memory:
                self.known.clear()
            single = self.library._encode_single_piece if hasattr(self.library, "_encode_single_piece") else self.library.encode_single_piece
            for at, (p, x) in enumerate(zip(pieces, found)):
                if x is None:
                    if (x := self.known.get(p)) is None:
                        x = self.known[p] = np.array(single(p), "<u4").tobytes()
                    found[at] = x
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def stitch(c: Codec, left: str, right: str, chunk: int, sure: int = 0) -> tuple[int, int]:
    """The first boundary that ``left`` and ``right``, the text from ``chunk`` on, share; as a place in left.

    ``sure`` is a boundary of ``left``. Returns it, and -1 or the place if they share none.
    """
    a = c.bounds(left, sure)
    a = a[(a >= chunk) & (a <= len(left) - AHEAD)]
    b = np.append(0, c.bounds(right[: len(left) - chunk])) + chunk
    both = np.intersect1d(a, b[b <= len(left) - AHEAD])
    return (int(both[0]), 1) if len(both) else (-1, 0)


def encode_long(c: Codec, chunks: list[tuple[str, bool]], chunk: int) -> list[bytes]:
    """Ids of a text whose overlapping chunks come in order; the second of each pair is True for the last."""
    out, start, text = [], 0, ""
    for at, (part, last) in enumerate(chunks):
        text = text[:] + part if not text else text
        if last:
            out.append(c.encode(c.matches(text[start:])))
            break
        nxt = chunks[at + 1][0]
        base = len(text) - (len(part) - chunk)
        place, ok = stitch(c, text, nxt, base, start)
        if ok:
            out.append(c.encode(c.between(text, start, place)))
            text, start = nxt, place - base
        else:
            text = text[:base] + nxt
    return out


def _digest(c: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def _rows(docs: DataFrame) -> DataFrame:
    """row (its number), doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text.alias("text"))


def chunks(rows: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row, doc_id, n, at, part: the overlapping chunks of the texts that are longer than one, cut in one pass and numbered from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                n = -(-(len(text) - overlap) // chunk)
                # A text's chunks go on one by one: no batch holds a whole long text again.
                for at in range(n):
                    part = text[at * chunk : (at + 1) * chunk + overlap] if at < n - 1 else text[at * chunk :]
                    yield pa.record_batch([pa.array([row]), pa.array([doc_id], pa.int64()), pa.array([n], pa.int32()), pa.array([at], pa.int32()), pa.array([part])], ["row", "doc_id", "n", "at", "part"])

    return rows.where(F.length("text") > chunk + overlap).mapInArrow(cut, "row long, doc_id long, n int, at int, part string")


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (unsigned little-endian 32-bit integers) of ``docs`` (doc_id, text)."""
    rows = _rows(docs)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            ids = [c.encode(c.matches(t.as_py())) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    one = rows.where(F.length("text") <= chunk + overlap).select("doc_id", "text").mapInArrow(short, "doc_id long, ids binary")
    return one.unionByName(_long(chunks(rows, chunk, overlap), ranks_path, pattern, chunk, overlap))


def _long(parts: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Each chunk in a task of its own: boundaries of the overlaps, then stitches, then ids."""
    # Written once: the numbers of the rows must be the same wherever the chunks are read.
    parts = written(parts, "long-texts")
    # What a chunk needs of its neighbour is the neighbour's head, as long as the overlap.
    head = parts.select("row", (F.col("at") - 1).alias("at"), F.substring("part", 1, overlap).alias("next_head"))
    with_next = parts.join(head, ["row", "at"], "left")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            ends = []
            for part, nxt in zip(b.column("part").to_pylist(), b.column("next_head").to_pylist()):
                ends.append(None if nxt is None else stitch(c, part, nxt, chunk)[0])
            yield pa.record_batch([*b.columns[:-1], pa.array(ends, pa.int64())], [*b.schema.names[:-1], "end"])

    found = with_next.select("row", "doc_id", "n", "at", "part", "next_head").mapInArrow(places, "row long, doc_id long, n int, at int, part string, end long")
    # A chunk starts where its predecessor was stitched to it.
    starts = found.where("end is not null").select("row", (F.col("at") + 1).alias("at"), F.when(F.col("end") >= 0, F.col("end") - chunk).otherwise(F.lit(-1)).alias("start"))
    whole = found.join(starts, ["row", "at"], "left").select("row", "doc_id", "n", "at", "part", F.coalesce("start", F.lit(0).cast("long")).alias("start"), "end")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            ids = []
            for part, start, end in zip(*(b.column(n).to_pylist() for n in ("part", "start", "end"))):
                known = start >= 0 and (end is None or end >= 0)
                # The first boundary of a chunk is sure only behind its own start, so a stitch holds for both sides.
                ids.append(c.encode(c.between(part, start, len(part) if end is None else end)) if known else None)
            unsure = pa.array([p if i is None else None for p, i in zip(b.column("part").to_pylist(), ids)], pa.string())
            yield pa.record_batch([b.column("row"), b.column("doc_id"), b.column("at"), b.column("n"), pa.array(ids, pa.binary()), unsure], ["row", "doc_id", "at", "n", "ids", "part"])

    encoded = whole.mapInArrow(pieces, "row long, doc_id long, at int, n int, ids binary, part string")
    # One text's ids lie in one row in the end; a text with an unsure stitch keeps its chunks and is joined again.
    rows = encoded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "ids"))).alias("p"), F.max(F.col("part").isNotNull()).alias("unsure"))
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([b"".join(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    sure = rows.where("not unsure").select("doc_id", F.transform("p", lambda x: x["ids"]).alias("ids")).mapInArrow(joined, "doc_id long, ids binary")
    again = parts.join(rows.where("unsure").select("row"), "row", "left_semi")
    again = again.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "part"))).alias("p")).select("doc_id", F.transform("p", lambda x: x["part"]).alias("parts"))

    def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            ids = [b"".join(encode_long(c, [(p, i == len(x) - 1) for i, p in enumerate(x)], chunk)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return sure.unionByName(again.mapInArrow(rejoin, "doc_id long, ids binary"))


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, and decoded_sha256 of the bytes that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            rows = [_digest(c, x.as_py()) for x in b.column(1)]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .common import table

    path = P.path("byte_bpe_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), path, P.PATTERN), path, P.PATTERN)
