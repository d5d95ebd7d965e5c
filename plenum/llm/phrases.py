"""Collocations by compressed position bitmaps of words.

Texts are cut at sentence marks into pieces and pieces into words. Words take positions one after the other, with an
empty position after each piece, in shards of bounded length that hold one language. A word's bitmap keeps the
16-bit chunks that have a bit: their numbers and their bits. A phrase's bitmap marks the positions of its last
words, so it is extended by one shift by a position, an AND with the bitmaps of all words that share a chunk, and
popcounts; the empty position keeps it within the piece.

Supports are sums of popcounts over shards. What a later pass is told of the sums of an earlier one is a Bloom filter of fixed
size: of the words, then of the pairs of frequent words, then of the triples of frequent pairs, which have ``least`` occurrences or more. For pairs
and triples tasks hand on hashes and popcounts only; equal hashes add up, so the filters let every frequent phrase pass. In the last pass shards extend phrases
depth-first, as long as all their triples pass, and what passed by mistake has too small an exact sum in the end. So the result
is exact however full the filters are. Bitmaps stay where they are written; only counts are shuffled.

A piece that is longer than a shard goes on in the next one, which begins with the last words of the one before;
phrases that end there are not counted twice. Null and empty texts have no words; a null language is ``und``. Repeated rows and ids count
as often as they come, and ids are not read. Texts of any length are read whole, in slices. Ties in rank go by support
and then by the phrase's bytes, so ranks are unique. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Positions of a shard: all chunk numbers fit 16 bits, and a shift stays inside. Positions that a task keeps over all languages; bytes of a slice of a text.
POSITIONS, HELD, SLICE = (1 << 19) - 16, 1 << 20, 1 << 20
#: Entries of bitmaps that are extended at once, and the filters' bits: 4 MB, which pass one in a hundred of other words at three million frequent ones.
BLOCK, FILTER_BITS = 1 << 16, 1 << 25
#: Hashes that a task holds before it hands them on.
HASHES = 1 << 19
#: No byte of UTF-8; stands for the end of a piece.
END = b"\xff"
_TO = bytearray(range(256))
_TO[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _TO[_c] = END[0]
_TO[9] = 32
_TO = bytes(_TO)

_SHARD = "lang string, words array<string>, counts array<long>, skip int, offs binary, chunks binary, bits binary"


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with END between pieces and at the end, slice by slice."""
    text, at = text.translate(_TO), 0
    while len(text) - at > SLICE:
        ends = [e for e in (text.find(b" ", at + SLICE), text.find(END, at + SLICE)) if e >= 0]
        end = min(ends, default=len(text))
        yield text[at:end].replace(END, b" \xff ").split()
        at = end
    yield [*text[at:].replace(END, b" \xff ").split(), END]


def bitmaps(tokens: list[bytes], skip: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their occurrences after the first ``skip`` positions, and their bitmaps: offsets, chunk numbers, bits."""
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy()
    gap = words.index(END).as_py()
    real = ids != gap
    real[1:] |= real[:-1]  # of ends in a row one is enough
    ids = ids[real]
    pos = np.flatnonzero(ids != gap)
    order = np.argsort(ids[pos], kind="stable")
    w, p = ids[pos][order], pos[order]
    chunk = p >> 4
    first = np.flatnonzero(np.append(True, (np.diff(w) != 0) | (np.diff(chunk) != 0))) if len(w) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat((1 << (p & 15)).astype(np.uint16), first) if len(w) else np.zeros(0, np.uint16)
    offs = np.searchsorted(w[first], np.arange(len(words) + 1)).astype(np.uint32)
    return words, np.bincount(w[p >= skip], minlength=len(words)), offs, chunk[first].astype(np.uint16), bits


def shard_rows(batches: Iterator[pa.RecordBatch], positions: int = POSITIONS, longest: int = 5) -> Iterator[pa.RecordBatch]:
    """From (lang, text) a row for each shard: its words, their occurrences and their bitmaps."""
    held: dict[str, list[bytes]] = {}
    skips: dict[str, int] = {}
    total = 0

    def shard(lang: str, tokens: list[bytes], skip: int) -> pa.RecordBatch:
        words, counts, offs, chunks, bits = bitmaps(tokens, skip)
        end = words.index(END).as_py()  # its bitmap is empty
        words = words if end < 0 else pa.concat_arrays([words[:end], pa.array([b""], pa.binary()), words[end + 1 :]])
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
        return pa.record_batch(
            [pa.array([lang]), one(words, pa.string()), one(pa.array(counts), pa.int64()), pa.array([skip], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (offs, chunks, bits))],
            [c.split()[0] for c in _SHARD.split(", ")],
        )

    def flush(lang: str, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        nonlocal total
        tokens, skip = held.pop(lang), skips.pop(lang, 0)
        total -= len(tokens)
        while len(tokens) >= positions or all_of_it and len(tokens) > skip:
            yield shard(lang, tokens[:positions], skip)
            tail = tokens[max(0, min(positions, len(tokens)) - longest + 1) : positions]
            while END in tail:
                tail = tail[tail.index(END) + 1 :]
            skip = len(tail)
            tokens = tail + tokens[positions:]
        if tokens:  # at the end only what has been counted is left, else the piece may go on
            held[lang], skips[lang] = tokens, skip
            total += len(tokens)

    for b in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            for tokens in tokens_of(text or b""):
                held.setdefault(lang, []).extend(tokens)
                total += len(tokens)
                if len(held[lang]) >= positions:
                    yield from flush(lang, False)
            if total > HELD:
                yield from flush(max(held, key=lambda x: len(held[x])), True)
                held = {k: v for k, v in held.items() if v}
    for lang in list(held):
        yield from flush(lang, True)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ ((second << np.uint64(31) | second >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class Filter:
    """Four bits for each hash among a fixed number of bits. ``low``: how many of a hash's last bits don't count."""

    def __init__(self, bits: int = FILTER_BITS):
        self.words, self.low = np.zeros(max(1, bits // 64), np.uint64), 0

    def _places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        step = h >> np.uint64(32) | np.uint64(1)
        for k in range(4):
            at = (h + np.uint64(k) * step) % np.uint64(len(self.words) * 64)
            yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def add(self, h: np.ndarray) -> None:
        for word, bit in self._places(h):
            np.bitwise_or.at(self.words, word, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for word, bit in self._places(h >> np.uint64(self.low)):
            out &= self.words[word] & bit != 0
        return out


def united(parts: DataFrame, bits: int) -> Filter:
    """The filter of ``parts`` (at, bits), 64-bit words of the filters that tasks have made."""
    out = Filter(bits)
    # Rows by the filter's size at most.
    rows = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _filled(own: Filter) -> pa.RecordBatch:
    at = np.flatnonzero(own.words)
    return pa.record_batch([pa.array(at), pa.array(own.words[at].view(np.int64))], ["at", "bits"])


def filter_of(words: DataFrame, bits: int) -> Filter:
    """The filter of ``words`` (phrase)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for b in batches:
            own.add(word_hashes(b.column(0).cast(pa.binary()).to_pylist()))
        yield _filled(own)

    return united(words.select("phrase").mapInArrow(part, "at long, bits long"), bits)


def frequent_hashes(made: DataFrame, counts: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], least: int, bits: int, ranges: int) -> Filter:
    """The filter of the hashes whose popcounts, summed over all shards, reach ``least``.

    ``counts`` gives (hashes, popcounts) of a task's shards. They are dealt by ranges of the hash; in a range a hash is known by its next 32 bits,
    so others may add to its sum.
    """
    low = 64 - int(ranges).bit_length() + 1  # ranges is a power of two

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, n = (np.concatenate(c) for c in zip(*held))
        h, at = np.unique(h >> np.uint64(low - 32), return_inverse=True)
        n = np.bincount(at, n, len(h)).astype(np.uint32)
        cuts = [0, *(np.flatnonzero(np.diff(h >> np.uint64(32))) + 1).tolist(), len(h)]
        key = h.astype(np.uint32)
        rows = [(int(h[i] >> np.uint64(32)), np.diff(key[i:j], prepend=np.uint32(0)).tobytes(), n[i:j].tobytes()) for i, j in zip(cuts, cuts[1:]) if i < j]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["range", "keys", "counts"]) if rows else pa.record_batch([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())], ["range", "keys", "counts"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for h, n in counts(batches):
            held.append((h, n))
            size += len(h)
            if size >= HASHES:
                yield from dealt(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from dealt(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, key, total = Filter(bits), None, np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def close() -> None:
            often = key[total >= least].astype(np.uint64)
            if len(often):
                own.add(np.uint64(now) << np.uint64(32) | often)

        for b in batches:
            for r, keys, n in zip(*(b.column(c).to_pylist() for c in ("range", "keys", "counts"))):
                if r != now:
                    close()
                    now, key, total = r, np.zeros(0, np.uint32), np.zeros(0, np.int64)
                both = np.concatenate([key, np.cumsum(np.frombuffer(keys, np.uint32), dtype=np.uint32)])
                key, at = np.unique(both, return_inverse=True)
                total = np.bincount(at, np.concatenate([total, np.frombuffer(n, np.uint32)]), len(key)).astype(np.int64)
        close()
        yield _filled(own)

    rows = made.mapInArrow(emit, "`range` int, keys binary, counts binary").repartition("range").sortWithinPartitions("range")
    out = united(rows.mapInArrow(add, "at long, bits long"), bits)
    out.low = low - 32
    return out


def summed(made: DataFrame, told: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], least: int, ranges: int) -> DataFrame:
    """lang, phrase, f: the exact sums, from ``least`` on, of ``told`` (lang, phrase, cnt). A task adds up what its shards tell and hands it on in blocks, one for each range of a hash."""

    def add(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("cnt", "sum")]).rename_columns(["lang", "phrase", "cnt"])

    def dealt(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = add(parts)
        at = (word_hashes(t["phrase"].combine_chunks().cast(pa.binary()).to_pylist()) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        t, at = t.take(pa.array(order)).combine_chunks(), at[order]
        first = np.flatnonzero(np.append(True, np.diff(at) != 0)) if len(at) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, t[c].chunk(0) if t[c].num_chunks else pa.array([], t.schema.field(c).type)) for c in ("lang", "phrase", "cnt")]
        yield pa.record_batch([pa.array(at[first]), *lists], ["range", "langs", "phrases", "counts"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in told(batches):
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size >= HASHES // 2:
                held = [add(held)]
                if held[0].num_rows >= HASHES // 4:
                    yield from dealt(held)
                    held = []
                    pa.default_memory_pool().release_unused()
                size = sum(t.num_rows for t in held)
        if held:
            yield from dealt(held)

    def close(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if parts:
            t = add(parts)
            yield from t.filter(pc.greater_equal(t["cnt"], least)).rename_columns(["lang", "phrase", "f"]).combine_chunks().to_batches()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for k, r in enumerate(b.column("range").to_pylist()):
                if r != now:
                    yield from close(parts)
                    now, parts = r, []
                parts.append(pa.table([b.column(c)[k].values for c in ("langs", "phrases", "counts")], ["lang", "phrase", "cnt"]))
                parts = [add(parts)] if len(parts) >= 16 else parts
        yield from close(parts)

    rows = made.mapInArrow(emit, "`range` int, langs array<string>, phrases array<string>, counts array<long>").repartition("range").sortWithinPartitions("range")
    return rows.mapInArrow(gather, "lang string, phrase string, f long")


class Shard:
    """The bitmaps of a shard's words that may be frequent, by word and by chunk."""

    def __init__(self, b: pa.RecordBatch, row: int, frequent: Filter):
        own = {c: b.column(c)[row] for c in ("lang", "skip", "offs", "chunks", "bits")}
        self.lang, self.skip = own["lang"].as_py(), own["skip"].as_py()
        offs, chunks, bits = (np.frombuffer(own[c].as_buffer(), d) for c, d in (("offs", np.uint32), ("chunks", np.uint16), ("bits", np.uint16)))
        words = b.column("words")[row].values
        hashes = word_hashes(words.cast(pa.binary()).to_pylist())
        lids = np.flatnonzero(frequent.has(hashes))
        self.words, self.hashes, self.m = words.take(pa.array(lids)), hashes[lids], len(lids)
        n = (offs[lids + 1] - offs[lids]).astype(np.int32)
        at = np.arange(n.sum(), dtype=np.int32) + np.repeat(offs[lids].astype(np.int32) - (np.cumsum(n, dtype=np.int32) - n), n)
        self.w, self.c, self.b = np.repeat(np.arange(self.m), n), chunks[at].astype(np.int32), bits[at]
        order = np.argsort(chunks[at], kind="stable")
        self.by_w, self.by_b = self.w[order], self.b[order]
        self.start = np.searchsorted(self.c[order], np.arange((1 << 16) + 1)).astype(np.int32)

    def extended(self, pid: np.ndarray, c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bitmaps (phrase, chunk, bits) shifted by one and joined by AND with those of all words: (phrase, word, chunk, bits)."""
        own, over = b << np.uint16(1), b >> np.uint16(15)
        i, j = np.flatnonzero(own), np.flatnonzero(over)
        pid, c, b = np.concatenate([pid[i], pid[j]]), np.concatenate([c[i], c[j] + 1]), np.concatenate([own[i], over[j]])
        low = self.start[c]
        n = self.start[c + 1] - low
        at = np.repeat(low - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(n.sum(), dtype=np.int32)
        each = np.repeat(np.arange(len(c), dtype=np.int32), n)
        both = b[each] & self.by_b[at]
        hit = np.flatnonzero(both)
        each = each[hit]
        return pid[each], self.by_w[at[hit]], c[each], both[hit]

    def supports(self, key: np.ndarray, c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different keys, each row's place among them, and the popcounts without the positions that the shard before has counted."""
        counted = np.bitwise_count(np.where(c == 0, b & np.uint16((0xFFFF << self.skip) & 0xFFFF), b))
        keys, at = np.unique(key, return_inverse=True)
        return keys, at, np.bincount(at, counted, len(keys)).astype(np.int64)

    def blocks(self) -> Iterator[tuple[np.ndarray, ...]]:
        for k in range(0, len(self.w), BLOCK):
            yield self.w[k : k + BLOCK], self.c[k : k + BLOCK], self.b[k : k + BLOCK]

    def told(self, path: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """lang, phrase, cnt of the phrases that the places in ``path`` spell."""
        some = n > 0
        phrase = pc.binary_join_element_wise(*(self.words.take(pa.array(p[some])) for p in path), " ")
        return pa.record_batch([pa.array([self.lang] * len(phrase), pa.string()), phrase, pa.array(n[some])], ["lang", "phrase", "cnt"])

    def hashes_of(self, path: list[np.ndarray]) -> np.ndarray:
        out = self.hashes[path[0]]
        for p in path[1:]:
            out = pair_hashes(out, self.hashes[p])
        return out

    def walk(self, longest: int, filters: dict[int, Filter]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """The paths of phrases and their popcounts, depth-first from each block of first words.

        A phrase is followed, and told, if the filter of its length lets it pass; one that is longer than all filters if the longest one lets its last words pass.
        """
        for block in self.blocks():
            (pid, c, b), path = block, [np.arange(self.m)]
            while len(path) < longest and len(c):
                pid, word, c, b = self.extended(pid, c, b)
                key, pid, n = self.supports(pid * self.m + word, c, b)
                path = [*(p[key // self.m] for p in path), key % self.m]
                known = max((k for k in filters if k <= len(path)), default=0)
                if known:
                    ok = filters[known].has(self.hashes_of(path[-known:]))
                    place, keep = np.cumsum(ok) - 1, ok[pid]
                    path, n = [p[ok] for p in path], n[ok]
                    pid, c, b = place[pid[keep]], c[keep], b[keep]
                yield path, n

    def supports_of(self, length: int, filters: dict[int, Filter]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes and popcounts of the phrases of a length."""
        for path, n in self.walk(length, filters):
            if len(path) == length:
                yield self.hashes_of([p[n > 0] for p in path]), n[n > 0]


def shards_of(batches: Iterator[pa.RecordBatch], frequent: Filter) -> Iterator[Shard]:
    for b in batches:
        for row in range(b.num_rows):
            shard = Shard(b, row, frequent)
            if shard.m:
                yield shard


def collocations(docs: DataFrame, least: int = 100, most: int | None = 2000, longest: int = 5, share: int = 100, positions: int = POSITIONS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to ``longest`` words in ``docs`` (lang, text) that come ``least`` times or more.

    A phrase inside a longer one that has ``share`` per cent of its support or more goes; ``most`` of each language stay.
    """
    if not 2 <= longest <= 16 or positions > POSITIONS or positions < 2 * longest:
        raise ValueError("longest must be 2 to 16, and positions within a shard's")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"))
    made = written(texts.mapInArrow(lambda x: shard_rows(x, positions, longest), _SHARD), "bitmaps")

    def often(counts: DataFrame, name: str) -> DataFrame:
        return written(counts.groupBy("lang", "phrase").agg(F.sum("cnt").alias("f")).where(F.col("f") >= least), name)

    words = made.select("lang", F.explode(F.arrays_zip(F.col("words").alias("phrase"), F.col("counts").alias("cnt"))).alias("w")).select("lang", "w.*").where("cnt > 0")
    totals = made.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    one = often(words, "words")
    frequent = filter_of(one, filter_bits)
    # Ranges of about a million positions each.
    size = made.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    ranges = 1 << min(20, max(6, (size >> 21).bit_length()))
    filters: dict[int, Filter] = {}
    for length in range(2, min(3, longest) + 1):
        known = dict(filters)
        filters[length] = frequent_hashes(made, lambda x, k=length, known=known: (y for s in shards_of(x, frequent) for y in s.supports_of(k, known)), least, filter_bits, ranges)
    spelt = lambda x: (s.told(path, n) for s in shards_of(x, frequent) for path, n in s.walk(longest, filters))
    phrases = written(summed(made, spelt, least, ranges), "phrases")
    return ranked(phrases, one, totals, most, share)


def ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, most: int | None, share: int) -> DataFrame:
    """``phrases`` (lang, phrase, f) scored by their worst cut, without those inside longer ones, ranked within each language; ``words`` (lang, phrase, f) and ``totals`` (lang, n) of it."""
    parts = phrases.unionByName(words)
    d = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    inside = F.explode(F.expr("flatten(transform(sequence(2, size(ws) - 1), n -> transform(sequence(1, size(ws) - n + 1), i -> array_join(slice(ws, i, n), ' '))))"))
    covered = d.where(F.size("ws") > 2).select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = d.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    cuts = kept.join(totals, "lang").select("*", F.explode(F.expr("sequence(1, size(ws) - 1)")).alias("k"))
    cuts = cuts.withColumn("head", F.expr("array_join(slice(ws, 1, k), ' ')")).withColumn("tail", F.expr("array_join(slice(ws, k + 1, size(ws) - k), ' ')"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    out = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) as piece from documents),
lists as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as ws from pieces),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists),
f as (
  select lang, ws[i : i + m - 1] as p, m, count(*) as f from starts, range(1, 6) t(m) where i + m - 1 <= len(ws) group by all),
totals as (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
g as materialized (select lang, array_to_string(p, ' ') as s, p, m, f from f where f >= 100),
c as (select * from g where m >= 2),
halves as (
  select lang, s, p, f as a, unnest(range(1, m)) as k from c),
heads as (select lang, s, p, a, k, array_to_string(p[1 : k], ' ') as head, array_to_string(p[k + 1 :], ' ') as tail from halves),
cuts as (
  select h.lang, h.s, h.a, h.k, l.f as l, r.f as r, n, (1000::hugeint * h.a * n) // (l.f::hugeint * r.f) as score
  from heads h join totals on totals.lang = h.lang join g l on l.lang = h.lang and l.s = h.head join g r on r.lang = h.lang and r.s = h.tail),
worst as (select lang, s, a, n, arg_min({'l': l, 'r': r, 'score': score}, (score, k)) as cut from cuts group by all),
inside as (
  select lang, array_to_string(p[i : i + j - 1], ' ') as s, max(f) as longer from c, range(2, 5) t(j), range(1, 5) u(i) where j < m and i + j - 1 <= m group by 1, 2),
named as (
  select w.lang, w.s as phrase, a, cut.l as l, cut.r as r, n, cut.score::bigint as score
  from worst w left join inside x on x.lang = w.lang and x.s = w.s where longer is null or 100 * longer < 100 * a),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from named)
select lang, rank, phrase, a, l, r, n, score from placed where rank <= 2000
"""
