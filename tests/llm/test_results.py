"""Results against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plenum.llm import bpe, chat, line_dedup, one_bit, orc_ids, packing, quality_rules, secrets, simhash, subwords
from plenum.llm.common import shared_folder, table
from plenum.llm.queries import QUERIES
from tests.conftest import SMALL

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ALPHABET = "abc XYZ 019 ,.'!\n\t   é中한🙂\x1c\x85 's 'll ## \r\n"


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(400)))) for i in range(150)]
    rows += [(200, "x" * 3000), (201, " " * 3000), (202, "no limit " * 500), (203, "</s><|endoftext|> [INST]")]
    return rows


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids_of(rows):
    return np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist()


def test_packing_pieces(spark, odd, library):
    out = packing.pack(spark.createDataFrame(odd, "doc_id long, text string"), JSON, window=64).collect()
    assert len({r.sequence_id for r in out}) == len(out)
    for i, text in odd:
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert ids_of(own) == library(text) + [1]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)]).tolist()[:-1]
        assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and 1 << r.bucket == r.length for r in own)


def test_orc_round_trip(spark, odd, library, tmp_path):
    path = shared_folder(spark, "orc")
    orc_ids.write_ids(spark.createDataFrame(odd, "doc_id long, text string"), path, JSON, files=5)
    rows = orc_ids.read_ids(spark, path).orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(rows, sorted(odd)):
        want = library(text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(want), want)
        start += len(want)
    d = {r.doc_id: r for r in orc_ids.digest(orc_ids.read_ids(spark, path)).collect()}
    assert d[200].ids_crc32 == zlib.crc32(np.array(library("x" * 3000) + [2], "<u4").tobytes())
    one = orc_ids.read_ids(spark, path).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()


def test_packing_query(spark, texts, library):
    out = {}
    for r in QUERIES["op2_packing"](spark, SMALL).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert set(out) == set(texts) and len({r.sequence_id for p in out.values() for r in p}) == sum(map(len, out.values()))
    for i, text in texts.items():
        ids, at = [*library(text), 1], 0
        for r in sorted(out[i], key=lambda r: r.start):
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids)) and r.length & (r.length - 1) == 0 and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_buckets(spark, odd, tmp_path):
    pieces = packing.pack(spark.createDataFrame(odd, "doc_id long, text string"), JSON, window=64)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert {(r.bucket, r.length) for r in back.select("bucket", "length").distinct().collect()} == {(b, 1 << b) for b in range(7)}
    assert back.count() == pieces.count()
    one = back.where("bucket = 3")
    assert one.count() == pieces.where("length = 8").count() and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()


def test_orc_query(spark, texts, library):
    start, out = 0, {r.doc_id: r for r in QUERIES["op4_orc_ids"](spark, SMALL).collect()}
    for i in sorted(texts):
        ids = [*library(texts[i]), 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(out) == len(texts)


def scanned(df):
    """Rows that the file scan of a query gives on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_orc_prunes_by_metadata(spark):
    """Even ids in stripes of row groups of 1,000: one id reads one group, an odd id inside the range is ruled out by the Bloom filters alone."""
    import pyarrow.orc

    path = shared_folder(spark, "orc-pruned")
    docs = spark.range(0, 24_000, 2).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.xxhash64("id", i).cast("string")), " ").alias("text"))
    orc_ids.write_ids(docs, path, JSON, files=1, stripe=1 << 18)
    rows = spark.read.schema(orc_ids.SCHEMA).orc(path)
    file = pyarrow.orc.ORCFile(next(f for f in rows.inputFiles()).removeprefix("file://"))
    assert file.nrows == 12_000 and file.row_index_stride == 1000 and file.nstripes > 1
    assert scanned(rows.select("doc_id", "n_tokens")) == 12_000
    assert 0 < scanned(rows.where("doc_id = 8000").select("doc_id", "n_tokens")) <= 2000
    absent = [scanned(rows.where(f"doc_id = {i}").select("doc_id", "n_tokens")) for i in (4001, 9001, 12345, 20011, 21)]
    assert sorted(absent)[2] == 0 and sum(absent) <= 2000


def test_added_tokens_and_cold_memory(library):
    """An added token inside a text is one id, as the library has it; a memory of a few bytes changes no id."""
    from plenum.llm.tokens import Encoder

    rng = random.Random(9)
    enc, cold = Encoder(JSON), Encoder(JSON, memory=1)
    assert len(library("a <|endoftext|> b")) == 4
    for text in ["a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|>中", *("".join(rng.choice(ALPHABET) for _ in range(200)) for _ in range(50)), "plain words, again and again. " * 40]:
        for e in (enc, cold):
            assert np.frombuffer(e.encode(text), e.dtype).tolist() == library(text)
    assert len(cold.known) <= 400 and len(cold.pieces) <= 400


def test_bpe_query(spark, texts):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, SMALL).collect()}
    assert set(out) == set(texts)
    for i, text in texts.items():
        ids = np.array(lib.encode_ordinary(text), "<u4")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_matches_the_library(spark, odd):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    # Small chunks force stitches, and texts without a shared boundary.
    for size in ((1 << 16, 1 << 10), (60, 40)):
        out = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, RANKS, P.PATTERN, *size).collect()}
        assert all(out[i] == lib.encode_ordinary(t) for i, t in odd)
    d = {r.doc_id: r for r in bpe.digests(bpe.encode(docs, RANKS, P.PATTERN, 60, 40), RANKS, P.PATTERN).collect()}
    assert all(d[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in odd)


def test_one_bit_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 48)).astype(np.float32)
    x[100:200] = x[:100] + 0.05 * rng.standard_normal((100, 48)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>")
    out = {}
    for r in one_bit.nearest(v.where("id % 20 = 0"), v, k=10).collect():
        out.setdefault(r.query_id, {})[r.rank] = r.vec_id
    d = x.astype(float)
    hits = 0
    for q in range(0, 900, 20):
        s = d @ d[q]
        s[q] = -np.inf
        hits += len(set(out[q].values()) & set(np.lexsort((np.arange(900), -s))[:10].tolist()))
    assert hits >= 0.9 * 45 * 10


def test_one_bit_prunes():
    """The bounds hold for nearly all candidates and spare most of them the exact product, or the codes are of no use."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((10_000, 64))
    block = one_bit.Block(np.arange(len(x)), x, 3.0, 0)
    reranked, lost = [], 0
    for qid in range(40):
        est = one_bit.estimates(block.bits, x[qid], block.turn) * block.scale
        exact = x @ x[qid]
        assert np.mean(np.abs(exact - est) <= block.spread * np.linalg.norm(x[qid])) > 0.95
        near, score, n = block.search(qid, x[qid], 20)
        exact[qid] = -np.inf
        want = np.lexsort((np.arange(len(x)), -exact))[:20]
        lost += len(set(want) - set(near))
        reranked.append(n)
        assert np.array_equal(score, np.sort(score)[::-1])
    assert np.mean(reranked) < 0.5 * len(x) and lost <= 0.005 * 40 * 20
    # Every code's estimate is that of its signs.
    signs = np.unpackbits(block.bits[:5], axis=1, bitorder="little")[:, :64] * 2.0 - 1
    assert np.allclose(one_bit.estimates(block.bits[:5], x[3], block.turn), signs @ (block.turn @ x[3]) / 8)


def test_one_bit_on_the_table(spark):
    """Recall over all queries of the table, by brute force, with ties and a small block that makes many tasks."""
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' where embedding is not null order by vec_id").fetchall()
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    found = {}
    for r in QUERIES["op3_one_bit_search"](spark, sf).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = one_bit._inner(x, x[q])
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        own = found[ids[q]]
        assert sorted(own) == list(range(1, 21)) and all(own[k][1] == s[np.searchsorted(ids, own[k][0])] for k in own)
        hits += len({i for i, _ in own.values()} & set(ids[best].tolist()))
        n += 20
    assert hits >= 0.99 * n
    d = x[:300].copy()
    d[150:] = d[:150]  # every score comes twice
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(d)], "id long, v array<double>")
    for r in one_bit.nearest(v.where("id = 0"), v, k=10, error=50.0).collect():
        s = one_bit._inner(d, d[0])
        s[0] = -np.inf
        assert r.vec_id == np.lexsort((np.arange(300), -s))[r["rank"] - 1]


def brute_fingerprint(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_query(spark, texts):
    want = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups = brute_components(want)
    out = QUERIES["op6_simhash"](spark, SMALL).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{x:016x}" for i, x in want.items()}
    assert {r.doc_id: r.component_id for r in out} == groups


@pytest.mark.parametrize("shard", [4096, 16])
def test_simhash_links(spark, shard):
    rng = random.Random(3)
    fps = {}
    for i in range(0, 600, 3):
        x = rng.getrandbits(64) if i % 2 else rng.getrandbits(16) << 3  # a dense part makes large shards
        for k in range(3):
            fps[i + k] = x
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    distinct = {}
    for i, x in fps.items():
        distinct.setdefault(x, i)
    points = spark.createDataFrame([(simhash._signed(x), i) for x, i in distinct.items()], "fp long, node long")
    got = {r.node: r.component for r in simhash.components(simhash.links(points, shard=shard)).collect()}
    want = brute_components({i: x for x, i in distinct.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_simhash_shards_overlap(spark):
    """A dense shard is split by vantage points: shards stay small, fingerprints at a boundary lie in both, and no link is lost."""
    rng = random.Random(8)
    flips = lambda: (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    fps = sorted({simhash._signed(((1 << rng.randrange(1, 64)) - 1) ^ flips()) for _ in range(1500)})
    rows = spark.createDataFrame([(0, 0, x, i) for i, x in enumerate(fps)], "tree long, leaf long, fp long, node long")
    parts = {}
    for r in simhash._split(rows, 3, 200).collect():
        parts.setdefault((r.leaf, r.blocks), set()).add(r.node)
    places = [i for own in parts.values() for i in own]
    assert len(parts) > 4 and len(places) > len(set(places)) and max(len(own) for (_, blocks), own in parts.items() if blocks == 1) <= 200
    meet = {}
    for own in parts.values():
        for i in own:
            meet.setdefault(i, set()).update(own)
    a = np.array(fps, np.int64).view(np.uint64)
    i, j = simhash.near(a, a, 3)
    assert len(i) > len(a) and all(y in meet.get(x, {x}) for x, y in zip(i.tolist(), j.tolist()))


def test_vantage_tree_is_exact():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 62, 40)]))
    forest = simhash.Forest(len(fps))
    simhash.vantage_links(fps, 3, forest, leaf=16)
    want = brute_components({i: int(x) for i, x in enumerate(fps)})
    assert [forest.root(i) for i in range(len(fps))] == [want[i] for i in range(len(fps))]


def test_line_index_is_reversible(spark):
    common = ["shared line number %d that is certainly long enough to count" % i for i in range(40)]
    rows = [(i, "\n".join(common[(i + j) % 40] if j % 2 else f"own {i} {j} " + "y" * 40 for j in range(8))) for i in range(60)]
    first = spark.createDataFrame(rows[:40], "doc_id long, text string")
    more = spark.createDataFrame(rows[40:], "doc_id long, text string")
    index = line_dedup.LineIndex(spark)
    index.insert(first)
    refs, clean = sorted(index.references.collect()), sorted(index.clean(first).collect())
    index.insert(more)
    both = line_dedup.LineIndex(spark)
    both.insert(first.union(more))
    assert sorted(both.references.collect()) == sorted(index.references.collect())
    assert sorted(both.clean(first).collect()) == sorted(index.clean(first).collect())
    assert sorted(index.clean(first).collect()) != clean
    index.delete(more.select("doc_id"))
    assert sorted(index.references.collect()) == refs and sorted(index.clean(first).collect()) == clean
    known = index._known()
    hot = np.array([(r.key_hi, r.key_lo) for r in index.references.where("n_docs >= 5").collect()], np.int64).reshape(-1, 2)
    cold = np.array([(r.key_hi, r.key_lo) for r in index.references.where("n_docs < 5").collect()], np.int64).reshape(-1, 2)
    assert known(hot[:, 0], hot[:, 1]).all() and known(cold[:, 0], cold[:, 1]).mean() < 0.1


def test_line_index_beyond_the_broadcast(spark):
    """Filters too large to be sent give the same texts, through the shards."""
    rows = [(i, "\n".join(f"common line {j} that is long enough to be counted" if j % 3 else f"own {i} {j} " + "z" * 40 for j in range(9))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for most in (1 << 26, 0):
        index = line_dedup.LineIndex(spark, filter_bytes=most)
        index.insert(docs)
        index.shards, index.version = index.shards, index.version
        out.append(sorted(map(tuple, index.clean(docs).select("doc_id", "text", "n_dropped").collect())))
    assert out[0] == out[1] and sum(r[2] for r in out[0]) == 6 * 29
    posts = line_dedup.postings(docs)
    left = index._probed(posts)
    hot = index.references.where("n_docs >= 5").count()
    assert hot == 6 and hot * 30 <= left.count() < hot * 30 + 0.1 * posts.count()
    # The same documents again replace themselves.
    refs = sorted(map(tuple, index.references.collect()))
    index.insert(docs.where("doc_id < 10"))
    assert sorted(map(tuple, index.references.collect())) == refs


def test_cuckoo_filter_forgets():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    f = line_dedup.CuckooFilter.sized(5000)
    assert f.add(keys) and f.holds(keys).all()
    f.remove(keys[:2500])
    assert f.holds(keys[2500:]).all() and f.holds(keys[:2500]).mean() < 0.01
    g = line_dedup.CuckooFilter.load(f.dump())
    assert (g.holds(keys) == f.holds(keys)).all()
    assert not line_dedup.CuckooFilter(np.zeros((16, 4), np.uint16)).add(keys[:200])


NEAR = re.compile(secrets.NEAR_SECRET)


def brute_candidates(text):
    """(place, candidate) of a text, by loops over its words."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = []
    for i, w in enumerate(words):
        if len(w) < 8 or not re.search("[0-9]", w) or not re.search(secrets.RUN, w):
            continue
        head = re.match(r"[^:=]*[:=]", w)
        behind = i > 0 and NEAR.search(" ".join([*words[max(0, i - 2) : i], head[0] if head else ""]))
        if behind or NEAR.search(w) or re.search(r"[A-Za-z0-9+/_\-]{16}", w):
            out += [(i, c) for c in re.findall(secrets.RUN, w) if re.search("[0-9]", c) and re.search("[A-Za-z]", c)]
    return out


def brute_known(candidates, docs):
    """The letters of each candidate in words that stand alone in five documents or more, or in the fixed list."""
    count = {}
    for t in docs:
        for w in {w.rstrip('.,;:!?)"\'').lstrip("(\"'") for w in re.split(r"[\x20\x09-\x0D]+", t.lower())}:
            if re.fullmatch("[a-z]{4,}", w):
                count[w] = count.get(w, 0) + 1
    pieces = {c: re.findall("[a-z]{4,}", c.lower()) for c in candidates}
    return {c: sum(len(w) for w in ws if w in secrets.WORDS or count.get(w, 0) >= 5) for c, ws in pieces.items()}


PLANTED = [
    ("the deploy job reads password = Zx9!kQ7vLp2mRt8w from the vault", None),
    ("AWS_SECRET_ACCESS_KEY=wJ7rXUtnFEMIK9MDENGbPxRfiCYq2LhT8sVd", True),
    ("api_key: 'sk-live-9fQ2xLm8Rt4Vb7Zk1Np6'", True),
    ("export AUTH_TOKEN=ghx_A8dk29sLmQp47RtZx01VbNc93KfJh56We", True),
    ("client_secret = \"3f9a8c1d7e5b2a6f4c0d9e8b7a6f5c4d3e2b1a09\"", True),
    ("fixed in commit 3f9a8c1d7e5b2a6f4c0d9e8b7a6f5c4d3e2b1a09 yesterday", False),
    ("sha256 checksum 9b74c9897bac770ffc029102a200c5de1f2e3d4c5b6a79880123456789abcdef matches", False),
    ("ticket uuid 550e8400-e29b-41d4-a716-446655440000 was closed", False),
    ("api_key = your_token_here_12345 is only an example", False),
    ("see /docs/v2/internationalisation2024 for more", False),
]


def test_secrets_accuracy(spark, texts):
    found = secrets.labelled_findings(spark, 6000).withColumn("test", F.pmod(F.xxhash64("candidate"), F.lit(5)) == 0)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = secrets.known_words([found, secrets.candidates(docs, "source")], docs)
    forest = secrets.train(found.where("not test"), words)
    rows = forest.transform(secrets._vectors(found.where("test"), words, "is_secret")).select("is_secret", "prediction").collect()
    right = np.mean([r.is_secret == r.prediction for r in rows])
    assert right > 0.95 and right > max(np.mean([r.is_secret for r in rows]), np.mean([1 - r.is_secret for r in rows])) + 0.2
    own = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    hits = secrets.judge(secrets.candidates(docs, "source"), forest, words)
    assert sorted((r.doc_id, r.at, r.candidate) for r in hits.collect()) == sorted((i, at, c) for i, t in own.items() for at, c in brute_candidates(t))
    keys = {(i, k) for i, t in own.items() for k in re.findall(r'token = "([0-9a-fA-F]{40})"', t)}
    marked = {(r.doc_id, r.candidate) for r in hits.where("is_secret").collect()}
    assert keys and keys == marked
    clean = {r.doc_id: r.text for r in secrets.redact(docs, hits).collect()}
    assert not any(k in clean[i] for i, k in keys) and len(clean) == docs.count()
    planted = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLANTED)], "doc_id long, text string")
    verdict = {}
    for r in secrets.scan(planted, found).collect():
        verdict[r.doc_id] = verdict.get(r.doc_id, False) or r.is_secret
    for i, (t, want) in enumerate(PLANTED):
        assert want is None or verdict.get(i, False) == want, t


def test_secrets_dictionary(spark, texts):
    words = ["common%s" % c for c in "abcdefgh"]
    docs = [f"{w} stands alone, (and {w}) here. x{w}1" for w in words[:4] for _ in range(5)] + [f"{w} is rare" for w in words[4:] for _ in range(4)] + ["COMMONE!"]
    found = spark.createDataFrame([(f"{w.upper()}_9{w}",) for w in words] + [("token_1abcdef",)], "candidate string")
    d = spark.createDataFrame([(t,) for t in docs] + [(None,)], "text string")
    got = {r.candidate: r.known for r in secrets._covered(found, secrets.known_words([found], d)).collect()}
    assert got == brute_known(got, docs) and got["COMMONA_9commona"] == 14 and got["COMMONE_9commone"] == 14 and got["COMMONF_9commonf"] == 0


def test_redact_without_ids(spark):
    rows = [(None, 'token = "%s"' % ("ab12" * 10), "x"), (None, "nothing here", "y"), (1, None, "z"), (None, 'token = "%s"' % ("cd34" * 10), "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    found = docs.select("doc_id", F.xxhash64("text").alias("t"), F.regexp_extract("text", '"(\\w+)"', 1).alias("candidate")).where("candidate <> ''").withColumn("is_secret", F.lit(True))
    out = {r.more: r.text for r in secrets.redact(docs, found).collect()}
    assert out == {"x": 'token = "[SECRET]"', "y": "nothing here", "z": None, "w": 'token = "[SECRET]"'}


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = {}
    for w in windows:
        n[w] = n.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_guarantee(spark, texts):
    out = QUERIES["op9_quality_rules"](spark, SMALL).collect()
    for r in out:
        c = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    lost = [r for r in out if r.doc_id in good and not r.base_failed and not r.kept]
    assert len(lost) <= 0.05 * len(good)


def plain_thresholds(rows, limit=0.05, risk=0.05):
    """(stratum, rule): (cutoff, n_good, n_false, n_bad) by loops. ``rows``: (stratum, good, half, ratios by rule)."""
    strata, out = {r[0] for r in rows}, {}
    for s in strata:
        own = [r for r in rows if r[0] == s]
        first = [r for r in own if r[2] == 0]
        goods = sum(r[1] == 1 for r in first)
        tests = []
        for rule, grid in quality_rules.GRID.items():
            for cutoff in grid:
                over = [r for r in first if r[3][rule] > cutoff]
                tests.append((rule, cutoff, sum(r[1] == 1 for r in over), sum(r[1] == 0 for r in over)))
        best = None
        for level in quality_rules.LEVELS:
            union = {}
            for rule, cutoff, false, bad in tests:
                if bad and false <= max(level, 0) * goods:
                    key = (bad, 0 if level < 0 else -false, cutoff if level < 0 else -cutoff)
                    if rule not in union or key > union[rule][0]:
                        union[rule] = (key, cutoff)
            if level == -2 and union:
                top = max(union, key=lambda r: (union[r][0][0], r))
                union = {top: union[top]}
            fails = lambda r: any(r[3][rule] > c for rule, (_, c) in union.items())
            n = sum(r[1] == 1 and r[2] == 1 for r in own)
            k = sum(r[1] == 1 and r[2] == 1 and fails(r) for r in own)
            bad = sum(r[1] == 0 and fails(r) for r in own)
            if not union or not n or k >= n * limit:
                continue
            if sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(k + 1)) <= risk / len(strata) and (best is None or (bad, -level) > best[0]):
                best = ((bad, -level), {rule: (c, n, k, bad) for rule, (_, c) in union.items()})
        out |= {(s, rule): x for rule, x in (best[1] if best else {}).items()}
    return out


def holdout(counted, labels):
    own = labels.groupBy("doc_id").agg(F.max("quality").alias("good"))
    d = counted.where("not base_failed").join(own, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)))
    return [(r.lang, r.good, r.half, {g: r[g] for g in quality_rules.GRID}) for r in d.collect()]


def limits_of(table):
    return {(r.stratum, r.rule): (r.cutoff, r.n_good, r.n_false, r.n_bad) for r in table.collect()}


def test_quality_thresholds_on_made_labels(spark):
    """Where thresholds act, some with false rejections, some strata without: as loops have it."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000
    d = spark.range(6000).withColumn("good", (u(1) > 0.25).cast("int"))
    bad, noise = F.col("good") == 0, F.when(u(5) < 0.01, 0.5).otherwise(0.2)
    d = d.select(
        F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "xx"])), F.when(F.col("id") < 3000, 1).when(F.col("id") < 4800, 2).when(F.col("id") < 5900, 3).otherwise(4)).alias("lang"), F.lit(False).alias("base_failed"), "good",
        (F.when(bad & (u(2) < 0.6), 0.3).otherwise(0.05) * u(3) * noise * 5).alias("symbol_share"), F.when(bad & (u(4) < 0.3), u(6)).otherwise(u(6) * 0.12).alias("dup_line_share"),
        (u(7) * 0.3).alias("repeat_share"), (5 + 3 * u(8) + F.when(bad & (u(9) < 0.2), 20).otherwise(0)).alias("long_words"), (-5 - u(10)).alias("short_words"),
    )
    labels = d.select("doc_id", F.col("good").alias("quality"))
    counted = d.drop("good")
    table = quality_rules.thresholds(counted, labels)
    want = plain_thresholds(holdout(counted, labels))
    assert limits_of(table) == want and {s for s, _ in want} >= {"en", "de"} and "xx" not in {s for s, _ in want} and any(x[2] > 0 for x in want.values())
    kept = {r.doc_id: r.kept for r in quality_rules.judged(counted, table).collect()}
    for r in d.collect():
        assert kept[r.doc_id] == (not any(r[rule] > want[r.lang, rule][0] for rule in quality_rules.GRID if (r.lang, rule) in want))


def test_quality_verdict_on_the_table(spark):
    """At sf0.1 every rule's verdict, and the query's, against loops over the same counts."""
    sf = "/root/testdata/sf0.1"
    counted = quality_rules.with_counts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")).drop("text")
    counted = spark.createDataFrame(counted.toPandas(), counted.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = plain_thresholds(holdout(counted, labels))
    assert want and limits_of(quality_rules.thresholds(counted, labels)) == want
    out = {r.doc_id: r.kept for r in QUERIES["op9_quality_rules"](spark, sf).collect()}
    rows = counted.collect()
    for r in rows:
        assert out[r.doc_id] == (not r.base_failed and not any(r[rule] > want[r.lang, rule][0] for rule in quality_rules.GRID if (r.lang, rule) in want))
    assert sum(not out[r.doc_id] and not r.base_failed for r in rows) > 100


def test_binomial_tail(spark):
    cases = [(0, 50, 0.01), (3, 400, 0.02), (7, 900, 0.01), (30, 3000, 0.011), (5, 5, 0.5), (0, 0, 0.01)]
    d = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = d.where(f"k = {k} and n = {n}").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).first().t
        assert got == pytest.approx(exact if k < n * p else 1.0, rel=1e-9)


def test_repeated_windows_of_one_word(spark):
    rows = [("a a a a a",), ("a b c a b c",), ("a b c d",), ("x y x y x",), ("one",)]
    out = quality_rules.with_counts(spark.createDataFrame(rows, "text string")).select("n_repeat_words").collect()
    assert [r[0] for r in out] == [counts(t)[4] for (t,) in rows]


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(out[i].held_out for i in held)
    share = max(np.mean([labels[i] == c for i in held]) for c in (0, 1))
    assert np.mean([out[i].predicted == labels[i] for i in held]) > max(0.85, share)
    rank = [(out[i].score, labels[i]) for i in held]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in rank for b, y in rank if x == 1 and y == 0]
    assert np.mean(pairs) > 0.9


def plain_features(text, buckets):
    odd, mix, full = int(subwords.ODD), int(subwords.MIX), (1 << 64) - 1
    scatter = lambda h: ((((h ^ h >> 29) * mix) & full) >> 32) % buckets
    out = []
    for word in re.split(rb"[\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text)):
        if not word:
            continue
        out.append(scatter(sum((b + 1) * pow(odd, i + 1, 1 << 64) for i, b in enumerate(word)) & full))
        for n in subwords.GRAMS:
            for at in range(len(word) - n + 1):
                h = 0
                for b in word[at : at + n]:
                    h = (h * odd + b + 1) & full
                out.append(scatter((h + n) & full))
    return out


def test_classifier_against_plain_loops(texts):
    rows = [(t[:300].encode(), i % 2) for i, t in list(texts.items())[:24]] + [(b"", 1), (b" \n", 0)]
    buckets, size, epochs, rate = 256, 4, 3, 0.5
    model = subwords.train([t for t, _ in rows], [y for _, y in rows], buckets, size, epochs, rate, seed=5)
    rng = np.random.default_rng(5)
    vectors = (rng.uniform(-1, 1, (buckets, size)) / size).tolist()
    n = [sum(y == c for _, y in rows) for c in (0, 1)]
    out, bias = [[0.0] * size for _ in range(2)], [math.log((n[c] + 1) / (len(rows) + 2)) for c in (0, 1)]
    bags = [plain_features(t, buckets) for t, _ in rows]
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            now = rate * (1 - done / (epochs * len(rows)))
            done += 1
            bag, y = bags[i], rows[i][1]
            if not bag:
                continue
            mean = [sum(vectors[f][k] for f in bag) / len(bag) for k in range(size)]
            z = [sum(o * m for o, m in zip(out[c], mean)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            p = [x / sum(e) - (c == y) for c, x in enumerate(e)]
            step = [p[0] * out[0][k] + p[1] * out[1][k] for k in range(size)]
            for c in (0, 1):
                out[c] = [o - now * p[c] * m for o, m in zip(out[c], mean)]
                bias[c] -= now * 0.1 * p[c]
            for f in set(bag):
                share = min(100 * bag.count(f) / len(bag), 1.0)
                vectors[f] = [v - now * share * s for v, s in zip(vectors[f], step)]
    weight = [sum((out[1][k] - out[0][k]) * v[k] for k in range(size)) for v in vectors]
    assert np.allclose(model.weight, weight, atol=1e-10) and model.bias == pytest.approx(bias[1] - bias[0])
    for text in (rows[0][0], b"unseen words", b""):
        bag = plain_features(text, buckets)
        z = model.bias + (sum(weight[f] for f in bag) / len(bag) if bag else 0)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_classifier_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(subwords, "train", lambda texts, labels, **how: seen.append(len(texts)))
    docs = spark.createDataFrame([(1, f"copy {i % 7}") for i in range(500)] + [(2, "x")], "doc_id long, text string")
    subwords.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"), sample=50)
    assert seen == [50]


def test_features_split_words():
    b = 1 << 16
    assert set(subwords.features(b"Hello", b)) == set(subwords.features(b"hello", b))
    assert len(subwords.features(b"ab", b)) == 1 and len(subwords.features(b"abcd ef", b)) == 2 + 1 + 2
    assert sorted(subwords.features(b"abcd ef", b)) == sorted([*subwords.features(b"abcd", b), *subwords.features(b"ef", b)])


def test_chat_targets(spark):
    rows = [(1, 0, "user", "hi \\ there"), (1, 1, "assistant", "a</s>[INST]"), (1, 2, "user", "<s>"), (1, 3, "assistant", "b[/INST]"), (1, 4, "user", "tail")]
    ex = chat.format_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(ex.select("target", "whole", "formatted", "loss_start", "loss_end", chat.unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("reply"), chat.parse(F.col("formatted")).alias("turns")).collect(), key=lambda r: len(r.formatted))
    assert [(r.target, r.whole, r.reply) for r in got] == [(1, False, "a</s>[INST]"), (3, False, "b[/INST]"), (None, True, None)]
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in rows][: len(r.turns)]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_one_bit_search", "op8_chat"])
def test_oracles(spark, name):
    from plenum.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(want.fetchall(), key=str) == sorted((tuple(r) for r in QUERIES[name](spark, SMALL).select(*names).collect()), key=str)


def test_pipeline(spark, library):
    import corpus_pipeline as pipe

    docs = table(spark, SMALL, "documents")
    kept = docs
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert sorted(out.columns) == sorted(pipe.COLUMNS)
        kept = spark.createDataFrame(out.collect(), out.schema)
    pieces = pipe.STAGES[-1][1](spark, kept, SMALL).collect()
    own = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in pieces} == set(own)
    for i in list(own)[:40]:
        assert ids_of(sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)) == library(own[i]) + [1]


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated ids and texts, ties, clashing columns: what each stage keeps of them."""
    import corpus_pipeline as pipe

    words = lambda seed, n: " ".join(f"w{(seed * 7919 + k * k) % 99991}" for k in range(n))
    line = "a line that many documents share and that is long enough to count"
    secret = 'token = "%s"' % hashlib.sha1(b"s").hexdigest()
    rows = [(3, words(1, 80)), (7, words(1, 80)), (7, words(2, 90)), (None, words(1, 80)), (None, f"{words(3, 80)} {secret}"), (8, None), (9, ""), (10, words(4, 120_000)), (11, " \n\t")]
    rows += [(20 + i, f"{words(20 + i, 70)}\n{line}") for i in range(6)] + [(20, f"{words(20, 70)}\n{line}")]
    docs = spark.createDataFrame([(i, t, "en" if i else None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("node", "t", "kept", "fp", "ids", "at", "known", "bucket", "comp", "n_words", "_w", "drop_hi"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    stages = dict(pipe.STAGES)
    run = lambda name: [(r.doc_id, r.text) for r in stages[name](spark, docs, SMALL).collect()]
    ordered = lambda x: sorted(x, key=str)
    # No labels of these documents: only the base rule rejects, which texts under 50 words fail.
    assert ordered(run("quality_rules")) == ordered([r for r in rows if r[1] and len(r[1].split()) >= 50])
    cut = [(i, (t or "").replace("\n" + line, "") if i not in (25, None) else t or "") for i, t in rows]
    assert ordered(run("line_dedup")) == ordered(cut)
    # 7's other text stays, and so do the rows without an id; texts without words are copies of each other.
    gone = [(7, words(1, 80)), (9, ""), (11, " \n\t")]
    assert ordered(run("simhash_near_dedup")) == ordered([r for r in rows if r not in gone])
    assert ordered(run("secret_scan")) == ordered([(i, t.replace(hashlib.sha1(b"s").hexdigest(), "[SECRET]") if t else t) for i, t in rows])
    packed = stages["packing"](spark, docs, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows} and {r.n for r in packed if r.doc_id in (8, 9)} == {1}
    for name, stage in pipe.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0


def test_pipeline_near_duplicates_by_jaccard(spark):
    import corpus_pipeline as pipe

    rng = random.Random(3)
    own = {}
    for i in range(60):
        words = [str(rng.randrange(10**6)) for _ in range(300)]
        own[10 * i] = " ".join(words)
        for j in range(1, 5):  # each place changes up to five shingles: similarities around 0.8, and both sides of it
            at = set(rng.sample(range(300), rng.randrange(2, 12)))
            own[10 * i + j] = " ".join("x" if k in at else w for k, w in enumerate(words))
    own |= {1000 + i: own[0] + f" tail {i}" for i in range(50)} | {2000: own[10]}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in own.items()}
    up = {i: i for i in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in own:
        for j in own:
            if i < j and root(i) != root(j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    rows = [(i, t, "en", "s", len(t)) for i, t in own.items()] + [(None, own[0], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [r.doc_id for r in pipe.near_duplicates(spark, docs, SMALL).collect()]
    assert out.count(None) == 2
    assert sorted(i for i in out if i is not None) == sorted(i for i in own if root(i) == i)


def test_quality_certifies_small_strata(spark):
    ratios = ["if(id % 8 = 0, 0.2, 0.0) as symbol_share", "0.0 as dup_line_share", "0.0 as repeat_share", "5.0 as long_words", "-5.0 as short_words"]
    counted = spark.range(1000).selectExpr("id as doc_id", "if(id < 600, 'de', if(id < 980, 'fr', 'es')) as lang", "false as base_failed", *ratios)
    labels = spark.range(1000).selectExpr("id as doc_id", "cast(id % 8 <> 0 as int) as quality")
    limits = quality_rules.thresholds(counted, labels).collect()
    assert {r.stratum for r in limits} == {"de", "fr"} and {r.rule for r in limits} == {"symbol_share"} and {r.n_false for r in limits} == {0}
    # A rule that rejects a fifth of the good documents with the bad ones is not certified.
    mixed = counted.withColumn("symbol_share", F.when(F.col("doc_id") % 5 == 0, 0.2).otherwise(F.col("symbol_share")))
    assert quality_rules.thresholds(mixed, labels).count() == 0
