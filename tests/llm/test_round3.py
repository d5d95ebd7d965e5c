"""Sharding, tiered search, phrases, and features of long texts, against brute force and odd rows."""

import math
import random
import re
import resource
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import bpe, orc_ids, phrases, sharding, subwords, tiered_index
from plenum.llm.common import shared_folder

WORDS = ["the", "of", "New", "york", "CITY", "café", "a1", "red", "car", "ice", "cream"]
SCHEMA = "doc_id long, text string, lang string"


def corpus(n, seed=1, cut=" "):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, [20, 15, 4, 4, 4, 2, 1, 6, 5, 3, 3], k=rng.randrange(90))
        text = "".join(w + rng.choice([cut, cut, cut, cut, ". ", "\n", "  ", "\t", ", "]) for w in words)
        rows.append((i, text + " new york city" * (i % 3), rng.choice(["en", "de", None])))
    return rows + [(n, None, "en"), (n + 1, "", "de"), (n + 2, "...\n!?", None), (None, "no id the of", "en"), (None, "no id the of", "en"), (7, "same id red car", "en")]


def frame(spark, rows):
    """Other columns have clashing names."""
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("shard", "slot", "range", "size", "place", "key", "salt", "term", "tier", "item_id", "score", "n", "words", "cnt", "phrase"):
        d = d.withColumn(c, F.lit(1))
    return d


# Sharding


def shards(spark, rows, n=24, **how):
    d, path = frame(spark, rows), shared_folder(spark, "test-shards")
    sharding.write_shards(d, path, n, **how)
    return sharding.read_shards(spark, path, d.schema).collect()


def check_laws(rows, got, n):
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    assert all(r.size == size(r.text) and 0 <= r.shard < n for r in got)
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # In the order of shards and slots the keys ascend, and each end is the nearest that there is.
    import hashlib

    key = lambda r: (int(hashlib.md5((r.text or "").encode()).hexdigest()[:15], 16), r.doc_id is not None, r.doc_id or 0)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [key(r) for r in order] == sorted(map(key, got))
    below = [0]
    for r in order:
        below.append(below[-1] + r.size)
    for j in range(1, n):
        cut = below[sum(r.shard < j for r in order)]
        assert abs(cut * n - j * below[-1]) == min(abs(b * n - j * below[-1]) for b in below)


def test_shards_by_brute_force(spark):
    rows = corpus(300)
    check_laws(rows, shards(spark, rows), 24)
    check_laws(rows, shards(spark, rows, 1), 1)
    few = rows[:5]
    check_laws(few, shards(spark, few), 24)


def test_a_group_of_copies_is_cut(spark):
    rows = [(i, "one text that a third of all rows have, and it is not short", "en") for i in range(400)] + [(None, "again and again", "en")] * 300 + corpus(200)
    got = shards(spark, rows)
    check_laws(rows, got, 24)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)


def test_ranges_inside_shards_and_tolerance(spark):
    rows = corpus(400, 2)
    got = shards(spark, rows, 4, range_bytes=2000)
    check_laws(rows, got, 4)
    loose = shards(spark, rows, 6, tolerance=0.1)
    sizes = Counter()
    for r in loose:
        sizes[r.shard] += r.size
    mean, most = sum(sizes.values()) / 6, max(r.size for r in loose)
    assert all(abs(s - mean) <= 0.2 * mean + most for s in sizes.values())
    path = shared_folder(spark, "no-shards")
    empty = frame(spark, corpus(1)).where("false")
    sharding.write_shards(empty, path)
    assert sharding.read_shards(spark, path, empty.schema).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(empty, path, 0)


# Tiered search


def brute_search(rows, items, k=20):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    docs = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t, _ in rows if i is not None]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    asked = {}
    for item, text in dict.fromkeys(items):
        if item is not None:
            asked.setdefault(item, Counter()).update(term.findall((text or "").translate(lower)))
    for item, terms in asked.items():
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // max(1, total)
            score = sum(times * math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if c[t])
            found.append((-score, i))
        for rank, (score, i) in enumerate(sorted(x for x in found if x[0] < 0)[:k], 1):
            out[item, rank] = (i, -score)
    return out


@pytest.mark.parametrize(("postings", "tiers"), [(10**6, (64, 512)), (40, (1, 3)), (300, (2,)), (1, (1, 1, 1))])
def test_tiered_search_by_brute_force(spark, monkeypatch, postings, tiers):
    monkeypatch.setattr(tiered_index, "POSTINGS", postings)
    rows = corpus(260, 3) + [(1000 + i, f"rare{i} red car", "en") for i in range(30)]
    items = [(1, "new York café"), (2, "the of"), (3, None), (4, "nothing known"), (5, "rare3 rare4 red RED ice"), (5, "car"), (1, "new York café"), (None, "the"), (6, "a1 cream " * 30)]
    path = shared_folder(spark, "test-index")
    tiered_index.build(frame(spark, rows), path, tiers)
    index = tiered_index.TieredIndex(spark, path)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("tier", F.lit("x"))
    for k in (3, 20):
        got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in index.search(asked, k, len(tiers) + 1).collect()}
        assert got == brute_search(rows, items, k)
    assert index.asked[0] == 0
    assert index.search(asked.where("false")).count() == 0


def test_items_in_blocks_and_proofs(spark, monkeypatch):
    # A shard of many documents without the item's words is proven by the first tier.
    rows = [(i, f"common word{i % 50} filler{i}", "en") for i in range(3000)] + [(5000 + i, "needle " * 5 + "in hay", "en") for i in range(30)]
    path = shared_folder(spark, "test-proofs")
    monkeypatch.setattr(tiered_index, "POSTINGS", 900)
    tiered_index.build(spark.createDataFrame(rows, SCHEMA).repartition(4), path, (8, 64))
    index = tiered_index.TieredIndex(spark, path)
    items = [(1, "needle"), (2, "common"), (3, "needle hay word7")]
    monkeypatch.setattr(tiered_index, "BLOCK_TERMS", 2)
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in index.search(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_search(rows, items)
    shards_there = index.postings.where("tier = -1").count()
    assert 0 < index.asked[1] < 3 * shards_there and index.asked[2] <= index.asked[1]
    empty = shared_folder(spark, "test-no-index")
    tiered_index.build(spark.createDataFrame([], SCHEMA), empty)
    assert tiered_index.TieredIndex(spark, empty).search(spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    for module, parts in ((tiered_index, tiered_index.terms_of), (phrases, phrases.tokens_of)):
        text = ("ab, Cd. éf\n" * 50 + "x" * 200 + " end").encode()
        whole = [t for p in parts(text) for t in p]
        for size in (1, 7, 64):
            monkeypatch.setattr(module, "SLICE", size)
            assert [t for p in parts(text) for t in p] == whole
        monkeypatch.undo()


# Phrases


def brute_phrases(rows, least, most=2000, longest=5):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    gone = {(lang, p[i : i + k]) for (lang, p), c in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= 100 * f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in often.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    got = []
    for lang, found in out.items():
        found.sort(key=lambda x: (x[0], x[1], x[2].encode()))
        got += [(lang, i, p, -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(found[:most], 1)]
    return sorted(got)


@pytest.mark.parametrize(("positions", "bits"), [(phrases.POSITIONS, phrases.FILTER_BITS), (11, 1 << 16), (40, 64)])
def test_phrases_by_brute_force(spark, positions, bits):
    # Short shards cut pieces, and a filter of 64 bits lets everything pass: the result stays the same.
    rows = corpus(150, 4) + [(900, "the of " * 300, "en"), (901, "x y" * 50 + " " + "new york " * 120, "de")]
    got = phrases.collocations(frame(spark, rows), least=20, positions=positions, filter_bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 20)


def test_phrases_of_other_lengths_and_odd_rows(spark):
    rows = corpus(80, 5)
    for longest in (2, 3):
        got = phrases.collocations(frame(spark, rows), least=15, most=7, longest=longest)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 15, 7, longest)
    none = frame(spark, rows).where("false")
    assert phrases.collocations(none, least=1).count() == 0
    blank = frame(spark, [(1, None, None), (2, "", "en"), (3, " .. \t", "en")])
    assert phrases.collocations(blank, least=1).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(none, longest=1)


def test_word_without_marks_longer_than_a_shard(spark):
    rows = [(1, " ".join(f"w{i % 7}" for i in range(500)), "en")]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=3, positions=20)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 3)


# What changed in other operators


def test_features_in_slices(monkeypatch):
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("abcd \n\té") for _ in range(rng.randrange(60))).encode()
        whole = sorted(subwords.features(text, 1 << 16))
        for size in (1, 2, 3, 5, 8, 64):
            assert sorted(np.concatenate([np.zeros(0, np.int64), *subwords.feature_slices(text, 1 << 16, size)])) == whole
        at, n = subwords.bag(text, 1 << 16)
        assert Counter(whole) == dict(zip(at, n))


def test_a_long_text_is_scored_in_little_memory():
    # 200 MB of words and a word of 20 MB, in a process of its own, whose memory is measured.
    code = (
        "import resource, numpy as np; from plenum.llm import subwords as s; text = b'lorem ipsum dolor sit amet ' * 7_500_000 + b'x' * 20_000_000;"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; m = s.Model(np.ones(1 << 16), 0.0); print(round(m.score(text), 6), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    score, mb = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout.split()
    assert float(score) == pytest.approx(1 / (1 + math.exp(-1)), abs=1e-5) and int(mb) < 300


def test_ids_of_null_are_dealt_over_files(spark):
    import public_tokenizers as P

    rows = [(None, f"text {i % 40}") for i in range(400)] + [(3, "same")] * 200
    path = shared_folder(spark, "null-ids")
    orc_ids.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("byte_bpe_50k.json"), files=6)
    per_file = [r.n for r in spark.read.orc(path).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(per_file) >= 5 and max(per_file) < 250
    got = orc_ids.digest(orc_ids.read_ids(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 400 + [3] * 200 and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(600)]
