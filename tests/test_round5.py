"""Small tables for the findings of round 4, named by their numbers."""

import math
from collections import Counter

import numpy as np

from plenum.catalog import QUERIES
from plenum.operators import layout


def test_f2_pairs_of_a_page_make_small_files(spark, tmp_path):
    # One page of 1,500 figures and 1,500 others: before, names came back after a whole page and a pair took 0.97 bytes.
    parts = spark.range(4500).selectExpr("id * 40 as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "cast(pmod(xxhash64(id), 50) + 1 as int) as p_size")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    QUERIES["g4_trimmed"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 1500 * 1500 == out.select("figure", "other").distinct().count()
    size = sum(f.stat().st_size for f in (tmp_path / "out").iterdir() if f.suffix == ".parquet")
    assert size < 0.75 * 1500**2


def test_f2_blocks_hold_all_others(spark):
    # Equal boxes are cut into blocks, boxes without a side still meet, and rows without a page don't.
    boxes = spark.createDataFrame([(p, i, 0.0, 0.0, 1.0, 1.0) for p in (1, 2, None) for i in range(5)], "page int, figure int, ax0 double, ay0 double, ax1 double, ay1 double")
    others = spark.createDataFrame([(p, i, None if i % 7 == 0 else 0.0, 0.0, 1.0, 1.0) for p in (1, 3, None) for i in range(50)], "page int, other int, bx0 double, by0 double, bx1 double, by1 double")
    got = layout.meet_in_blocks(boxes, others, block=8, most=2, slices=1, parts=3)
    rows = [(r.page, r.figure, r.other, r.bx0) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(((1, f, o, None if o % 7 == 0 else 0.0) for f in range(5) for o in range(50)), key=str)


def _hybrid(query, q, docs, vectors, k=5):
    """The reference's search in one workspace, in plain loops: ``docs`` is collection -> {id: text}. Yields (collection, id, score)."""
    for name, texts in docs.items():
        words = {i: x.split() for i, x in texts.items()}
        n, mean_len = len(words), sum(map(len, words.values())) / len(words)
        df = Counter(w for x in words.values() for w in set(x))
        idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
        mean = sum(idf.values()) / len(idf)
        idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
        score = {i: sum(idf.get(w, 0) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean_len)) for w in query.split()) for i, x in words.items()}
        most = max(score.values()) if max(score.values()) > 0 else 1.0
        dense = {i: np.dot(q, vectors[i]) / np.linalg.norm(q) / np.linalg.norm(vectors[i]) for i in texts if i in vectors}
        for i in sorted(dense, key=lambda i: (-dense[i], i))[:k]:
            yield name, i, round(0.7 * dense[i] + 0.3 * max(0.0, min(score[i] / most, 1.0)), 4)


def test_f3_hybrid_search_of_workspaces(spark, tmp_path):
    # Workspaces have scores of their own, frequent words the library's floor, and the collections of a workspace are merged by score.
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(list("aabbccdefghij"), rng.integers(1, 9))), "xy"[i % 2], f"w{i % 3}", 1) for i in range(60)] + [(60, "a b", None, "w0", 1), (61, "a b", "x", None, 1)]
    vectors = {i: rng.normal(size=4) for i in range(62) if i % 5 != 4}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    items = {0: "a b d d", 1: "c a j", 2: "b zz"}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.query_id, r.workspace, r.place, r.lang, r.rank, r.id, r.score) for r in QUERIES["search_hybrid"](spark, str(tmp_path)).collect())
    want = []
    for item, text in items.items():
        for w in ("w0", "w1", "w2"):
            found = sorted(_hybrid(text, vectors[item], {c: {i: x for i, x, lang, source, _ in docs if (lang, source) == (c, w)} for c in "xy"}, vectors), key=lambda r: (-r[2], r[1]))
            ranks = Counter()
            for place, (c, i, score) in enumerate(found, 1):
                ranks[c] += 1
                want.append((item, w, place, c, ranks[c], i, score))
    assert got == sorted(want) and len(got) == 90
