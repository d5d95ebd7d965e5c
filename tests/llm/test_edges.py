"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from plenum.llm import bpe, chat, line_dedup, one_bit, orc_ids, packing, quality_rules, secrets, simhash, subwords
from plenum.llm.common import shared_folder

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [(1, "one line\nand another"), (2, None), (3, ""), (None, "no id here"), (4, LONG), (5, "same text"), (5, "same text"), (6, "same text"), (7, " \n\t\x0b\n"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, None, "s") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    for c in ("n_chars", "fp", "node", "ids", "part", "start", "key_hi", "drop_hi", "kept", "_w", "n_words", "at", "score", "_found"):
        d = d.withColumn(c, F.lit(None).cast("long"))
    return d


def empty(docs):
    return docs.where("false")


def test_line_dedup(spark, docs):
    index = line_dedup.LineIndex(spark)
    index.insert(docs)
    out = index.clean(docs).collect()
    assert len(out) == len(ROWS) and sum(r.n_dropped for r in out) == 0
    assert {r.text for r in out if r.doc_id in (2, 3)} == {""}
    line = "a line that is shared by six documents and long enough"
    rows = [(i, f"own {i}\n{line}\n{line}") for i in range(6)] + [(3, f"own 3\n{line}\n{line}"), (3, f"{line} but longer"), (None, line), (None, line), (9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drop_id", F.lit(1)).withColumn("key_lo", F.lit("x"))
    index = line_dedup.LineIndex(spark)
    index.insert(d)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in index.clean(d).collect()), key=str)
    want = [(i, f"own {i}", 3, 2) for i in range(5)] + [(5, rows[5][1], 3, 0), (3, "own 3", 3, 2), (3, f"{line} but longer", 1, 0), (None, line, 1, 0), (None, line, 1, 0), (9, "", 1, 0)]
    assert got == sorted(want, key=str)
    none = line_dedup.LineIndex(spark)
    none.insert(empty(docs))
    assert none.clean(empty(docs)).count() == 0


def test_packing(docs):
    out = packing.pack(docs, JSON).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = {r.doc_id: r.n for r in out}
    assert n[2] == n[3] == 1 and set(n) == {1, 2, 3, 4, 5, 6, 7, None}
    assert packing.pack(empty(docs), JSON).count() == 0


def test_one_bit(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [float("inf"), 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>").withColumn("score", F.lit(None).cast("long")).withColumn("cb", F.lit("x"))
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in one_bit.nearest(v.where("id in (1, 3, 9)"), v, k=20).collect()}
    assert out == {(1, 1): (8, 1.0), (1, 2): (2, 0.5)}
    assert one_bit.nearest(v.where("false"), v).count() == 0 == one_bit.nearest(v, v.where("false")).count()


def test_orc(spark, docs):
    path = shared_folder(spark, "edge-ids")
    orc_ids.write_ids(docs, path, JSON, files=3)
    out = orc_ids.digest(orc_ids.read_ids(spark, path)).orderBy("start").collect()
    assert len(out) == len(ROWS) and [r.doc_id for r in out] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
    path = shared_folder(spark, "no-ids")
    orc_ids.write_ids(empty(docs), path, JSON, files=2)
    assert orc_ids.read_ids(spark, path).count() == 0


def test_secrets(docs, spark):
    findings, small = secrets.labelled_findings(spark, 800), {"trees": 5, "depth": 5}
    assert secrets.scan(docs, findings, "source", **small).count() == 0
    assert secrets.scan(empty(docs), findings, **small).count() == 0
    assert secrets.redact(docs, secrets.scan(docs, findings, **small)).count() == len(ROWS)
    with pytest.raises(ValueError):
        secrets.scan(docs, findings.where("is_secret = 1"))


def test_simhash(docs):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    of = {}
    for r in out:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[2] == of[3] == of[7] == {2} and of[5] == of[6] == {5}
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_subwords(docs, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None), (4, 7), (5, 1)], "doc_id long, label int")
    model = subwords.fit(docs, labels)
    out = subwords.score(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    blank = subwords.fit(docs, labels.where("false"))
    assert {r.score for r in subwords.score(docs, blank).collect()} == {0.5}
    assert subwords.score(empty(docs), model).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "x"), (None, 0, "assistant", "y\\</s>"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("at", F.lit(1))
    out = {r.conv_id: r for r in chat.digest(chat.format_examples(turns)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 2, 2: 1, None: 1, 3: 2}
    assert {k: r.loss_chars for k, r in out.items()} == {1: 0, 2: 0, None: 6, 3: 2}
    assert chat.format_examples(turns.where("false")).count() == 0


def test_quality(docs, spark):
    counted = quality_rules.with_counts(docs)
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    out = quality_rules.judged(counted, quality_rules.thresholds(counted, labels)).collect()
    assert len(out) == len(ROWS) and not any(r.kept for r in out)
    assert {r.n_words for r in out if r.doc_id in (2, 3, 7)} == {0}
    none = quality_rules.with_counts(empty(docs))
    assert quality_rules.judged(none, quality_rules.thresholds(none, labels.where("false"))).count() == 0


def test_bpe(docs):
    out = bpe.digests(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(out) == len(ROWS) and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    assert bpe.encode(empty(docs), RANKS, P.PATTERN).count() == 0
