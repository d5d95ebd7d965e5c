"""Versioned tables: conflicts, old readers, broken writes; and the keyword index beside plain BM25."""

import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import lexical
from plenum.operators import search as S
from plenum.operators.lexical import LexicalIndex
from plenum.operators.snapshots import Conflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    t.create(spark.createDataFrame([(i, f"s{i % 3}", i * 10) for i in range(100)], "id long, status string, n long"))
    return t


def ids(d):
    return sorted(r.id for r in d.collect())


def test_versions_and_old_readers(spark, table):
    old = table.read()
    assert table.upsert(spark.createDataFrame([(5, "new", 1), (200, "new", 2)], "id long, status string, n long")) == 1
    assert table.delete(spark.createDataFrame([(i,) for i in range(50)], "id long")) == 2
    assert table.update("status = 's0'", {"status": F.lit("done"), "n": F.col("n") + 1}) == 3
    assert ids(old) == list(range(100)) == ids(table.read(0)) and ids(table.read(1)) == [*range(100), 200]
    now = {r.id: (r.status, r.n) for r in table.read().collect()}
    assert sorted(now) == [*range(50, 100), 200] and now[51] == ("done", 511) and now[52] == ("s1", 520) and now[200] == ("new", 2)
    assert table.update("status = 'nobody'", {"n": F.lit(0)}) == 3


def test_one_of_two_writers_conflicts(spark, table):
    one = spark.createDataFrame([(7, "a", 0)], "id long, status string, n long")
    table.upsert(one, base=0)
    with pytest.raises(Conflict):
        table.upsert(one.withColumn("status", F.lit("b")), base=0)
    assert table.version() == 1 and table.read().where("id = 7").first().status == "a"
    # A writer whose keys lie in other buckets goes on top.
    bucket = {r.id: r.b for r in spark.range(100).select("id", table_bucket(table).alias("b")).collect()}
    other = next(i for i in range(100) if bucket[i] != bucket[7])
    assert table.delete(spark.createDataFrame([(other,)], "id long"), base=0) == 2
    assert ids(table.read()) == [i for i in range(100) if i != other] and table.read().where("id = 7").first().status == "a"
    with pytest.raises(Conflict):
        table.create(one)


def table_bucket(table):
    return table._bucket()


def test_a_broken_write_leaves_the_old_version(spark, table, monkeypatch):
    rows = spark.createDataFrame([(1, "x", 0)], "id long, status string, n long")

    def broken(*_):
        raise OSError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_put", broken)
        with pytest.raises(OSError):
            table.upsert(rows)
    assert table.version() == 0 and table.read().where("id = 1").first().status == "s1"
    failing = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        table.upsert(rows.withColumn("n", failing("n")))
    assert table.version() == 0 and table.upsert(rows) == 1


def test_many_writers_at_once(spark, table):
    from concurrent.futures import ThreadPoolExecutor

    def write(i):
        try:
            return table.upsert(spark.createDataFrame([(i, f"w{i}", i)], "id long, status string, n long"), base=0)
        except Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = dict(zip(range(8), pool.map(write, range(8))))
    versions = sorted(v for v in done.values() if v)
    assert versions == list(range(1, len(versions) + 1))
    now = {r.id: r.status for r in table.read().collect()}
    assert all(now[i] == (f"w{i}" if v else f"s{i % 3}") for i, v in done.items())


WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "été", "the", "of"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    weights = [1, 2, 3, 4, 5, 6, 2, 60, 40]
    rows = [(i, "ab"[i % 2], " ".join(rng.choices(WORDS, weights, k=rng.randrange(60)))) for i in range(n)]
    return rows + [(n, "a", None), (n + 1, "b", ""), (n + 2, "c", " \n\talpha  alpha\n")]


def plain(spark, queries, rows):
    docs = spark.createDataFrame(rows, "id long, scope string, text string")
    return {(r.query_id, r.scope, r.id): round(r.keyword, 9) for r in S.bm25(queries, docs, "scope").collect()}


def scores(d):
    return {(r.query_id, r.scope, r.id): round(r.keyword, 9) for r in d.collect()}


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, "alpha beta the"), (2, "été of of unknown"), (3, None), (4, "zeta gamma delta epsilon the of")], "query_id long, text string")


def test_index_equals_plain_scores(spark, tmp_path, queries):
    rows = corpus(400)
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    d = spark.createDataFrame(rows, "id long, scope string, text string")
    index.insert(d.where("id % 3 = 0"))
    index.insert(d.where("id % 3 > 0").unionByName(d.where("id = 1").withColumn("id", F.lit(None).cast("long"))))
    want = plain(spark, queries, rows)
    assert scores(index.scores(queries)) == want
    for k, first, bounded in ((3, 1, True), (10, 4, None), (5, 1, False)):
        got = {(r.query_id, r.scope, r["rank"]): (r.id, round(r.keyword, 9)) for r in index.top(queries, k, first, 9, bounded).collect()}
        best = {}
        for (q, s, i), w in sorted(want.items(), key=lambda x: (-x[1], x[0][2])):
            n = 1 + sum(1 for key in best if key[:2] == (q, s))
            if n <= k:
                best[q, s, n] = (i, w)
        assert got == best


def test_insert_then_delete_leaves_equal_results(spark, tmp_path, queries):
    rows = corpus(200)
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.insert(spark.createDataFrame(rows, "id long, scope string, text string"))
    before = scores(index.scores(queries))
    more = spark.createDataFrame([(1000 + i, s, t) for i, s, t in corpus(90, 2)], "id long, scope string, text string")
    index.insert(more)
    assert scores(index.scores(queries)) != before
    index.delete(more.select("id"))
    assert scores(index.scores(queries)) == before == plain(spark, queries, rows)
    top = [tuple(r)[:4] for r in index.top(queries, 5, digits=9).orderBy("query_id", "scope", "rank").collect()]
    # A document that comes again after its deletion lives; the compacted index gives the same.
    index.delete(spark.createDataFrame([(0,)], "id long"))
    index.insert(spark.createDataFrame([r for r in rows if r[0] == 0], "id long, scope string, text string"))
    assert scores(index.scores(queries)) == before
    small = index.compact(f"file://{tmp_path}/small")
    assert scores(small.scores(queries)) == before and len(small._folders("docs")) == 1 and not small._folders("deleted")
    assert [tuple(r)[:4] for r in small.top(queries, 5, digits=9).orderBy("query_id", "scope", "rank").collect()] == top


def test_a_query_reads_only_its_terms(spark, tmp_path):
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    docs = spark.createDataFrame([(i, "a", f"w{i} w{i + 1} w{i + 2}") for i in range(3000)], "id long, scope string, text string")
    index.insert(docs)
    asked, buckets = index._asked(spark.createDataFrame([(1, "w77 w2000")], "query_id long, text string"))
    assert len(buckets) <= 2
    plan = index._blocks(asked, buckets)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    files = index._read("postings", buckets).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in files} <= set(buckets)
    # Most groups of documents are never read: their bounds don't reach the best score.
    groups = index._read("postings").select("seq", "group").distinct().count()
    hit = index._blocks(asked, buckets).select("group").distinct().count()
    assert groups > 40 and hit <= 4


def test_broken_segment_is_not_seen(spark, tmp_path, queries, monkeypatch):
    rows = corpus(60)
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.insert(spark.createDataFrame(rows, "id long, scope string, text string"))
    before = scores(index.scores(queries))
    # Postings of a segment whose last step didn't come.
    index._read("postings").drop("seq").write.partitionBy("bucket").parquet(f"{index.path}/postings/{index._next()}")
    assert scores(index.scores(queries)) == before
    empty = LexicalIndex(spark, f"file://{tmp_path}/empty")
    with pytest.raises(ValueError):
        empty.sizes()
    empty.insert(spark.createDataFrame([(1, "a", ""), (2, "a", None)], "id long, scope string, text string"))
    assert empty.scores(queries).count() == 0 == empty.top(queries, 3).count() and empty.sizes().first().n_docs == 2


def test_long_texts_and_string_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 50)
    text = "x " * 400 + "needle" + " y" * 300 + "z" * 200
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.insert(spark.createDataFrame([("one", 1, text), ("two", 1, "x needle")], "id string, scope int, text string"))
    p = {(r.token, r.id): (r.tf, r.len) for r in index.postings(index._read("postings")).collect()}
    assert p["x", "one"] == (400, 701) and p["needle", "two"] == (1, 2) and p["y" , "one"][0] == 299


def test_scores_are_added_up_by_document(spark, tmp_path, queries, monkeypatch):
    """No table of all pairs of queries and documents is made: tasks add up, and hand on the best, the wanted ones and the sums."""
    rows = corpus(300) + [(1000 + i, "a", "alpha alpha beta") for i in range(80)]
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.insert(spark.createDataFrame(rows, "id long, scope string, text string"))
    monkeypatch.setattr("plenum.operators.lexical.SUMS", 64)
    monkeypatch.setattr("plenum.operators.lexical.ASKED", 4)
    want = plain(spark, queries, rows)
    assert scores(index.scores(queries)) == want
    sums = {}
    for (q, s, _), w in want.items():
        n, total, most = sums.get((q, s), (0, 0.0, 0.0))
        sums[q, s] = n + 1, total + w, max(most, w)
    near = lambda a, b: abs(a - b) < 1e-6
    got = {(r.query_id, r.scope): r for r in index.totals(queries).collect()}
    assert got.keys() == sums.keys() and all(got[k].n == n and near(got[k].total, t) and near(got[k].most, m) for k, (n, t, m) in sums.items())
    asked = [(q, i) for n, (q, _, i) in enumerate(sorted(want)) if n % 3 == 0] + [(queries.first().query_id, 10**9)]
    some, totals = index.among(queries, spark.createDataFrame(asked, "query_id long, id long"))
    assert scores(some) == {k: w for k, w in want.items() if (k[0], k[2]) in set(asked)} and totals.count() == len(sums)
    best = index.top(queries, 3, digits=9, bounded=False)
    assert "HashAggregate" not in best._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    # A row that repeats an id is the same document.
    twice = rows + rows[:40]
    more = LexicalIndex(spark, f"file://{tmp_path}/twice")
    more.insert(spark.createDataFrame(twice, "id long, scope string, text string"))
    assert scores(more.scores(queries)) == plain(spark, queries, twice)
