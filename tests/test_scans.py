"""Scans in parts give the rows of plain windows, and no part is long."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import scans
from plenum.operators import windows as W


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out, at = [], 0
    for i in range(3000):
        at += rng.choice([1, 1, 2, 5, 40])
        out.append((1, i, rng.choice("abc") if rng.random() < 0.6 else "a", at, at + rng.choice([1, 3, 90, 300])))
    # Short groups, ties of the first order column, a null key and null labels.
    out += [(2, 9000 + i, rng.choice(["x", None]), 5 * (i // 3), 5 * (i // 3) + 2) for i in range(60)] + [(None, 9500 + i, "n", i, i + 1) for i in range(20)]
    return spark.createDataFrame(out, "g int, id int, label string, s long, e long").cache()


def plain(d):
    return sorted(map(str, d.collect()))


def test_a_long_group_is_dealt(rows):
    d = scans.deal(rows, ["g"], "s", most=60, parts=256)
    sizes = {(r.g, r._part): r.n for r in d.groupBy("g", "_part").agg(F.count("*").alias("n")).collect()}
    assert sum(1 for g, _ in sizes if g == 1) >= 50 and max(sizes.values()) <= 150 and sizes[2, 0] == 60 and sizes[None, 0] == 20
    # The parts follow the order.
    ends = sorted((r._part, r.a, r.b) for r in d.where("g = 1").groupBy("_part").agg(F.min("s").alias("a"), F.max("s").alias("b")).collect())
    assert all(x[2] < y[1] for x, y in zip(ends, ends[1:]))


def test_beside_and_running(rows):
    order = ["s", "e", "id"]
    w = Window.partitionBy("g").orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"was": F.lag("label").over(w), "next": F.lead("e").over(w), "sum": F.sum("e").over(up), "top": F.max("e").over(up), "before": F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    d = scans.deal(rows, ["g"], "s", most=60, parts=256)
    d = scans.beside(d, ["g"], order, {"was": "label"})
    d = scans.beside(d, ["g"], order, {"next": "e"}, after=True)
    d = scans.running(d, ["g"], order, sums={"sum": F.col("e")}, tops={"top": F.col("e")})
    d = scans.running(d, ["g"], order, tops={"before": F.col("e")}, inclusive=False)
    assert plain(d.select(want.columns)) == plain(want)


def test_rules_equal_their_twins(spark, rows):
    known = rows.where("g is not null and label is not null")
    how = {"most": 60, "parts": 256}
    # Ties of (start, end) have no order in the plain twin, so it gets rows without any.
    own = known.where("g = 1").dropDuplicates(["s", "e"])
    cols = ["g", "label", "s", "e", "parts"]
    assert plain(scans.merge_gaps(own, "g", "label", "s", "e", 10, "id", **how).select(cols)) == plain(W.merge_gaps(own, "g", "label", "s", "e", 10).select(cols))
    cols = ["g", "run", "label", "s", "e"]
    assert plain(scans.label_runs(own, "g", "label", "s", "e", "id", **how).select(cols)) == plain(W.label_runs(own, "g", "label", "s", "e").select(cols))
    w = Window.partitionBy("g").orderBy("s", "id")
    want = known.withColumns({"b": F.lag("label").over(w), "a": F.lead("label").over(w)}).withColumn("label", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("label")))
    assert plain(scans.smoothed(known, "g", "label", ["s", "id"], **how).select("id", "label")) == plain(want.select("id", "label"))
    got = scans.gap_clusters(known, "g", "s", 5, "id", **how)
    want = W.islands(known, ["g"], ["s", "id"], F.col("s") - W.before("s", ["g"], ["s", "id"]) > 5, "cluster")
    assert plain(got.select("id", "cluster")) == plain(want.select("id", "cluster"))
    assert scans.merge_gaps(known.where("false"), "g", "label", "s", "e", 10, "id").count() == 0
