"""Literal rows for the findings of round 3, named by their numbers."""

import numpy as np
from pyspark.sql import functions as F

from plenum.functions import cleaning as C
from plenum.operators import evaluation, intervals, layout, scans
from plenum.plans.registry import QUERIES
from tests.conftest import SMALL


def test_f6_first_lines_keep_digits(spark):
    # The index of a line was taken for the characters to strip.
    text = "0 first 0\n  call 16.155.205.171\n\n 3 three 33 "
    assert spark.createDataFrame([(text,)], "t string").select(C.first_lines(F.col("t"))).first()[0] == "0 first 0 call 16.155.205.171 3 three 33"


def test_f7_runs_of_equal_times(spark):
    # x and y are clipped to the same times; the cuts are those between x, y and the second x.
    segments = spark.range(400).selectExpr("id as meeting_id", "0 as segment_index", "0l as start", "10000l as end")
    slots = segments.selectExpr("meeting_id", "explode(array(struct('x' as name, -10l as s, 10000l as e), struct('y' as name, -5l as s, 10000l as e), struct('x' as name, 4000l as s, 10000l as e))) as p")
    slots = slots.selectExpr("meeting_id", "p.name", "p.s as slot_start", "p.e as slot_end").repartition(7)
    got = intervals.split_at_runs(segments, slots, ["meeting_id", "segment_index"]).collect()
    assert sorted((r.meeting_id, r.part, r.start, r.end) for r in got) == [(m, *p) for m in range(400) for p in ((0, 0.0, 5000.0), (1, 5000.0, 7000.0), (2, 7000.0, 10000.0))]


def _boxes(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_f1_f9_f10_equal_boxes_meet_once(spark):
    # Many figures and texts in two places: the pairs that the join makes are those of the places.
    a = "page int, figure int, ax0 double, ay0 double, ax1 double, ay1 double"
    figures = _boxes(spark, [(1, i, 0.0, 0.0, 10.0, 40.0 if i % 2 else 10.0) for i in range(60)], a)
    texts = _boxes(spark, [(1, "t", 0.0, 0.0, 5.0, 10.0) for _ in range(60)] + [(1, " ", 0.0, 0.0, 9.0, 99.0)], "page int, text string, bx0 double, by0 double, bx1 double, by1 double")
    assert {r.figure for r in layout.over_text(figures, texts).collect()} == set(range(0, 60, 2))
    cells = _boxes(spark, [(1, 0.0, 0.0, 10.0, 8.0, [["a", "b"], ["c", "d"]])] * 60, "page int, bx0 double, by0 double, bx1 double, by1 double, cells array<array<string>>")
    assert {r.figure for r in layout.over_tables(figures, cells).collect()} == set(range(0, 60, 2))
    # A box alone in its place isn't in another; two of one place are.
    others = _boxes(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 7, 0.0, 0.0, 10.0, 40.0), (1, 7, 0.0, 0.0, 10.0, 41.0)], "page int, other int, bx0 double, by0 double, bx1 double, by1 double")
    assert {r.figure for r in layout.contained(figures, others).collect()} == set(range(60)) - {7}
    for out in (layout.over_text(figures, texts), layout.over_tables(figures, cells), layout.contained(figures, others)):
        assert "_slice" in out._jdf.queryExecution().optimizedPlan().toString()


def test_f3_reading_order_of_a_long_page():
    # 50,000 blocks on a page: a table of all pairs would take 20 GB.
    n = 50_000
    y = np.arange(n, dtype=float)
    b = np.stack([np.zeros(n), y, np.full(n, 10.0), y + 1], 1)
    b[::1000, 2] = 100
    order = layout.reading_places(b)
    assert sorted(order.tolist()) == list(range(n)) and order.tolist() == list(range(n))


def test_f4_f5_places_and_ranks(spark):
    figures = _boxes(spark, [(1, i, 0.0, 50.0, 10.0) for i in range(9)], "page int, figure int, x0 double, y0 double, x1 double")
    texts = [(1, t, "body", 0.0, 5.0, e) for t, e in (("b", 40.0), ("a", 40.0), ("c", 30.0), ("x" * 81, 45.0))] + [(1, "h", "heading", 0.0, 5.0, 60.0)]
    out = layout.nearest_caption(figures, _boxes(spark, texts, "page int, text string, style string, tx0 double, tx1 double, bottom double"))
    assert sorted(map(tuple, out.collect())) == [(1, i, "a") for i in range(9)]
    assert "_slice" in out._jdf.queryExecution().optimizedPlan().toString()
    lines = _boxes(spark, [(1, i, 2, 0.0, 0.0, 10.0, 10.0) for i in range(9)] + [(2, 9, 2, 0.0, 0.0, 1.0, 1.0)], "page int, line int, rank int, ax0 double, ay0 double, ax1 double, ay1 double")
    regions = [(1, r, f"r{r}", 0.0, 0.0, 10.0, y) for r, y in ((3, 6.0), (2, 8.0), (1, 8.0), (3, 4.0))]
    out = layout.style_override(lines, _boxes(spark, regions, "page int, region_rank int, style string, bx0 double, by0 double, bx1 double, by1 double"))
    assert sorted(map(tuple, out.collect())) == [(1, i, "r2") for i in range(9)] + [(2, 9, None)]
    assert "_slice" in out._jdf.queryExecution().optimizedPlan().toString()


def test_f8_f15_f17_parts_by_halves(spark):
    # The parts are those of counting the cuts, and no expression walks over all of them for a row.
    d = spark.range(5000).selectExpr("0 as g", "cast(case when id % 50 = 7 then null else id * id % 997 end as double) as v", "id")
    out = scans.deal(d, ["g"], "v", most=100, parts=64)
    assert "(_cuts" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "aggregate(_cuts" not in plan
    rows = out.collect()
    first, last = {}, {}
    for r in rows:
        if r.v is None:
            assert r._part == 0
            continue
        first[r._part] = min(first.get(r._part, r.v), r.v)
        last[r._part] = max(last.get(r._part, r.v), r.v)
    parts = sorted(first)
    assert parts == list(range(len(parts))) and 40 <= len(parts) <= 64
    assert all(last[a] < first[b] for a, b in zip(parts, parts[1:]))


def test_f18_f20_equal_rows_are_drawn_at_once(spark):
    # A million rows with twenty different values: row by row these are ten thousand million draws.
    d = spark.range(1_000_000).selectExpr("id", "cast(id % 4 as int) as e", "cast(10 + id % 5 as int) as n")
    low, high = evaluation.bootstrap(d, "id", "e", "n").first()
    assert low < 0.125 < high and 0.0002 < high - low < 0.0006
    assert (low, high) == tuple(evaluation.bootstrap(d.repartition(5, "e"), "id", "e", "n").first())
    rates = evaluation.resampled(d.limit(1000), "id", ["e", "n"], 4000).selectExpr("avg(e) as e", "stddev(e) as s").first()
    assert abs(rates.e - 1500) < 4 and abs(rates.s - 59.16) < 3  # the sum's deviation is the root of the squares' sum, 3500


def test_f12_only_places_that_conflicts_name_are_numbered(spark):
    plan = QUERIES["d10_resolve"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 2000" in plan[plan.index("Window") :]


def test_f25_folders_are_fewer_than_meetings(spark, monkeypatch, tmp_path):
    from plenum.plans import sources

    monkeypatch.setattr(sources, "shared_folder", lambda *_: str(tmp_path / "t"))
    QUERIES["io12_transcript"](spark, "/root/testdata/sf0.01").count()
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert 0 < len(files) <= 128 and len({f.parent for f in files}) <= 64
