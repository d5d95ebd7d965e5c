"""Literal rows for rules that the driver's tables can't exercise."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.functions import cleaning as C
from plenum.functions import korean as K
from plenum.functions import scalars as V
from plenum.functions import scores, tables
from plenum.operators import chunking, decisions, evaluation, greedy, layout, measures, relational, search, speakers, windows
from plenum.sources import readers


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return d.select(column).first()[0]


def test_quota(spark):
    rows = lambda *r: spark.createDataFrame([(1, i, s, float(x)) for i, s, x in r], "q int, id string, source string, score double")
    d = rows(("d1", "d", 0.9), ("d2", "d", 0.3), ("m1", "m", 0.95), ("m2", "m", 0.5))
    get = lambda d, k, least: [r.id for r in search.quota_merge(d, ["q"], "source", "score", "id", k, least).orderBy("rank").collect()]
    assert get(d, 3, 0) == ["m1", "d1", "m2"]
    got = get(rows(("d1", "d", 0.30), ("d2", "d", 0.25), *((f"m{i}", "m", 0.9 - i / 100) for i in range(5))), 4, 2)
    assert {"d1", "d2"} <= set(got) and sum(x[0] == "m" for x in got) == 2
    assert set(get(rows(*((f"{s}{i}", s, 0.5 - i / 10) for s in "dmx" for i in (1, 2))), 3, 2)) == {"d1", "m1", "x1"}


@pytest.mark.parametrize("value, want", [("0.75", 0.75), ("1.4", 1.0), ("-0.3", 0.0), ("x", 0.0), (None, 0.0)])
def test_clamp(spark, value, want):
    assert one(spark, V.clamp_score(F.col("v")), v=value) == want


@pytest.mark.parametrize("answer, want", [("a [출처: 1,3]", [1, 3]), ("a [출처: 9]", [1, 2, 3]), ("a", [1, 2, 3]), ("[출처: 2, 2] ", [2])])
def test_citations(spark, answer, want):
    assert one(spark, V.citations(F.col("a"), F.col("n")), a=answer, n=3) == want


def test_spacing(spark):
    join = lambda t: one(spark, C.joined_letters(F.col("t")), t=t)
    assert join("회 의 록 정리") == "회의록 정리" and join("A B C D") == "A B C D" and join("가 나") == "가 나"
    assert one(spark, C.vertical_restored(F.col("t")), t=["회", "의", "록", "a long line", "x", "y"]) == ["회의록", "a long line", "x", "y"]


@pytest.mark.parametrize("word, want", [("팔천이", 8002), ("구십사", 94), ("십육", 16), ("팔백만", 8_000_000), ("삼조이천억", 3_200_000_000_000), ("만", 10_000), ("오륙", 6), ("집", None), ("", None)])
def test_sino(word, want):
    assert K.sino_number(word) == want


@pytest.mark.parametrize("word, want", [("열다섯", 15), ("스물셋", 23), ("두", 2), ("열", 10), ("집", None)])
def test_native(word, want):
    assert K.native_number(word) == want


def test_spans(spark):
    d = spark.createDataFrame([(1, 1, "Hello", 0.0, 10.0), (1, 2, "World", 15.0, 20.0), (2, 1, "abc", 0.0, 10.0), (2, 2, "def", 10.0, 20.0), (3, 1, "ab", 0.0, 5.0), (3, 2, "c", 4.0, 9.0)], "line int, pos int, text string, x0 double, x1 double")
    assert {r.line: r.text for r in layout.joined_spans(d, "line").collect()} == {1: "Hello World", 2: "abcdef", 3: "abc"}


def places(rows):
    return layout.reading_places(np.array([r[2:] for r in rows], float)).tolist()


def column(x0, x1, ys, height=8):
    return [(1, 0, x0, y, x1, y + height) for y in ys]


def test_reading_order(spark):
    wide = lambda y: [(1, 0, 0.0, y, 100.0, y + 5.0)]
    # Two columns of three lines each, given row by row, between two separators.
    mixed = [r for pair in zip(column(55, 95, (20, 30, 40)), column(5, 45, (20, 30, 40))) for r in pair]
    page = wide(0) + mixed + wide(60)
    assert places(page) == [0, 2, 4, 6, 1, 3, 5, 7]
    d = spark.createDataFrame([(1, i, *map(float, r[2:])) for i, r in enumerate(page)], "page int, pos int, x0 double, y0 double, x1 double, y1 double")
    assert [r.pos for r in layout.reading_order(d).orderBy("place").collect()] == [0, 2, 4, 6, 1, 3, 5, 7]
    # Too few lines, labels beside values, a third start: the order given stays, even where it isn't from the top.
    assert places(wide(0) + column(55, 95, (30, 20)) + column(5, 45, (20, 30))) == [0, 1, 2, 3, 4]
    labels = [r for pair in zip(column(40, 95, (40, 20, 30)), column(0, 8, (40, 20, 30))) for r in pair]
    assert places(labels) == list(range(6))
    assert places(mixed + column(25, 50, (90,)) + wide(0)) == [7, *range(7)]
    # Columns that don't stand beside each other are none.
    assert places(column(55, 95, (20, 30, 40)) + column(5, 45, (120, 130, 140))) == list(range(6))
    # A wide block with something on its left in the same row separates nothing.
    row = [(1, 0, 0.0, 50.0, 20.0, 58.0), (1, 0, 21.0, 50.0, 100.0, 58.0)]
    assert places(row + column(5, 45, (10, 20, 30)) + column(55, 95, (10, 20, 30))) == list(range(8))
    assert places([]) == [] and places(wide(3)) == [0]


def test_layout_joins(spark):
    f = spark.createDataFrame([(1, "f", 0.0, 100.0, 50.0)], "page int, figure string, x0 double, y0 double, x1 double")
    t = spark.createDataFrame([(1, "near", "body", 0.0, 40.0, 95.0), (1, "far", "title", 0.0, 40.0, 10.0), (1, "beside", "body", 60.0, 90.0, 99.0)], "page int, text string, style string, tx0 double, tx1 double, bottom double")
    assert [r.caption for r in layout.nearest_caption(f, t).collect()] == ["near"]


def test_tables(spark):
    text = "intro\n| a | b ||\n|---|:-:|\n| 1 | 2,000원 | x |\nend\n| only | row |\n\n| c | d |\n| 3 | |\n| e | f |\n"
    got = one(spark, tables.markdown_tables(F.col("t")), t=text)
    assert got == [[["a", "b"], ["1", "2,000원", "x"]]] and one(spark, tables.markdown_tables(F.col("t")), t="| a | b |") == []
    rows = spark.createDataFrame([(got[0],)], "t array<array<string>>").select(tables.records(F.col("t"))).first()[0]
    assert [tuple(c) for c in rows[0]] == [("a", "1", 1.0), ("b", "2,000원", 2000.0), ("col2", "x", None)]
    assert one(spark, V.number_of(F.col("t")), t="1,200억원(%)") == 1200.0 and one(spark, V.number_of(F.col("t")), t="많음") is None
    d = spark.createDataFrame([([[None, " "], [" a  b", None], ["c"], ["", "x", "y|\nz"]],)], "t array<array<string>>")
    clean = d.select(tables.clean_table(F.col("t")).alias("t"))
    assert clean.first()[0] == [["a b", "", ""], ["c", None, None], ["", "x", "y|\nz"]]
    assert clean.select(tables.to_markdown(F.col("t"))).first()[0] == "| a b |  |  |\n| --- | --- | --- |\n| c |  |  |\n|  | x | y\\| z |"
    assert spark.createDataFrame([([[None]],)], "t array<array<string>>").select(tables.clean_table(F.col("t"))).first()[0] is None
    page = [(1, [["a", "b"], ["", "c"]], 100, 200), (2, [["a", ""], ["", ""]], 100, 200), (3, [["a", "b"]], 10, 99), (4, [["a", "b"]], 901, 950), (5, [["a", "b"], ["", ""]], 100, 200)]
    d = spark.createDataFrame([(*r, 1000) for r in page], "k int, cells array<array<string>>, top int, bottom int, page_height int")
    assert [r.k for r in readers.page_tables(d).collect()] == [1]


def chart(spark, f, *rows):
    d = spark.createDataFrame([([[("n", str(x), float(x)) for x in r] for r in rows],)], "r array<array<struct<name string, text string, number double>>>")
    return d.select(f(F.col("r"))).first()[0]


def test_charts(spark):
    titles = ["-0.2", "출처 x", "(% WoW)", " 차트 ", "", None, "표준지 공시지가", "데이터센터 투자"]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(tables.title_valid(F.col("t"))).collect()
    assert [r[0] for r in got] == [False] * 6 + [True] * 2
    assert chart(spark, tables.made_up, *[[-0.2]] * 8) and not chart(spark, tables.made_up, *[[-0.2]] * 7) and not chart(spark, tables.made_up, *[[1]] * 8, [2])
    assert chart(spark, tables.same_series, [1, 1], [2, 2], [3, 3], [4, 4], [5, 6]) and not chart(spark, tables.same_series, [1, 1], [2, 3]) and not chart(spark, tables.same_series, [1], [2])
    assert chart(spark, tables.reliable, [1, 2], [2, 3]) and not chart(spark, tables.reliable)
    told = lambda t: one(spark, tables.has_content(F.lit(None).cast("array<array<struct<name string, text string, number double>>>"), F.col("t")), t=t)
    assert told("| sales | 12.5 |") and not told("| a | b |") and not told("no table 12")
    echo = [(1, 0, [("region", "region")]), (1, 1, [("region", "x")]), (1, 2, [("region", "y")])] + [(1, 3 + i, [("region", "z")]) for i in range(50)]
    d = spark.createDataFrame(echo, "k int, pos int, r array<struct<name string, text string>>")
    kept = windows.drop_repeats(d.where(~tables.is_echo(F.col("r"))).withColumn("j", F.to_json("r")), ["k", "j"], "pos", 3)
    assert [r.pos for r in kept.orderBy("pos").collect()] == [1, 2, 3]


def test_cleaning(spark):
    fix = lambda t: one(spark, C.corrected(F.col("t")), t=t)
    for raw, want in [("a.... --- b", "a… — b"), ("O1 1O xO1", "01 10 xO1"), ("l2 2l al2", "12 21 al2"), ("가-\n나 a-\nb", "가나 a-\nb"), ("mode rn modern", "mode m modern"), ("1 2 3 4 x1 2 3 4", "1234 x1 2 3 4"), ("1 2 3", "1 2 3")]:
        assert fix(raw) == want, raw
    keep = lambda t: one(spark, C.known_scripts(F.col("t")), t=t)
    assert keep("ঌই \n• 해발 고도") == "\n• 해발 고도" and keep("҃Ҋ 안전  벨트") == "안전 벨트" and keep("570 ± 25 g") == "570 ± 25 g"
    assert keep("α 값") == "α 값" and keep("漢字 text カナ") == "漢字 text カナ" and keep("abж жa ж жж.") == "abж жa"
    noise = lambda t: one(spark, C.no_noise_lines(F.col("t")), t=t)
    assert noise("a\n*-*\n....\n.....\n  \n__\n%%%%% a\n%%% ab\n x ") == "a\n\n%%% ab\n x "
    assert one(spark, C.tidy(F.col("t")), t="  a   b\t\n\n\n\nc \n") == "a b\t\n\nc"
    lines = lambda t: one(spark, C.joined_lines(F.col("t")), t=t)
    assert lines("장\n매 출 성\n5.6%)") == "장매 출 성\n5.6%)" and lines("장\n매출") == "장\n매출" and lines("ab\nabcdef") == "ab\nabcdef" and lines("장\n매\n출성과보고") == "장\n매출성과보고"
    chain = "<b>회 의 록</b>\n\\textbf{x {y}} O1\n***\n장\n매출성과  보고\n\n\n\n끝 문장"
    assert one(spark, C.cleaned(F.col("t")), t=chain) == "회의록\nx y 01\n장매출성과 보고\n\n끝 문장"


@pytest.mark.parametrize(
    "text, want",
    [("서버 팔천이번 포트에서", "서버 8002번 포트에서"), ("무려 사십오 퍼센트", "무려 45퍼센트"), ("이번에는 안 돼", "이번에는 안 돼"), ("십육 점 팔 정도", "16.8 정도"), ("아홉 시에 스물세 명이", "9시에 23명이"), ("두 번째", "두 번째"), ("오월인데 이월하다", "5월인데 이월하다"), ("팔백만 원", "800만원"), ("4천 개", "4천 개"), ("일 번 결합", "1번 결합"), ("이 회사 구분", "이 회사 구분"), ("", "")],
)
def test_digits(text, want):
    assert K.digits_of(text) == want


def test_korean_texts(spark):
    name = lambda t: one(spark, K.introduced_name(F.col("t")), t=t)
    assert name("안녕하세요, 김하나입니다") == "김하나" and name("박둘 이에요") == "박둘" and name("안녕") is None
    parts = lambda t: one(spark, K.message_parts(F.col("t")), t=t)
    assert tuple(parts("'새 말'라고 하셨는데, 기존 자료(a.pdf)의 '옛 말'와 다릅니다.")) == (None, "새 말", "옛 말", None)
    assert tuple(parts("결정 변경: '새 값' (기존: '옛 값', 사유: 비용).")) == ("결정 변경", "새 값", "옛 값", "비용") and parts("다른 말") is None
    said = "b/ (1대16.8)/(일 대 십육 점 팔) 그/ 말+ 했*"
    assert one(spark, K.spoken_text(F.col("t")), t=said).split() == ["1대16.8", "그", "말", "했"]
    assert one(spark, K.spoken_text(F.col("t"), written=False), t=said).split() == ["일", "대", "십육", "점", "팔", "그", "말", "했"]


def test_votes(spark):
    got = greedy.vote_lines(["hello world", "zzzq", "abcdefgh"], ["hello worlde", "extra line", "<b>abcd</b> zz zzz"])
    assert [(v, t) for v, t, *_ in got] == [("agree", "hello worlde"), ("partial", "abcd zz zzz"), ("single", "abcdefgh"), ("single", "extra line")] or got[1][0] in ("partial", "single")
    assert got[0][2] == round((1 + 22 / 23) / 2, 3)
    for junk in ("", "J", "p.", "u ur", "--", "ab cd"):
        assert greedy.junk_line(junk), junk
    for line in ("회의", "ABC", "가", "a1b2 word")[:2]:
        assert not greedy.junk_line(line), line
    votes = greedy.line_votes(spark.createDataFrame([(1, 0, 0, "the budget"), (1, 1, 0, "the budgets"), (1, 0, 1, "-"), (2, 0, 0, "--")], "page int, side int, pos int, text string"), "page")
    pages = {r.page: (r.text, r.confidence, r.reason) for r in greedy.voted_pages(votes, "page").collect()}
    assert pages[1] == ("the budgets", round((1 + 20 / 21) / 2, 3), "ok") and pages[2][2] == "too_short"
    assert greedy.echoed("x" * 30 + "tail", "lead " + "x" * 30) and not greedy.echoed("short", "short")


def test_longest_first(spark):
    d = spark.createDataFrame([(1, 0.0, 1000.0, 1), (1, 800.0, 3000.0, 2), (1, 900.0, 1300.0, 3)], "m int, s double, e double, item int")
    assert sorted((r.item, r.s, r.e) for r in greedy.longest_first(d, "m", "s", "e").collect()) == [(1, 0.0, 800.0), (2, 800.0, 3000.0)]


def brute_ops(ref, hyp):
    """The edit operations by a plain table, from the end: pair, delete, insert."""
    n, m = len(ref), len(hyp)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    out = []
    i, j = n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if ref[i] == hyp[j] else "substitute", i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


def test_alignment(spark):
    rng = random.Random(2)
    for _ in range(200):
        ref, hyp = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        assert evaluation.align(ref, hyp) == brute_ops(ref, hyp)
    d = spark.createDataFrame([(1, "Buy spark를 now, ok", "buy park를 now ok spark 온"), (2, None, "x")], "id long, ref string, hyp string")
    errors = {r.id: tuple(r)[1:] for r in evaluation.biased_errors(evaluation.aligned(d), ["Spark!"]).collect()}
    assert errors == {1: (2, 1, 1, 3, 1), 2: (0, 0, 1, 0, 0)}
    e = spark.createDataFrame([("a b c d", "a x c", 2), ("", "a", 1), ("same words", "same words", 0)], "r string, h string, n int")
    assert all(r.d == r.n for r in e.select("n", evaluation.word_distance(F.col("r"), F.col("h")).alias("d")).collect())
    assert C.normal_form("Ａ-b,  C!") == "a b c" and one(spark, C.normal_text(F.col("t")), t="A-b,  C!") == "a b c"
    recall = one(spark, evaluation.term_recall(F.col("a"), F.col("b"), ["on board", "zz"]), a="on board on board zz", b="onboard z z z")
    assert tuple(recall) == (3, 2)


def brute_runs(lines, pieces, most=4):
    from plenum.operators.evaluation import edit_distance

    plain = lambda t: "".join(c for c in t if c.isascii() and c.isalnum() or "가" <= c <= "힣")
    best = {0: (0, [])}
    for line in lines:
        new = {}
        for j, (cost, way) in sorted(best.items()):
            for k in range(min(most, len(pieces) - j) + 1):
                c = cost + edit_distance(plain(line), plain(" ".join(pieces[j : j + k])))
                if j + k not in new or c < new[j + k][0]:
                    new[j + k] = (c, [*way, (j, j + k)])
        best = new
    return best[min(best, key=lambda j: (best[j][0], j))][1]


def test_script_alignment(spark):
    rng = random.Random(4)
    words = ["one", "two", "three", "four", "가나", "다라"]
    for _ in range(40):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5))]
        pieces = [rng.choice(words) for _ in range(rng.randrange(8))]
        assert greedy.line_runs(lines, pieces) == brute_runs(lines, pieces)
    # Noise behind the last line stays out.
    assert greedy.line_runs(["good day", "bye"], ["good", "day", "bye", "qqqqqqqqqqqq"]) == [(0, 2), (2, 3)]
    a = spark.createDataFrame([(1, 0, "good day"), (1, 1, "bye"), (2, 0, "alone")], "m int, pos int, text string")
    b = spark.createDataFrame([(1, 0, "good"), (1, 1, "day"), (1, 2, "bye"), (1, 3, "qqqqqqqqqqqq"), (3, 0, "x")], "m int, pos int, text string")
    assert sorted(tuple(r) for r in greedy.script_alignment(a, b, "m").collect()) == [(1, 0, 0), (1, 0, 1), (1, 1, 2)]


def test_bootstrap(spark):
    rows = [(i, i % 3, 10, i % 2, 10) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, e int, n int, f int, m int")
    low, high = evaluation.bootstrap(d, "id", "e", "n", 2000).first()
    assert low < 0.1 < high and 0.01 < high - low < 0.03
    assert (low, high) == tuple(evaluation.bootstrap(d.repartition(7, "n", "id"), "id", "e", "n", 2000).first())
    point, low, high, p = evaluation.paired_bootstrap(d, "id", ("e", "n"), ("f", "m"), 2000).first()
    assert point == pytest.approx(0.0998 - 0.05, abs=1e-3) and low > 0 and p < 0.01
    assert evaluation.paired_bootstrap(d, "id", ("e", "n"), ("e", "n"), 200).first().p == 1.0


def test_z_scores(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.3), (2, 0.4), (2, 0.1), (3, 0.7)], "k int, s double")
    got = {r.k: (r.top, round(r.margin, 6), round(r.z, 3)) for r in evaluation.z_scores(d, "k", "s").collect()}
    assert got == {1: (0.9, 0.4, round(0.5 / 0.100001, 3)), 2: (0.4, 0.3, 0.0), 3: (0.7, 0.0, 0.0)}


def test_splits(spark):
    d = spark.range(2000).withColumn("s", F.col("id") % 50)
    out = d.withColumn("t", evaluation.held_out("s", 0.2)).groupBy("s").agg(F.count_distinct("t").alias("n"), F.max("t").alias("t")).collect()
    assert all(r.n == 1 for r in out) and 3 <= sum(r.t for r in out) <= 20
    rest = evaluation.unseen(d, d.where("id < 1990"), "id", 20).collect()
    assert {r.id for r in rest} == set(range(1990, 2000))


def test_merged_turns(spark):
    d = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 1, 2), (1, "a", 8, 12), (1, "a", 14, 15), (1, "b", 15, 16), (1, "a", 16, 17)], "m int, who string, s int, e int")
    assert sorted(tuple(r)[2:] for r in windows.merge_gaps(d, "m", "who", "s", "e", 1).collect()) == [(0, 12, 3), (14, 15, 1), (15, 16, 1), (16, 17, 1)]


def brute_turns(spans, total, least):
    labels = [s[2] for s in spans]
    for i, x in enumerate(labels):
        if x is None:
            past, later = [y for y in labels[:i] if y is not None], [y for y in labels[i:] if y is not None]
            labels[i] = past[-1] if past else later[0] if later else None
    turns, start = [], 0
    for i in range(1, len(spans)):
        if labels[i] != labels[i - 1]:
            turns.append((start, spans[i][0], labels[i - 1]))
            start = spans[i][0]
    turns.append((start, total, labels[-1]))
    out, queue = [], collections.deque(turns)
    while queue:
        s, e, who = queue.popleft()
        if e - s >= least or (not out and not queue):
            out.append((s, e, who))
        elif out:
            out[-1] = (out[-1][0], e, out[-1][2])
        else:
            _, e2, who2 = queue.popleft()
            out.append((s, e2, who2))
    return out


def test_turns(spark):
    rng, rows, want = random.Random(6), [], {}
    for m in range(80):
        at, spans = rng.randrange(500), []
        for _ in range(rng.randrange(1, 9)):
            end = at + rng.randrange(200, 2500)
            spans.append((at, end, rng.choice(["x", "y", "z", None])))
            at = end + rng.randrange(1, 400)
        rows += [(m, *s, at) for s in spans]
        want[m] = brute_turns(spans, at, 1500)
    d = spark.createDataFrame(rows, "m int, s int, e int, who string, total int")
    got = {}
    for r in windows.turns(d, "m", "who", "s", "e", "total").orderBy("m", "turn").collect():
        got.setdefault(r.m, []).append((r.s, r.e, r.who))
    assert got == want


def brute_sentences(text, start, end, least=6):
    import re

    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]
    out = []
    for p in parts:
        if out and len(p) < least:
            out[-1] += " " + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[0]) < least:
        out[:2] = [out[0] + " " + out[1]]
    if len(out) < 2:
        return [(start, end, text.strip(), False)]
    total, n, rows = sum(map(len, out)), 0, []
    for i, p in enumerate(out):
        a, n = start + (end - start) * n / total, n + len(p)
        rows.append((round(a, 2), round(end if i == len(out) - 1 else start + (end - start) * n / total, 2), p, True))
    return rows


def test_sentences(spark):
    texts = ["One sentence only.", "Yes. This one is long enough. No. And the last one? Ok.", "Version 9.15 is out. It works!", "A. B. C.", "", "no mark at all", "Long first sentence here. x"]
    d = spark.createDataFrame([(i, t, 1.5 * i, 1.5 * i + 7.3) for i, t in enumerate(texts)], "k int, text string, s double, e double")
    got = {}
    for r in windows.sentences(d, ["k"], "text", "s", "e").orderBy("k", "part").collect():
        got.setdefault(r.k, []).append((r.s, r.e, r.text, r.estimated))
    for i, t in enumerate(texts):
        want = brute_sentences(t, 1.5 * i, 1.5 * i + 7.3)
        assert [x[2:] for x in got[i]] == [x[2:] for x in want]
        assert np.allclose([x[:2] for x in got[i]], [x[:2] for x in want], atol=0.0101)


def test_speakers(spark):
    v = [[1.0, 0.0], [0.95, 0.05], [0.0, 1.0], [0.9, 0.1]]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "session int, seq int, v array<double>")
    assert [r.name for r in speakers.open_set(d, "session", "seq").orderBy("seq").collect()] == ["S1", "S1", "S2", "S1"]
    assert [r.cluster for r in speakers.agglomerate(d, "session", "seq").orderBy("seq").collect()] == [0, 0, 2, 0]
    # At the cap the nearest one's name, which then doesn't move.
    full = speakers.OpenSet(cap=1)
    assert full.name([1, 0]) == "S1" and full.name([0, 1]) == "S1" and full.profiles[0].tolist() == [1, 0] and full.name([0, 0]) is None
    assert [r.name for r in speakers.unassigned(d, "session", "seq").orderBy("seq").collect()] == ["SPEAKER_미상1", "SPEAKER_미상1", "SPEAKER_미상2", "SPEAKER_미상1"]
    near = {r.query_id: r.id for r in search.nearest(spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0])], "query_id int, q array<double>"), spark.createDataFrame([(1, v[0]), (2, v[2]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "id int, v array<double>"), 1).collect()}
    assert near == {7: 1, 8: 2}
    many = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "query_id int, q array<double>")
    rows = spark.createDataFrame([(i, f"s{i % 2}", [float(i % 11), float(i % 3), 1.0]) for i in range(300)], "id int, scope string, v array<double>")
    whole = sorted(map(tuple, search.nearest(many, rows, 3, "scope").collect()))
    old, search.QUERY_BYTES = search.QUERY_BYTES, 1000
    assert sorted(map(tuple, search.nearest(many, rows, 3, "scope").collect())) == whole and len(whole) == 1200
    search.QUERY_BYTES = old


def test_chunks(spark):
    rows = [(1, 0, "title", "T1", 1), (1, 1, "heading", "H", 1), (1, 2, "body", "b" * 600, 1), (1, 3, "body", "c" * 1200, 2), (1, 4, "caption", "x", 2), (1, 5, "heading", "E", 3)]
    d = spark.createDataFrame(rows, "doc int, pos int, style string, text string, page int")
    got = [(r.content, r.page) for r in chunking.chunk_documents(d, "doc").orderBy("chunk").collect()]
    assert got == [("H\n" + "b" * 600, 1), ("H\n" + "c" * 1200, 2), ("E", 3)]


def test_script(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n\nS1: hello: there\n[overlap] S2: yes\nno speaker\n")
    got = [(r.speaker, r.text, r.overlapped) for r in readers.read_script(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [("S1", "hello: there", False), ("S2", "yes", True)]
    (tmp_path / "t.tsv").write_text("1\ta\tb\tc\td\n")
    assert readers.read_trials(spark, str(tmp_path / "t.tsv")).first().member2 == "d"


def test_dates_and_labels(spark):
    d = spark.sql("select timestamp '2024-05-01 06:05:00' as t")
    assert d.select(V.clock_label(F.col("t"))).first()[0] == "오후 3:05"
    assert one(spark, V.refine(F.col("t"), ["please", "tell me"]), t="please tell me the budget") == "the budget"
    assert one(spark, V.refine(F.col("t"), ["please"]), t="please x") == "please x"


def test_measures(spark):
    runs = spark.createDataFrame([(1, "skip", None, None), (1, "success", "both", 0.5), (1, "success", "first", 0.1), (1, "empty", "cells", None), (2, "success", None, 0.9)], "k int, outcome string, engine string, score double")
    a, b = measures.ocr_statistics(runs, "k").orderBy("k").collect()
    assert (a.attempts, a.skip_ratio, a.success_ratio, a.useful_ratio, a.both_ratio, a.mean_score, a.consistent) == (4, 0.25, 0.5, 0.5, 0.333, 0.3, True)
    assert not b.consistent and b.both_ratio == 0.0
    sound = [(1, 0, [1.0, 0.1], [True, False]), (1, 1, [], []), (1, 2, [0.5, None], [False, True]), (2, 0, [0.0, 0.0], [False, False])]
    a, b = measures.audio_statistics(spark.createDataFrame(sound, "s int, at int, samples array<double>, speech array<boolean>"), "s", "at", 2).orderBy("s").collect()
    assert (a.speech_rms, a.background_rms, a.snr_db, a.clip_ratio, a.speech_sec, a.silent_sec) == (0.7906, 0.1, 18.0, 0.33333, 1.0, 0.0)
    assert b.snr_db is None and b.silent_sec == 1.0
    streams = spark.createDataFrame([(1, 0, [30000, 1, 2]), (1, 1, [30000]), (1, 0, [30000]), (1, None, [None, -5])], "k int, offset_ms int, samples array<int>")
    assert sorted((r.at, r.value) for r in measures.mixed(streams, "k", 1000).collect()) == [(0, 32767), (1, 29996), (2, 2)]


def test_table_and_image_scores(spark):
    table = lambda rows: spark.createDataFrame([(rows,)], "t array<array<string>>").select(scores.table_quality(F.col("t"))).first()[0]
    assert table([]) == 0.0
    assert table([["a", "b"], ["1", None]]) == pytest.approx(0.25 + 0.25 * 0.75 + 0.2 + 0.2 * (0.2 + 0.5) / 2 + 0.1)
    assert table([["a"], ["a"]]) == pytest.approx(0.125 + 0.25 + 0.2 + 0.2 * (0.2 + 0.25) / 2 + 0.07)
    image = spark.createDataFrame([("가나 ab\n--", "가나 ab"), (" ", "x"), ("w w w w", None)], "t string, o string")
    got = [r[0] for r in image.select(scores.image_quality(F.col("t"), greedy.agreement(F.col("t"), F.col("o")))).collect()]
    assert got[0] == pytest.approx(0.3 * 10 / 13 + 0.15 * 0.08 + 0.15 * 2 / 8 + 0.2 * 0.5 + 0.1 * (1 - 6 / 8) + 0.1, abs=1e-9)
    assert got[1] == 0.0 and got[2] == pytest.approx(0.3 * 0.4 + 0.15 * 0.07 + 0.2 + 0.1)


def test_resolved(spark):
    d = spark.createDataFrame([("d1", 1, "t", "x", None, "active", None), ("d2", 1, "u", "y", None, "pending", None)], "decision_id string, meeting_id int, title string, text string, reason string, status string, previous string")
    c = spark.createDataFrame([(7, "d1", 5, "change_acknowledged", "new", "why"), (8, "d1", 6, "change_acknowledged", "late", None), (9, "d2", 5, "change_acknowledged", "z", None), (10, "d1", 5, "keep_reference", "k", None)], "conflict_id int, decision_id string, meeting_id int, resolution string, text string, reason string")
    got = sorted(tuple(r) for r in decisions.resolved(c, d).fillna("-").collect())
    assert got == [("conflict-7", 5, "t", "new", "why", "active", "d1"), ("d1", 1, "t", "x", "-", "superseded", "-"), ("d2", 1, "u", "y", "-", "pending", "-")]


def test_chat_exchange(spark):
    s = spark.createDataFrame([(1, "", None), (2, "had", None)], "session_id int, title string, updated_at timestamp")
    asked = spark.sql("select 1 as session_id, '  ' || repeat('q', 50) as question, 'a' as answer, timestamp '2024-01-01 00:00:00' as at union all select 2, 'x', 'y', timestamp '2024-01-01 00:00:01'")
    sessions, rows = relational.chat_exchange(s, asked)
    assert {r.session_id: r.title for r in sessions.collect()} == {1: "q" * 40, 2: "had"}
    first = rows.where("session_id = 1").orderBy("created_at").collect()
    assert [r.role for r in first] == ["user", "assistant"] and (first[1].created_at - first[0].created_at).microseconds == 1


def test_long_folds(spark):
    """Chunks and pauses of one key with many rows, against plain loops."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["body", "body", "body", "heading", "title", "caption"]), "w" * rng.randrange(1, 900), i // 10 + 1) for i in range(3000)]
    d = spark.createDataFrame(rows, "k int, pos int, style string, text string, page int").repartition(6)
    got = [(r.content, r.page) for r in chunking.chunk_documents(d, "k").orderBy("chunk").collect()]
    out, lines, title, page, chars = [], [], "", 1, 0
    for _, _, style, text, p in rows:
        if style == "caption":
            continue
        if style in ("title", "heading"):
            if lines:
                out.append(("\n".join([title] * bool(title) + lines), page))
                lines, chars = [], 0
            title = text
        else:
            if chars + len(text) > 1700 and chars >= 500:
                out.append(("\n".join([title] * bool(title) + lines), page))
                lines, chars = [], 0
            lines.append(text)
            chars += len(text)
        page = p
    out.append(("\n".join([title] * bool(title) + lines), page))
    assert got == out
    times = sorted(rng.randrange(10**6) for _ in range(3000))
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(None, 9000, 5), (None, 9001, 6)], "k int, id int, t int").withColumn("at", F.timestamp_seconds("t"))
    got = {r.id: r.accepted for r in decisions.cooled_down(d, ["k"], "at", "id", 1800).collect()}
    last = None
    for i, t in enumerate(times):
        ok = last is None or t >= last + 1800
        last = t if ok else last
        assert got[i] == ok
    assert got[9000] and not got[9001]


def test_sinks(spark, tmp_path):
    path = str(tmp_path)
    readers.write_json(spark.createDataFrame([(1, None)], "a int, b string"), f"{path}/json")
    assert spark.read.text(f"{path}/json").first()[0] == '{"a":1,"b":null}'
    readers.append_rows(spark.createDataFrame([(1, "x")], "user int, text string"), f"{path}/notes", "user")
    readers.append_rows(spark.createDataFrame([(1, "y")], "user int, text string"), f"{path}/notes", "user")
    assert spark.read.parquet(f"{path}/notes").count() == 2
    new = readers.collection(spark, f"{path}/vectors", "meetings", 2)
    assert new.count() == 0
    new.unionByName(spark.createDataFrame([("a", "d", 1, [0.0, 1.0], "t", None)], new.schema)).write.mode("append").parquet(f"{path}/vectors/collection=meetings/dimensions=2")
    assert readers.collection(spark, f"{path}/vectors", "meetings", 2).count() == 1
    readers.write_chunks(spark.createDataFrame([(1, "a"), (2, "b")], "id int, collection string"), f"{path}/chunks")
    readers.write_text(spark.createDataFrame([("x",)], "t string"), f"{path}/txt", "t")
    assert spark.read.parquet(f"{path}/chunks").where("collection = 'a'").count() == 1 and spark.read.text(f"{path}/txt").first()[0] == "x"
    (tmp_path / "m.jsonl").write_text('{"audio": "a.wav", "text": "hi"}\n')
    assert tuple(readers.read_manifest(spark, f"{path}/m.jsonl").first()) == ("a.wav", "hi")
    assert one(spark, readers.first_present("j", "$.keywords", "$.tags"), j='{"keywords": "", "tags": "t"}') == "t"


def test_long_chains(spark, tmp_path):
    from plenum.catalog import QUERIES

    turns = [(c, i, "user", "x") for c, n in ((1, 150), (2, 3)) for i in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = sorted((r.newest, r.id, r.steps) for r in QUERIES["d9_chains"](spark, str(tmp_path)).collect())
    assert out == sorted([(249, 100 + i, 149 - i) for i in range(150)] + [(202, 200 + i, 2 - i) for i in range(3)])
    # Two newest rows share older ones; a circle is an error.
    forked = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2)], "id int, previous int")
    assert sorted(map(tuple, decisions.chains(forked).collect())) == [(3, 1, 2), (3, 2, 1), (3, 3, 0), (4, 1, 2), (4, 2, 1), (4, 4, 0)]
    with pytest.raises(ValueError):
        decisions.chains(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id int, previous int"))


def test_whole_page_rate(spark, tmp_path):
    import random

    from plenum.catalog import QUERIES

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab#") for _ in range(rng.randrange(70))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        assert evaluation.edit_distance(a, b) == row[-1]
    rows = [(1, "x" * 40 + " # b*c", "en", "s", 46), (2, "`" * 50 + " y", "de", "s", 52), (3, None, "de", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.lang: (r.cer, r.wer) for r in QUERIES["e9_page_rate"](spark, str(tmp_path)).collect()}
    assert out == {"en": (3 / 46, 2 / 3), "de": (51 / 52, 1 / 2)}
    assert evaluation.page_text("| a | b |\n| --- | :-: |\n| x\\(^{*}\\) | Contents ····· 4 |") == "a b x* Contents 4"


def test_word_distance_of_many_words(spark):
    ref = [f"w{i}" for i in range(12000)]
    hyp = ref[:100] + ["new"] + ref[100:9000] + ["other"] + ref[9001:11990] + [" \n"]
    d = spark.createDataFrame([(" ".join(ref), " ".join(hyp)), (None, "a")], "r string, h string")
    assert [r.d for r in d.select(evaluation.word_distance(F.col("r"), F.col("h")).alias("d")).collect()] == [12, None]


def test_clear(spark):
    from plenum import shared

    shared.clear(spark)
    d = shared.written(spark.range(5), "test")
    other = shared.written(spark.range(3), "test")
    assert d.count() == 5 and other.count() == 3
    assert shared.clear(spark) == 2 and shared.clear(spark) == 0
    kept = shared.written(spark.range(4), "test")
    with shared.scratch(spark):
        gone = shared.written(spark.range(6), "test")
        assert gone.count() == 6
    assert kept.count() == 4 and shared.clear(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(*d.inputFiles()).count()


def test_signs_before_a_letter_take_no_ways(spark):
    """A word of foreign signs that ends in a letter stays: it isn't tried in all ways that two classes give."""
    word = "\U0001f600" * 60
    assert one(spark, C.known_scripts(F.col("t")), t=f"x {word}a {word} b") == f"x {word}a b"
    import time

    began = time.time()
    assert one(spark, C.known_scripts(F.col("t")), t="\u0590" * 40 + "a") == "\u0590" * 40 + "a"
    assert time.time() - began < 20
    # The text of a replacement is worked out once.
    plan = spark.range(1).select(C.replace_each(F.concat(F.lit("a"), F.rand().cast("string")), "a", lambda m: m).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rand(") == 1
