"""Speakers' errors, line votes and alignment over whole texts, against brute force."""

import itertools
import random
import time
from difflib import SequenceMatcher

import numpy as np

from plenum.operators import greedy, multitalker
from plenum.operators.evaluation import edit_distance


def test_assignment():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(30):
            cost = rng.integers(0, 12, (n, n))
            least = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            total, columns = multitalker.assignment(cost)
            assert total == least == sum(cost[i, columns[i]] for i in range(n)) and sorted(columns) == list(range(n))
    assert multitalker.assignment(np.zeros((0, 0), np.int64)) == (0, [])


def brute_cp(ref, hyp):
    """The least errors over all ways to pair speakers; ``ref`` and ``hyp`` are lists of (speaker, word)."""
    a = [[w for s, w in ref if s == x] for x in sorted({s for s, _ in ref})]
    b = [[w for s, w in hyp if s == x] for x in sorted({s for s, _ in hyp})]
    n = max(len(a), len(b))
    a, b = a + [[]] * (n - len(a)), b + [[]] * (n - len(b))
    return min(sum(edit_distance(a[i], b[p[i]]) for i in range(n)) for p in itertools.permutations(range(n)))


def brute_di(ref, hyp):
    """The least errors over all speakers that every heard segment may have."""
    a = [[w for s, w in ref if s == x] for x in sorted({s for s, _ in ref})]
    best = 10**9
    for way in itertools.product(range(len(a)), repeat=len(hyp)):
        best = min(best, sum(edit_distance(a[i], [w for k, (_, w) in zip(way, hyp) if k == i]) for i in range(len(a))))
    return best


def test_speaker_errors(spark):
    rng = random.Random(2)
    ref, hyp = [], []
    for m in range(14):
        speakers = rng.randrange(1, 7)
        for pos in range(7):
            s, w = rng.randrange(speakers), rng.choice("abcd")
            ref.append((m, f"s{s}", pos, w))
            if rng.random() < 0.8:
                hyp.append((m, f"h{(s + 1) % speakers}" if rng.random() < 0.7 else f"h{rng.randrange(7)}", pos, w if rng.random() < 0.8 else "x"))
    ref += [(50, None, 0, "only written"), (51, "a", 0, None), (52, "a", 0, "x y"), (52, "b", 1, "z")]
    hyp += [(60, "q", 0, "only heard here"), (52, "k", 0, "x"), (52, "j", 2, "z"), (52, "j", 1, "y")]
    columns = "m int, speaker string, pos int, text string"
    out = {r.m: r for r in multitalker.speaker_errors(spark.createDataFrame(ref, columns), spark.createDataFrame(hyp, columns), "m").collect()}
    for m in range(14):
        a, b = [(s, w) for k, s, _, w in ref if k == m], [(s, w) for k, s, _, w in hyp if k == m]
        assert out[m].units == len(a) and out[m].cp_errors == brute_cp(a, b)
        assert out[m].di_errors <= out[m].cp_errors and out[m].speaker_errors == out[m].cp_errors - out[m].di_errors
        if len({s for s, _ in a}) <= 4:
            assert out[m].di_errors >= brute_di(a, b) or len({s for s, _ in b}) > len({s for s, _ in a})
    # One segment of the wrong speaker costs a deletion and an insertion, which the second rate doesn't see.
    assert (out[52].cp_errors, out[52].di_errors) == (2, 0)
    assert (out[50].units, out[50].cp_errors) == (2, 2) and (out[60].units, out[60].cp_errors) == (0, 3) and 51 not in out
    chars = {r.m: r for r in multitalker.speaker_errors(spark.createDataFrame(ref, columns), spark.createDataFrame(hyp, columns), "m", chars=True).collect()}
    assert chars[60].cp_errors == len("onlyheardhere") and chars[50].units == len("onlywritten")
    empty = spark.createDataFrame([], columns)
    assert multitalker.speaker_errors(empty, empty, "m").count() == 0


def test_first_rate_alone(spark):
    """No second rate, and no table of segments for it, where it isn't asked for."""
    columns = "m int, speaker string, pos int, text string"
    ref = spark.createDataFrame([(1, "a", 0, "Öl, ab c"), (1, "b", 1, "d e")], columns)
    for chars in (False, True):
        first = multitalker.speaker_errors(ref, ref, "m", chars=chars, second=False)
        assert first.columns == ["m", "units", "cp_errors"] and first.first()[:] == (1, 7 if chars else 5, 0)


def moved(refs, heard, sweeps=10):
    """``regrouped`` with all moves tried."""
    streams = max([len(refs), *(s + 1 for s, _ in heard)])
    refs, of = refs + [[]] * (streams - len(refs)), [s for s, _ in heard]
    total = lambda: [edit_distance(refs[s], [x for k, (_, u) in enumerate(heard) if of[k] == s for x in u]) for s in range(streams)]
    for _ in range(sweeps):
        before = of[:]
        for k in range(len(heard)):
            home, now, best = of[k], sum(total()), []
            for s in range(streams):
                of[k] = s
                best.append((sum(total()) - now, s))
            of[k] = min(best)[1]
        if of == before:
            break
    return sum(total())


def test_moves_that_cannot_help_are_not_tried():
    rng = random.Random(8)
    for _ in range(150):
        refs = [[rng.choice("abcd") for _ in range(rng.randrange(8))] for _ in range(rng.randrange(1, 4))]
        heard = [(rng.randrange(4), [rng.choice("abcd") for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 6))]
        assert multitalker.regrouped(refs, heard) == moved(refs, heard)


def plain_votes(a, b):
    """Each line of ``a`` against every free line of ``b``."""
    free, out = dict(enumerate(b)), []
    for line in a:
        scored = [(SequenceMatcher(None, line, other).ratio(), -i) for i, other in free.items()]
        score, at = max(scored, default=(0.0, 1))
        out.append((line, free.pop(-at) if scored and score >= greedy.PART else None))
    return out + [(None, x) for x in free.values()]


def test_votes_of_whole_lines():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "회의", "결정", "e", ""]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for n in (0, 1, 5, 20):
        for _ in range(6):
            a = [line(rng.randrange(60)) for _ in range(n)]
            b = [x if rng.random() < 0.3 else "".join(c for c in x if rng.random() < 0.9) for x in rng.sample(a, len(a))] + [line(3), line(3), ""]
            assert [v[3:] for v in greedy.vote_lines(a, b)] == plain_votes(a, b)


def test_votes_of_a_long_page():
    rng = random.Random(5)
    a = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(40)) for _ in range(2000)]
    b = [x[:20] + "#" + x[20:] for x in rng.sample(a, len(a))]
    votes = greedy.vote_lines(a, b)
    assert len(votes) == 2000 and all(v[0] == "agree" and v[4].replace("#", "") == v[3] for v in votes)


def test_ratio_is_that_of_sequence_matcher():
    """Over lines below and above 200 characters, from which on popular characters begin no block."""
    rng = random.Random(9)
    for _ in range(1500):
        signs = "abcdefghij klmnop회의결정ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[: rng.choice([1, 2, 5, 17, 60])]
        x, y = ("".join(rng.choice(signs) for _ in range(rng.randrange(rng.choice([1, 5, 30, 300])))) for _ in range(2))
        if rng.random() < 0.5:
            y = "".join(c for c in x if rng.random() < 0.9) + x[: rng.randrange(200)]
        want = SequenceMatcher(None, x, y).ratio()
        assert greedy.ratio(greedy.Line(x), greedy.Line(y, True), 0) == greedy.ratio(greedy.Line(x), greedy.Line(y, True), want) == want
        assert greedy.ratio(greedy.Line(x), greedy.Line(y, True), want + 0.01) < want + 0.01


def test_votes_of_long_lines_take_a_fraction_of_all_comparisons():
    rng = random.Random(10)
    parts = "tha tion re en ou ly the an in er ble at es on ed ti. Th, ing".split(" ")
    a = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(60, 260))) for _ in range(30)]
    b = [x[::-1] if i % 2 else x.replace("e", "c") for i, x in enumerate(a)]
    start = time.process_time()
    want = plain_votes(a, b)
    middle = time.process_time()
    got = greedy.vote_lines(a, b)
    assert [v[3:] for v in got] == want
    assert time.process_time() - middle < (middle - start) / 3


def test_votes_of_large_pages_are_dealt(spark):
    """Pages with more pairs of lines than ``room`` are compared in squares, with the same votes."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "회의", "결정", "e", ""]
    rows = []
    for page, n in ((1, 9), (2, 14), (None, 8), (3, 2), (4, 0)):
        a = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(n)]
        rows += [(page, 0, i if i else None, x) for i, x in enumerate(a)] + [(page, 1, i, x[::-1] if rng.random() < 0.4 else x) for i, x in enumerate(rng.sample(a, len(a)))]
        rows += [(page, 1, 50, None), (page, 1, 51, "beta beta")]
    votes = greedy.line_votes(spark.createDataFrame(rows, "page long, side int, pos int, text string"), "page", room=20, square=4).collect()
    for page in (1, 2, None, 3, 4):
        lines = [[x or "" for p, s, pos, x in sorted(rows, key=lambda r: (r[2] is None, r[2])) if (p, s) == (page, side)] for side in (0, 1)]
        want = greedy.vote_lines(*lines)
        want = [v for v in want if not greedy.junk_line(v[1])] or want
        assert [v[2:] for v in sorted((v for v in votes if v.page == page), key=lambda v: v.at)] == want


def test_voted_pages_are_dealt_to_a_fixed_number_of_tasks(spark):
    """What speaks against a page takes time that its bytes don't tell, so few small partitions must not be joined."""
    votes = spark.createDataFrame([(p, k, f"line {k} of {p}", 0.6 + k / 10) for p in range(20) for k in (1, 0)], "page int, at int, text string, confidence double")
    pages = greedy.voted_pages(votes, "page")
    assert pages.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r[:] for r in pages.collect()) == [(p, f"line 0 of {p}\nline 1 of {p}", 0.65, "ok") for p in range(20)]


def test_common_is_the_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert greedy.common(a, b) == row[-1]


def test_run_errors():
    rng = random.Random(7)
    for _ in range(200):
        line = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(4)]
        assert greedy.run_errors(line, pieces) == [edit_distance(line, "".join(pieces[:k])) for k in range(5)]


def all_runs(lines, pieces, most=4):
    """``line_runs`` with all runs of all lines."""
    plain = lambda t: "".join(c for c in t if c.isascii() and c.isalnum() or "가" <= c <= "힣")
    bare, best, ways = list(map(plain, pieces)), {0: 0}, []
    for line in map(plain, lines):
        reached = {}
        for start, cost in best.items():
            for end, errors in enumerate(greedy.run_errors(line, bare[start : start + most]), start):
                reached[end] = min(reached.get(end, (cost + errors, start)), (cost + errors, start))
        ways.append(reached)
        best = {end: cost for end, (cost, _) in reached.items()}
    at, out = min(best, key=lambda j: (best[j], j)), []
    for reached in reversed(ways):
        out.append((reached[at][1], at))
        at = reached[at][1]
    return out[::-1]


def test_line_runs_equal_all_runs():
    rng = random.Random(9)
    for _ in range(300):
        words = ["ab", "ba", "회의", "q", "", "!", "결정 x", "aaa"]
        lines = ["".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 7))]
        pieces = ["".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(12))]
        assert greedy.line_runs(lines, pieces) == all_runs(lines, pieces)


def test_a_long_script_takes_few_distances(monkeypatch):
    rng, calls = random.Random(10), []
    lines = ["".join(rng.choice("aeiounthrs") for _ in range(rng.randrange(20, 300))) for _ in range(120)]
    pieces = [p for x in lines for p in (x[: len(x) // 2], x[len(x) // 2 :].translate(str.maketrans("aeo", "oae")))]
    plain = greedy.run_errors
    monkeypatch.setattr(greedy, "run_errors", lambda line, run: calls.append(len(run)) or plain(line, run))
    assert greedy.line_runs(lines, pieces) == [(2 * i, 2 * i + 2) for i in range(120)]
    # All starts of all lines are 22,000 runs.
    assert sum(calls) < 5000
