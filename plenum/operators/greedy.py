"""Order-dependent rules that aren't associative: grouped maps over one page, one meeting or one text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.scores import gate
from plenum.shared import spread

from .evaluation import edit_distance


#: Two lines agree, are partly alike; the confidence of a part and of a line of one reading; the gate of the whole text.
SAME, PART, PART_CONFIDENCE, ALONE_CONFIDENCE = 0.84, 0.10, 0.55, 0.62
GATE = {"least_chars": 4, "most_special": 0.40, "most_words": 0.60, "most_lines": 0.50, "least_confidence": 0.40}


def without_marks(text: str) -> str:
    """A reading without tags, LaTeX commands and braces, with single blanks."""
    return " ".join(re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+\{[^}]*\}|\\[a-zA-Z]+", "", re.sub(r"<[^>]+>", "", text))).split())


def junk_line(text: str) -> bool:
    """No letter or digit, one character, a letter with a mark or two, or pieces of up to two small letters in five characters."""
    s = text.strip()
    letters, small = sum(c.isalpha() for c in s), re.findall(r"[a-z]+", s)
    return (
        len(s) <= 1
        or not any(c.isalpha() or c.isdigit() for c in s)
        or (len(s) <= 3 and letters <= 1 and s[0].isascii())
        or (len(s) <= 5 and bool(small) and max(map(len, small)) <= 2 and not re.search("[가-힣]", s))
    )


def letter_counts(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each line holds each of the characters that both sides have."""
    shared = {c: k for k, c in enumerate(sorted(set("".join(a)) & set("".join(b))))}
    out = np.zeros((len(a), len(shared)), np.int32), np.zeros((len(b), len(shared)), np.int32)
    for table, lines in zip(out, (a, b)):
        for row, line in zip(table, lines):
            for c, n in Counter(line).items():
                if c in shared:
                    row[shared[c]] = n
    return out


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by the bits of an integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Line:
    """A line to be compared; as second line it begins blocks only with characters that ``SequenceMatcher`` doesn't call popular.

    ``rare``: None, or of a line of 200 characters or more the characters that make up at most a hundredth of it, and the places of pairs of them.
    """

    __slots__ = ("text", "rare", "found")

    def __init__(self, text: str, second: bool = False):
        self.text, self.rare, self.found = text, None, {}
        if second and len(text) >= 200:
            kept = {c for c, n in Counter(text).items() if n <= len(text) // 100 + 1}
            pairs: dict[str, list[int]] = {}
            for j in [j for j, c in enumerate(text) if c in kept]:
                if text[j + 1 : j + 2] in kept:
                    pairs.setdefault(text[j : j + 2], []).append(j)
            self.rare = kept, pairs

    def places(self, part: str) -> list[int]:
        if part not in self.found:
            out, i = [], self.text.find(part)
            while i >= 0:
                out.append(i)
                i = self.text.find(part, i + 1)
            self.found[part] = out
        return self.found[part]


def longest_block(a: str, b: str, al: int, ah: int, bl: int, bh: int) -> tuple[int, int, int]:
    """Size and places of the longest common part of two slices; of equal ones the first in ``a``, then in ``b``."""
    size, bi, bj = 0, al, bl
    if bh - bl > ah - al:
        for i in range(al, ah):
            if i + size >= ah:
                break
            while i + size < ah and (j := b.find(a[i : i + size + 1], bl, bh)) >= 0:
                size, bi, bj = size + 1, i, j
        return size, bi, bj
    for j in range(bl, bh):
        if j + (size or 1) > bh:
            break
        i = a.find(b[j : j + (size or 1)], al, ah)
        if i >= 0:
            if not size or i < bi:
                size, bi, bj = size or 1, i, j
            while j + size < bh and (i := a.find(b[j : j + size + 1], al, ah)) >= 0:
                size, bi, bj = size + 1, i, j
    return size, bi, bj


def rare_runs(x: Line, y: Line) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Where ``x`` has characters that are rare in ``y``, and (place in ``x``, place in ``y``, length) of all common runs of two or more of them."""
    kept, pairs = y.rare
    points = [i for i, c in enumerate(x.text) if c in kept]
    seeds = {(i, j) for p, at in pairs.items() for i in x.places(p) for j in at}
    runs = []
    for i, j in seeds:
        if (i - 1, j - 1) not in seeds:
            k = 1
            while (i + k, j + k) in seeds:
                k += 1
            runs.append((i, j, k + 1))
    return points, runs


def rare_block(a: str, b: str, al: int, ah: int, bl: int, bh: int, points: list[int], runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """As ``longest_block``, but the longest run of rare characters is taken, and then what is equal on both sides of it."""
    size, bi, bj = 0, al, bl
    for i, j, k in runs:
        if i < ah and j < bh:
            skip = max(al - i, bl - j, 0)
            k = min(k, ah - i, bh - j) - skip
            if k > 1 and (k > size or k == size and (i + skip, j + skip) < (bi, bj)):
                size, bi, bj = k, i + skip, j + skip
    if not size:
        for at in range(bisect_left(points, al), bisect_left(points, ah)):
            if (j := b.find(a[points[at]], bl, bh)) >= 0:
                size, bi, bj = 1, points[at], j
                break
    while bi > al and bj > bl and a[bi - 1] == b[bj - 1]:
        size, bi, bj = size + 1, bi - 1, bj - 1
    while bi + size < ah and bj + size < bh and a[bi + size] == b[bj + size]:
        size += 1
    return size, bi, bj


def matched(x: Line, y: Line, least: float = 0) -> int:
    """The characters in the matching blocks of ``SequenceMatcher(None, x, y)``; where they are fewer than ``least``, any number below it.

    Blocks are looked up by ``str.find`` or from the few rare runs, not by a walk over all pairs of characters.
    """
    a, b = x.text, y.text
    points, runs = rare_runs(x, y) if y.rare else ([], [])
    most = min(len(a), len(b))
    todo = [(0, len(a), 0, len(b))]
    while todo and most >= least:
        al, ah, bl, bh = todo.pop()
        size, i, j = rare_block(a, b, al, ah, bl, bh, points, runs) if y.rare else longest_block(a, b, al, ah, bl, bh)
        most += size - min(ah - al, bh - bl)
        for rest in ((al, i, bl, j), (i + size, ah, j + size, bh)) if size else ():
            n = min(rest[1] - rest[0], rest[3] - rest[2])
            if n > 0:
                todo.append(rest)
                most += n
    return most


def ratio_bounds(line: str, counts: np.ndarray, their: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ratios that a line can't pass with others of these letter counts and sizes: matching blocks are no longer than the characters that both hold."""
    both = sizes + len(line)
    return np.where(both > 0, 2 * np.minimum(their, counts).sum(1) / np.maximum(both, 1), 1.0)


def ratio(x: Line, y: Line, least: float) -> float:
    """``SequenceMatcher(None, x, y).ratio()``; where it is below ``least``, any number below it."""
    n = len(x.text) + len(y.text)
    return 2.0 * matched(x, y, least * n / 2 - 1e-6) / n if n else 1.0


def most_similar(line: str, others: list[Line], bounds: np.ndarray, free: np.ndarray) -> tuple[float, int]:
    """The highest ratio, of ``PART`` at least, with a line that is free, and the first line that has it; (0, -1) if none.

    Lines are taken by their bounds, and compared only while these reach the best ratio.
    """
    x, best, place = Line(line), PART, -1
    at = np.flatnonzero(free & (bounds >= PART))
    for i in at[np.lexsort((at, -bounds[at]))].tolist():
        if bounds[i] < best or bounds[i] == best and 0 <= place < i:
            break
        score = ratio(x, others[i], best)
        if score > best or score == best and (place < 0 or i < place):
            best, place = score, i
    return (best, place) if place >= 0 else (0.0, -1)


def pick_lines(a: list[str], b: list[str]) -> list[tuple[float, int]]:
    """For each line of ``a`` in turn the most similar unused line of ``b``, by ratio and place; (0, -1) if none is partly alike."""
    counts, their = letter_counts(a, b)
    others, sizes, free = [Line(y, True) for y in b], np.array([len(y) for y in b], np.int64), np.ones(len(b), bool)
    out = []
    for line, own in zip(a, counts):
        out.append(most_similar(line, others, ratio_bounds(line, own, their, sizes), free))
        if out[-1][1] >= 0:
            free[out[-1][1]] = False
    return out


def similar_lines(a: list[str], b: list[str]) -> list[tuple[list[int], list[float]]]:
    """For each line of ``a`` all lines of ``b`` that are partly alike at least, and their ratios."""
    counts, their = letter_counts(a, b)
    others, sizes = [Line(y, True) for y in b], np.array([len(y) for y in b], np.int64)
    out = []
    for line, own in zip(a, counts):
        x, known = Line(line), {}
        for i in np.flatnonzero(ratio_bounds(line, own, their, sizes) >= PART).tolist():
            score = ratio(x, others[i], PART)
            if score >= PART:
                known[i] = score
        out.append((list(known), list(known.values())))
    return out


def votes_of(a: list[str], b: list[str], picks: list[tuple[float, int]]) -> list[tuple[str, str, float, str | None, str | None]]:
    """``vote_lines`` once each line of ``a`` has its line of ``b``."""
    out, used = [], {at for _, at in picks}
    for line, (score, at) in zip(a, picks):
        other = b[at] if at >= 0 else None
        if other is None:
            out.append(("single", line, ALONE_CONFIDENCE, line, None))
        elif score >= SAME:
            out.append(("agree", other if len(other) >= len(line) else line, round((1 + score) / 2, 3), line, other))
        else:
            clean = without_marks(other)
            out.append(("partial", clean if len(clean) >= len(line) else line, PART_CONFIDENCE, line, other))
    return out + [("single", x, ALONE_CONFIDENCE, None, x) for i, x in enumerate(b) if i not in used]


def vote_lines(a: list[str], b: list[str]) -> list[tuple[str, str, float, str | None, str | None]]:
    """(verdict, chosen text, confidence, line of a, line of b): each line of ``a`` takes the most similar unused line of ``b``; what is left of ``b`` follows.

    Lines that agree give the longer one, partly alike ones the longer one without marks of ``b``, ``a`` if they are as long.
    """
    return votes_of(a, b, pick_lines(a, b))


def line_votes(rows: DataFrame, group: str, room: int = 1 << 17, square: int = 64) -> DataFrame:
    """group, at, verdict, text, confidence, first, second: the votes between the lines of two readings of one page.

    ``rows``: side (0 or 1), pos, text (null: empty). Junk lines go, unless no other is left. A page's lines meet in one group. Of a page
    with more than ``room`` pairs of lines the ratios are worked out before, in squares of ``square`` lines a side that are dealt to tasks.
    """
    kind = dict(rows.dtypes)[group]
    page = Window.partitionBy(group)
    lines = rows.where("side in (0, 1)").select(group, "side", "pos", F.coalesce("text", F.lit("")).alias("text"))
    lines = spread(lines, group)
    for k in (0, 1):
        lines = lines.withColumn(f"_n{k}", F.count(F.when(F.col("side") == k, 1)).over(page))
    lines = lines.withColumn("_at", F.row_number().over(Window.partitionBy(group, "side").orderBy(F.asc_nulls_last("pos"), "text")) - 1)

    def sides(rows: pa.Table) -> list[list[str]]:
        order = sorted(zip(*(rows[c].to_pylist() for c in ("side", "_at", "text"))))
        return [[text for s, _, text in order if s == k] for k in (0, 1)]

    def table(key: pa.Table, names: list[str], types: list[pa.DataType], out: list[tuple]) -> pa.Table:
        columns = list(zip(*out)) or [[] for _ in names]
        kind = key.schema.field(group).type
        return pa.table([pa.array([key[group][0].as_py()] * len(out), kind), *map(pa.array, columns, types)], [group, *names])

    def voted(rows: pa.Table, a: list[str], b: list[str], picks: list[tuple[float, int]]) -> pa.Table:
        votes = votes_of(a, b, picks)
        votes = [v for v in votes if not junk_line(v[1])] or votes
        names, types = ["at", "verdict", "text", "confidence", "first", "second"], [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]
        return table(rows, names, types, [(i, *v) for i, v in enumerate(votes)])

    def whole(rows: pa.Table) -> pa.Table:
        a, b = sides(rows)
        return voted(rows, a, b, pick_lines(a, b))

    def compared(rows: pa.Table) -> pa.Table:
        starts = [rows["_row"][0].as_py() * square, rows["_column"][0].as_py() * square]
        out = [(starts[0] + i, [starts[1] + j for j in at], scores) for i, (at, scores) in enumerate(similar_lines(*sides(rows))) if at]
        return table(rows, ["i", "j", "ratio"], [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())], out)

    def dealt(rows: pa.Table, known: pa.Table) -> pa.Table:
        a, b = sides(rows)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, j, scores in zip(known["i"].to_pylist(), known["j"], known["ratio"]):
            found.setdefault(i, []).append((j.values.to_numpy(), scores.values.to_numpy()))
        free, picks = np.ones(len(b), bool), [(0.0, -1)] * len(a)
        for i in sorted(found):
            at, scores = (np.concatenate(x) for x in zip(*found[i]))
            at, scores = at[free[at]], scores[free[at]]
            if len(at):
                score = scores.max()
                picks[i] = float(score), int(at[scores == score].min())
                free[picks[i][1]] = False
        return voted(rows, a, b, picks)

    schema = f"{group} {kind}, at int, verdict string, text string, confidence double, first string, second string"
    small = lines.where(F.col("_n0") * F.col("_n1") <= room).groupBy(group).applyInArrow(whole, schema)
    large = lines.where(F.col("_n0") * F.col("_n1") > room)
    own, first = F.floor(F.col("_at") / square), F.col("side") == 0
    all_others = F.sequence(F.lit(0).cast("long"), F.floor((F.when(first, F.col("_n1")).otherwise(F.col("_n0")) - 1) / square))
    squares = large.withColumn("_other", F.explode(all_others)).select(
        group, "side", "_at", "text", F.when(first, own).otherwise(F.col("_other")).alias("_row"), F.when(first, F.col("_other")).otherwise(own).alias("_column")
    )
    ratios = spread(squares, group, "_row", "_column").groupBy(group, "_row", "_column").applyInArrow(compared, f"{group} {kind}, i int, j array<int>, ratio array<double>")
    return small.unionByName(large.groupBy(group).cogroup(ratios.groupBy(group)).applyInArrow(dealt, schema))


def voted_pages(votes: DataFrame, group: str) -> DataFrame:
    """group, text, confidence, reason: a page's chosen lines, their mean confidence, and ok or what speaks against the page."""
    votes = spread(votes.select(group, "at", "text", "confidence"), group)
    g = votes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"), F.round(F.avg("confidence"), 3).alias("confidence"))
    g = g.select(group, F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), "confidence")
    return g.withColumn("reason", gate("text", confidence=F.col("confidence"), **GATE))


def agreement(first: Column, second: Column) -> Column:
    """How alike two readings are, 0 to 1: 0 if both are blank, 0.4 if one is. For texts of an image, as the time grows with the product of lengths."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = ((x.strip(), y.strip()) for x, y in zip(a, b))
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.4 if x or y else 0.0 for x, y in pairs])

    return ratio(F.coalesce(first, F.lit("")), F.coalesce(second, F.lit("")))


def longest_first(rows: DataFrame, group: str, start: str, end: str, least: float = 400) -> DataFrame:
    """group, start, end, item: segments take their time longest first; a later one keeps its largest free piece of ``least`` or more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[float, float]] = []
        out = []
        order = rows.assign(_n=rows[end] - rows[start]).sort_values(["_n", start, "item"], ascending=[False, True, True])
        for r in order.itertuples():
            s, e = getattr(r, start), getattr(r, end)
            cuts = sorted(x for x in taken if x[0] < e and s < x[1])
            edges = [s, *(p for c in cuts for p in c), e]
            free = max(((edges[i], edges[i + 1]) for i in range(0, len(edges), 2)), key=lambda x: x[1] - x[0])
            if free[1] - free[0] >= least:
                taken.append(free)
                out.append((getattr(r, group), *free, r.item))
        return pd.DataFrame(out, columns=[group, start, end, "item"])

    kind = dict(rows.dtypes)
    return rows.select(group, start, end, "item").groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {start} double, {end} double, item {kind['item']}")


def echoed(text: str, context: str, least: int = 20, share: float = 0.5) -> bool:
    """Whether a text repeats its context: the longest common part has ``least`` characters and half of the text."""
    n = SequenceMatcher(None, text, context, autojunk=False).find_longest_match(0, len(text), 0, len(context)).size
    return n >= least and n >= share * len(text)


def run_errors(line: str, pieces: list[str]) -> list[int]:
    """The edit distances of ``line`` to nothing, the first piece, the first two together, and so on: one column of the table goes on from piece to piece."""
    masks: dict[str, int] = {}
    for i, c in enumerate(line):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last, cost = (1 << len(line)) - 1, len(line) - 1, len(line)
    up, down, out = full, 0, [len(line)]
    for piece in pieces:
        for c in piece if line else "":
            eq = masks.get(c, 0)
            zero = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | (full & ~(zero | up)), up & zero
            cost += (plus >> last & 1) - (minus >> last & 1)
            plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
            up, down = minus | (full & ~(zero | plus)), plus & zero
        cost += 0 if line else len(piece)
        out.append(cost)
    return out


def sign_counts(texts: list[str], signs: int = 64) -> np.ndarray:
    """How often each text holds the signs of each of ``signs`` classes."""
    return np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % signs, minlength=signs) for t in texts], np.int32).reshape(len(texts), signs)


def fewest_errors(difference: np.ndarray) -> np.ndarray:
    """Bounds from below of edit distances, from the differences of ``sign_counts``: each error adds one sign at most, and takes one away."""
    more = np.maximum(difference, 0).sum(1)
    return np.maximum(more, more - difference.sum(1))


def line_runs(lines: list[str], pieces: list[str], most: int = 4) -> list[tuple[int, int]]:
    """For each line the run [from, to) of pieces that it takes, up to ``most``, in order, with the least character errors over letters and digits.

    Pieces behind the cheapest end stay out: noise may follow the last line. Of equal ways the longer run of the later line counts.
    The way that is best by bounds from below is worked out first; then only runs are that a way with no more errors can take.
    """
    plain = lambda t: re.sub(r"[^가-힣a-zA-Z0-9]", "", t)
    own, bare, n = list(map(plain, lines)), list(map(plain, pieces)), len(pieces)
    held, upto = sign_counts(own), np.vstack([np.zeros((1, 64), np.int32), sign_counts(bare).cumsum(0, np.int32)])
    runs = [upto[k:] - upto[: n + 1 - k] for k in range(min(most, n) + 1)]
    known: list[tuple[int, list[int]]] = []  # of each line the start of its run on the first way, and the errors of its runs from there

    def rests() -> np.ndarray:
        """Of each line and start: a bound from below of all errors from there on."""
        rest = np.zeros((len(own) + 1, n + 1), np.int32)
        for i in reversed(range(len(own))):
            rest[i] = np.iinfo(np.int32).max
            for k, run in enumerate(runs):
                low = fewest_errors(run - held[i])
                if known and k < len(known[i][1]):
                    low[known[i][0]] = known[i][1][k]
                rest[i, : n + 1 - k] = np.minimum(rest[i, : n + 1 - k], low + rest[i + 1, k:])
        return rest

    def lows(i: int, start: int) -> list[int]:
        low = fewest_errors(upto[start : start + most + 1] - upto[start] - held[i]).tolist()
        return known[i][1] + low[len(known[i][1]) :] if i < len(known) and known[i][0] == start else low

    rest, start, limit = rests(), 0, 0
    for i, line in enumerate(own):
        ends = [low + int(rest[i + 1, start + k]) for k, low in enumerate(lows(i, start))]
        k = ends.index(min(ends))
        known.append((start, run_errors(line, bare[start : start + k])))
        start, limit = start + k, limit + known[i][1][k]
    rest, best, ways = rests(), {0: 0}, []
    for i, line in enumerate(own):
        # Of each start: the errors of the runs that begin there, one column of distances after the other.
        reached: dict[int, tuple[int, int]] = {}
        for start, cost in best.items():
            ends = [k for k, low in enumerate(lows(i, start)) if cost + low + int(rest[i + 1, start + k]) <= limit]
            errors = run_errors(line, bare[start : start + ends[-1]]) if ends else []
            for k in ends:
                new = (cost + errors[k], start)
                reached[start + k] = min(reached.get(start + k, new), new)
        ways.append(reached)
        best = {end: cost for end, (cost, _) in reached.items()}
    at, out = min(best, key=lambda j: (best[j], j)), []
    for reached in reversed(ways):
        start = reached[at][1]
        out.append((start, at))
        at = start
    return out[::-1]


def script_alignment(lines: DataFrame, pieces: DataFrame, group: str) -> DataFrame:
    """group, line, piece: which ``pieces`` (group, pos, text) each of the script's ``lines`` (group, pos, text) takes. A script is one group."""

    def run(lines: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        lines, pieces = lines.sort_values("pos"), pieces.sort_values("pos")
        if not len(lines):
            return pd.DataFrame({group: [], "line": [], "piece": []})
        runs = line_runs(lines["text"].tolist(), pieces["text"].tolist())
        out = [(lines[group].iloc[0], line, pieces["pos"].iloc[k]) for line, (a, b) in zip(lines["pos"], runs) for k in range(a, b)]
        return pd.DataFrame(out, columns=[group, "line", "piece"])

    kind = dict(lines.dtypes)
    own = lambda d: spread(d.select(group, "pos", F.coalesce("text", F.lit("")).alias("text")), group).groupBy(group)
    return own(lines).cogroup(own(pieces)).applyInPandas(run, f"{group} {kind[group]}, line {kind['pos']}, piece {dict(pieces.dtypes)['pos']}")


def echo(text: Column, context: Column) -> Column:
    """``echoed`` of each text with its context, in Arrow batches."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([echoed(a or "", b or "") for a, b in zip(texts, contexts)])

    return run(text, context)
