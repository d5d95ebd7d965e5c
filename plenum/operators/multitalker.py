"""Error rates of transcripts with several speakers: by the best matching of speakers, and without the speakers' share.

The first (concatenated minimum permutation) joins each speaker's words in order and pairs the reference's speakers with
the heard ones so that all edit distances together are least; a speaker without a partner costs its words. The
second (diarization-invariant) may also give each heard segment to another speaker, in its order. The difference is what wrong speakers cost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.cleaning import normal_form
from plenum.shared import spread

from .evaluation import edit_distance


def assignment(cost: np.ndarray) -> tuple[int, list[int]]:
    """The least sum of a square matrix of integers with one entry in each row and column, and each row's column.

    Rows are added one by one; each finds the cheapest alternating path to a free column, by potentials that keep
    all reduced costs at 0 or more, so n rows take steps in proportion to n cubed.
    """
    n = len(cost)
    row_of = np.full(n + 1, -1)  # of each column; the last one is where a search begins
    u, v = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n):
        row_of[n], at = i, n
        slack, came, done = np.full(n, np.iinfo(np.int64).max), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            done[at] = True
            r = row_of[at]
            free = ~done[:n]
            reduced = cost[r] - u[r] - v[:n]
            better = free & (reduced < slack)
            slack[better], came[better] = reduced[better], at
            nearest = int(np.where(free, slack, np.iinfo(np.int64).max).argmin())
            step = slack[nearest]
            u[row_of[done]] += step
            v[done] -= step
            slack[free] -= step
            at = nearest
        while at != n:
            row_of[at] = row_of[came[at]]
            at = int(came[at])
    columns = [0] * n
    for c in range(n):
        columns[row_of[c]] = c
    return int(sum(cost[r][columns[r]] for r in range(n))), columns


def _padded(cost: dict[tuple, int], refs: dict, hyps: dict) -> np.ndarray:
    n = max(len(refs), len(hyps))
    out = np.zeros((n, n), np.int64)
    for i, a in enumerate(refs):
        for j, b in enumerate(hyps):
            out[i, j] = cost[a, b]
    for i, a in enumerate(refs.values()):
        out[i, len(hyps) :] = a
    for j, b in enumerate(hyps.values()):
        out[len(refs) :, j] = b
    return out


def regrouped(refs: list[list], heard: list[tuple[int, list]], sweeps: int = 10) -> int:
    """The errors after heard segments (stream, units) have moved between streams for as long as a move helps, at most ``sweeps`` times through.

    Streams of numbers beyond the references' are heard alone: their units are errors. It starts from the given streams, so it is never
    more than theirs; it is a bound from above of the least over all regroupings, which is too dear to find.
    """
    streams = max([len(refs), *(s + 1 for s, _ in heard)])
    refs = refs + [[]] * (streams - len(refs))
    of = [s for s, _ in heard]
    join = lambda s: [x for k, (_, units) in enumerate(heard) if of[k] == s for x in units]
    cost = [edit_distance(refs[s], join(s)) for s in range(streams)]
    for _ in range(sweeps):
        moved = False
        for k in range(len(heard)):
            home = of[k]
            best = (0, home, 0, 0)
            of[k] = -1
            left, n = edit_distance(refs[home], join(home)), len(heard[k][1])
            for s in range(streams):
                # A segment takes no more errors away than its units, so most moves can't help.
                least = left - cost[home] - n
                if s != home and (least < 0 or least == 0 and s < home):
                    of[k] = s
                    there = edit_distance(refs[s], join(s))
                    best = min(best, (left + there - cost[home] - cost[s], s, left, there))
            of[k] = best[1]
            if best[1] != home:
                cost[home], cost[best[1]], moved = best[2], best[3], True
        if not moved:
            break
    return sum(cost)


def speaker_errors(ref: DataFrame, hyp: DataFrame, session: str, chars: bool = False, second: bool = True) -> DataFrame:
    """session, units, cp_errors and, if ``second``, di_errors, speaker_errors of each session of ``ref`` and ``hyp`` (session, speaker, pos, text).

    Units are the words of the texts' normal forms, or their letters without blanks if ``chars``. A missing speaker is one of his own, ``?``;
    segments of equal ``pos`` go by speaker and text. A session that was only heard counts its units as errors, one only written down too. Each pair of speakers of a session is a row of
    its own; texts travel as strings, and a task holds one pair's units at a time; the matching sees the distances alone. The second rate holds one session.
    """
    kind = dict(ref.dtypes)[session]

    blank = "" if chars else " "
    split = (lambda t: t) if chars else str.split

    @F.pandas_udf("string")
    def units(texts: pd.Series) -> pd.Series:
        return pd.Series([normal_form(t or "").replace(" ", blank) for t in texts], dtype=object)

    def number(c: str):
        return F.length(c) if chars else F.size(F.split(c, " "))

    def segments(d: DataFrame) -> DataFrame:
        d = d.select(session, F.coalesce(F.col("speaker").cast("string"), F.lit("?")).alias("speaker"), "pos", F.coalesce("text", F.lit("")).alias("text"))
        return d.withColumn("units", units("text")).where("units <> ''")

    def streams(d: DataFrame, name: str) -> DataFrame:
        g = d.groupBy(session, "speaker").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "units"))).alias("x"))
        return g.select(session, F.col("speaker").alias(name), F.array_join(F.transform("x", lambda x: x["units"]), blank).alias(f"{name}_units"))

    a, b = segments(ref), segments(hyp)

    @F.pandas_udf("long")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(split(p), split(q)) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="Int64")

    pairs = streams(a, "r").join(streams(b, "h"), session, "full")
    pairs = pairs.select(session, "r", "h", number("r_units").alias("nr"), number("h_units").alias("nh"), distance("r_units", "h_units").alias("cost"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        given, heard = rows[rows["r"].notna()], rows[rows["h"].notna()]
        refs, hyps = dict(sorted(zip(given["r"], given["nr"].astype(int)))), dict(sorted(zip(heard["h"], heard["nh"].astype(int))))
        both = rows[rows["cost"].notna()]
        total, columns = assignment(_padded({(r, h): int(c) for r, h, c in zip(both["r"], both["h"], both["cost"])}, refs, hyps))
        place = {h: columns.index(j) for j, h in enumerate(hyps)}
        return pd.DataFrame({session: [rows[session].iloc[0]], "units": [sum(refs.values())], "cp_errors": [total], "refs": [list(refs)], "hyps": [list(place)], "places": [list(place.values())]})

    matched = spread(pairs, session).groupBy(session).applyInPandas(match, f"{session} {kind}, units long, cp_errors long, refs array<string>, hyps array<string>, places array<int>")
    if not second:
        return matched.select(session, "units", "cp_errors")
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    both = both.select(session, "side", "speaker", "pos", "text", "units", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("cp"), *(F.lit(None).cast(f"array<{k}>").alias(c) for c, k in (("refs", "string"), ("hyps", "string"), ("places", "int"))))
    head = matched.select(session, F.lit(2).alias("side"), *(F.lit(None).cast(k).alias(c) for c, k in (("speaker", "string"), ("pos", dict(ref.dtypes)["pos"]), ("text", "string"), ("units", "string"))), F.col("units").alias("n"), F.col("cp_errors").alias("cp"), "refs", "hyps", "places")

    def regroup(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["side"] == 2].iloc[0]
        rows = rows.sort_values(["pos", "speaker", "text"])
        refs: dict[str, list] = {r: [] for r in own["refs"]}
        for r, x in rows.loc[rows["side"] == 0, ["speaker", "units"]].itertuples(index=False):
            refs[r] += split(x)
        place = dict(zip(own["hyps"], own["places"]))
        heard = [(int(place[h]), list(split(x))) for h, x in rows.loc[rows["side"] == 1, ["speaker", "units"]].itertuples(index=False)]
        di = min(int(own["cp"]), regrouped(list(refs.values()), heard))
        return pd.DataFrame({session: [own[session]], "units": [own["n"]], "cp_errors": [own["cp"]], "di_errors": [di], "speaker_errors": [own["cp"] - di]})

    return spread(both.unionByName(head), session).groupBy(session).applyInPandas(regroup, f"{session} {kind}, units long, cp_errors long, di_errors long, speaker_errors long")
