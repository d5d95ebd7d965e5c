"""Ordered scans over groups that are too long for one task: parts of bounded rows are scanned alone, and their ends are carried over.

``deal`` cuts each long group at approximate quantiles of its first order column. Windows then run inside a part; what a row needs from the rows
before its part comes from one row for each part, which is scanned over the parts of a group and joined back. The results
are those of plain windows over the whole group. Equal values of the first order column stay in one part, so these must be few. Short groups are one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "_part"


def deal(rows: DataFrame, keys: list[str], order: str, most: int = 1_000_000, parts: int = 4096) -> DataFrame:
    """``rows`` with the number of their part: a group with more than ``most`` rows is cut into parts of about that many, up to ``parts`` of them.

    Rows without a value of ``order`` come first, in part 0.
    """
    value = F.col(order).cast("double")
    share = 1.0 / parts
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    long = rows.join(sizes.select(*keys), keys, "left_semi")
    cuts = long.groupBy(*keys).agg(F.percentile_approx(value, [i * share for i in range(1, parts)], 4 * parts).alias("_q"), F.count("*").alias("_n"))
    # Of all quantiles as many as the group has parts.
    each = F.greatest(F.lit(1), F.floor(parts / F.ceil(F.col("_n") / most))).cast("int")
    cuts = cuts.select(*keys, F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % F.greatest(F.lit(1), each) == 0)).alias("_cuts"))
    # How many cuts are no larger than the value, by halves: a row's work follows the logarithm of the parts.
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(parts.bit_length()))))
    step = lambda a, k: a + F.when((a + k <= F.size("_cuts")) & (F.get("_cuts", a + k - 1) <= value), k).otherwise(0)
    found = F.coalesce(F.aggregate(halves, F.lit(0), step), F.lit(0))
    return rows.join(cuts, keys, "left").withColumn(PART, found).drop("_cuts")


def _parts(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(PART)


def _back(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Joins one row of each part to its rows; null keys meet each other."""
    names = [*keys, PART]
    right = carried.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), *(c for c in carried.columns if c not in names))
    same = None
    for i, k in enumerate(names):
        hit = rows[k].eqNullSafe(right[f"_k{i}"])
        same = hit if same is None else same & hit
    return rows.join(right, same, "left").drop(*(f"_k{i}" for i in range(len(names))))


def beside(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], after: bool = False) -> DataFrame:
    """``rows`` with the values that ``columns`` (new: old) have in the row before, or ``after``, in the whole group; null at its end.

    ``rows`` have been dealt; ``order`` must be total.
    """
    w = Window.partitionBy(*keys, PART).orderBy(*order)
    shift = F.lead if after else F.lag
    place = F.struct(*(F.col(c) for c in order))
    end = (F.min_by if after else F.max_by)(F.struct(*(F.col(old).alias(new) for new, old in columns.items())), place)
    ends = rows.groupBy(*keys, PART).agg(end.alias("_end"))
    ends = ends.withColumn("_end", shift("_end").over(_parts(keys)))
    d = _back(rows, ends, keys)
    first = (F.lead if after else F.lag)(F.lit(1)).over(w).isNull()
    return d.withColumns({new: F.when(first, F.col(f"_end.{new}")).otherwise(shift(old).over(w)) for new, old in columns.items()}).drop("_end")


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """``rows`` with sums and maxima over all rows of the group up to this one, or up to the one before it; a sum of nothing is 0, a maximum null."""
    sums, tops = sums or {}, tops or {}
    w = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = _parts(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, PART).agg(*(F.sum(c).alias(f"_c_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_c_{n}") for n, c in tops.items()))
    carried = totals.select(*keys, PART, *(F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums), *(F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in tops))
    d = _back(rows, carried, keys)
    own = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n, c in sums.items()}
    own |= {n: F.greatest(F.max(c).over(w), F.col(f"_c_{n}")) for n, c in tops.items()}
    return d.withColumns(own).drop(*(f"_c_{n}" for n in [*sums, *tops]))


def islands(rows: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each group; ``breaks`` is true on a row that starts one, and may use columns of ``beside``."""
    return running(rows, keys, order, sums={name: F.coalesce(breaks.cast("int"), F.lit(1))})


def smoothed(rows: DataFrame, group: str, label: str, order: list[str], **how) -> DataFrame:
    """``rows`` with each label replaced by that of both neighbours if these agree."""
    d = deal(rows, [group], order[0], **how)
    d = beside(d, [group], order, {"_before": label})
    d = beside(d, [group], order, {"_after": label}, after=True)
    return d.withColumn(label, F.when(F.col("_before") == F.col("_after"), F.col("_before")).otherwise(F.col(label))).drop("_before", "_after", PART)


def merge_gaps(rows: DataFrame, group: str, label: str, start: str, end: str, gap: float, tie: str, **how) -> DataFrame:
    """group, label, start, end, parts: neighbours of one label that begin at most ``gap`` after the latest end so far; the twin of ``windows.merge_gaps``."""
    order = [start, end, tie]
    d = beside(deal(rows, [group], start, **how), [group], order, {"_was": label})
    d = islands(d, [group], order, F.col(label) != F.col("_was"), "_island")
    d = running(d, [group, "_island"], order, tops={"_top": F.col(end)}, inclusive=False)
    d = islands(d, [group, "_island"], order, F.col(start) - F.col("_top") > gap)
    return d.groupBy(group, "_island", "run", label).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island", "run")


def label_runs(rows: DataFrame, group: str, label: str, start: str, end: str, tie: str, **how) -> DataFrame:
    """group, run, label, start, end: runs of equal labels, which meet in the middle of the gap; the twin of ``windows.label_runs``."""
    order = [start, end, tie]
    d = beside(deal(rows, [group], start, **how), [group], order, {"_was": label, "_at": start})
    d = islands(d, [group], order, ~F.col(label).eqNullSafe(F.col("_was")) | F.col("_at").isNull())
    # A run lies where its first row does, so the runs of a part are no more than its rows.
    runs = d.groupBy(group, "run").agg(F.min(PART).alias(PART), F.first(label).alias(label), F.min(start).alias("_s"), F.max(end).alias("_e"))
    runs = beside(runs, [group], ["run"], {"_left": "_e"})
    runs = beside(runs, [group], ["run"], {"_right": "_s"}, after=True)
    return runs.select(group, "run", label, F.coalesce((F.col("_left") + F.col("_s")) / 2, F.col("_s").cast("double")).alias(start), F.coalesce((F.col("_e") + F.col("_right")) / 2, F.col("_e").cast("double")).alias(end))


def gap_clusters(rows: DataFrame, group: str, at: str, gap: float, tie: str, **how) -> DataFrame:
    """``rows`` with ``cluster``: a new one begins where a value is more than ``gap`` after the one before."""
    order = [at, tie]
    d = beside(deal(rows, [group], at, **how), [group], order, {"_was": at})
    return islands(d, [group], order, F.col(at) - F.col("_was") > gap, "cluster").drop("_was", PART)
