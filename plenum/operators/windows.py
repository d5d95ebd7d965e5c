"""Order-dependent operators as window expressions: runs, gap merges, sweeps, numbering, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.scores import WHITE, WS


def numbered(rows: DataFrame, keys: list[str], *order: Column, name: str = "n") -> DataFrame:
    """A running number from 1 inside each key; the order must be total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def drop_repeats(rows: DataFrame, keys: list[str], order: str, least: int) -> DataFrame:
    """Of rows that are equal in ``keys`` ``least`` times or more, the first; all others."""
    w = Window.partitionBy(*keys)
    d = rows.withColumns({"_n": F.count("*").over(w), "_first": F.min(order).over(w)})
    return d.where((F.col("_n") < least) | (F.col(order) == F.col("_first"))).drop("_n", "_first")


def islands(rows: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each key; ``breaks`` is true on a row that starts one. It may look back with lag()."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumn("_b", F.coalesce(breaks.cast("int"), F.lit(1)))
    return d.withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def before(column: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def merge_gaps(rows: DataFrame, group: str, label: str, start: str, end: str, gap: float) -> DataFrame:
    """Joins neighbours (by start) of one label that begin at most ``gap`` after the latest end so far: group, label, start, end, parts."""
    order = [start, end]
    same = islands(rows, [group], order, F.col(label) != before(label, [group], order), "_island")
    # Inside the rows of one label an earlier part ends before any gap, so the latest end of all of them will do.
    w = Window.partitionBy(group, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    runs = islands(same.withColumn("_top", F.max(end).over(w)), [group, "_island"], order, F.col(start) - F.col("_top") > gap)
    return runs.groupBy(group, "_island", "run", label).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("run", "_island")


def turns(spans: DataFrame, group: str, label: str, start: str, end: str, length: str, least: float = 1500) -> DataFrame:
    """group, turn, start, end, label: the turns of a chunk (``length``) whose voiced ``spans`` have a label.

    A null label, of a span too short to tell, is that of the span before, else of the one after. A turn lasts from its
    first span to the next turn's, the first from 0, the last to ``length``. One shorter than ``least`` goes to the
    turn before it; the first one, if short, to the next, whose label it takes.
    """
    w = Window.partitionBy(group).orderBy(start, end)
    near = F.coalesce(F.last(label, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(label, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    d = spans.withColumn("_l", near)
    d = islands(d, [group], [start, end], ~F.col("_l").eqNullSafe(F.lag("_l").over(w)), "_run").groupBy(group, "_run").agg(F.first("_l").alias("_l"), F.min(start).alias("_s"), F.max(length).alias("_len"))
    w = Window.partitionBy(group).orderBy("_run")
    d = d.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.when(F.col("_n") == 1, 0).otherwise(F.col("_s")))
    d = d.withColumn("_e", F.coalesce(F.lead("_s").over(w), F.col("_len"))).withColumn("_short", F.col("_e") - F.col("_s") < least)
    after_short_first = (F.col("_n") == 2) & F.lag("_short").over(w)
    head = (F.col("_n") == 1) | (~F.col("_short") & ~after_short_first)
    d = d.withColumn("turn", F.sum(head.cast("int")).over(w)).withColumn("_rank", F.when(after_short_first, 0).otherwise(F.col("_n")))
    return d.groupBy(group, "turn").agg(F.min("_s").alias(start), F.max("_e").alias(end), F.min_by("_l", "_rank").alias(label))


def sentences(segments: DataFrame, keys: list[str], text: str, start: str, end: str, least: int = 6) -> DataFrame:
    """keys, part, start, end, text, estimated: segments cut after a sentence's mark and blanks.

    A part under ``least`` characters joins the one before it, the first one the next. A segment's time is dealt by the
    parts' characters, to two places; ``estimated`` marks segments that were cut.
    """
    bare = lambda c: F.btrim(c, F.lit(WHITE))
    pieces = F.filter(F.transform(F.split(bare(F.col(text)), rf"(?<=[.!?])[{WS}]+"), bare), lambda p: p != "")
    start_array = F.array().cast("array<string>")

    def join(a, p):
        last = F.element_at(a, -1)
        short = (F.size(a) > 0) & (F.length(p) < least)
        return F.when(short, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat_ws(" ", last, p)))).otherwise(F.concat(a, F.array(p)))

    d = segments.withColumn("_p", F.aggregate(pieces, start_array, join))
    first = (F.size("_p") > 1) & (F.length(F.get("_p", F.lit(0))) < least)
    d = d.withColumn("_p", F.when(first, F.concat(F.array(F.concat_ws(" ", F.get("_p", F.lit(0)), F.get("_p", F.lit(1)))), F.slice("_p", F.lit(3), F.size("_p")))).otherwise(F.col("_p")))
    d = d.withColumn("_p", F.when(F.size("_p") < 2, F.array(bare(F.col(text)))).otherwise(F.col("_p")))
    total = F.aggregate("_p", F.lit(0), lambda a, p: a + F.length(p))
    d = d.withColumns({"_total": total, "estimated": F.size("_p") > 1}).select("*", F.posexplode("_p").alias("part", "_t"))
    w = Window.partitionBy(*keys).orderBy("part")
    upto = F.sum(F.length("_t")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = lambda n: F.round(F.col(start) + (F.col(end) - F.col(start)) * n / F.col("_total"), 2)
    cut_start = F.when(~F.col("estimated"), F.col(start)).otherwise(at(upto - F.length("_t")))
    cut_end = F.when(~F.col("estimated"), F.col(end)).when(F.lead("part").over(w).isNull(), F.round(F.col(end), 2)).otherwise(at(upto))
    return d.select(*keys, "part", cut_start.alias(start), cut_end.alias(end), F.col("_t").alias(text), "estimated")


def label_runs(rows: DataFrame, group: str, label: str, start: str, end: str) -> DataFrame:
    """Runs of equal labels; where two runs meet the boundary is the middle of the gap."""
    order = [start, end]
    runs = islands(rows, [group], order, ~F.col(label).eqNullSafe(before(label, [group], order)) | before(start, [group], order).isNull())
    spans = runs.groupBy(group, "run").agg(F.first(label).alias(label), F.min(start).alias("_s"), F.max(end).alias("_e"))
    w = Window.partitionBy(group).orderBy("run")
    left, right = F.lag("_e").over(w), F.lead("_s").over(w)
    return spans.select(group, "run", label, F.coalesce((left + F.col("_s")) / 2, F.col("_s").cast("double")).alias(start), F.coalesce((F.col("_e") + right) / 2, F.col("_e").cast("double")).alias(end))


def union_spans(rows: DataFrame, keys: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """The union of spans inside each key, joining what is at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = rows.select(*keys, start, end).withColumn("_b", F.coalesce((F.col(start) - top > gap).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def concurrency(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, at, active, until: how many spans are open from each event to the next; ends come before starts."""
    events = rows.select(group, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(rows.select(group, F.col(end).alias("at"), F.lit(-1).alias("d")))
    # One row for a time: the ends and starts there are summed.
    sums = events.groupBy(group, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(group).orderBy("at")
    return sums.select(group, "at", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("active"), F.lead("at").over(w).alias("until"))


def overlaps(tracks: DataFrame, group: str, speaker: str, start: str, end: str, speakers: int = 2, least: float = 300, gap: float = 300) -> DataFrame:
    """Spans in which ``speakers`` or more different ones talk: short ones go, then near ones are joined."""
    own = union_spans(tracks.where(F.col(speaker).isNotNull() & (F.col(end) > F.col(start))), [group, speaker], start, end)
    both = concurrency(own, group, start, end).where((F.col("active") >= speakers) & F.col("until").isNotNull())
    spans = union_spans(both.select(group, F.col("at").alias(start), F.col("until").alias(end)), [group], start, end)
    return union_spans(spans.where(F.col(end) - F.col(start) >= least), [group], start, end, gap)


def prefix_sums(rows: DataFrame, order: str, tie: str, sums: list[str], buckets: int = 64) -> DataFrame:
    """``rows`` with cum_<name>: sums over all rows up to this one by (order descending, tie).

    The range of ``order`` is cut at approximate quantiles, at most ``buckets`` numbers that the driver sees;
    each bucket is summed alone and the sums of the buckets above are added, so no task gets all rows.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    cut = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    d = rows.withColumn("_b", F.size(F.filter(cut, lambda c: c <= F.col(order))))
    w = Window.partitionBy("_b").orderBy(F.desc(order), tie)
    d = d.withColumns({f"cum_{s}": F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, 0)) for s in sums})
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_b").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    totals = totals.select("_b", *(F.coalesce(F.sum(f"_t_{s}").over(above), F.lit(0)).alias(f"_o_{s}") for s in sums))
    # At most ``buckets`` rows.
    d = d.join(F.broadcast(totals), "_b")
    return d.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_o_{s}") for s in sums}).drop("_b", *(f"_o_{s}" for s in sums))
