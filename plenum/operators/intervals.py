"""Interval joins for speaker attribution. Each has the meeting as its equality key.

A meeting's segments and tracks are compared inside one meeting only; ``bucketed`` adds a time bucket as a
second key, so that a very long meeting is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucketed(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each time bucket that a span touches."""
    low, high = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width)
    return rows.withColumn("_bucket", F.explode(F.sequence(low, high)))


def overlap_join(a: DataFrame, b: DataFrame, group: str, a_span: tuple[str, str], b_span: tuple[str, str], width: int = 600_000) -> DataFrame:
    """Pairs of spans of one group that overlap, with ``overlap``. Each pair comes once: in the bucket where its overlap starts."""
    x, y = bucketed(a, *a_span, width), bucketed(b, *b_span, width)
    (s, e), (u, v) = a_span, b_span
    pairs = x.join(y, [group, "_bucket"]).where((F.col(s) < F.col(v)) & (F.col(u) < F.col(e)))
    at = F.greatest(s, u)
    return pairs.where(F.floor(at / width) == F.col("_bucket")).withColumn("overlap", F.least(e, v) - at).drop("_bucket")


def best_track(segments: DataFrame, tracks: DataFrame, keys: list[str], group: str = "meeting_id") -> DataFrame:
    """``segments`` (start, end) with the speaker of the track (track_start, track_end, track) of the largest overlap; UNKNOWN without any."""
    hit = overlap_join(segments, tracks, group, ("start", "end"), ("track_start", "track_end"))
    top = hit.groupBy(*keys).agg(F.max_by("speaker", F.struct("overlap", -F.col("track"))).alias("speaker"))
    return segments.join(top, keys, "left").withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))


def longest_name(segments: DataFrame, slots: DataFrame, keys: list[str], group: str = "meeting_id") -> DataFrame:
    """The name with the largest sum of overlaps; of equal sums the one whose slot comes first."""
    hit = overlap_join(segments, slots.where("name is not null"), group, ("start", "end"), ("slot_start", "slot_end"))
    by = hit.groupBy(*keys, "name").agg(F.sum("overlap").alias("total"), F.min("slot_start").alias("first"))
    top = by.groupBy(*keys).agg(F.max_by("name", F.struct("total", -F.col("first"))).alias("name"))
    return segments.join(top, keys, "left")


def coverage(segments: DataFrame, spans: DataFrame, keys: list[str], group: str = "meeting_id") -> DataFrame:
    """``segments`` with the share of their time that disjoint spans cover."""
    hit = overlap_join(segments, spans, group, ("start", "end"), ("span_start", "span_end")).groupBy(*keys).agg(F.sum("overlap").alias("covered"))
    return segments.join(hit, keys, "left").withColumn("ratio", F.coalesce(F.try_divide(F.col("covered").cast("double"), (F.col("end") - F.col("start")).cast("double")), F.lit(0.0)))


def clipped_runs(segments: DataFrame, slots: DataFrame, keys: list[str], group: str = "meeting_id") -> DataFrame:
    """Inside each segment the slots, clipped to it, those of one name in a row joined."""
    hit = overlap_join(segments, slots, group, ("start", "end"), ("slot_start", "slot_end"))
    clip = hit.select(*keys, "name", "slot_start", "slot_end", F.greatest("start", "slot_start").alias("a"), F.least("end", "slot_end").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a", "b", "name", "slot_start", "slot_end")
    clip = clip.withColumn("_b", F.coalesce((~F.col("name").eqNullSafe(F.lag("name").over(w))).cast("int"), F.lit(1)))
    clip = clip.withColumn("_b", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_b")))
    clip = clip.withColumn("run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return clip.groupBy(*keys, "run").agg(F.first("name").alias("name"), F.min("a").alias("a"), F.max("b").alias("b"))


def split_at_runs(segments: DataFrame, slots: DataFrame, keys: list[str], least: int = 1000) -> DataFrame:
    """Cuts segments in the middle between neighbouring runs of different names that last ``least`` or longer."""
    runs = clipped_runs(segments, slots, keys).where((F.col("b") - F.col("a") >= least) & F.col("name").isNotNull())
    # Runs clipped to the same times are taken in the order of their slots.
    w = Window.partitionBy(*keys).orderBy("a", "b", "run")
    cut = runs.withColumns({"_n": F.lead("name").over(w), "_a": F.lead("a").over(w)}).where(F.col("_n") != F.col("name"))
    cuts = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(((F.col("b") + F.col("_a")) / 2).cast("double"))).alias("cuts"))
    d = segments.join(cuts, keys, "left").withColumn("edges", F.concat(F.array(F.col("start").cast("double")), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.col("end").cast("double"))))
    d = d.select(*keys, "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("part"))
    return d.select(*keys, "part", F.col("edges")[F.col("part")].alias("start"), F.col("edges")[F.col("part") + 1].alias("end"))


def windows(spans: DataFrame, size: int = 1500, hop: int = 500) -> DataFrame:
    """The windows of ``size`` that start every ``hop`` inside each span (start, end); a shorter span gives itself."""
    starts = F.when(F.col("end") - F.col("start") >= size, F.sequence("start", F.col("end") - size, F.lit(hop).cast("bigint"))).otherwise(F.array("start"))
    return spans.withColumn("at", F.explode(starts)).withColumn("until", F.least(F.col("at") + size, F.col("end")))
