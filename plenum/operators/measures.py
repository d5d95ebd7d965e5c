"""Statistics of OCR runs and of audio, and the mix of several recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 3)


def ocr_statistics(attempts: DataFrame, key: str, useful: float = 0.35) -> DataFrame:
    """Counts and ratios of OCR attempts for each ``key``; a ratio of nothing is 0.

    ``attempts``: outcome (skip, success, empty, filtered), engine (first, both, cells), score (null or negative: not scored).
    ``consistent``: engines and outcomes each add up to the runs, and useful and useless ones to the successes.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    outcome, scored = F.col("outcome"), F.col("score") >= 0
    success = outcome == "success"
    g = attempts.groupBy(key).agg(
        F.count("*").alias("attempts"),
        n(outcome == "skip").alias("skips"),
        n(success).alias("successes"),
        n(outcome.isin("success", "empty", "filtered")).alias("results"),
        n(success & (F.col("score") >= useful)).alias("useful"),
        n(success & scored).alias("judged"),
        n((outcome != "skip") & (F.col("engine") == "both")).alias("both"),
        n(~outcome.eqNullSafe("skip") & F.col("engine").isin("first", "both", "cells")).alias("engines"),
        F.round(F.coalesce(F.avg(F.when(scored, F.col("score"))), F.lit(0.0)), 3).alias("mean_score"),
    )
    run = F.col("attempts") - F.col("skips")
    return g.select(
        key, "attempts", "skips", "successes", "useful", "mean_score",
        _ratio(F.col("skips"), F.col("attempts")).alias("skip_ratio"),
        _ratio(F.col("successes"), F.col("attempts")).alias("success_ratio"),
        _ratio(F.col("useful"), F.col("successes")).alias("useful_ratio"),
        _ratio(F.col("both"), run).alias("both_ratio"),
        ((run == F.col("engines")) & (run == F.col("results")) & (F.col("successes") == F.col("judged"))).alias("consistent"),
    )


def audio_statistics(chunks: DataFrame, session: str, order: str, rate: int = 16000) -> DataFrame:
    """Loudness, noise and silence of each session from its ``chunks`` (samples array<double>, speech array<boolean>).

    A chunk without a mark of speech counts as speech altogether; samples that are null or not finite are left
    out, and so are empty chunks. snr_db is null where the background's level is 1e-6 or less. ``silent_sec``: the chunks at
    the end that are without speech or where the level of speech so far is under 1e-4.
    """
    pairs = F.arrays_zip("samples", "speech")
    sound = lambda x: x["samples"].isNotNull() & ~F.isnan(x["samples"]) & (F.abs(x["samples"]) != float("inf"))
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["samples"] * x["samples"])
    c = chunks.select(session, order, F.filter(pairs, sound).alias("p")).where(F.size("p") > 0)
    c = c.withColumn("loud", F.filter("p", lambda x: F.coalesce(x["speech"], F.lit(False))))
    c = c.select(
        session, order, F.size("p").alias("n"), F.size(F.filter("p", lambda x: F.abs(x["samples"]) > 0.99)).alias("clipped"), energy(F.col("p")).alias("e"),
        F.when(F.size("loud") == 0, energy(F.col("p"))).otherwise(energy(F.col("loud"))).alias("se"), F.when(F.size("loud") == 0, F.size("p")).otherwise(F.size("loud")).alias("sn"),
    )
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("silent", F.sqrt(F.sum("se").over(so_far) / F.sum("sn").over(so_far)) < 1e-4)
    c = c.withColumn("heard", F.max(F.when(~F.col("silent"), F.col(order))).over(Window.partitionBy(session)))
    g = c.groupBy(session).agg(
        *(F.sum(x).alias(x) for x in ("n", "clipped", "se", "sn")),
        F.sum(F.col("n") - F.col("sn")).alias("bn"),
        F.sum(F.when(F.col("n") > F.col("sn"), F.col("e") - F.col("se")).otherwise(F.lit(0.0))).alias("be"),
        F.sum(F.when(F.col("heard").isNull() | (F.col(order) > F.col("heard")), F.col("n")).otherwise(F.lit(0))).alias("quiet"),
    )
    speech, back = F.sqrt(F.col("se") / F.col("sn")), F.sqrt(F.coalesce(F.try_divide(F.greatest("be", F.lit(0.0)), F.col("bn").cast("double")), F.lit(0.0)))
    snr = F.when((speech > 0) & (back > 1e-6), F.round(20 * F.log10(speech / back), 1))
    return g.select(
        session, F.round(speech, 4).alias("speech_rms"), F.round(back, 4).alias("background_rms"), snr.alias("snr_db"),
        F.round(F.col("clipped") / F.col("n"), 5).alias("clip_ratio"), F.round(F.col("sn") / rate, 1).alias("speech_sec"), F.round(F.col("quiet") / rate, 3).alias("silent_sec"),
    )


def mixed(streams: DataFrame, key: str, rate: int = 16000) -> DataFrame:
    """key, at, value: the sum of 16-bit ``streams`` (offset_ms, samples array<int>) at each place, clipped. Places without a stream are absent: silence.

    The sums are combined where the samples are read, so a recording of any length needs no task of its own.
    """
    start = F.floor(F.coalesce(F.col("offset_ms"), F.lit(0)) * rate / 1000).cast("long")
    placed = streams.select(key, start.alias("start"), F.posexplode("samples").alias("i", "x"))
    total = placed.groupBy(key, (F.col("start") + F.col("i")).alias("at")).agg(F.sum(F.coalesce(F.col("x").cast("long"), F.lit(0))).alias("value"))
    return total.withColumn("value", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.col("value"))))
