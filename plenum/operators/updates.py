"""State changes of records as column expressions: conditional transitions, revocations, counters, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_and_set(rows: DataFrame, column: str, expected: str, new: str) -> DataFrame:
    """``rows`` whose ``column`` goes from ``expected`` to ``new``, with ``changed``; any other value, null too, stays."""
    hit = F.coalesce(F.col(column) == expected, F.lit(False))
    return rows.withColumn("changed", hit).withColumn(column, F.when(F.col("changed"), F.lit(new)).otherwise(F.col(column)))


def net_duration(total: Column, paused: Column) -> Column:
    """Time without pauses, at least 0."""
    return F.greatest(F.lit(0).cast("long"), total - F.coalesce(paused, F.lit(0)))


def confidence(log_probability: Column, confident: Column) -> Column:
    """The probability of a transcript, to four places; without one 1 for a confident segment, else a half."""
    return F.coalesce(F.round(F.exp(log_probability), 4), F.when(confident, 1.0).otherwise(0.5))


def revoked(state: Column, mine: Column) -> Column:
    """The state of tokens after all live ones (without a state) of a user are revoked."""
    return F.coalesce(state, F.when(mine, "revoked"))


def reopened(status: Column, closed: str, opened: str) -> Column:
    return F.when(status == closed, opened).otherwise(status)


def completed_at(done: Column, had: Column, now: Column) -> Column:
    """The time at which a task was done: set when it is, else what it had."""
    return F.when(done, now).otherwise(had)


def retried(tries: Column, failed: Column) -> Column:
    """One more try for what failed."""
    return tries + failed.cast("int")


def detached(folder: Column, gone: list[str]) -> Column:
    """Null for files of a folder record that is deleted."""
    return F.when(~folder.isin(gone), folder)


def attached_score(score: Column, rerank: Column) -> Column:
    """The reranker's score where there is one."""
    return F.coalesce(rerank, score)


def with_bonus(score: Column, bonus: Column, where: Column) -> Column:
    """``score`` with ``bonus`` for the rows of one collection."""
    return score + F.when(where, bonus).otherwise(F.lit(0.0))


def low_confidence(score: str, least: float = 0.4) -> Column:
    """Aggregate: whether the best score stays under ``least``."""
    return F.max(score) < least
