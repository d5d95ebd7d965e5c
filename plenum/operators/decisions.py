"""Decision rules: case cascade, suppression of repeats, cooldown, priorities, chains, versions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.shared import written

#: Popups from the most to the least urgent; a case that is not listed is dropped.
PRIORITY = ("3", "2", "document", "0", "recommendation")


def case_of(same_topic: Column, presents_new: Column, same_as_existing: Column, reasoned: Column) -> Column:
    """none: another topic; 0: no new value; 1: the existing value again; 2 or 3: a change without or with a reason."""
    return F.when(~F.coalesce(same_topic, F.lit(False)), "none").when(~presents_new, "0").when(same_as_existing, "1").when(reasoned, "3").otherwise("2")


def most_urgent(rows: DataFrame, keys: list[str], case: str, tie: str, ranks=PRIORITY) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(case))
    w = Window.partitionBy(*keys).orderBy("_rank", tie)
    return rows.withColumn("_rank", rank).where("_rank > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_rank", "_n")


def once(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def alerts(rows: DataFrame, keys: list[str], reasoned: str, *order: str) -> DataFrame:
    """``rows`` with ``shown``: a reasoned alert silences all later ones; an unreasoned one shows once, before any reasoned one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    after_reason = F.coalesce(F.max(F.col(reasoned).cast("int")).over(past), F.lit(0)) == 1
    first = F.row_number().over(w) == 1
    return rows.withColumn("shown", ~after_reason & (F.col(reasoned) | first))


def cooled_down(rows: DataFrame, keys: list[str], at: str, tie: str, seconds: int) -> DataFrame:
    """keys, tie, accepted: a row is accepted if ``seconds`` have passed since the last accepted one of its key.

    The pause starts anew at each accepted row, which no window frame can say: each key's ordered rows are walked in
    Arrow batches, and only the last accepted time is kept, so a key of any length streams through its task. A row without
    a time is not accepted.
    """
    kinds = dict(rows.dtypes)
    d = rows.select(*keys, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    ordered = d.repartition(*keys).sortWithinPartitions(*keys, "_t", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0
        for batch in batches:
            ok = []
            for *key, _, t in zip(*(c.to_pylist() for c in batch.columns)):
                hit = t is not None and (key != last_key or t >= last + seconds * 1_000_000)
                last, last_key = t if hit else last if key == last_key else -1 << 62, key
                ok.append(hit)
            yield pa.record_batch([*batch.columns[:-1], pa.array(ok, pa.bool_())], [*keys, tie, "accepted"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, tie])
    return ordered.mapInArrow(run, f"{schema}, accepted boolean")


def transition(topics: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """What a topic (key, status) does to the decisions: insert, activate, pend or skip. ``existing`` (key, state)."""
    d = topics.join(existing, key, "left")
    act = F.when((F.col("status") == "agreed") & (F.col("state").isNull()), "insert").when((F.col("status") == "agreed") & (F.col("state") == "pending"), "activate")
    return d.withColumn("action", act.when((F.col("status") == "open") & F.col("state").isNull(), "pend").otherwise("skip"))


def chains(links: DataFrame) -> DataFrame:
    """newest, id, steps: from each newest row back along ``previous`` to its end. ``links`` (id, previous); an id of any type.

    By pointer doubling: after k rounds a walk has its first 2^k rows, and a jump leads 2^k rows back. Tables between rounds
    lie in the shared folder. A walk that runs into a circle has no end and raises an error.
    """
    rows = written(links.where("id is not null").select("id", "previous"), "chain_links")
    jump = rows.join(rows.select(F.col("id").alias("previous")).distinct(), "previous", "left_semi").select("id", "previous")
    older = rows.select(F.col("previous").alias("id")).where("id is not null")
    walk = rows.join(older, "id", "left_anti").select(F.col("id").alias("newest"), "id", F.lit(0).alias("steps"))
    walk, most, reach = written(walk, "chain_walk"), rows.count(), 1
    while True:
        more = written(walk.join(jump, "id").select("newest", F.col("previous").alias("id"), (F.col("steps") + reach).alias("steps")), "chain_walk")
        if more.isEmpty():
            return walk.select("newest", "id", "steps")
        if reach >= most:
            raise ValueError("the links of a chain run in a circle")
        walk = written(walk.unionByName(more), "chain_walk")
        then = jump.select(F.col("id").alias("previous"), F.col("previous").alias("last"))
        jump, reach = written(jump.join(then, "previous").select("id", F.col("last").alias("previous")), "chain_jump"), 2 * reach


def resolved(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` (decision_id, meeting_id, title, text, reason, status, previous) after the ``conflicts`` (conflict_id, decision_id, meeting_id, resolution, text, reason) are resolved.

    A change that is acknowledged supersedes the active decision it is about; a new active one, named after the conflict, takes
    its title and points back to it. Other conflicts change no decision. Of several changes of one decision that of the smallest conflict counts.
    """
    c = conflicts.where("resolution = 'change_acknowledged' and decision_id is not null")
    c = c.groupBy("decision_id").agg(F.min_by(F.struct("conflict_id", F.col("meeting_id").alias("held"), F.col("text").alias("said"), F.col("reason").alias("why")), "conflict_id").alias("c"))
    d = decisions.join(c, "decision_id", "left").withColumn("hit", F.col("c").isNotNull() & (F.col("status") == "active"))
    old = d.withColumn("status", F.when(F.col("hit"), "superseded").otherwise(F.col("status"))).select(*decisions.columns)
    new = d.where("hit").select(
        F.concat(F.lit("conflict-"), F.col("c.conflict_id").cast("string")).alias("decision_id"),
        F.coalesce("c.held", "meeting_id").alias("meeting_id"),
        "title",
        F.col("c.said").alias("text"),
        F.col("c.why").alias("reason"),
        F.lit("active").alias("status"),
        F.col("decision_id").alias("previous"),
    )
    return old.unionByName(new.select(*decisions.columns))


def versions(files: DataFrame, group: list[str], *order: str) -> DataFrame:
    """``files`` with version_no from 1 and is_newest; one file of a group is the newest."""
    w = Window.partitionBy(*group).orderBy(*order)
    return files.withColumns({"version_no": F.row_number().over(w), "is_newest": F.lead(F.lit(1)).over(w).isNull()})
