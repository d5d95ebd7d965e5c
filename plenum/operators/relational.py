"""Scoped reads, joins, aggregates and set operations over the entities: DataFrame expressions that Catalyst plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def same_or_null(column: str, value) -> Column:
    """``column = value``, or ``column is null`` if no value is given."""
    return F.col(column).eqNullSafe(F.lit(value))


def contains_any(term: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ in ``term`` are wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns])


def between_dates(column: str, low=None, high=None) -> Column:
    """A closed range whose ends may be missing."""
    return all_of(F.col(column) >= F.lit(low) if low is not None else None, F.col(column) <= F.lit(high) if high is not None else None)


def half_open(column: str, low, high) -> Column:
    return (F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high))


def passes(column: str, least: float) -> Column:
    """A gate that a missing value passes."""
    return F.coalesce(F.col(column) >= least, F.lit(True))


def unless_empty(rows: DataFrame, drop: Column, group: str) -> DataFrame:
    """Rows without those that ``drop`` marks; a group that would lose all its rows keeps them."""
    n = F.sum((~drop).cast("int")).over(Window.partitionBy(group))
    return rows.withColumn("_left", n).where(~drop | (F.col("_left") == 0)).drop("_left")


def in_order_of(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows whose key is in ``ids``, with ``pos``, the key's place there. ``ids`` come from the caller, as few as a query names."""
    order = F.create_map(*[F.lit(x) for pair in ((v, i) for i, v in enumerate(ids)) for x in pair])
    return rows.where(F.col(key).isin(ids)).withColumn("pos", order[F.col(key)])


def first_per(rows: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def latest_with_ties(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows of each key's latest time."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).where("_r = 1").drop("_r")


def resolve_names(asked: DataFrame, users: DataFrame) -> DataFrame:
    """``asked`` (name) with ``resolved``: the user of that name, else the only user whose name holds it, else the name itself.

    Partial matches need a comparison of every asked name with every user: ``asked`` should be small.
    """
    names = users.select(F.col("name").alias("user_name")).distinct()
    exact = names.select(F.col("user_name").alias("name"), F.lit(True).alias("exact"))
    want = asked.select("name").distinct().join(exact, "name", "left")
    part = want.where("exact is null").join(names, F.contains(F.lower("user_name"), F.lower("name")))
    part = part.groupBy("name").agg(F.min("user_name").alias("one"), F.count("*").alias("n")).where("n = 1")
    found = want.join(part, "name", "left").select("name", F.when(F.col("exact"), F.col("name")).otherwise(F.coalesce("one", "name")).alias("resolved"))
    return asked.join(found, "name")


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(F.sum(part.cast("double")), F.sum(whole.cast("double")))


def settled(total: Column, done: Column, failed: Column) -> Column:
    """The state of a folder from the counts of its files."""
    return F.when(done + failed < total, "analyzing").when(failed == total, "failed").when(failed > 0, "partial").otherwise("completed")


def upsert(old: DataFrame, new: DataFrame, key: str, supplied: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``: supplied columns are overwritten, with null too, the others stay."""
    n = new.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in supplied))
    both = old.join(n, key, "full")
    return both.select(key, *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns if c != key))


def replace_pairs(old: DataFrame, new: DataFrame, a: str, b: str) -> DataFrame:
    """Upserts undirected edges: each pair is kept once, the smaller end first."""
    canon = lambda d: d.withColumns({a: F.least(a, b), b: F.greatest(a, b)})
    return canon(old).join(canon(new), [a, b], "left_anti").unionByName(canon(new))


def soft_delete(rows: DataFrame, gone: DataFrame, key: str, at) -> DataFrame:
    """Marks the rows of the deleted keys, those that are marked already keep their time."""
    g = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(g, key, "left").withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), F.lit(at)).otherwise(F.col("deleted_at"))).drop("_gone")


def replace_set(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """The sets of the owners in ``new`` replace theirs in ``old``."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def relabel(rows: DataFrame, column: str, names: list[tuple[str, str]]) -> DataFrame:
    """Applies the renamings in order, so a chain a -> b, b -> c leads from a to c."""
    out = F.col(column)
    for old, new in names:
        out = F.when(out == old, F.lit(new)).otherwise(out)
    return rows.withColumn(column, out)


def chat_exchange(sessions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sessions (session_id, title, updated_at) and new messages (session_id, role, content, created_at) after the exchanges ``asked`` (session_id, question, answer, at).

    The answer comes a microsecond after its question. An empty title becomes the first 40 characters of the session's first question.
    """
    at = F.col("at").cast("timestamp")
    message = lambda role, text, late: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"), F.timestamp_micros(F.unix_micros(at) + late).alias("created_at"))
    rows = asked.select("session_id", F.explode(F.array(message("user", "question", 0), message("assistant", "answer", 1))).alias("m")).select("session_id", "m.*")
    first = asked.groupBy("session_id").agg(F.min_by("question", F.struct("at", "question")).alias("_q"), F.max("at").alias("_at"))
    s = sessions.join(first, "session_id", "left")
    title = F.when(F.coalesce("title", F.lit("")) == "", F.substring(F.btrim("_q"), 1, 40)).otherwise(F.col("title"))
    s = s.select("session_id", F.when(F.col("_q").isNull(), F.col("title")).otherwise(title).alias("title"), F.coalesce("_at", "updated_at").alias("updated_at"))
    return s, rows


def neighbours(edges: DataFrame, node) -> DataFrame:
    """other, strength of the ``edges`` (a, b, strength) of a node, strongest first."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    near = edges.where((F.col("a") == node) | (F.col("b") == node)).select(ends.alias("e"), "strength")
    return near.where(F.col("e.node") == node).select("e.other", "strength").orderBy(F.desc("strength"), "other")


def bundle(rows: DataFrame, parts: dict[str, tuple[DataFrame, list[str], list[str]]], key: str) -> DataFrame:
    """``rows`` with an array of structs for each part: (its rows, the order, the fields). A key's parts are one row, as they make one document."""
    for name, (part, order, fields) in parts.items():
        item = F.struct(F.struct(*(F.col(c) for c in order)).alias("o") if order else F.lit(0).alias("o"), F.struct(*fields).alias("x"))
        own = part.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name)).select(key, F.transform(name, lambda e: e["x"]).alias(name))
        rows = rows.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return rows
