"""Registers queries, each with the SQL that gives the same rows, and maps the driver's tables to the engine's entities.

An entity is a list of expressions over one table, in the dialect that Spark and DuckDB share, so a query and
its SQL start from the same columns. Nothing else is shared between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ENTITIES: dict[str, tuple[str, list[str]]] = {
    "users": ("customer", ["c_custkey as user_id", "c_name as name", "lower(c_name) as email", "c_nationkey as workspace_id", "c_acctbal < 0 as deleted", "c_mktsegment as team"]),
    "workspaces": ("nation", ["n_nationkey as workspace_id", "n_name as name", "n_regionkey as region_id"]),
    "members": ("customer", ["c_nationkey as workspace_id", "c_custkey as user_id", "case when c_custkey % 50 = 0 then 'owner' else 'member' end as role", "c_acctbal < 0 as removed"]),
    "meetings": (
        "orders",
        [
            "o_orderkey as meeting_id", "o_custkey as starter_id", "o_custkey % 25 as workspace_id", "o_orderpriority as category",
            "case o_orderstatus when 'F' then 'completed' when 'O' then 'scheduled' else 'recording' end as status",
            "case when o_orderstatus <> 'O' then o_orderdate end as started_at", "o_orderdate as scheduled_at",
            "cast(floor(o_totalprice) as bigint) as duration_ms", "cast(floor(o_totalprice) as bigint) % 100000 * 2 as paused_ms",
            "concat('Meeting ', o_orderpriority, ' ', cast(o_orderkey as string)) as title",
        ],
    ),
    "decisions": (
        "lineitem",
        [
            "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as decision_id",
            "l_orderkey as meeting_id", "l_partkey as topic_id", "l_suppkey as author_id", "l_linenumber as line",
            "case when l_linestatus = 'O' then 'pending' when l_returnflag = 'R' then 'superseded' else 'active' end as status",
            "l_shipdate as decided_at", "l_discount * 10 as score", "l_tax > 0.04 as reasoned", "cast(l_quantity as bigint) as weight",
        ],
    ),
    "attendees": ("lineitem", ["l_orderkey as meeting_id", "l_suppkey as user_id", "l_linenumber = 1 as is_initial"]),
    "files": (
        "part",
        [
            "p_partkey as file_id", "p_name as filename", "p_brand as folder", "p_type as kind", "p_size as size", "p_size > 10 as rag_enabled",
            "case p_partkey % 4 when 0 then 'failed' when 1 then 'pending' else 'completed' end as status", "p_partkey % 3 = 0 as is_latest", "p_size % 7 = 0 as deleted",
        ],
    ),
    "segments": (
        "conversations",
        ["conv_id as meeting_id", "turn as segment_index", "role as speaker", "text", "turn * 5000 as start_ms", "turn * 5000 + 500 + coalesce(length(text), 0) * 20 as end_ms"],
    ),
    "chunks": ("documents", ["doc_id as chunk_id", "lang as collection", "source as workspace", "text", "n_chars"]),
    "vectors": ("embeddings", ["vec_id", "embedding", "label"]),
    "recordings": ("embeddings", ["label as session", "vec_id as seq", "embedding as samples"]),
    "ocr_attempts": (
        "events",
        [
            "user_id % 50 as workspace_id", "case event_id % 7 when 0 then 'skip' when 1 then 'empty' when 2 then 'filtered' else 'success' end as outcome",
            "case when event_id % 7 = 0 then null when event_id % 3 = 0 then 'first' when event_id % 3 = 1 then 'both' else 'cells' end as engine", "round(value / 100, 4) as score",
        ],
    ),
    "marks": ("labels", ["doc_id as chunk_id", "quality", "toxic"]),
    "questions": ("benchmark", ["item_id as question_id", "text"]),
    "web": ("pages", ["page_id", "url", "html"]),
    "activity": ("events", ["event_id", "ts", "user_id as session_id", "event_type as kind", "value", "props"]),
    "judgements": (
        "events",
        [
            "event_id", "ts", "user_id as session_id", "event_id % 40 as decision_id", "value > 5 as same_topic", "value > 20 as presents_new", "value < 60 as same_as_existing",
            "event_id % 3 = 0 as reasoned", "case when event_id % 11 = 0 then null else round(value / 500, 4) end as confidence",
        ],
    ),
}


class Tables:
    """The entities of one folder of tables; ``raw`` gives a table as it is."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def columns(self, entity: str) -> tuple[str, list[str]]:
        """An entity's table and expressions."""
        return ENTITIES[entity]

    def __call__(self, entity: str) -> DataFrame:
        table, columns = ENTITIES[entity]
        return self.raw(table).selectExpr(*columns)


def _expand(sql: str) -> str:
    """Puts an entity's columns where SQL says {entity}; quotes a column name that DuckDB reserves."""
    sql = re.sub(r'(?<!")\bat\b(?!")', '"at"', sql)
    return re.sub(rf"\{{({'|'.join(ENTITIES)})\}}", lambda m: f"(select {', '.join(ENTITIES[m[1]][1])} from {ENTITIES[m[1]][0]})", sql)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = _expand(sql)
        return f

    return put
