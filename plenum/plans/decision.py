"""Queries of decision rules and of the batch twins of the streaming rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import decisions as D
from plenum.operators import relational as R
from plenum.operators import updates as U
from plenum.shared import shared_folder

from .registry import query

CASES = "(select *, case when not same_topic then 'none' when not presents_new then '0' when same_as_existing then '1' when reasoned then '3' else '2' end as kase from {judgements})"


def _cases(t):
    return t("judgements").withColumn("kase", D.case_of(F.col("same_topic"), F.col("presents_new"), F.col("same_as_existing"), F.col("reasoned")))


@query("d1_cases", f"select event_id, kase from {CASES}")
def _(t):
    return _cases(t).select("event_id", "kase")


@query("d2_most_urgent", f"select session_id, event_id, kase from (select *, row_number() over (partition by session_id order by case kase when '3' then 1 when '2' then 2 else 4 end, event_id) as n from {CASES} where kase in ('3', '2', '0')) where n = 1")
def _(t):
    return D.most_urgent(_cases(t), ["session_id"], "kase", "event_id").select("session_id", "event_id", "kase")


@query("d3_once", f"select session_id, decision_id, event_id from (select *, row_number() over (partition by session_id, decision_id order by ts, event_id) as n from {CASES} where kase = '1') where n = 1")
def _(t):
    return D.once(_cases(t).where("kase = '1'"), ["session_id", "decision_id"], "ts", "event_id").select("session_id", "decision_id", "event_id")


@query(
    "d4_alerts",
    f"""select event_id, coalesce(max(reasoned::int) over (partition by session_id, decision_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 0
 and (reasoned or row_number() over (partition by session_id, decision_id order by ts, event_id) = 1) as shown from {CASES} where kase in ('2', '3')""",
)
def _(t):
    return D.alerts(_cases(t).where("kase in ('2', '3')"), ["session_id", "decision_id"], "reasoned", "ts", "event_id").select("event_id", "shown")


@query(
    "d5_cooldown",
    """with recursive n as (select session_id, event_id, epoch_us(ts) as t, row_number() over (partition by session_id order by ts, event_id) as i from {judgements}),
w as (select session_id, event_id, i, t as last, true as accepted from n where i = 1 union all
 select n.session_id, n.event_id, n.i, case when n.t >= w.last + 86400000000 then n.t else w.last end, n.t >= w.last + 86400000000 from w join n on n.session_id = w.session_id and n.i = w.i + 1)
select session_id, event_id, accepted from w""",
)
def _(t):
    return D.cooled_down(t("judgements"), ["session_id"], "ts", "event_id", 86_400)


@query("d6_dedup_key", "select event_id, sha256(concat_ws(':', session_id, decision_id, event_id)) as key from {judgements}")
def _(t):
    return t("judgements").select("event_id", F.sha2(F.concat_ws(":", F.col("session_id").cast("string"), F.col("decision_id").cast("string"), F.col("event_id").cast("string")), 256).alias("key"))


@query("d7_most_confident", "select session_id, event_id from (select *, row_number() over (partition by session_id order by confidence desc, event_id) as n from {judgements} where confidence >= 0.2) where n = 1")
def _(t):
    g = t("judgements").where("confidence >= 0.2").groupBy("session_id").agg(F.max_by("event_id", F.struct("confidence", -F.col("event_id"))).alias("event_id"))
    return g


@query(
    "d8_transition",
    """with topics as (select topic_id, case topic_id % 3 when 0 then 'agreed' when 1 then 'open' else 'dropped' end as status from (select distinct topic_id from {decisions})), had as (select topic_id, max(status) as state from {decisions} where author_id < 20 and status <> 'superseded' group by topic_id)
select t.topic_id, case when t.status = 'agreed' and state is null then 'insert' when t.status = 'agreed' and state = 'pending' then 'activate' when t.status = 'open' and state is null then 'pend' else 'skip' end as action from topics t left join had using (topic_id)""",
)
def _(t):
    status = F.when(F.col("topic_id") % 3 == 0, "agreed").when(F.col("topic_id") % 3 == 1, "open").otherwise("dropped")
    topics = t("decisions").select("topic_id").distinct().withColumn("status", status)
    had = t("decisions").where("author_id < 20 and status <> 'superseded'").groupBy("topic_id").agg(F.max("status").alias("state"))
    return D.transition(topics, had, "topic_id").select("topic_id", "action")


@query(
    "d9_chains",
    """with recursive l as (select meeting_id * 100 + segment_index as id, case when segment_index > 0 then meeting_id * 100 + segment_index - 1 end as previous from {segments}),
w as (select id, previous, id as newest, 0 as steps from l where id not in (select previous from l where previous is not null) union all select l.id, l.previous, w.newest, w.steps + 1 from w join l on l.id = w.previous) select newest, id, steps from w""",
)
def _(t):
    # Links are keyed by both columns; the number that the SQL makes of them is unique only below 100 turns.
    key = lambda turn: F.struct(F.col("meeting_id").alias("meeting_id"), turn.alias("segment_index"))
    i = F.col("segment_index")
    found = D.chains(t("segments").select(key(i).alias("id"), F.when(i > 0, key(i - 1)).alias("previous")))
    number = lambda c: (F.col(f"{c}.meeting_id") * 100 + F.col(f"{c}.segment_index")).alias(c)
    return found.select(number("newest"), number("id"), "steps")


@query(
    "d10_resolve",
    """with c as (select decision_id, min(event_id) as conflict_id from (select event_id, session_id, event_id % 4 as k, 'x' as x from {judgements}) j join (select decision_id, row_number() over (order by decision_id) as r from {decisions}) d on d.r = j.event_id % 2000 where k in (1, 2) group by decision_id),
h as (select d.*, c.conflict_id from {decisions} d left join c using (decision_id))
select decision_id, meeting_id, 'topic ' || topic_id as title, case when status = 'active' and conflict_id is not null then 'superseded' else status end as status, null as text, null as previous from h
union all select 'conflict-' || conflict_id, coalesce(case when conflict_id % 3 > 0 then conflict_id % 150 end, meeting_id), 'topic ' || topic_id, 'active', 'said ' || conflict_id, decision_id from h where status = 'active' and conflict_id is not null""",
)
def _(t):
    from plenum.operators.windows import numbered

    null = F.lit(None).cast("string")
    d = t("decisions").select("decision_id", "meeting_id", F.concat(F.lit("topic "), F.col("topic_id").cast("string")).alias("title"), null.alias("text"), null.alias("reason"), "status", null.alias("previous"))
    # The places of decisions by id tie each conflict to one; conflicts name places below 2,000 only, so these are all that are numbered.
    first = d.select("decision_id").orderBy("decision_id").limit(2000)
    places = numbered(first.withColumn("all", F.lit(0)), ["all"], F.col("decision_id"), name="r")
    e = F.col("event_id")
    conflicts = t("judgements").select(e.alias("conflict_id"), (e % 2000).alias("r"), F.when(e % 3 > 0, e % 150).alias("meeting_id"), F.when((e % 4).isin(1, 2), "change_acknowledged").otherwise("keep_reference").alias("resolution"), F.concat(F.lit("said "), e.cast("string")).alias("text"), null.alias("reason"))
    conflicts = conflicts.join(places.select("decision_id", "r"), "r", "left")
    return D.resolved(conflicts, d).select("decision_id", "meeting_id", "title", "status", "text", "previous")


@query("d11_versions", "select file_id, row_number() over w as version_no, row_number() over (partition by folder, filename order by file_id desc) = 1 as is_newest from {files} window w as (partition by folder, filename order by file_id)")
def _(t):
    return D.versions(t("files").select("file_id", "folder", "filename"), ["folder", "filename"], "file_id").select("file_id", "version_no", "is_newest")


@query("d12_compare_and_set", "select meeting_id, case when status = 'recording' then 'processing' else status end as status, status = 'recording' as changed from {meetings}")
def _(t):
    return U.compare_and_set(t("meetings"), "status", "recording", "processing").select("meeting_id", "status", "changed")


@query("d13_duration", "select meeting_id, greatest(0, duration_ms - paused_ms) as net_ms from {meetings}")
def _(t):
    return t("meetings").select("meeting_id", U.net_duration(F.col("duration_ms"), F.col("paused_ms")).alias("net_ms"))


@query("d14_confidence", "select event_id, round(coalesce(round(exp(-confidence), 4), case when reasoned then 1.0 else 0.5 end), 4) as confidence from {judgements}")
def _(t):
    return t("judgements").select("event_id", U.confidence(-F.col("confidence"), F.col("reasoned")).alias("confidence"))


@query("d15_relabel", "select meeting_id, segment_index, coalesce(case speaker when 'user' then 'S1' end, speaker) as speaker from {segments}")
def _(t):
    names = t.spark.createDataFrame([("user", "S1")], "speaker string, name string")
    # A meeting's own few names.
    return t("segments").join(F.broadcast(names), "speaker", "left").select("meeting_id", "segment_index", F.coalesce("name", "speaker").alias("speaker"))


@query(
    "x4_unknown_ratio",
    """select session_id, min(n) as at from (select session_id, row_number() over w as n, sum((event_type = 'error')::int) over w as unknown from (select user_id as session_id, event_type, ts, event_id from events) window w as (partition by session_id order by ts, event_id rows unbounded preceding))
where n >= 3 and unknown >= 0.6 * n group by session_id""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    d = t("activity").withColumns({"n": F.count("*").over(w), "unknown": F.sum((F.col("kind") == "error").cast("int")).over(w)})
    return d.where("n >= 3 and unknown >= 0.6 * n").groupBy("session_id").agg(F.min("n").alias("at"))


@query("x9_remote_duplicates", "select event_id from {activity} where not (kind = 'view' and session_id % 2 = 0)")
def _(t):
    return t("activity").where("not (kind = 'view' and session_id % 2 = 0)").select("event_id")


@query("rules_order", "select count(*) as broken from {segments} where not coalesce(end_ms > start_ms, true)")
def _(t):
    return t("segments").where(~F.coalesce(F.col("end_ms") > F.col("start_ms"), F.lit(True))).agg(F.count("*").alias("broken"))


@query("rules_unique", "select meeting_id, user_id, count(*) as n from {attendees} group by all having count(*) > 1")
def _(t):
    return t("attendees").groupBy("meeting_id", "user_id").agg(F.count("*").alias("n")).where("n > 1")


@query("rules_live_unique", "select email from {users} where not deleted group by email having count(*) > 1")
def _(t):
    return t("users").where(R.all_of(~F.col("deleted"))).groupBy("email").agg(F.count("*").alias("n")).where("n > 1").select("email")


@query(
    "m15_versions",
    """with v0 as (select meeting_id, status, duration_ms from {meetings}),
v1 as (select meeting_id, case when status = 'recording' then 'processing' else status end as status, duration_ms from v0),
v2 as (select * from v1 where meeting_id not in (select meeting_id from {meetings} where category = '1-URGENT' and status = 'scheduled')),
v3 as (select meeting_id, case when meeting_id % 5 = 0 then 'archived' else status end as status, case when meeting_id % 5 = 0 then 0 else duration_ms end as duration_ms from v2 union all select -1, 'archived', 0),
every as (select 0 as version, * from v0 union all select 1, * from v1 union all select 2, * from v2 union all select 3, * from v3)
select version, status, count(*) as n, sum(duration_ms)::bigint as total_ms from every group by version, status""",
)
def _(t):
    from plenum.operators.snapshots import VersionedTable

    meetings = t("meetings").select("meeting_id", "status", "duration_ms", "category")
    table = VersionedTable(t.spark, shared_folder(t.spark, "meetings"), ["meeting_id"], buckets=16)
    table.create(meetings.drop("category"))
    table.update("status = 'recording'", {"status": F.lit("processing")})
    table.delete(meetings.where("category = '1-URGENT' and status = 'scheduled'").select("meeting_id"))
    archived = table.read().where("meeting_id % 5 = 0").select("meeting_id", F.lit("archived").alias("status"), F.lit(0).cast("long").alias("duration_ms"))
    table.upsert(archived.unionByName(t.spark.createDataFrame([(-1, "archived", 0)], archived.schema)))
    every = None
    for version in range(table.version() + 1):
        one = table.read(version).groupBy("status").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms")).select(F.lit(version).alias("version"), "status", "n", "total_ms")
        every = one if every is None else every.unionByName(one)
    return every
