"""Queries of the relational operators: filters, joins, aggregates, order, sets, writes, list reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import relational as R
from plenum.operators import updates as U

from .registry import query

TS = "timestamp '1998-01-01 00:00:00'"


@query("io1_scoped_scan", "select meeting_id, title from {meetings} where workspace_id = 3 and status = 'completed'")
def _(t):
    return t("meetings").where("workspace_id = 3 and status = 'completed'").select("meeting_id", "title")


@query("io3_collections_get", "select chunk_id, collection from {chunks} where workspace = 'src1' and collection in ('en', 'fr', 'de')")
def _(t):
    return t("chunks").where((F.col("workspace") == "src1") & F.col("collection").isin("en", "fr", "de")).select("chunk_id", "collection")


@query("io4_insert_defaults", "select chunk_id, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic from {chunks} left join {marks} using (chunk_id)")
def _(t):
    return t("chunks").join(t("marks"), "chunk_id", "left").select("chunk_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("io5_delete_document", "select chunk_id from {chunks} where chunk_id not in (select chunk_id from {marks} where toxic = 1)")
def _(t):
    return t("chunks").join(t("marks").where("toxic = 1"), "chunk_id", "left_anti").select("chunk_id")


@query(
    "io8_document_kind",
    """select folder, case when avg((size <= 10)::int) >= 0.7 then 'scanned' when avg((size > 10)::int) >= 0.7 then 'digital' else 'mixed' end as kind from {files} group by folder""",
)
def _(t):
    from plenum.sources.readers import page_kind

    return page_kind(t("files").withColumn("chars", F.col("size") * 5), "folder", "chars")


@query("io10_content_hash", "select chunk_id, sha256(text) as sha256 from {chunks} where text is not null")
def _(t):
    return t("chunks").where("text is not null").select("chunk_id", F.sha2("text", 256).alias("sha256"))


@query(
    "io11_file_kind",
    """select page_id, case when regexp_extract(url, '\\.([a-z]+)$', 1) in ('com', 'net') then 'site' when regexp_extract(url, '\\.([a-z]+)$', 1) = 'pdf' then 'document' else 'code' end as kind from {web}""".replace("\\\\", "\\"),
)
def _(t):
    from plenum.sources.readers import kind_of

    return t("web").select("page_id", kind_of("url", {"site": ["com", "net"], "document": ["pdf"]}).alias("kind"))


@query("f1_where_builder", "select meeting_id from {meetings} where category = '1-URGENT' and status = 'completed'")
def _(t):
    return t("meetings").where(R.all_of(F.col("category") == "1-URGENT", None, F.col("status") == "completed")).select("meeting_id")


@query("f2_in_list", "select file_id from {files} where file_id in (1, 5, 9, 77)")
def _(t):
    return t("files").where(F.col("file_id").isin(1, 5, 9, 77)).select("file_id")


@query(
    "f3_text_search",
    """select m.meeting_id from {meetings} m left join {users} u on m.starter_id = u.user_id
where m.title ilike '%urgent 12%' or m.category ilike '%urgent 12%' or u.name ilike '%urgent 12%'""",
)
def _(t):
    m, u = t("meetings"), t("users").select(F.col("user_id").alias("starter_id"), "name")
    return m.join(u, "starter_id", "left").where(R.contains_any("urgent 12", "title", "category", "name")).select("meeting_id")


@query("f4_date_range", "select meeting_id from {meetings} where started_at >= timestamp '1997-01-01' and started_at <= timestamp '1997-06-30'")
def _(t):
    return t("meetings").where(R.between_dates("started_at", F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1997-06-30 00:00:00")))).select("meeting_id")


@query("f5_window_count", "select count(*) as n from {activity} where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'")
def _(t):
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    return t("activity").where(R.half_open("ts", at("2024-01-05 00:00:00"), at("2024-01-12 00:00:00"))).agg(F.count("*").alias("n"))


@query("f6_upcoming", "select meeting_id from {meetings} where scheduled_at > timestamp '1998-01-01' and scheduled_at <= timestamp '1998-01-01' + interval 30 day and status = 'scheduled'")
def _(t):
    now = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    return t("meetings").where((F.col("scheduled_at") > now) & (F.col("scheduled_at") <= now + F.expr("interval 30 days")) & (F.col("status") == "scheduled")).select("meeting_id")


@query("f7_status_sets", "select file_id from {files} where status in ('completed', 'pending') and kind not in ('ECONOMY', 'PROMO')")
def _(t):
    return t("files").where(F.col("status").isin("completed", "pending") & ~F.col("kind").isin("ECONOMY", "PROMO")).select("file_id")


@query("f8_null_aware", "select meeting_id from {meetings} where started_at is null and status = 'scheduled' and category = '5-LOW'")
def _(t):
    return t("meetings").where(R.same_or_null("started_at", None) & R.same_or_null("category", "5-LOW") & (F.col("status") == "scheduled")).select("meeting_id")


@query("f9_rag_files", "select file_id from {files} where rag_enabled and is_latest and status = 'completed' and not deleted")
def _(t):
    return t("files").where("rag_enabled and is_latest and status = 'completed' and not deleted").select("file_id")


@query("f10_graph_files", "select file_id from {files} where is_latest and not deleted and kind not in ('SMALL')")
def _(t):
    return t("files").where("is_latest and not deleted and kind not in ('SMALL')").select("file_id")


@query("f11_relevance_cut", "select decision_id from {decisions} where coalesce(score, 0) >= 0.4")
def _(t):
    return t("decisions").where(F.coalesce("score", F.lit(0.0)) >= 0.4).select("decision_id")


@query("f12_confidence_gate", "select event_id from {judgements} where coalesce(confidence >= 0.3, true)")
def _(t):
    return t("judgements").where(R.passes("confidence", 0.3)).select("event_id")


@query("f13_skip_low", "select event_id, coalesce(confidence < 0.6, false) as skipped from {judgements}")
def _(t):
    return t("judgements").select("event_id", (~R.passes("confidence", 0.6)).alias("skipped"))


@query(
    "f14_drop_chitchat",
    """select meeting_id, segment_index from (select *, sum((length(text) >= 60)::int) over (partition by meeting_id) as left_over from {segments}) where length(text) >= 60 or left_over = 0""",
)
def _(t):
    return R.unless_empty(t("segments"), F.length("text") < 60, "meeting_id").select("meeting_id", "segment_index")


@query("f15_fact_lookup", "select file_id, size from {files} where kind = 'ECONOMY' and folder = 'Brand#2' and status = 'completed'")
def _(t):
    return t("files").where("kind = 'ECONOMY' and folder = 'Brand#2' and status = 'completed'").select("file_id", "size")


@query("f16_preferences", "select event_id, case when json_extract_string(props, '$.k') is not null then json_extract_string(props, '$.k') else 'on' end as k, 'on' as mention from {activity}")
def _(t):
    from plenum.functions.scalars import overlay

    merged = overlay({"k": "on", "mention": "on"}, F.from_json("props", "map<string,string>"))
    return t("activity").select("event_id", merged["k"].alias("k"), merged["mention"].alias("mention"))


@query(
    "f17_quality_gate",
    """select chunk_id, case when length(s) < 60 then 'too_short' when special > 0.15 then 'high_special' when n_lines >= 3 and top > 0.4 then 'repeated_lines' else 'ok' end as reason from (
 select chunk_id, s, length(regexp_replace(s, '[A-Za-z0-9À-ÿ\\s]', '', 'g')) * 1.0 / greatest(length(s), 1) as special, n_lines, top from (
  select chunk_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as s, len(ls) as n_lines, list_max(map_values(list_histogram(ls))) * 1.0 / greatest(len(ls), 1) as top from (
   select chunk_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as ls from {chunks} where text is not null)))""".replace("\\\\", "\\"),
)
def _(t):
    from plenum.functions.scores import gate

    return t("chunks").where("text is not null").select("chunk_id", gate("text", least_chars=60, most_special=0.15, most_lines=0.4).alias("reason"))


@query("j1_pending_decisions", "select d.decision_id, d.decided_at from {decisions} d join {meetings} m using (meeting_id) where d.status = 'pending' and m.category = '1-URGENT' order by d.decided_at desc, d.decision_id")
def _(t):
    d, m = t("decisions").where("status = 'pending'"), t("meetings").where("category = '1-URGENT'").select("meeting_id")
    return d.join(m, "meeting_id").select("decision_id", "decided_at").orderBy(F.desc("decided_at"), "decision_id")


@query("j2_candidate_order", "select m.meeting_id, c.pos from {meetings} m join (values (77, 0), (3, 1), (512, 2), (40, 3)) c(id, pos) on m.meeting_id = c.id")
def _(t):
    return R.in_order_of(t("meetings"), "meeting_id", [77, 3, 512, 40]).select("meeting_id", "pos").orderBy("pos")


@query("j3_attendee_users", "select distinct a.meeting_id, u.name from {attendees} a join {users} u using (user_id)")
def _(t):
    return t("attendees").join(t("users"), "user_id").select("meeting_id", "name").distinct()


@query("j4_meeting_summaries", "select m.meeting_id, s.text as summary from {meetings} m left join (select meeting_id, text from {segments} where segment_index = 0) s using (meeting_id)")
def _(t):
    s = t("segments").where("segment_index = 0").select("meeting_id", F.col("text").alias("summary"))
    return t("meetings").select("meeting_id").join(s, "meeting_id", "left")


@query("j5_or_across_left", "select count(*) as n from {judgements} j left join {users} u on j.decision_id = u.user_id where j.session_id = 7 or u.workspace_id = 7")
def _(t):
    u = t("users").select(F.col("user_id").alias("decision_id"), "workspace_id")
    return t("judgements").join(u, "decision_id", "left").where("session_id = 7 or workspace_id = 7").agg(F.count("*").alias("n"))


LATEST = "select decision_id, topic_id, decided_at from (select *, rank() over (partition by topic_id order by decided_at desc) as r from {decisions}) where r = 1"


@query("j6_latest_per_key", LATEST)
def _(t):
    return R.latest_with_ties(t("decisions"), ["topic_id"], "decided_at").select("decision_id", "topic_id", "decided_at")


@query("w1_latest_status", "select topic_id, max(decided_at) as decided_at, count(*) as n from (" + LATEST + ") group by topic_id")
def _(t):
    return R.latest_with_ties(t("decisions"), ["topic_id"], "decided_at").groupBy("topic_id").agg(F.max("decided_at").alias("decided_at"), F.count("*").alias("n"))


@query("j7_source_titles", "select d.decision_id, coalesce(f.filename, m.title) as title from {decisions} d left join {files} f on d.topic_id = f.file_id and f.is_latest left join {meetings} m on d.meeting_id = m.meeting_id")
def _(t):
    f = t("files").where("is_latest").select(F.col("file_id").alias("topic_id"), "filename")
    return t("decisions").join(f, "topic_id", "left").join(t("meetings").select("meeting_id", "title"), "meeting_id", "left").select("decision_id", F.coalesce("filename", "title").alias("title"))


@query("j8_messages_of_sessions", "select s.meeting_id, s.segment_index from {segments} s join {meetings} m using (meeting_id) where m.status = 'completed'")
def _(t):
    return t("segments").join(t("meetings").where("status = 'completed'").select("meeting_id"), "meeting_id").select("meeting_id", "segment_index")


@query("j9_my_workspaces", "select w.workspace_id, w.name from {workspaces} w where exists (select 1 from {members} m where m.workspace_id = w.workspace_id and not m.removed and m.role = 'owner')")
def _(t):
    return t("workspaces").join(t("members").where("not removed and role = 'owner'"), "workspace_id", "left_semi").select("workspace_id", "name")


@query("j10_member_users", "select m.workspace_id, u.email from {members} m join {users} u using (user_id) where not m.removed and m.role = 'owner'")
def _(t):
    return t("members").where("not removed and role = 'owner'").join(t("users").select("user_id", "email"), "user_id").select("workspace_id", "email")


@query("j11_exports", "select d.topic_id, m.meeting_id from {decisions} d join {meetings} m using (meeting_id) join {files} f on d.topic_id = f.file_id where f.kind = 'PROMO' and m.status = 'completed'")
def _(t):
    f = t("files").where("kind = 'PROMO'").select(F.col("file_id").alias("topic_id"))
    return t("decisions").join(f, "topic_id").join(t("meetings").where("status = 'completed'").select("meeting_id"), "meeting_id").select("topic_id", "meeting_id")


@query("j12_already_notified", "select user_id from {users} where exists (select 1 from {activity} a where a.session_id = user_id and a.kind = 'signup')")
def _(t):
    return t("users").join(t("activity").where("kind = 'signup'").select(F.col("session_id").alias("user_id")), "user_id", "left_semi").select("user_id")


@query("j13_not_recorded", "select user_id from {users} where not exists (select 1 from {judgements} j where j.session_id = user_id and j.same_topic)")
def _(t):
    return t("users").join(t("judgements").where("same_topic").select(F.col("session_id").alias("user_id")), "user_id", "left_anti").select("user_id")


@query(
    "j14_reminders",
    """select distinct m.meeting_id, a.user_id from {meetings} m join {attendees} a using (meeting_id) where m.status = 'scheduled' and m.scheduled_at > timestamp '1998-01-01' and m.scheduled_at <= timestamp '1998-01-08'
and not exists (select 1 from {attendees} s where s.meeting_id = m.meeting_id and s.user_id = a.user_id and s.is_initial)""",
)
def _(t):
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    due = t("meetings").where((F.col("status") == "scheduled") & (F.col("scheduled_at") > at("1998-01-01 00:00:00")) & (F.col("scheduled_at") <= at("1998-01-08 00:00:00")))
    want = due.select("meeting_id").join(t("attendees").select("meeting_id", "user_id"), "meeting_id").distinct()
    return want.join(t("attendees").where("is_initial"), ["meeting_id", "user_id"], "left_anti").select("meeting_id", "user_id")


@query("j20_chunk_meeting", "select c.chunk_id, m.meeting_id from {chunks} c join {meetings} m on c.chunk_id = m.meeting_id")
def _(t):
    return t("chunks").select("chunk_id").join(t("meetings").select("meeting_id"), F.col("chunk_id") == F.col("meeting_id"))


@query(
    "j21_list_enrichment",
    """select m.meeting_id, s.preview, coalesce(a.n, 0) as attendees, coalesce(d.n, 0) as decisions from {meetings} m
left join (select meeting_id, substring(text, 1, 80) as preview from {segments} where segment_index = 0) s using (meeting_id)
left join (select meeting_id, count(distinct user_id) as n from {attendees} group by meeting_id) a using (meeting_id)
left join (select meeting_id, count(*) as n from {decisions} group by meeting_id) d using (meeting_id)""",
)
def _(t):
    s = t("segments").where("segment_index = 0").select("meeting_id", F.substring("text", 1, 80).alias("preview"))
    a = t("attendees").groupBy("meeting_id").agg(F.count_distinct("user_id").alias("attendees"))
    d = t("decisions").groupBy("meeting_id").agg(F.count("*").alias("decisions"))
    out = t("meetings").select("meeting_id").join(s, "meeting_id", "left").join(a, "meeting_id", "left").join(d, "meeting_id", "left")
    return out.fillna(0, ["attendees", "decisions"])


@query(
    "j22_search_union",
    """select meeting_id, started_at from {meetings} where (title ilike '%urgent 1%' or duration_ms > 490000) and started_at >= timestamp '1996-01-01' order by started_at desc nulls last, meeting_id""",
)
def _(t):
    text = t("meetings").where(R.contains_any("urgent 1", "title"))
    meaning = t("meetings").where("duration_ms > 490000")
    both = text.unionByName(meaning).dropDuplicates(["meeting_id"])
    return both.where(R.between_dates("started_at", F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")))).select("meeting_id", "started_at").orderBy(F.desc_nulls_last("started_at"), "meeting_id")


@query("j23_category_lookup", "select m.meeting_id, w.name from {meetings} m left join {workspaces} w using (workspace_id)")
def _(t):
    # A row for each workspace; Spark broadcasts it while its size stays under the session's threshold.
    return t("meetings").select("meeting_id", "workspace_id").join(t("workspaces").select("workspace_id", "name"), "workspace_id", "left").select("meeting_id", "name")


@query(
    "j24_resolve_names",
    """with a(name) as (values ('Customer#000000007'), ('customer#00000001'), ('000000042'), ('nobody'), ('#00000149'))
select a.name, coalesce((select min(u.name) from {users} u where u.name = a.name), case when (select count(distinct u.name) from {users} u where contains(lower(u.name), lower(a.name))) = 1
 then (select min(u.name) from {users} u where contains(lower(u.name), lower(a.name))) end, a.name) as resolved from a""",
)
def _(t):
    asked = t.spark.createDataFrame([(x,) for x in ("Customer#000000007", "customer#00000001", "000000042", "nobody", "#00000149")], "name string")
    return R.resolve_names(asked, t("users")).select("name", "resolved")


@query("a1_count", "select status, count(*) as n from {meetings} group by status")
def _(t):
    return t("meetings").groupBy("status").agg(F.count("*").alias("n"))


@query("a2_distinct_two_keys", "select count(distinct topic_id) + count(distinct case when reasoned then meeting_id end) as n from {decisions}")
def _(t):
    return t("decisions").agg((F.count_distinct("topic_id") + F.count_distinct(F.when(F.col("reasoned"), F.col("meeting_id")))).alias("n"))


@query("a3_next_index", "select meeting_id, coalesce(max(segment_index) + 1, 0) as next_index from {meetings} left join {segments} using (meeting_id) group by meeting_id")
def _(t):
    s = t("segments").groupBy("meeting_id").agg(F.max("segment_index").alias("top"))
    return t("meetings").select("meeting_id").join(s, "meeting_id", "left").select("meeting_id", F.coalesce(F.col("top") + 1, F.lit(0)).alias("next_index"))


@query("a4_last_start", "select workspace_id, max(started_at) as started_at from {meetings} group by workspace_id")
def _(t):
    return t("meetings").groupBy("workspace_id").agg(F.max("started_at").alias("started_at"))


@query("a5_weekly", "select cast(cast(date_trunc('week', started_at) as date) as varchar) as week, count(*) as n, cast(sum(coalesce(duration_ms, 0)) as bigint) as total_ms from {meetings} where started_at is not null group by 1")
def _(t):
    d = t("meetings").where("started_at is not null").groupBy(F.date_trunc("week", F.col("started_at").cast("timestamp")).cast("date").cast("string").alias("week"))
    return d.agg(F.count("*").alias("n"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_ms"))


@query(
    "a6_dashboard",
    """select (select count(*) from {meetings}) as meetings, (select count(*) from {meetings} where status = 'completed') as completed, (select max(started_at) from {meetings}) as last_start,
(select count(*) from {decisions} where status = 'pending') as pending, (select count(*) from {decisions} where status = 'active') as active, (select count(*) from {files} where status = 'completed') as files""",
)
def _(t):
    m = t("meetings").agg(F.count("*").alias("meetings"), F.count_if(F.col("status") == "completed").alias("completed"), F.max("started_at").alias("last_start"))
    d = t("decisions").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "active").alias("active"))
    # One row each.
    return m.crossJoin(d).crossJoin(t("files").agg(F.count_if(F.col("status") == "completed").alias("files")))


FOLDERS = """select folder, count(*) as total, count(*) filter (status = 'completed') as done, count(*) filter (status = 'failed') as failed from {files} group by folder"""


@query("a7_owner_count", "select workspace_id, count(*) filter (role = 'owner' and not removed) as owners from {members} group by workspace_id")
def _(t):
    return t("members").groupBy("workspace_id").agg(F.count_if((F.col("role") == "owner") & ~F.col("removed")).alias("owners"))


@query("a8_success_rate", "select folder, round(count(*) filter (rag_enabled and status = 'completed') * 1.0 / nullif(count(*) filter (rag_enabled), 0), 6) as rate from {files} group by folder")
def _(t):
    return t("files").groupBy("folder").agg(F.round(R.rate(F.col("rag_enabled") & (F.col("status") == "completed"), F.col("rag_enabled")), 6).alias("rate"))


@query("a19_folder_state", "select folder, total, done, failed, case when done + failed < total then 'analyzing' when failed = total then 'failed' when failed > 0 then 'partial' else 'completed' end as state from (" + FOLDERS + ")")
def _(t):
    c = lambda s: F.count_if(F.col("status") == s)
    f = t("files").groupBy("folder").agg(F.count("*").alias("total"), c("completed").alias("done"), c("failed").alias("failed"))
    return f.withColumn("state", R.settled(F.col("total"), F.col("done"), F.col("failed")))


@query("w2_recent", "select meeting_id, started_at from {meetings} where started_at is not null order by started_at desc, meeting_id desc limit 20")
def _(t):
    return t("meetings").where("started_at is not null").select("meeting_id", "started_at").orderBy(F.desc("started_at"), F.desc("meeting_id")).limit(20)


@query("w3_many_keys", "select meeting_id, status, scheduled_at from {meetings} where category = '2-HIGH' order by status, scheduled_at desc, meeting_id")
def _(t):
    return t("meetings").where("category = '2-HIGH'").select("meeting_id", "status", "scheduled_at").orderBy("status", F.desc("scheduled_at"), "meeting_id")


@query(
    "w18_task_order",
    """select decision_id, row_number() over (order by (status <> 'active' and decided_at < timestamp '1998-01-01') desc, decided_at asc nulls last, weight desc, decision_id) as place
from {decisions} where author_id = 7""",
)
def _(t):
    from plenum.operators.windows import numbered

    late = (F.col("status") != "active") & (F.col("decided_at") < F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    tasks = t("decisions").where("author_id = 7").withColumn("late", late)
    return numbered(tasks, ["author_id"], F.desc("late"), F.asc_nulls_last("decided_at"), F.desc("weight"), F.col("decision_id"), name="place").select("decision_id", "place")


@query(
    "w19_upcoming_mix",
    """select kind, id, at from (select 'meeting' as kind, cast(meeting_id as string) as id, scheduled_at as at from {meetings} where status = 'scheduled' union all
select 'task', decision_id, decided_at from {decisions} where status = 'pending') where at > timestamp '2001-07-01' order by at, kind, id""",
)
def _(t):
    m = t("meetings").where("status = 'scheduled'").select(F.lit("meeting").alias("kind"), F.col("meeting_id").cast("string").alias("id"), F.col("scheduled_at").alias("at"))
    d = t("decisions").where("status = 'pending'").select(F.lit("task").alias("kind"), F.col("decision_id").alias("id"), F.col("decided_at").alias("at"))
    return m.unionByName(d).where(F.col("at") > F.to_timestamp_ntz(F.lit("2001-07-01 00:00:00"))).orderBy("at", "kind", "id")


@query("u1_union", "select collection, count(*) as n from {chunks} where collection in ('en', 'fr') group by collection")
def _(t):
    c = t("chunks")
    return c.where("collection = 'en'").unionByName(c.where("collection = 'fr'")).groupBy("collection").agg(F.count("*").alias("n"))


@query(
    "u2_first_seen",
    """select id, min(priority) as priority from (select chunk_id as id, 0 as priority from {marks} where quality = 1 union all select chunk_id, 1 from {chunks} where n_chars > 500 union all select chunk_id, 2 from {chunks}) group by id""",
)
def _(t):
    p = lambda d, n: d.select(F.col("chunk_id").alias("id"), F.lit(n).alias("priority"))
    rows = p(t("marks").where("quality = 1"), 0).unionByName(p(t("chunks").where("n_chars > 500"), 1)).unionByName(p(t("chunks"), 2))
    return rows.groupBy("id").agg(F.min("priority").alias("priority"))


LINES = """select chunk_id, line, pos from (select chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from {chunks})"""


@query("u3_page_duplicates", "select chunk_id, line, pos from (select *, row_number() over (partition by chunk_id, line order by pos) as rn from (" + LINES + ")) where rn = 1")
def _(t):
    lines = t("chunks").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("chunk_id", "line").agg(F.min("pos").alias("pos"))


@query("u5_ordered_distinct", "select meeting_id, string_agg(speaker, ',' order by first) as speakers from (select meeting_id, speaker, min(segment_index) as first from {segments} group by all) group by meeting_id")
def _(t):
    by = t("segments").groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "speaker"))).alias("s"))
    return by.select("meeting_id", F.array_join(F.array_distinct(F.transform("s", lambda x: x["speaker"])), ",").alias("speakers"))


@query("u8_session_split", "select meeting_id, segment_index, ('0x' || substr(md5(meeting_id::varchar), 1, 8))::bigint % 1000 < 200 as test from {segments}")
def _(t):
    from plenum.operators.evaluation import held_out

    return t("segments").select("meeting_id", "segment_index", held_out("meeting_id", 0.2).alias("test"))


@query("m1_upsert", "select meeting_id, case when n.id is not null then n.title else m.title end as title, m.category from {meetings} m full join (select meeting_id as id, case when meeting_id % 2 = 0 then concat('new ', title) end as title from {meetings} where meeting_id < 50) n on m.meeting_id = n.id")
def _(t):
    new = t("meetings").where("meeting_id < 50").select("meeting_id", F.when(F.col("meeting_id") % 2 == 0, F.concat(F.lit("new "), "title")).alias("title"))
    return R.upsert(t("meetings").select("meeting_id", "title", "category"), new, "meeting_id", ["title"])


@query(
    "m2_upsert_pairs",
    """with o as (select distinct least(topic_id, author_id) as a, greatest(topic_id, author_id) as b, 1 as score from {decisions}), n as (select distinct least(topic_id, author_id) as a, greatest(topic_id, author_id) as b, 2 as score from {decisions} where reasoned)
select * from n union all select * from o where not exists (select 1 from n where n.a = o.a and n.b = o.b)""",
)
def _(t):
    pairs = lambda d, s: d.select(F.col("topic_id").alias("a"), F.col("author_id").alias("b")).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).distinct().withColumn("score", F.lit(s))
    return R.replace_pairs(pairs(t("decisions"), 1), pairs(t("decisions").where("reasoned"), 2), "a", "b")


@query("m3_bulk_insert", "select meeting_id, segment_index from {segments} union all select meeting_id, segment_index + 100 from {segments} where segment_index = 0")
def _(t):
    s = t("segments").select("meeting_id", "segment_index")
    return s.unionByName(s.where("segment_index = 0").withColumn("segment_index", F.col("segment_index") + 100))


@query("m4_soft_delete", "select decision_id, case when meeting_id in (select meeting_id from {meetings} where status = 'scheduled') then '1998-01-01' when line = 1 then '1990-01-01' end as deleted_at from {decisions} where line <> 1 union all select decision_id, '1990-01-01' from {decisions} where line = 1")
def _(t):
    d = t("decisions").select("decision_id", "meeting_id", F.when(F.col("line") == 1, "1990-01-01").alias("deleted_at"))
    return R.soft_delete(d, t("meetings").where("status = 'scheduled'"), "meeting_id", "1998-01-01").select("decision_id", "deleted_at")


@query("m5_hard_delete", "select decision_id from {decisions} where meeting_id not in (select meeting_id from {meetings} where starter_id in (select user_id from {users} where deleted))")
def _(t):
    gone = t("meetings").join(t("users").where("deleted").select(F.col("user_id").alias("starter_id")), "starter_id", "left_semi")
    return t("decisions").join(gone, "meeting_id", "left_anti").select("decision_id")


@query("m6_replace_attendees", "select distinct meeting_id, user_id from {attendees} where meeting_id >= 100 union select meeting_id, starter_id from {meetings} where meeting_id < 100")
def _(t):
    new = t("meetings").where("meeting_id < 100").select("meeting_id", F.col("starter_id").alias("user_id"))
    # Meetings under 100 are all replaced, also those that had no order.
    old = t("attendees").select("meeting_id", "user_id").distinct().where("meeting_id >= 100")
    return R.replace_set(old, new, "meeting_id")


@query("m7_relabel", "select meeting_id, segment_index, case speaker when 'user' then 'S2' when 'assistant' then 'S2' else speaker end as speaker from {segments}")
def _(t):
    return R.relabel(t("segments"), "speaker", [("user", "S1"), ("assistant", "S1"), ("S1", "S2")]).select("meeting_id", "segment_index", "speaker")


@query("m8_revoke", "select event_id, case when session_id = 8 and kind <> 'error' then 'revoked' when kind = 'error' then 'expired' end as state from {activity}")
def _(t):
    old = F.when(F.col("kind") == "error", "expired")
    return t("activity").select("event_id", U.revoked(old, F.col("session_id") == 8).alias("state"))


@query("m9_revive", "select user_id, workspace_id, case when user_id % 3 = 0 then false else removed end as removed from {members}")
def _(t):
    back = t("members").where("user_id % 3 = 0").select("user_id", F.lit(False).alias("removed"))
    return R.upsert(t("members").select("user_id", "workspace_id", "removed"), back, "user_id", ["removed"])


@query("m10_reopen", "select decision_id, case when status = 'superseded' then 'pending' else status end as status from {decisions}")
def _(t):
    return t("decisions").select("decision_id", U.reopened(F.col("status"), "superseded", "pending").alias("status"))


@query("m11_task_done", "select decision_id, case when status = 'active' then timestamp '1998-01-01' when line = 2 then decided_at end as completed_at from {decisions}")
def _(t):
    had = F.when(F.col("line") == 2, F.col("decided_at"))
    return t("decisions").select("decision_id", U.completed_at(F.col("status") == "active", had, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).alias("completed_at"))


def _exchanges(t):
    s = t("segments").where("segment_index < 2").select(F.col("meeting_id").alias("session_id"), F.coalesce("text", F.lit("")).alias("question"), F.col("speaker").alias("answer"), F.timestamp_seconds(F.col("meeting_id") * 1000 + F.col("segment_index")).alias("at"))
    had = t("segments").select(F.col("meeting_id").alias("session_id")).distinct().select("session_id", F.when(F.col("session_id") % 2 == 0, "old title").alias("title"), F.lit(None).cast("timestamp").alias("updated_at"))
    return R.chat_exchange(had, s)


@query("m12_chat_messages", "select meeting_id as session_id, unnest(['user', 'assistant']) as role, unnest([coalesce(text, ''), speaker]) as content, unnest([0, 1]) + (meeting_id * 1000 + segment_index) * 1000000 as at_us from {segments} where segment_index < 2")
def _(t):
    return _exchanges(t)[1].select("session_id", "role", "content", F.unix_micros("created_at").alias("at_us"))


@query("m12_chat_titles", "select meeting_id as session_id, case when meeting_id % 2 = 0 then 'old title' else arg_min(substring(trim(coalesce(text, ''), ' ' || chr(10) || chr(9)), 1, 40), segment_index) end as title from {segments} where segment_index < 2 group by meeting_id")
def _(t):
    return _exchanges(t)[0].select("session_id", "title")


@query("w20_neighbours", "select case when topic_id = 7 then author_id + 1000000 else topic_id end as other, max(score) as strength from (select topic_id, author_id, score from {decisions} where topic_id = 7) group by 1 order by strength desc, other")
def _(t):
    edges = t("decisions").groupBy(F.col("topic_id").alias("a"), (F.col("author_id") + 1_000_000).alias("b")).agg(F.max("score").alias("strength"))
    return R.neighbours(edges, 7)


@query("m13_retry", "select file_id, case when status = 'failed' then size + 1 else size end as tries from {files}")
def _(t):
    return t("files").select("file_id", U.retried(F.col("size"), F.col("status") == "failed").alias("tries"))


@query("m14_detach", "select file_id, case when folder <> 'Brand#2' then folder end as folder from {files}")
def _(t):
    return t("files").select("file_id", U.detached(F.col("folder"), ["Brand#2"]).alias("folder"))


def _lists() -> None:
    """List reads: a filter and an order each."""
    reads = {
        "n1_segments": ("segments", "true", ["meeting_id", "start_ms", "segment_index"], []),
        "n2_decisions": ("decisions", "status = 'active' and author_id = 3", ["decided_at desc", "decision_id"], []),
        "n3_tasks": ("decisions", "status <> 'superseded' and author_id = 4", ["decision_id"], ["weight"]),
        "n4_contradictions": ("judgements", "same_topic and not same_as_existing", ["event_id"], ["session_id"]),
        "n5_notifications": ("activity", "kind = 'signup' and session_id = 9", ["ts desc", "event_id"], []),
        "n6_categories": ("workspaces", "region_id = 1", ["name", "workspace_id"], []),
        "n7_files": ("files", "is_latest and not deleted", ["folder", "filename", "file_id"], []),
        "n8_chunks": ("chunks", "workspace = 'src2'", ["chunk_id"], ["n_chars"]),
        "n9_history": ("segments", "meeting_id = 7", ["segment_index"], ["speaker", "text"]),
        "n10_meetings": ("meetings", "workspace_id = 4 and status = 'scheduled'", ["scheduled_at", "meeting_id"], []),
        "n11_edges": ("decisions", "score >= 0.9", ["decision_id"], ["topic_id", "author_id"]),
    }
    for name, (entity, where, order, more) in reads.items():
        columns = [*(o.split()[0] for o in order), *more]
        run = lambda t, e=entity, w=where, k=order, c=columns: t(e).where(w).select(*c).orderBy(*(F.expr(o) if not o.endswith(" desc") else F.desc(o[:-5]) for o in k))
        query(name, f"select {', '.join(columns)} from {{{entity}}} where {where} order by {', '.join(order)}")(run)


_lists()


@query(
    "n12_minutes_bundle",
    """with s as (select meeting_id, string_agg(segment_index || '|' || coalesce(speaker, '') || '|' || coalesce(text, ''), chr(10) order by start_ms, segment_index) as segments from {segments} group by 1),
a as (select meeting_id, string_agg(user_id || '|' || name, ',' order by user_id) as attendees from (select distinct meeting_id, user_id from {attendees}) join {users} using (user_id) group by 1),
d as (select meeting_id, string_agg(decision_id || '|' || status, ',' order by decided_at, decision_id) as decisions, string_agg(case when status = 'pending' then decision_id end, ',' order by decision_id) as tasks from {decisions} group by 1)
select m.meeting_id, m.title, m.started_at, k.quality as summary, segments, attendees, decisions, tasks from {meetings} m left join {marks} k on k.chunk_id = m.meeting_id left join s using (meeting_id) left join a using (meeting_id) left join d using (meeting_id) where m.status = 'completed'""",
)
def _(t):
    m = t("meetings").where("status = 'completed'").select("meeting_id", "title", "started_at")
    people = t("attendees").select("meeting_id", "user_id").distinct().join(t("users").select("user_id", "name"), "user_id")
    summary = t("marks").select(F.col("chunk_id").alias("meeting_id"), F.col("quality").alias("summary"))
    b = R.bundle(m, {
        "summary": (summary, [], ["summary"]),
        "segments": (t("segments"), ["start_ms", "segment_index"], ["segment_index", "speaker", "text"]),
        "attendees": (people, ["user_id"], ["user_id", "name"]),
        "decisions": (t("decisions"), ["decided_at", "decision_id"], ["decision_id", "status"]),
        "tasks": (t("decisions").where("status = 'pending'"), ["decision_id"], ["decision_id"]),
    }, "meeting_id")
    text = lambda part, fields, glue: F.when(F.size(part) > 0, F.array_join(F.transform(part, lambda x: F.concat_ws("|", *(F.coalesce(x[f].cast("string"), F.lit("")) for f in fields))), glue))
    return b.select(
        "meeting_id", "title", "started_at", F.get("summary", F.lit(0))["summary"].alias("summary"), text("segments", ["segment_index", "speaker", "text"], "\n").alias("segments"),
        text("attendees", ["user_id", "name"], ",").alias("attendees"), text("decisions", ["decision_id", "status"], ",").alias("decisions"), text("tasks", ["decision_id"], ",").alias("tasks"),
    )
