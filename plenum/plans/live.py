"""Queries of the streaming rules: a table is read as a stream until its end, the rule's rows are appended to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.shared import shared_folder, written
from plenum.streaming import rules

from .registry import Tables, query


def _source(t: Tables, entity: str, live: bool = False) -> DataFrame:
    """A stream of an entity, in a session of its own, whose settings touch no other query."""
    spark = t.spark.newSession()
    # A rule with a time to live would ask for batches for ever; a window is closed by one.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(live).lower())
    table, columns = t.columns(entity)
    return spark.readStream.schema(t.raw(table).schema).parquet(f"{t.sf_dir}/{table}.parquet*").selectExpr(*columns)


def _run(t: Tables, entity: str, make, live: bool = False) -> DataFrame:
    """The rows of ``make`` over a stream of an entity."""
    out, state = shared_folder(t.spark, "live"), shared_folder(t.spark, "live-state")
    rows = make(_source(t, entity, live))
    rules.append(rows, out, state).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)


def _frames(s: DataFrame) -> DataFrame:
    """Events of a session as frames of 700 ms, an error being silent."""
    return s.select("session_id", "event_id", (F.col("kind") != "error").alias("voiced"), (F.col("kind") == "error").alias("silent"), F.lit(700).alias("ms"))


@query("x1_utterances")
def _(t):
    return _run(t, "activity", lambda s: rules.utterances(_frames(s), "session_id", "voiced", "event_id", "ms"))


@query(
    "x3_silence_gaps",
    """with e as (select session_id, event_id, kind = 'error' as silent, row_number() over (partition by session_id order by event_id) - row_number() over (partition by session_id, kind = 'error' order by event_id) as run from {activity}),
g as (select session_id, min(event_id) as first, max(event_id) as last, count(*) * 700 as length from e where silent group by session_id, run),
c as (select g.* from g where exists (select 1 from e where e.session_id = g.session_id and e.event_id > g.last))
select session_id, length, length >= 2000 and row_number() over (partition by session_id, length >= 2000 order by first) = 1 as warned from c""",
)
def _(t):
    return _run(t, "activity", lambda s: rules.silence_gaps(_frames(s), "session_id", "silent", "event_id", "ms"))


@query(
    "x4_unknown_live",
    """select session_id, min(n) as at_count from (select session_id, row_number() over w as n, sum((kind = 'error')::int) over w as unknown from {activity} window w as (partition by session_id order by event_id rows unbounded preceding)) where n >= 3 and unknown >= 0.6 * n group by session_id""",
)
def _(t):
    return _run(t, "activity", lambda s: rules.unknown_speakers(s.withColumn("u", F.col("kind") == "error"), "session_id", "u", "event_id", "event_id"))


@query("x5_quality_warnings")
def _(t):
    signs = {"speech": F.col("kind") != "error", "clip": (F.col("value") % 7) / 300, "snr": F.col("value") % 40, "volume": (F.col("value") % 11) / 100}
    return _run(t, "activity", lambda s: rules.quality_warnings(s.withColumns(signs), "session_id", "event_id", "speech", "clip", "snr", "volume"))


@query("d3_once_live", "select distinct session_id, kind from {activity}")
def _(t):
    # One watermark's delay holds the whole table, so a key comes once.
    return _run(t, "activity", lambda s: rules.once(s.withColumn("ts", F.col("ts").cast("timestamp")), ["session_id", "kind"], "ts", "1000 days").select("session_id", "kind"))


def _drafts(s: DataFrame) -> DataFrame:
    """Turns as drafts that begin alike."""
    return s.withColumn("text", F.concat(F.lit("in "), F.when(F.col("segment_index") % 4 < 2, "this ").otherwise("that "), F.coalesce("text", F.lit(""))))


@query(
    "t16_agreed_live",
    """with w as (select meeting_id, segment_index, list_filter(string_split_regex('in ' || case when segment_index % 4 < 2 then 'this ' else 'that ' end || coalesce(text, ''), '\\s+'), lambda x: x <> '') as w from {segments}),
p as (select *, lag(w) over (partition by meeting_id order by segment_index) as p from w),
n as (select *, coalesce((select min(i) - 1 from range(1, 2 + least(len(w), len(p))) r(i) where w[i] is distinct from p[i] or i > least(len(w), len(p))), 0) as k from p)
select meeting_id, segment_index, array_to_string(w[1:k], ' ') as agreed from n""",
)
def _(t):
    return _run(t, "segments", lambda s: rules.agreed_words(_drafts(s), "meeting_id", "segment_index", "text")).select("meeting_id", "segment_index", "agreed")


MOVES = {"signup": ("scheduled", "recording"), "view": ("recording", "processing"), "click": ("processing", "completed"), "error": ("processing", "recording"), "purchase": ("completed", "scheduled")}


@query(
    "d12_live_transitions",
    f"""with recursive r as (select session_id, event_id, case kind {' '.join(f"when '{k}' then '{a}'" for k, (a, _) in MOVES.items())} end as expected, case kind {' '.join(f"when '{k}' then '{b}'" for k, (_, b) in MOVES.items())} end as target,
 row_number() over (partition by session_id order by event_id) as i from {{activity}}),
f as (select session_id, 0::bigint as i, null::bigint as event_id, 'scheduled' as status, 0::bigint as version, false as ok from (select distinct session_id from r)
 union all select r.session_id, r.i, r.event_id, case when r.expected = f.status then r.target else f.status end, f.version + (r.expected = f.status)::int, r.expected = f.status from f join r on r.session_id = f.session_id and r.i = f.i + 1)
select session_id, event_id, case when ok then 'ok' else 'conflict' end as verdict, status, version from f where i > 0""",
)
def _(t):
    def pick(k: int):
        out = F.when(F.lit(False), "")
        for kind, move in MOVES.items():
            out = out.when(F.col("kind") == kind, move[k])
        return out

    return _run(t, "activity", lambda s: rules.transitions(s.withColumns({"was": pick(0), "new": pick(1)}), "session_id", "event_id", "was", "new", "scheduled"))


@query(
    "x7_finished",
    """with e as (select session_id, ts, ts - lag(ts) over (partition by session_id order by ts) > interval 6 hour as far from {activity}),
g as (select session_id, ts, sum((coalesce(far, true))::int) over (partition by session_id order by ts rows unbounded preceding) as island from e),
s as (select session_id, min(ts) as first, max(ts) + interval 6 hour as done, count(*) as n from g group by session_id, island)
select session_id, epoch_us(first) as start_us, epoch_us(done) as end_us, n from s where done <= (select max(ts) from {activity}) - interval 1 minute""",
)
def _(t):
    out = _run(t, "activity", lambda s: rules.sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "session_id", "ts", "6 hours"), live=True)
    return out.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("p3_unassigned_live")
def _(t):
    return _run(t, "vectors", lambda s: rules.unassigned(s.select(F.col("label").alias("session"), F.col("vec_id").alias("seq"), F.col("embedding").alias("v")), "session", "seq"))


@query(
    "x8_reminders",
    """with ticks as (select distinct date_trunc('year', scheduled_at) as now from {meetings}),
due as (select meeting_id from {meetings} where exists (select 1 from ticks where scheduled_at > now and scheduled_at <= now + interval 400 day))
select distinct a.meeting_id, a.user_id from {attendees} a join due using (meeting_id)""",
)
def _(t):
    # A poll at each year's beginning, with windows that overlap.
    meetings, attendees = t("meetings").select("meeting_id", F.col("scheduled_at").cast("timestamp").alias("scheduled_at")), t("attendees").select("meeting_id", "user_id")
    ticks, sent = shared_folder(t.spark, "ticks"), shared_folder(t.spark, "sent")
    years = meetings.select(F.date_trunc("year", "scheduled_at").alias("now")).distinct()
    years.write.option("maxRecordsPerFile", 1).parquet(ticks)
    clock = t.spark.newSession().readStream.schema(years.schema).option("maxFilesPerTrigger", 1).parquet(ticks)

    # Meetings and attendees meet once, not at each poll.
    planned = written(meetings.join(attendees, "meeting_id").select("meeting_id", "user_id", "scheduled_at").distinct(), "planned")

    def due(now):
        return planned.where((F.col("scheduled_at") > F.lit(now)) & (F.col("scheduled_at") <= F.lit(now) + F.expr("interval 400 days"))).select("meeting_id", "user_id")

    rules.reminders(clock, "now", due, sent, ["meeting_id", "user_id"], shared_folder(t.spark, "poll-state")).awaitTermination()
    return t.spark.read.schema("meeting_id long, user_id long").parquet(sent).select("meeting_id", "user_id")
