"""Queries of OCR, table, image and audio statistics, the mix-down, and the vote between two readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import scores
from plenum.operators import greedy, measures, multitalker

from .registry import query

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "a17_ocr_statistics",
    """with g as (select workspace_id, count(*) as attempts, count(*) filter (outcome = 'skip') as skips, count(*) filter (outcome = 'success') as successes, count(*) filter (outcome in ('success', 'empty', 'filtered')) as results,
  count(*) filter (outcome = 'success' and score >= 0.35) as useful, count(*) filter (outcome = 'success' and score >= 0) as judged, count(*) filter (outcome <> 'skip' and engine = 'both') as both_n,
  count(*) filter (outcome <> 'skip' and engine in ('first', 'both', 'cells')) as engines, round(coalesce(avg(score) filter (score >= 0), 0), 3) as mean_score from {ocr_attempts} group by workspace_id)
select workspace_id, attempts, skips, successes, useful, mean_score, round(skips / attempts, 3) as skip_ratio, round(successes / attempts, 3) as success_ratio, case when successes = 0 then 0.0 else round(useful / successes, 3) end as useful_ratio,
  case when attempts = skips then 0.0 else round(both_n / (attempts - skips), 3) end as both_ratio, attempts - skips = engines and attempts - skips = results and successes = judged as consistent from g""",
)
def _(t):
    return measures.ocr_statistics(t("ocr_attempts"), "workspace_id")


def _recordings(t):
    return t("recordings").withColumn("samples", F.col("samples").cast("array<double>"))


@query(
    "a18_audio_statistics",
    """with c as (select session, seq, list_filter(samples::double[], lambda x: x is not null and isfinite(x)) as s from {recordings}),
d as (select session, seq, s, list_filter(s, lambda x: abs(x) > 0.1) as loud from c where len(s) > 0),
e as (select session, seq, len(s) as n, len(list_filter(s, lambda x: abs(x) > 0.99)) as clipped, case when len(loud) = 0 then s else loud end as sp, case when len(loud) = 0 then [] else list_filter(s, lambda x: abs(x) <= 0.1) end as bg from d),
f as (select session, seq, n, clipped, len(sp) as sn, len(bg) as bn, list_sum(list_transform(sp, lambda x: x * x)) as se, coalesce(list_sum(list_transform(bg, lambda x: x * x)), 0) as be from e),
w as (select *, sqrt(sum(se) over o / sum(sn) over o) < 1e-4 as silent from f window o as (partition by session order by seq)),
h as (select *, max(case when not silent then seq end) over (partition by session) as heard from w),
g as (select session, sum(n) as n, sum(clipped) as clipped, sqrt(sum(se) / sum(sn)) as sr, case when sum(bn) = 0 then 0 else sqrt(sum(be) / sum(bn)) end as br, sum(sn) as sn, sum(case when heard is null or seq > heard then n else 0 end) as quiet from h group by session)
select session, round(sr, 4) as speech_rms, round(br, 4) as background_rms, case when sr > 0 and br > 1e-6 then round(20 * log10(sr / br), 1) end as snr_db, round(clipped / n, 5) as clip_ratio, round(sn / 16000, 1) as speech_sec, round(quiet / 16000, 3) as silent_sec from g""",
)
def _(t):
    chunks = _recordings(t).withColumn("speech", F.transform("samples", lambda x: F.abs(x) > 0.1))
    return measures.audio_statistics(chunks, "session", "seq")


@query(
    "x10_mix_down",
    """with p as (select session, seq % 97 * 10 + generate_subscripts(samples, 1) - 1 as at, unnest(samples::double[]) as x from {recordings}),
v as (select session, at, greatest(-32768, least(32767, sum(coalesce(cast(floor(x * 30000) as bigint), 0)))) as value from p group by session, at)
select session, cast(at // 256 as bigint) as block, count(*) as n, cast(sum(value) as bigint) as total, cast(max(value) as bigint) as peak from v group by all""",
)
def _(t):
    streams = _recordings(t).select("session", (F.col("seq") % 97 * 10).alias("offset_ms"), F.transform("samples", lambda x: F.floor(x * 30000)).alias("samples"))
    m = measures.mixed(streams, "session", 1000)
    return m.groupBy("session", F.floor(F.col("at") / 256).alias("block")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))


@query(
    "q4_table_quality",
    f"""with r as (select chunk_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ',')) as t from {{chunks}} where text is not null),
s as (select chunk_id, t, list_transform(t, lambda r: list_transform(r, lambda c: trim(c, {BLANK}))) as u, list_transform(t, lambda r: len(r)) as w from r),
k as (select *, list_filter(flatten(u), lambda c: c <> '') as kept, list_filter(u[1], lambda c: c <> '') as head from s),
n as (select *, list_transform(kept, lambda c: regexp_full_match(regexp_replace(c, '[.,]', '', 'g'), '[0-9]+')) as num from k)
select chunk_id, round(len(head) / len(u[1]) * case when len(u) < 2 then 0.7 when u[1] <> u[2] then 1.0 else 0.5 end * 0.25::double + len(kept) / len(flatten(u)) * 0.25::double
  + list_max(list_transform(list_distinct(w), lambda v: len(list_filter(w, lambda y: y = v)))) / len(w) * 0.2::double
  + (least(len(u) / 10.0, 1.0) + least(list_max(w) / 4.0, 1.0)) / 2 * 0.2::double + case when len(kept) = 0 then 0.0 when list_bool_or(num) and not list_bool_and(num) then 1.0 else 0.7 end::double * 0.1::double, 3) as score from n
union all select chunk_id, 1.0 from {{chunks}} where text is null""",
)
def _(t):
    tables = t("chunks").select("chunk_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, ",")).alias("t"))
    score = F.when(F.col("t").isNotNull(), scores.table_quality(F.col("t")))
    return tables.select("chunk_id", score.alias("s")).groupBy("chunk_id").agg(scores.mean_quality(F.col("s")).alias("score"))


def _turns(t):
    return t("segments").select("meeting_id", "segment_index", "speaker", "text")


@query("q5_image_quality")
def _(t):
    d = _turns(t)
    d = d.withColumn("other", F.regexp_replace("text", "[aeiou]", ""))
    score = scores.image_quality(F.col("text"), greedy.agreement(F.col("text"), F.col("other")))
    return d.select("meeting_id", score.alias("s")).groupBy("meeting_id").agg(scores.mean_quality(F.col("s")).alias("score"))


def _readings(t):
    """Two readings of each meeting: its turns, and the same with other signs; every fifth line is missing in the second."""
    d = _turns(t).select("meeting_id", F.col("segment_index").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    other = d.where("pos % 5 <> 4").withColumn("text", F.when(F.col("pos") % 2 == 0, F.translate("text", "e", "c")).otherwise(F.reverse("text")))
    return d.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)))


@query("j19_line_votes")
def _(t):
    return greedy.line_votes(_readings(t), "meeting_id")


@query("j19_voted_pages")
def _(t):
    return greedy.voted_pages(greedy.line_votes(_readings(t), "meeting_id"), "meeting_id")


@query("e8_script_alignment")
def _(t):
    lines = _turns(t).select("meeting_id", F.col("segment_index").alias("pos"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    heard = lines.withColumn("h", half).select(
        "meeting_id",
        F.explode(F.array(F.struct((F.col("pos") * 2).alias("pos"), F.expr("substring(text, 1, h)").alias("text")), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.translate(F.expr("substring(text, h + 1)"), "aeo", "oae").alias("text")))).alias("x"),
    )
    return greedy.script_alignment(lines, heard.select("meeting_id", "x.*"), "meeting_id")


SPOKEN = "select conv_id as meeting_id, role as speaker, turn as pos, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') as text from conversations"
HEARD = "select meeting_id, case when (pos * 3 + meeting_id) % 7 = 0 then 'guest' else upper(speaker) end as speaker, pos, replace(replace(text, ' the ', ' a '), 'ing', 'in') as text from spoken where pos % 11 <> 10"


def _spoken(t):
    d = _turns(t).select("meeting_id", "speaker", F.col("segment_index").alias("pos"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("text"))
    other = F.when((F.col("pos") * 3 + F.col("meeting_id")) % 7 == 0, "guest").otherwise(F.upper("speaker"))
    heard = d.where("pos % 11 <> 10").select("meeting_id", other.alias("speaker"), "pos", F.expr("replace(replace(text, ' the ', ' a '), 'ing', 'in')").alias("text"))
    return d, heard


@query("e10_speaker_words")
def _(t):
    return multitalker.speaker_errors(*_spoken(t), "meeting_id")


@query(
    "e10_speaker_chars",
    f"""with spoken as ({SPOKEN}), heard as ({HEARD}),
r as (select meeting_id, speaker, string_agg(regexp_replace(lower(text), '[^a-z0-9_]', '', 'g'), '' order by pos) as x from spoken group by all),
h as (select meeting_id, speaker, string_agg(regexp_replace(lower(text), '[^a-z0-9_]', '', 'g'), '' order by pos) as x from heard group by all),
rn as (select *, row_number() over (partition by meeting_id order by speaker) as i from r where x <> ''), hn as (select *, row_number() over (partition by meeting_id order by speaker) as i from h where x <> ''),
m as (select meeting_id from rn union select meeting_id from hn), n as (select * from range(1, 5) t(i)),
cost as (select m.meeting_id, a.i as i, b.i as j, levenshtein(coalesce(rn.x, ''), coalesce(hn.x, '')) as c from m cross join n a cross join n b
 left join rn on rn.meeting_id = m.meeting_id and rn.i = a.i left join hn on hn.meeting_id = m.meeting_id and hn.i = b.i),
ways as (select a.i as p1, b.i as p2, c.i as p3, d.i as p4 from n a, n b, n c, n d where len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
least_of as (select c1.meeting_id, min(c1.c + c2.c + c3.c + c4.c) as cp_errors from ways join cost c1 on c1.i = 1 and c1.j = p1 join cost c2 on c2.meeting_id = c1.meeting_id and c2.i = 2 and c2.j = p2
 join cost c3 on c3.meeting_id = c1.meeting_id and c3.i = 3 and c3.j = p3 join cost c4 on c4.meeting_id = c1.meeting_id and c4.i = 4 and c4.j = p4 group by 1)
select l.meeting_id, coalesce((select sum(length(x)) from rn where rn.meeting_id = l.meeting_id), 0)::bigint as units, cp_errors from least_of l""",
)
def _(t):
    return multitalker.speaker_errors(*_spoken(t), "meeting_id", chars=True, second=False)


@query(
    "t15_echo",
    """with p as (select meeting_id, segment_index, text, length(text) as n, case segment_index % 4 when 0 then length(text) // 3 when 1 then length(text) // 2 when 2 then least(length(text), 19) else (length(text) * 3) // 4 end as k from {segments} where text is not null)
select meeting_id, segment_index, k >= 20 and 2 * k >= n as echo from p""",
)
def _(t):
    k = F.expr("case segment_index % 4 when 0 then length(text) div 3 when 1 then length(text) div 2 when 2 then least(length(text), 19) else length(text) * 3 div 4 end")
    d = _turns(t).where("text is not null").withColumn("k", k.cast("int"))
    # The context has the text's last k characters, and around them signs that no text has.
    shared = F.concat(F.lit("\u2603\u2603"), F.expr("right(text, k)"), F.lit("\u2603\u2603"))
    return d.select("meeting_id", "segment_index", greedy.echo(F.col("text"), shared).alias("echo"))


@query("io7_page_tables", "select file_id, '| ' || filename || ' | x |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || size || ' |  |' as markdown from {files} where file_id % 3 > 0 and size * 10 >= 100 and size * 9 <= 450")
def _(t):
    from plenum.sources.readers import page_tables

    null = F.lit(None).cast("string")
    full = F.array(F.array(F.col("filename"), F.lit("x")), F.array(F.col("size").cast("string"), null))
    cells = F.when(F.col("file_id") % 3 > 0, full).otherwise(F.array(F.array(F.lit("a"), null), F.array(null, F.lit(" "))))
    d = t("files").select("file_id", cells.alias("cells"), (F.col("size") * 9).alias("top"), (F.col("size") * 10).alias("bottom"), F.when(F.col("size") > 0, 500).alias("page_height"))
    # The margin is a tenth: from 50 to 450 of 500; a bottom under 50 or a top over 450 is out.
    return page_tables(d.withColumn("bottom", F.col("bottom") - 50)).select("file_id", "markdown")
