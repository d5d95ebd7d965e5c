"""Queries over time spans: attribution joins, runs, sweeps, splits, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import intervals as I
from plenum.operators import scans
from plenum.operators import windows as W

from .registry import query

SEG = "(select meeting_id, segment_index, speaker, text, start_ms::bigint as start, end_ms::bigint as \"end\" from {segments})"
TRACK = "(select meeting_id, segment_index as track, speaker, start_ms::bigint + 1700 as a, end_ms::bigint + 1700 as b from {segments})"


def _segments(t):
    return t("segments").select("meeting_id", "segment_index", "speaker", F.col("start_ms").cast("bigint").alias("start"), F.col("end_ms").cast("bigint").alias("end"), "text")


def _tracks(t, prefix: str, shift: int = 1700):
    return _segments(t).select("meeting_id", F.col("segment_index").alias("track"), F.col("speaker"), (F.col("start") + shift).alias(f"{prefix}_start"), (F.col("end") + shift).alias(f"{prefix}_end"))


@query(
    "j15_greatest_overlap",
    f"""select meeting_id, segment_index, coalesce(who, 'UNKNOWN') as speaker from (select s.meeting_id, s.segment_index, t.speaker as who,
 row_number() over (partition by s.meeting_id, s.segment_index order by least(s."end", t.b) - greatest(s.start, t.a) desc nulls last, t.track) as n
 from {SEG} s left join {TRACK} t on s.meeting_id = t.meeting_id and s.start < t.b and t.a < s."end") where n = 1""",
)
def _(t):
    return I.best_track(_segments(t).drop("speaker", "text"), _tracks(t, "track"), ["meeting_id", "segment_index"]).select("meeting_id", "segment_index", "speaker")


@query(
    "j16_longest_name",
    f"""with h as (select s.meeting_id, s.segment_index, t.speaker as name, sum(least(s."end", t.b) - greatest(s.start, t.a)) as total, min(t.a) as first
 from {SEG} s join {TRACK} t on s.meeting_id = t.meeting_id and s.start < t.b and t.a < s."end" where t.speaker <> 'system' group by all),
r as (select *, row_number() over (partition by meeting_id, segment_index order by total desc, first) as n from h)
select s.meeting_id, s.segment_index, r.name from {SEG} s left join r on r.meeting_id = s.meeting_id and r.segment_index = s.segment_index and r.n = 1""",
)
def _(t):
    slots = _tracks(t, "slot").withColumn("name", F.when(F.col("speaker") != "system", F.col("speaker"))).drop("speaker", "track")
    return I.longest_name(_segments(t).drop("speaker", "text"), slots, ["meeting_id", "segment_index"]).select("meeting_id", "segment_index", "name")


EVENTS = "(select user_id as session, event_type as kind, event_id, epoch_us(ts) as at from events)"


def _events(t):
    return t("activity").select(F.col("session_id").alias("session"), "kind", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query(
    "w7_majority",
    f"""select event_id, case when prev = next then prev else kind end as kind from (select *, lag(kind) over w as prev, lead(kind) over w as next from {EVENTS} window w as (partition by session order by at, event_id))""",
)
def _(t):
    k = ["session"], ["at", "event_id"]
    from pyspark.sql import Window

    w = Window.partitionBy(*k[0]).orderBy(*k[1])
    d = _events(t).withColumns({"prev": F.lag("kind").over(w), "next": F.lead("kind").over(w)})
    # Of three different labels the middle one stays.
    return d.select("event_id", F.when(F.col("prev") == F.col("next"), F.col("prev")).otherwise(F.col("kind")).alias("kind"))


#: Every seventh event lasts a day, so spans nest.
LONG = f"(select *, at + case when event_id % 7 = 0 then 86400000000 else 1000000 end as until from {EVENTS})"


@query(
    "w8_gap_merge",
    f"""with recursive n as (select *, row_number() over (partition by session order by at, until, event_id) as i from {LONG}),
w as (select session, i, kind, at as s, until as e, 1 as run from n where i = 1
 union all select n.session, n.i, n.kind, x.hit_s, case when x.hit then greatest(w.e, n.until) else n.until end, w.run + (not x.hit)::int
 from w join n on n.session = w.session and n.i = w.i + 1, lateral (select n.kind = w.kind and n.at - w.e <= 3600000000 as hit, case when n.kind = w.kind and n.at - w.e <= 3600000000 then w.s else n.at end as hit_s) x)
select session, any_value(kind) as kind, min(s) as "at", max(e) as until, count(*) as parts from w group by session, run""",
)
def _(t):
    d = _events(t).withColumn("until", F.col("at") + F.when(F.col("event_id") % 7 == 0, 86_400_000_000).otherwise(1_000_000))
    return W.merge_gaps(d, "session", "kind", "at", "until", 3_600_000_000)


#: All events as one session, which is scanned in parts.
ONE = EVENTS.replace("select ", "select 0 as all_of, ", 1)


def _one(t):
    return _events(t).withColumn("all_of", F.lit(0))


@query(
    "w7_majority_dealt",
    f"""select event_id, case when prev = next then prev else kind end as kind from (select *, lag(kind) over w as prev, lead(kind) over w as next from {ONE} window w as (order by at, event_id))""",
)
def _(t):
    return scans.smoothed(_one(t), "all_of", "kind", ["at", "event_id"], most=500).select("event_id", "kind")


@query(
    "w8_gap_merge_dealt",
    f"""with n as (select *, at + case when event_id % 7 = 0 then 86400000000 else 1000000 end as until from {ONE}),
i as (select *, kind is distinct from lag(kind) over (order by at, until, event_id) as brk from n),
j as (select *, sum(brk::int) over (order by at, until, event_id rows unbounded preceding) as island from i),
t as (select *, max(until) over (partition by island order by at, until, event_id rows between unbounded preceding and 1 preceding) as top from j),
r as (select *, sum((coalesce(at - top > 3600000000, true))::int) over (partition by island order by at, until, event_id rows unbounded preceding) as run from t)
select any_value(kind) as kind, min(at) as "at", max(until) as until, count(*) as parts from r group by island, run""",
)
def _(t):
    d = _one(t).withColumn("until", F.col("at") + F.when(F.col("event_id") % 7 == 0, 86_400_000_000).otherwise(1_000_000))
    return scans.merge_gaps(d, "all_of", "kind", "at", "until", 3_600_000_000, "event_id", most=500).drop("all_of")


@query(
    "w9_label_runs_dealt",
    f"""with c as (select *, kind is distinct from lag(kind) over (order by at, event_id) as brk from {ONE}),
r as (select *, sum(brk::int) over (order by at, event_id rows unbounded preceding) as run from c),
g as (select run, any_value(kind) as kind, min(at) as s, max(at) as e from r group by run)
select run::bigint as run, kind, coalesce((lag(e) over w + s) / 2.0, s) as at, coalesce((e + lead(s) over w) / 2.0, e) as until from g window w as (order by run)""",
)
def _(t):
    return scans.label_runs(_one(t).withColumn("until", F.col("at")), "all_of", "kind", "at", "until", "event_id", most=500).drop("all_of")


@query(
    "w15_sentence_parts",
    """with p as (select meeting_id, segment_index, trim(text, ' ' || chr(10) || chr(9) || chr(13)) as whole, list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') as parts from {segments} where text is not null),
j as (select *, case when len(parts) > 1 then list_reduce(parts, lambda a, x: case when length(x) < 6 then a || ' ' || x else a || chr(2) || x end) end as joined from p),
f as (select *, case when joined is null or not contains(joined, chr(2)) then [whole] when length(split_part(joined, chr(2), 1)) < 6 then string_split(split_part(joined, chr(2), 1) || ' ' || substring(joined, length(split_part(joined, chr(2), 1)) + 2), chr(2)) else string_split(joined, chr(2)) end as out from j)
select meeting_id, segment_index, (unnest(range(len(o)))) as part, unnest(o) as text, len(o) > 1 as estimated from (select meeting_id, segment_index, case when len(out) < 2 then [whole] else out end as o from f)""",
)
def _(t):
    d = _segments(t).where("text is not null")
    return W.sentences(d, ["meeting_id", "segment_index"], "text", "start", "end").select("meeting_id", "segment_index", F.col("part").cast("long").alias("part"), "text", "estimated")


@query("w15_sentences")
def _(t):
    d = _segments(t).select("meeting_id", "segment_index", "text", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    return W.sentences(d.where("text is not null"), ["meeting_id", "segment_index"], "text", "start", "end")


@query(
    "x2_turns",
    """with s as (select meeting_id, turn, start, "end", coalesce(last_value(label ignore nulls) over (partition by meeting_id order by start, "end" rows unbounded preceding), first_value(label ignore nulls) over (partition by meeting_id order by start, "end" rows between current row and unbounded following)) as label
  from (select conv_id as meeting_id, turn, turn * 5000 as start, turn * 5000 + 500 + coalesce(length(text), 0) * 20 as "end", case when turn % 4 <> 2 then case turn // 3 % 2 when 0 then 'a' else 'b' end end as label from conversations)),
b as (select *, row_number() over (partition by meeting_id order by start, "end") as n, label is distinct from lag(label) over (partition by meeting_id order by start, "end") as cut, max("end") over (partition by meeting_id) as total from s),
r as (select meeting_id, row_number() over (partition by meeting_id order by n) as k, case when n = 1 then 0 else start end as s, label, total from b where cut or n = 1),
t as (select *, coalesce(lead(s) over (partition by meeting_id order by k), total) as e from r),
f as (select *, e - s < 6000 as short, first_value(e - s < 6000) over (partition by meeting_id order by k) as first_short from t),
h as (select *, sum((k = 1 or (not short and not (k = 2 and first_short)))::int) over (partition by meeting_id order by k rows unbounded preceding) as turn from f)
select meeting_id, turn::bigint as turn, min(s)::bigint as start, max(e)::bigint as "end", arg_min(label, case when k = 2 and first_short then 0 else k end) as speaker from h group by meeting_id, turn""",
)
def _(t):
    i = F.col("segment_index")
    label = F.when(i % 4 != 2, F.when(F.floor(i / 3) % 2 == 0, "a").otherwise("b"))
    from pyspark.sql import Window

    d = _segments(t).withColumns({"speaker": label, "total": F.max("end").over(Window.partitionBy("meeting_id"))})
    return W.turns(d, "meeting_id", "speaker", "start", "end", "total", least=6000)


@query("w13_longest_first")
def _(t):
    from plenum.operators.greedy import longest_first

    d = _events(t).select("session", (F.col("at") / 1_000_000).alias("start"), ((F.col("at") / 1_000_000) + F.col("event_id") % 13 * 3600).alias("end"), F.col("event_id").alias("item"))
    return longest_first(d, "session", "start", "end")


@query(
    "w9_label_runs",
    f"""with c as (select *, case when lag(kind) over w is null or lag(kind) over w <> kind then 1 else 0 end as brk from {EVENTS} window w as (partition by session order by at)),
r as (select *, sum(brk) over (partition by session order by at rows unbounded preceding) as run from c),
g as (select session, run, any_value(kind) as kind, min(at) as s, max(at) as e from r group by session, run)
select session, run::bigint as run, kind, coalesce((lag(e) over w + s) / 2.0, s) as at, coalesce((e + lead(s) over w) / 2.0, e) as until from g window w as (partition by session order by run)""",
)
def _(t):
    d = _events(t).withColumn("until", F.col("at"))
    return W.label_runs(d, "session", "kind", "at", "until")


CLIP = f"""clip as (select s.meeting_id, s.segment_index, t.speaker as name, greatest(s.start, t.a) as a, least(s."end", t.b) as b, t.a as ta, t.b as tb from {SEG} s join {TRACK} t on s.meeting_id = t.meeting_id and s.start < t.b and t.a < s."end"),
brk as (select *, case when lag(name) over w = name then 0 else 1 end as brk from clip window w as (partition by meeting_id, segment_index order by a, b, name, ta, tb)),
num as (select *, sum(brk) over (partition by meeting_id, segment_index order by a, b, name, ta, tb rows unbounded preceding) as run from brk),
runs as (select meeting_id, segment_index, run::bigint as run, any_value(name) as name, min(a) as a, max(b) as b from num group by meeting_id, segment_index, run)"""


@query("w10_clipped_runs", f"with {CLIP} select * from runs")
def _(t):
    return I.clipped_runs(_segments(t).drop("speaker", "text"), _tracks(t, "slot").withColumnRenamed("speaker", "name"), ["meeting_id", "segment_index"])


SPANS = f"""own as (select meeting_id, speaker, min(a) as a, max(b) as b from (select *, sum(brk) over (partition by meeting_id, speaker order by a, b rows unbounded preceding) as run from (
  select *, case when a - max(b) over (partition by meeting_id, speaker order by a, b rows between unbounded preceding and 1 preceding) > 0 or row_number() over (partition by meeting_id, speaker order by a, b) = 1 then 1 else 0 end as brk from {TRACK})) group by meeting_id, speaker, run),
ev as (select meeting_id, at, sum(d) as d from (select meeting_id, a as at, 1 as d from own union all select meeting_id, b, -1 from own) group by all),
act as (select meeting_id, at, sum(d) over w as active, lead(at) over (partition by meeting_id order by at) as until from ev window w as (partition by meeting_id order by at rows unbounded preceding)),
ov as (select meeting_id, min(at) as a, max(until) as b from (select *, sum(brk) over (partition by meeting_id order by at rows unbounded preceding) as run from (select *, case when at = lag(until) over (partition by meeting_id order by at) then 0 else 1 end as brk from act where active >= 2 and until is not null)) group by meeting_id, run),
big as (select *, case when a - lag(b) over (partition by meeting_id order by a) <= 300 then 0 else 1 end as brk from ov where b - a >= 300),
spans as (select meeting_id, min(a) as span_start, max(b) as span_end from (select *, sum(brk) over (partition by meeting_id order by a rows unbounded preceding) as run from big) group by meeting_id, run)"""


def _spans(t):
    return W.overlaps(_tracks(t, "span"), "meeting_id", "speaker", "span_start", "span_end")


@query("w11_overlap_spans", f"with {SPANS} select * from spans")
def _(t):
    return _spans(t)


@query(
    "w12_coverage",
    f"""with {SPANS} select s.meeting_id, s.segment_index, coalesce(sum(least(s."end", p.span_end) - greatest(s.start, p.span_start)) filter (p.span_end is not null) * 1.0 / any_value(s."end" - s.start), 0) >= 0.6 as overlapped
from {SEG} s left join spans p on s.meeting_id = p.meeting_id and s.start < p.span_end and p.span_start < s."end" group by s.meeting_id, s.segment_index""",
)
def _(t):
    c = I.coverage(_segments(t).drop("speaker", "text"), _spans(t), ["meeting_id", "segment_index"])
    return c.select("meeting_id", "segment_index", (F.col("ratio") >= 0.6).alias("overlapped"))


@query(
    "w14_boundary_split",
    f"""with {CLIP}, long as (select * from runs where b - a >= 1000), nx as (select *, lead(name) over w as n2, lead(a) over w as a2 from long window w as (partition by meeting_id, segment_index order by a, b)),
cuts as (select meeting_id, segment_index, (b + a2) / 2.0 as cut from nx where n2 <> name),
edges as (select meeting_id, segment_index, start::double as e from {SEG} union all select meeting_id, segment_index, "end"::double from {SEG} union all select meeting_id, segment_index, cut from cuts)
select meeting_id, segment_index, part::int as part, e as start, nxt as "end" from (select *, row_number() over w - 1 as part, lead(e) over w as nxt from edges window w as (partition by meeting_id, segment_index order by e)) where nxt is not null""",
)
def _(t):
    return I.split_at_runs(_segments(t).drop("speaker", "text"), _tracks(t, "slot").withColumnRenamed("speaker", "name"), ["meeting_id", "segment_index"])


@query(
    "w16_midpoint_split",
    f"""select meeting_id, segment_index, part, case when part = 0 then start else mid end as start, case when part = 0 then mid else "end" end as "end" from
 (select *, greatest(start + 1, least("end" - 1, start + 2500)) as mid from {SEG}), (values (0), (1)) p(part)""",
)
def _(t):
    mid = F.greatest(F.col("start") + 1, F.least(F.col("end") - 1, F.col("start") + 2500))
    d = _segments(t).withColumn("mid", mid).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    return d.select("meeting_id", "segment_index", "part", F.when(F.col("part") == 0, F.col("start")).otherwise(F.col("mid")).alias("start"), F.when(F.col("part") == 0, F.col("mid")).otherwise(F.col("end")).alias("end"))


@query("w17_peak", f"with {SPANS} select meeting_id, max(active)::bigint as peak from act group by meeting_id")
def _(t):
    own = W.union_spans(_tracks(t, "span"), ["meeting_id", "speaker"], "span_start", "span_end")
    return W.concurrency(own, "meeting_id", "span_start", "span_end").groupBy("meeting_id").agg(F.max("active").alias("peak"))


@query("a13_talk_time", f'select meeting_id, speaker, sum("end" - start)::bigint as total from {SEG} group by all')
def _(t):
    return _segments(t).groupBy("meeting_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("total"))


@query("p5_windows", f'select meeting_id, segment_index, at, least(at + 1500, "end") as until from (select *, unnest(case when "end" - start >= 1500 then range(start, "end" - 1500 + 1, 500) else [start] end) as at from {SEG})')
def _(t):
    return I.windows(_segments(t)).select("meeting_id", "segment_index", "at", "until")


@query(
    "g7_gap_clusters",
    f"""select event_id, sum(brk) over (partition by session order by at, event_id rows unbounded preceding)::bigint as cluster from (select *, case when at - lag(at) over (partition by session order by at, event_id) <= 7200000000 then 0 else 1 end as brk from {EVENTS})""",
)
def _(t):
    order = ["at", "event_id"]
    return W.islands(_events(t), ["session"], order, F.col("at") - W.before("at", ["session"], order) > 7_200_000_000, "cluster").select("event_id", "cluster")


@query("g8_median_width", "select event_type as kind, median(value) as width from events group by event_type")
def _(t):
    return t("activity").groupBy("kind").agg(F.median("value").alias("width"))


@query("g10_font_style", "select file_id, case when size >= 20 then 'title' when size >= 14 then 'heading' when size >= 9 then 'body' else 'caption' end as style from {files}")
def _(t):
    from plenum.operators.layout import style_of

    return t("files").select("file_id", style_of(F.col("size")).alias("style"))


@query(
    "g5_paragraphs",
    f"""with b as (select *, case when kind = 'error' or lag(kind) over w = 'error' or kind <> lag(kind) over w or at - lag(at) over w > 18000000000 or lag(at) over w is null then 1 else 0 end as brk from {EVENTS} window w as (partition by session order by at, event_id)),
r as (select *, sum(brk) over (partition by session order by at, event_id rows unbounded preceding) as block from b)
select session, block::bigint as block, kind as style, count(*) as parts from r group by session, block, kind""",
)
def _(t):
    from plenum.operators.layout import paragraphs

    d = _events(t).select("session", F.struct("at", "event_id").alias("pos"), F.col("kind").alias("style"), F.col("at").alias("top"), F.col("at").alias("bottom"))
    return paragraphs(d, "session", gap=18_000_000_000, alone="error").groupBy("session", "block", "style").agg(F.count("*").alias("parts"))


@query(
    "x3_zero_runs",
    f"""with r as (select *, row_number() over (partition by session order by at, event_id) - row_number() over (partition by session, kind order by at, event_id) as run from {EVENTS})
select session, min(at) as at, max(at) - min(at) as length, max(at) - min(at) >= 7200000000 as warn from r where kind = 'error' group by session, run having max(at) - min(at) >= 1800000000""",
)
def _(t):
    order = ["at", "event_id"]
    d = W.islands(_events(t), ["session"], order, F.col("kind") != W.before("kind", ["session"], order), "run").where("kind = 'error'")
    g = d.groupBy("session", "run").agg(F.min("at").alias("at"), (F.max("at") - F.min("at")).alias("length")).where("length >= 1800000000")
    return g.select("session", "at", "length", (F.col("length") >= 7_200_000_000).alias("warn"))


#: Boxes and texts on pages, from numbers of the files; in the dialect that Spark and DuckDB share.
BOX = "file_id % 40 as page, cast(file_id % 7 * 10 as double) as {x}x0, cast(file_id % 11 * 10 as double) as {x}y0, cast(file_id % 7 * 10 + size % 5 * 8 + 5 as double) as {x}x1, cast(file_id % 11 * 10 + size % 9 * 6 + 5 as double) as {x}y1"
AREA = "greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) / ((ax1 - ax0) * (ay1 - ay0))"


def _boxes(t, prefix: str, where: str, *more: str):
    return t("files").where(where).selectExpr(*BOX.replace("{x}", prefix).split(", "), *more)


FIGURES = "(select file_id as figure, " + BOX.replace("{x}", "a") + " from {files} where file_id % 3 = 0)"


@query("g1_over_tables", f"select distinct f.page, f.figure from {FIGURES} f join (select {BOX.replace('{x}', 'b')} from {{files}} where file_id % 3 = 1 and size % 2 = 0) t on f.page = t.page where {AREA} >= 0.5")
def _(t):
    from plenum.operators.layout import over_tables

    null = "cast(null as string)"
    cells = f"case when size % 2 = 0 then array(array('a', 'b'), array('c', {null})) when size % 4 = 1 then array(array('a', 'b'), array(' ', {null})) else array(array('a'), array('b')) end as cells"
    return over_tables(_boxes(t, "a", "file_id % 3 = 0", "file_id as figure"), _boxes(t, "b", "file_id % 3 = 1", cells))


@query(
    "g2_over_text",
    f"""with h as (select f.page, f.figure, unnest(range(greatest(0, floor((greatest(by0, ay0) - ay0) / ((ay1 - ay0) / 40))::int), least(40, floor((least(by1, ay1) - ay0) / ((ay1 - ay0) / 40))::int + 1))) as band
 from {FIGURES} f join (select filename as text, {BOX.replace('{x}', 'b')} from {{files}} where file_id % 3 = 2) t on f.page = t.page where bx1 > ax0 and bx0 < ax1 and least(by1, ay1) > greatest(by0, ay0))
select page, figure from h group by page, figure having count(distinct band) >= 24""",
)
def _(t):
    from plenum.operators.layout import over_text

    return over_text(_boxes(t, "a", "file_id % 3 = 0", "file_id as figure"), _boxes(t, "b", "file_id % 3 = 2", "filename as text"))


@query("g3_contained", f"select distinct f.page, f.figure from {FIGURES} f join (select file_id as other, {BOX.replace('{x}', 'b')} from {{files}}) o on f.page = o.page and f.figure <> o.other where {AREA} >= 0.9")
def _(t):
    from plenum.operators.layout import contained

    return contained(_boxes(t, "a", "file_id % 3 = 0", "file_id as figure"), _boxes(t, "b", "true", "file_id as other"))


@query(
    "g4_trimmed",
    f"""with p as (select f.figure, o.other, f.ax0, f.ay0, f.ax1, f.ay1, o.bx0, o.by0, o.bx1, o.by1, least(ax1, bx1) - greatest(ax0, bx0) as w, least(ay1, by1) - greatest(ay0, by0) as h
 from {FIGURES} f join (select file_id as other, {BOX.replace('{x}', 'b')} from {{files}} where file_id % 3 = 1) o on f.page = o.page),
k as (select *, case when w <= 0 or h <= 0 then 0 when w >= (ax1 - ax0) * 0.8 and by1 >= ay1 - 1 then 1 when w >= (ax1 - ax0) * 0.8 and by0 <= ay0 + 1 then 2 when h >= (ay1 - ay0) * 0.8 and bx1 >= ax1 - 1 then 3 when h >= (ay1 - ay0) * 0.8 and bx0 <= ax0 + 1 then 4 else 0 end as k from p)
select figure, other, case when k = 4 then greatest(ax0, bx1) else ax0 end as x0, case when k = 2 then greatest(ay0, by1) else ay0 end as y0, case when k = 3 then least(ax1, bx0) else ax1 end as x1, case when k = 1 then least(ay1, by0) else ay1 end as y1 from k""",
)
def _(t):
    from plenum.operators.layout import meet_in_blocks, trimmed

    d = meet_in_blocks(_boxes(t, "a", "file_id % 3 = 0", "file_id as figure"), _boxes(t, "b", "file_id % 3 = 1", "file_id as other"))
    return trimmed(d).select("figure", "other", "x0", "y0", "x1", "y1")


@query("g6_reading_order")
def _(t):
    from plenum.operators.layout import reading_order

    return reading_order(_boxes(t, "", "true", "file_id as pos"))


@query("g9_joined_spans", "select meeting_id, string_agg(case when segment_index > 0 and segment_index % 3 > 0 then ' ' else '' end || speaker, '' order by segment_index) as text from {segments} group by meeting_id")
def _(t):
    from plenum.operators.layout import joined_spans

    i = F.col("segment_index")
    spans = t("segments").select(F.col("meeting_id").alias("line"), i.alias("pos"), F.col("speaker").alias("text"), (i * 10.0 + F.when(i % 3 > 0, 1).otherwise(-1)).alias("x0"), ((i + 1) * 10.0).alias("x1"))
    return joined_spans(spans, "line").select(F.col("line").alias("meeting_id"), "text")


@query(
    "j17_captions",
    """with f as (select file_id as figure, file_id % 40 as page, file_id % 7 * 10.0 as x0, file_id % 11 * 10.0 + 30 as y0, file_id % 7 * 10.0 + 20 as x1 from {files} where file_id % 3 = 0),
x as (select file_id % 40 as page, filename || file_id as text, case when size % 4 = 0 then 'heading' else 'body' end as style, file_id % 5 * 15.0 as tx0, file_id % 5 * 15.0 + size as tx1, file_id % 13 * 8.0 as bottom from {files} where file_id % 3 = 1)
select page, figure, text as caption from (select f.page, figure, text, row_number() over (partition by f.page, figure order by y0 - bottom, text) as n from f join x on f.page = x.page
 where y0 - bottom >= 0 and y0 - bottom <= case when style = 'heading' then 100 else 40 end and tx0 < x1 and x0 < tx1 and length(text) <= 80) where n = 1""",
)
def _(t):
    from plenum.operators.layout import nearest_caption

    i = F.col("file_id")
    f = t("files").where("file_id % 3 = 0").select((i % 40).alias("page"), i.alias("figure"), (i % 7 * 10.0).alias("x0"), (i % 11 * 10.0 + 30).alias("y0"), (i % 7 * 10.0 + 20).alias("x1"))
    x = t("files").where("file_id % 3 = 1").select((i % 40).alias("page"), F.concat("filename", i.cast("string")).alias("text"), F.when(F.col("size") % 4 == 0, "heading").otherwise("body").alias("style"), (i % 5 * 15.0).alias("tx0"), (i % 5 * 15.0 + F.col("size")).alias("tx1"), (i % 13 * 8.0).alias("bottom"))
    return nearest_caption(f, x)


@query(
    "j18_style_override",
    f"""with r as (select f.page, f.figure as line, o.region_rank, o.style, {AREA} as ratio from {FIGURES} f left join (select size % 4 as region_rank, 'r' || size % 4 as style, {BOX.replace('{x}', 'b')} from {{files}} where file_id % 3 = 1) o on f.page = o.page),
b as (select page, line, coalesce(ratio, 0) as ratio, region_rank, style, row_number() over (partition by page, line order by coalesce(ratio, 0) desc, region_rank desc nulls last) as n from r)
select page, line, case when ratio >= 0.5 and region_rank >= 2 then style end as style from b where n = 1""",
)
def _(t):
    from plenum.operators.layout import style_override

    lines = _boxes(t, "a", "file_id % 3 = 0", "file_id as line", "2 as rank")
    return style_override(lines, _boxes(t, "b", "file_id % 3 = 1", "size % 4 as region_rank", "concat('r', cast(size % 4 as string)) as style"))
