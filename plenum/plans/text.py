"""Queries of chunking, cleaning, quality and error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import cleaning as C
from plenum.functions import korean, scalars, scores, tables
from plenum.operators import chunking as K
from plenum.operators import evaluation as E

from .registry import query

PIECES = """pieces as (select doc_id as key, pos, trim(line, ' ') as text, case when pos = 1 then 'title' when length(line) < 60 then 'caption' when pos % 7 = 0 then 'heading' else 'body' end as style, pos // 5 + 1 as page from
 (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents))"""


def _pieces(t):
    d = t("chunks").select(F.col("chunk_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("pos", F.col("p") + 1)
    style = F.when(F.col("pos") == 1, "title").when(F.length("line") < 60, "caption").when(F.col("pos") % 7 == 0, "heading").otherwise("body")
    return d.select("key", "pos", F.col("line").alias("text"), style.alias("style"), (F.floor(F.col("pos") / 5) + 1).alias("page"))


@query(
    "c1_document_chunks",
    f"""with recursive {PIECES}, n as (select *, row_number() over (partition by key order by pos) as i from pieces where text <> '' and style <> 'caption'),
f as (select key, 0::bigint as i, 0::bigint as chunk, 0::bigint as lines, 0::bigint as chars, '' as title, '' as body, 1::bigint as page, null::varchar as done, null::bigint as done_page from (select distinct key from n)
 union all select n.key, n.i, f.chunk + (x.close)::int, case when x.head then 0 when x.close then 1 else f.lines + 1 end, case when x.close then 0 else f.chars end + case when x.head then 0 else length(n.text) end,
  case when x.head then n.text else f.title end, case when x.head then case when x.close then '' else f.body end when x.close or f.lines = 0 then n.text else f.body || chr(10) || n.text end, n.page,
  case when x.close then case when f.title = '' then f.body else f.title || chr(10) || f.body end end, case when x.close then f.page end
 from f join n on n.key = f.key and n.i = f.i + 1, lateral (select n.style in ('title', 'heading') as head, (n.style in ('title', 'heading') and f.lines > 0) or (n.style not in ('title', 'heading') and f.chars + length(n.text) > 1700 and f.chars >= 500) as close) x)
select key, (chunk - 1)::bigint as chunk, md5(done) as content, done_page as page from f where done is not null
union all select key, chunk, md5(case when title = '' then body when body = '' then title else title || chr(10) || body end), page from (select *, row_number() over (partition by key order by i desc) as back from f) where back = 1 and (title <> '' or body <> '')""",
)
def _(t):
    c = K.chunk_documents(_pieces(t), "key")
    return c.select("key", F.col("chunk").cast("bigint").alias("chunk"), F.md5("content").alias("content"), "page")


@query(
    "c2_transcript_chunks",
    """with recursive n as (select meeting_id as key, '[' || speaker || ']: ' || trim(text, ' ' || chr(10)) as line, speaker as who, start_ms as s, end_ms as e, row_number() over (partition by meeting_id order by segment_index) as i from {segments} where trim(coalesce(text, ''), ' ' || chr(10)) <> ''),
f as (select key, 0::bigint as i, 0::bigint as chunk, '' as body, 0::bigint as chars, null::varchar as who, 0::bigint as s, 0::bigint as e, null::varchar as done, 0::bigint as ds, 0::bigint as de from (select distinct key from n)
 union all select n.key, n.i, f.chunk + x.close::int, case when x.close or f.body = '' then n.line else f.body || chr(10) || n.line end, case when x.close then 0 else f.chars end + length(n.line), n.who,
  case when x.close or f.body = '' then n.s else f.s end, n.e, case when x.close then f.body end, f.s, f.e
 from f join n on n.key = f.key and n.i = f.i + 1, lateral (select f.body <> '' and (f.who <> n.who or (f.chars + length(n.line) > 800 and f.chars >= 300)) as close) x)
select key, (chunk - 1)::bigint as chunk, md5(done) as content, ds as start_ms, de as end_ms from f where done is not null
union all select key, chunk, md5(body), s, e from (select *, row_number() over (partition by key order by i desc) as back from f) where back = 1 and body <> ''""",
)
def _(t):
    s = t("segments").select(F.col("meeting_id").alias("key"), F.col("segment_index").alias("pos"), "speaker", "text", "start_ms", "end_ms")
    return K.chunk_transcripts(s, "key").select("key", F.col("chunk").cast("bigint").alias("chunk"), F.md5("content").alias("content"), "start_ms", "end_ms")


@query("c3_chunk_ids", "select meeting_id as key, meeting_id || '_chunk_' || lpad(segment_index::varchar, 4, '0') as id from {segments}")
def _(t):
    return K.chunk_ids(t("segments").select(F.col("meeting_id").alias("key"), F.col("segment_index").alias("chunk")), "key").select("key", "id")


@query("c4_transcript", "select meeting_id as key, md5(string_agg('[' || i || '][' || speaker || ']: ' || coalesce(text, ''), chr(10) order by segment_index)) as text from (select *, row_number() over (partition by meeting_id order by segment_index) - 1 as i from {segments}) group by meeting_id")
def _(t):
    s = t("segments").select(F.col("meeting_id").alias("key"), F.col("segment_index").alias("pos"), "speaker", "text")
    return K.transcript(s, "key").select("key", F.md5("text").alias("text"))


@query("c5_chunk_decisions", "select c.chunk_id, string_agg(d.decision_id, ',' order by d.decision_id) as decisions from {chunks} c join {decisions} d on c.chunk_id = d.meeting_id group by c.chunk_id")
def _(t):
    d = t("decisions").select(F.col("meeting_id").alias("chunk_id"), "decision_id")
    g = t("chunks").select("chunk_id").join(d, "chunk_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list("decision_id")).alias("x"))
    return g.select("chunk_id", F.array_join("x", ",").alias("decisions"))


@query("t1_no_tags", "select page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) as text from {web}")
def _(t):
    return t("web").select("page_id", F.md5(C.no_tags(F.col("html"))).alias("text"))


@query("t2_no_latex", "select chunk_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\\\[a-zA-Z]+\\{([^{}]*)\\}', '\\1', 'g'), '\\\\[a-zA-Z]+', '', 'g'), '[{}]', '', 'g')) as text from {chunks}")
def _(t):
    return t("chunks").select("chunk_id", F.md5(C.no_latex(F.col("text"))).alias("text"))


#: Inputs that hold what the rules look for, in the dialect that Spark and DuckDB share.
MISREAD = "replace(replace(replace(replace(replace(coalesce(text, ''), ' th', ' O1'), 'an ', '2l '), 'er', 'rn'), ', ', ' 1 2 3 4 5 -- '), '. ', '.... 1O ')"
FOREIGN = "replace(replace(replace(coalesce(text, ''), ' de ', ' җӨ '), ' the ', ' α值  '), ' und ', ' жa ')"
NOISY = "replace(replace(replace(coalesce(text, ''), '. ', concat(chr(10), ' *-* ', chr(10), chr(10), '__', chr(10))), ', ', concat(chr(10), '%%%%% a', chr(10), '%%% ab', chr(10))), ' e', concat(chr(10), '.....', chr(10)))"
LOOSE = "replace(replace(coalesce(text, ''), ' e', '   e'), '. ', concat(chr(10), chr(10), chr(10), chr(10), ' '))"
SHORT = "replace(replace(translate(coalesce(text, ''), 'aeiou', '가나다라마'), ' ', chr(10)), '.', ' ')"


@query(
    "t3_corrections",
    "with x as (select chunk_id, " + MISREAD + " as x from {chunks}), a as (select chunk_id, regexp_replace(regexp_replace(x, '\\.{3,}', '…', 'g'), '-{2,}', '—', 'g') as x from x),\n"
    "b as (select chunk_id, regexp_replace(regexp_replace(x, '(^|[^\\p{L}\\p{N}_])O(\\p{Nd})', '\\10\\2', 'g'), '(\\p{Nd})O($|[^\\p{L}\\p{N}_])', '\\10\\2', 'g') as x from a),\n"
    "c as (select chunk_id, regexp_replace(regexp_replace(x, '(^|[^\\p{L}\\p{N}_])l(\\p{Nd})', '\\11\\2', 'g'), '(\\p{Nd})l($|[^\\p{L}\\p{N}_])', '\\11\\2', 'g') as x from b),\n"
    "d as (select chunk_id, regexp_replace(regexp_replace(regexp_replace(x, '([가-힣])-\\n([가-힣])', '\\1\\2', 'g'), 'rn([가-힣\\s])', 'm\\1', 'g'), '([가-힣\\s])rn', '\\1m', 'g') as x from c)\n"
    "select chunk_id, md5(array_to_string(list_transform(list_zip(string_split_regex(x, '\\b[0-9](?:\\s[0-9]){3,}\\b'), list_append(regexp_extract_all(x, '\\b[0-9](?:\\s[0-9]){3,}\\b'), '')), lambda p: p[1] || replace(p[2], ' ', '')), '')) as text from d",
)
def _(t):
    return t("chunks").select("chunk_id", F.md5(C.corrected(F.expr(MISREAD))).alias("text"))


ALLOWED = "\\x{0000}-\\x{03FF}\\x{1100}-\\x{11FF}\\x{2000}-\\x{2BFF}\\x{3000}-\\x{33FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FFEF}"


@query(
    "t4_known_scripts",
    "with x as (select chunk_id, unnest(string_split(x, chr(10))) as line, generate_subscripts(string_split(x, chr(10)), 1) as n from (select chunk_id, " + FOREIGN + " as x from {chunks})),\n"
    "w as (select chunk_id, n, array_to_string(list_transform(string_split(line, ' '), lambda w: case when regexp_matches(w, '[^" + ALLOWED + "]') and not regexp_matches(regexp_replace(w, '[^" + ALLOWED + "]', '', 'g'), '[\\p{L}\\p{Nd}]') then '' else w end), ' ') as line from x)\n"
    "select chunk_id, md5(string_agg(trim(regexp_replace(line, ' {2,}', ' ', 'g')), chr(10) order by n)) as text from w group by chunk_id",
)
def _(t):
    return t("chunks").select("chunk_id", F.md5(C.known_scripts(F.expr(FOREIGN))).alias("text"))


@query(
    "t5_noise_lines",
    "with x as (select chunk_id, list_transform(string_split(" + NOISY + ", chr(10)), lambda l: struct_pack(l := l, s := trim(l, ' ' || chr(9) || chr(13)))) as x from {chunks})\n"
    "select chunk_id, md5(array_to_string(list_transform(list_filter(x, lambda e: e.s = '' or not (regexp_matches(e.s, '^[^\\p{L}\\p{N}_]{1,4}$') or (length(e.s) <= 2 and not regexp_matches(e.s, '[\\p{L}\\p{N}]')) or length(regexp_replace(e.s, '[\\p{L}\\p{N}\\s]', '', 'g')) > 0.6 * length(e.s))), lambda e: case when e.s = '' then '' else e.l end), chr(10))) as text from x",
)
def _(t):
    return t("chunks").select("chunk_id", F.md5(C.no_noise_lines(F.expr(NOISY))).alias("text"))


@query("t6_tidy", "select chunk_id, md5(trim(regexp_replace(regexp_replace(" + LOOSE + ", ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) as text from {chunks}")
def _(t):
    return t("chunks").select("chunk_id", F.md5(C.tidy(F.expr(LOOSE))).alias("text"))


@query("t7_clean_chain")
def _(t):
    return t("web").select("page_id", F.md5(C.cleaned(F.col("html"))).alias("text"))


@query("t8_joined_letters", "select event_id, '회의록' || case when event_id % 2 = 0 then ' 정리 가 나' else 'A B C' end as text from {activity}")
def _(t):
    tail = F.when(F.col("event_id") % 2 == 0, " 정리 가 나").otherwise("A B C")
    return t("activity").select("event_id", C.joined_letters(F.concat(F.lit("회 의 록"), F.when(F.col("event_id") % 2 == 0, tail).otherwise(F.lit("")))).alias("x"), tail.alias("tail")).select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("x")).otherwise(F.concat("x", "tail")).alias("text"))


@query("t9_joined_lines", "select chunk_id, md5(regexp_replace(" + SHORT + ", '(^|\\n)[ \\t]*([가-힣a-zA-Z]{1,2})[ \\t]*\\n([ \\t]*[가-힣][^\\n]{3,}[^\\s])', '\\1\\2\\3', 'g')) as text from {chunks}")
def _(t):
    return t("chunks").select("chunk_id", F.md5(C.joined_lines(F.expr(SHORT))).alias("text"))


@query("t10_vertical", "select event_id, ['회의록', 'a long line', 'x', 'y', event_id::varchar || '....'] as lines from {activity}")
def _(t):
    lines = F.array(*map(F.lit, ["회", "의", "록", "a long line", "x", "y"]), F.concat(F.col("event_id").cast("string"), F.lit("....")))
    return t("activity").select("event_id", C.vertical_restored(lines).alias("lines"))


@query("t12_digits", "select event_id, '서버 ' || (10 + event_id % 90) || '번 포트에서 16.8 정도, ' || (1 + event_id % 5) || '시' as text from {activity}")
def _(t):
    n = 10 + F.col("event_id") % 90
    sino = lambda d: F.element_at(F.array(*map(F.lit, ["", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"])), (d + 1).cast("int"))
    hour = F.element_at(F.array(*map(F.lit, ["한", "두", "세", "네", "다섯"])), (F.col("event_id") % 5 + 1).cast("int"))
    spoken = F.concat(F.lit("서버 "), sino(F.floor(n / 10)), F.lit("십"), sino(n % 10), F.lit("번 포트에서 십육 점 팔 정도, "), hour, F.lit(" 시"))
    return t("activity").select("event_id", korean.to_digits(spoken).alias("text"))


@query("t13_normal_form", "select event_id, trim(regexp_replace(regexp_replace(lower(props || ' - ' || event_type), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as text from events")
def _(t):
    return t("activity").select("event_id", C.normal_text(F.concat("props", F.lit(" - "), "kind")).alias("text"))


NAMES = "translate(cast(user_id % 1000 + 1000 as string), '0123456789', '김이박최정강조윤장임')"


@query("t14_introduced_name", "select user_id, case when user_id % 4 < 3 then " + NAMES + " end as name from {users}")
def _(t):
    name, k = F.expr(NAMES), F.col("user_id") % 4
    text = F.when(k == 0, F.concat(F.lit("네, 안녕하세요, "), name, F.lit("입니다"))).when(k == 1, F.concat(name, F.lit(" 이에요."))).when(k == 2, F.concat(F.lit("안녕하세요 "), name, F.lit(" 예요"))).otherwise("안녕하세요")
    return t("users").select("user_id", korean.introduced_name(text).alias("name"))


@query("t27_message_parts", "select decision_id, case when line = 1 then decision_id when line = 2 then 'v' || weight end as new_text, case when line = 1 then status || chr(10) || 'x' when line = 2 then status end as existing, case when line = 2 then 'r' || topic_id end as reason from {decisions}")
def _(t):
    conflict = F.concat(F.lit("'"), "decision_id", F.lit("'라고 하셨는데, 기존 자료("), F.col("topic_id").cast("string"), F.lit(")의 '"), "status", F.lit("\nx'와 다릅니다."))
    change = F.concat(F.lit("결정 변경: 'v"), F.col("weight").cast("string"), F.lit("' (기존: '"), "status", F.lit("', 사유: r"), F.col("topic_id").cast("string"), F.lit(")."))
    text = F.when(F.col("line") == 1, conflict).when(F.col("line") == 2, change).otherwise(F.col("decision_id"))
    return t("decisions").select("decision_id", korean.message_parts(text).alias("m")).select("decision_id", F.col("m.new").alias("new_text"), "m.existing", "m.reason")


@query("e13_spoken_text", "select event_id, ' ' || case when event_id % 2 = 0 then event_id::varchar else '하나' end || ' 그 ' || kind as text from {activity}")
def _(t):
    raw = F.concat(F.lit("b/("), F.col("event_id").cast("string"), F.lit(")/(하나)+그/"), "kind")
    return t("activity").select("event_id", F.when(F.col("event_id") % 2 == 0, korean.spoken_text(raw)).otherwise(korean.spoken_text(raw, written=False)).alias("text"))


@query("s10_refine", "select question_id, case when question_id % 2 = 0 then 'the budget ' || question_id else 'please ' || (question_id % 10) end as text from {questions}")
def _(t):
    raw = F.when(F.col("question_id") % 2 == 0, F.concat(F.lit("please  tell me the budget "), F.col("question_id").cast("string"))).otherwise(F.concat(F.lit("please "), (F.col("question_id") % 10).cast("string")))
    return t("questions").select("question_id", scalars.refine(raw, ["please", "tell me"]).alias("text"))


@query("s12_citations", "select event_id, case when event_id % 3 = 0 then [1, 3] when event_id % 3 = 1 then [1, 2, 3] else [2] end as cited from {activity}")
def _(t):
    k = F.col("event_id") % 3
    answer = F.concat(F.col("kind"), F.when(k == 0, " [출처: 1,3,9]").when(k == 1, " [출처: 7]").otherwise("[출처: 2, 2] "))
    return t("activity").select("event_id", scalars.citations(answer, F.lit(3)).alias("cited"))


TABLE = "concat('intro', chr(10), '| name | size ||', chr(10), '|---|:-:|', chr(10), '|  ', filename, ' | 1,', lpad(cast(size as string), 3, '0'), '억원 | more |', chr(10), 'end x', chr(10), '| a | b |')"


@query("c6_markdown_tables", "select file_id, 1 as n_tables, 'name,size;' || filename || ',1_' || lpad(size::varchar, 3, '0') || '억원,more' as cells from {files}")
def _(t):
    m = t("files").select("file_id", tables.markdown_tables(F.expr(TABLE)).alias("m"))
    flat = F.array_join(F.transform(F.col("m")[0], lambda r: F.array_join(r, ",")), ";")
    return m.select("file_id", F.size("m").alias("n_tables"), F.regexp_replace(flat, "1,", "1_").alias("cells"))


@query("c7_numbers", "select file_id, case when file_id % 4 = 0 then null else (1000 + size)::double end as number from {files}")
def _(t):
    return t("files").select("file_id", scalars.number_of(F.when(F.col("file_id") % 4 == 0, "많음").otherwise(F.concat(F.lit("(1,"), F.lpad(F.col("size").cast("string"), 3, "0"), F.lit("억원%)")))).alias("number"))


@query("c8_records", "select file_id, unnest(['name', 'size', 'col2']) as name, unnest([filename, '1,' || lpad(size::varchar, 3, '0') || '억원', 'more']) as text, unnest([null, 1000.0 + size, null])::double as number from {files}")
def _(t):
    r = t("files").select("file_id", F.explode(F.flatten(F.transform(tables.markdown_tables(F.expr(TABLE)), tables.records))).alias("r"))
    return r.select("file_id", F.explode("r").alias("c")).select("file_id", "c.*")


@query("c9_clean_table", "select file_id, '| a b | c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || filename || ' |  |' as markdown from {files}")
def _(t):
    null = F.lit(None).cast("string")
    table = F.array(F.array(null, F.lit("  ")), F.array(F.lit(" a  b"), F.lit("c")), F.array(F.col("filename")), F.array(F.lit(""), null))
    return t("files").select("file_id", tables.to_markdown(tables.clean_table(table)).alias("markdown"))


@query(
    "u4_repeated_records",
    "with r as (select chunk_id, line, pos, split_part(line, ' ', 1) as head from (select chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from {chunks}))\n"
    "select chunk_id, line, pos from (select *, row_number() over (partition by chunk_id, line order by pos) as rn, count(*) over (partition by chunk_id, line) as n from r) where (n < 3 or rn = 1) and head <> 'name'",
)
def _(t):
    from plenum.operators.windows import drop_repeats

    null = F.lit(None).cast("double")
    lines = t("chunks").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    record = F.array(F.struct(F.lit("name").alias("name"), F.substring_index("line", " ", 1).alias("text"), null.alias("number")))
    rows = lines.where(~tables.is_echo(record))
    return drop_repeats(rows, ["chunk_id", "line"], "pos", 3).select("chunk_id", "line", "pos")


CHART = "select label, list(struct_pack(a := a, b := b) order by vec_id) as r from (select label, vec_id, round(embedding[1], case when label % 3 = 0 then 0 else 3 end) * (label % 2) as a, case when label % 4 = 0 then round(embedding[1], case when label % 3 = 0 then 0 else 3 end) * (label % 2) else round(embedding[2], 3) end as b from embeddings) group by label"


@query(
    "t19_charts",
    "select label, len(n) >= 8 and len(list_distinct(n)) = 1 as made_up, same >= 0.8 * rows as same_series, not (len(n) >= 8 and len(list_distinct(n)) = 1) and not (same >= 0.8 * rows) as reliable from (select label, list_concat(list_transform(r, lambda x: x.a), list_transform(r, lambda x: x.b)) as n, len(r) as rows, len(list_filter(r, lambda x: x.a = x.b)) as same from (" + CHART + "))",
)
def _(t):
    k = F.col("label")
    num = lambda i: F.col("embedding")[i].cast("double")
    a = F.when(k % 3 == 0, F.round(num(0), 0)).otherwise(F.round(num(0), 3)) * (k % 2)
    cells = F.array(F.struct(F.lit("a").alias("name"), F.lit("").alias("text"), a.alias("number")), F.struct(F.lit("b").alias("name"), F.lit("").alias("text"), F.when(k % 4 == 0, a).otherwise(F.round(num(1), 3)).alias("number")))
    g = t("vectors").groupBy("label").agg(F.collect_list(cells).alias("rows"))
    return g.select("label", tables.made_up(F.col("rows")).alias("made_up"), tables.same_series(F.col("rows")).alias("same_series"), tables.reliable(F.col("rows")).alias("reliable"))


@query("t19_titles", "select file_id, file_id % 5 = 0 as valid from {files}")
def _(t):
    k = F.col("file_id") % 5
    title = F.when(k == 0, F.col("filename")).when(k == 1, F.concat(F.lit("-"), F.col("size").cast("string"), F.lit(".5"))).when(k == 2, F.concat(F.lit("출처 "), "filename")).when(k == 3, "(% WoW)").otherwise(" 그래프 ")
    return t("files").select("file_id", tables.title_valid(title).alias("valid"))


@query(
    "t16_common_prefix",
    """with w as (select meeting_id, segment_index, string_split(coalesce(text, ''), ' ') as w, lag(string_split(coalesce(text, ''), ' ')) over (partition by meeting_id order by segment_index) as p from {segments})
select meeting_id, segment_index, coalesce((select min(i) - 1 from range(1, 2 + least(len(w), len(p))) r(i) where w[i] is distinct from p[i] or i > least(len(w), len(p))), 0)::int as agreed from w""",
)
def _(t):
    from pyspark.sql import Window

    words = F.split(F.coalesce("text", F.lit("")), " ")
    d = t("segments").withColumn("w", words).withColumn("p", F.lag("w").over(Window.partitionBy("meeting_id").orderBy("segment_index")))
    return d.select("meeting_id", "segment_index", F.when(F.col("p").isNull(), 0).otherwise(F.size(scalars.common_prefix(F.col("w"), F.col("p")))).alias("agreed"))


@query(
    "t17_fallback_summary",
    """select chunk_id, case when length(s) > 500 then substring(s, 1, 500) || '...' else s end as summary from (select chunk_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:8], ' ') as s from {chunks})""",
)
def _(t):
    return t("chunks").select("chunk_id", C.first_lines(F.col("text")).alias("summary"))


@query("t18_edit_gate", "select user_id, levenshtein(name, team) * 1.0 / greatest(length(name), 1) <= 0.35 and length(team) * 1.0 / greatest(length(name), 1) between 0.7 and 1.4 as accepted from {users}")
def _(t):
    return t("users").select("user_id", C.edit_gate(F.col("name"), F.col("team")).alias("accepted"))


@query("t20_merged_statement", "select chunk_id, len(regexp_extract_all(text || ' ', '[.!?다요죠]\\s')) >= 3 as merged from {chunks} where text is not null")
def _(t):
    return t("chunks").where("text is not null").select("chunk_id", C.merged_statement(F.col("text")).alias("merged"))


@query("t21_json_block", "select event_id, json_extract_string(regexp_extract('noise ' || props || ' more', '\\{.*\\}'), '$.k') as k from {activity}")
def _(t):
    noisy = F.concat(F.lit("noise "), "props", F.lit(" more"))
    return t("activity").select("event_id", F.get_json_object(scalars.json_block(noisy), "$.k").alias("k"))


@query("t22_topic_status", "select event_id, case when kind in ('view', 'click') then kind else 'open' end as status from {activity}")
def _(t):
    return t("activity").select("event_id", scalars.whitelisted(F.upper("kind"), ["view", "click"], "open").alias("status"))


@query("t23_clock_label", "select event_id, case when hour(l) < 12 then '오전 ' else '오후 ' end || case when hour(l) % 12 = 0 then 12 else hour(l) % 12 end || ':' || lpad(minute(l)::varchar, 2, '0') as label from (select event_id, ts + interval 9 hour as l from {activity})")
def _(t):
    return t("activity").select("event_id", scalars.clock_label(F.col("ts").cast("timestamp")).alias("label"))


@query("t24_decision_date", "select meeting_id, coalesce(strftime(started_at + interval 9 hour, '%Y-%m-%d'), 'unknown') as day from {meetings}")
def _(t):
    return t("meetings").select("meeting_id", scalars.local_date(F.col("started_at").cast("timestamp"), "unknown").alias("day"))


@query("t25_due_date", "select meeting_id, cast(try_cast(case when meeting_id % 3 = 0 then '2024-02-30' when meeting_id % 3 = 1 then 'soon' else strftime(scheduled_at, '%Y-%m-%d') end as date) as varchar) as due from {meetings}")
def _(t):
    text = F.when(F.col("meeting_id") % 3 == 0, "2024-02-30").when(F.col("meeting_id") % 3 == 1, "soon").otherwise(F.date_format("scheduled_at", "yyyy-MM-dd"))
    return t("meetings").select("meeting_id", scalars.due_date(text).cast("string").alias("due"))


@query("t26_preview", "select chunk_id, case when length(text) > 80 then substring(text, 1, 80) || '…' else text end as preview from {chunks}")
def _(t):
    return t("chunks").select("chunk_id", scalars.shorten(F.col("text"), 80).alias("preview"))


@query("t28_export_sections", "select meeting_id, concat_ws(chr(10), title, case when status = 'completed' then 'done' end, case when started_at is not null then category end) as text from {meetings}")
def _(t):
    return t("meetings").select("meeting_id", F.concat_ws("\n", "title", F.when(F.col("status") == "completed", "done"), F.when(F.col("started_at").isNotNull(), F.col("category"))).alias("text"))


LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"
TOP = "case when len(ls) >= 3 then list_max(map_values(list_histogram(ls))) * 1.0 / len(ls) else 0 end"


@query("a11_line_repeat", f"select chunk_id, round({TOP}, 9) as ratio from (select chunk_id, {LINES} as ls from {{chunks}})")
def _(t):
    return t("chunks").select("chunk_id", F.round(scores.most_repeated(scores.lines_of(F.coalesce("text", F.lit(""))), 3), 9).alias("ratio"))


QUALITY = f"""select chunk_id, case when solid = '' then 0 else round(least(length(regexp_replace(solid, '[^A-Za-z0-9가-힣]', '', 'g')) * 1.0 / length(solid) / 0.40, 1) * 0.45
 + len(list_filter(ls, lambda x: regexp_matches(x, '[A-Za-z0-9가-힣]'))) * 1.0 / len(ls) * 0.35 + greatest(1 - ({TOP}) * 2, 0) * 0.20, 3) end as score
 from (select chunk_id, regexp_replace(coalesce(text, ''), '[ \\n\\t]', '', 'g') as solid, {LINES} as ls from {{chunks}})"""


@query("q1_ocr_quality", QUALITY)
def _(t):
    return t("chunks").select("chunk_id", scores.ocr_quality(F.col("text")).alias("score"))


@query("q2_useful", f"select chunk_id from ({QUALITY}) where score >= 0.35")
def _(t):
    return t("chunks").where(scores.ocr_quality(F.col("text")) >= 0.35).select("chunk_id")


@query(
    "q3_text_quality",
    f"""with {PIECES.replace("trim(line, ' ')", 'line')}, s as (select key, style, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from pieces),
m as (select key, style, s, case when s = '' then 0 else (length(s) - length(regexp_replace(s, '[가-힣ᄀ-ᇿ]', '', 'g'))) / length(s)::double * 0.15 + least(length(s) / 50.0::double, 1) * 0.25
 + (1 - (length(s) - length(regexp_replace(s, '[□▯�\\x00]', '', 'g'))) / length(s)::double) * 0.30
 + (1 - least((length(s) - length(regexp_replace(s, '[^\\p{{L}}\\p{{N}}\\s\\p{{P}}.,!?:;()\\[\\]{{}}%+\\-=@#/\\\\"''…—·]', '', 'g'))) / length(s)::double * 5, 1)) * 0.15
 + (1 - least((length(s) - length(regexp_replace(s, '\\s', '', 'g'))) / length(s)::double * 2, 1)) * 0.10 end as q from s)
select key, round(least(avg(q) * 0.95 + case when bool_or(style in ('title', 'heading')) then 1.0 else 0.5 end * 0.05::double, 1), 3) as score from m group by key""",
)
def _(t):
    p = _pieces(t)
    g = p.groupBy("key").agg(F.avg(scores.block_quality(F.col("text"))).alias("mean"), F.bool_or(F.col("style").isin("title", "heading")).alias("titled"))
    return g.select("key", scores.text_quality(F.col("mean"), F.col("titled")).alias("score"))


@query("a12_mean_score", "select folder, round(avg(size), 3) as mean from {files} group by folder")
def _(t):
    return t("files").groupBy("folder").agg(F.round(F.avg("size"), 3).alias("mean"))


@query("q6_overall", "select chunk_id, case when quality is null and toxic is null then 1.0 else round((coalesce(quality, 0) + coalesce(1 - toxic, 0)) * 1.0 / ((quality is not null)::int + (toxic is not null)::int), 3) end as score from {chunks} left join {marks} using (chunk_id)")
def _(t):
    d = t("chunks").select("chunk_id").join(t("marks"), "chunk_id", "left")
    return d.select("chunk_id", scores.overall(F.col("quality").cast("double"), (1 - F.col("toxic")).cast("double")).alias("score"))


@query("q7_document_status", "select chunk_id, case when n = 0 then 'error' when n < 5 then 'uploaded' else 'processed' end as status from (select chunk_id, len(string_split(text, chr(10))) as n from {chunks})")
def _(t):
    n = F.size(F.split("text", "\n"))
    return t("chunks").select("chunk_id", scores.document_status(n, n / 7.0).alias("status"))


TOKENS = "select chunk_id, collection, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) as token from {chunks}"


@query(
    "a15_term_specificity",
    f"""with t as (select * from ({TOKENS}) where token <> ''), g as (select token, count(*) as g from t group by token), s as (select token, count(*) as s from t where collection = 'en' group by token having count(*) >= 5),
n as (select count(*) as gn, count(*) filter (collection = 'en') as sn from t), r as (select token, s.s as n, round((s.s * 1.0 / sn) / (g.g * 1.0 / gn + 1e-7), 6) as spec from s join g using (token), n)
select token, n, spec from r order by spec desc, n desc, token desc limit 300""",
)
def _(t):
    tok = t("chunks").select("collection", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("token")).where("token <> ''")
    own = F.count_if(F.col("collection") == "en")
    g = tok.groupBy("token").agg(F.count("*").alias("g"), own.alias("n"))
    total = g.agg(F.sum("g").alias("gn"), F.sum("n").alias("sn"))
    # One row of totals.
    r = g.where("n >= 5").crossJoin(F.broadcast(total)).withColumn("spec", F.round((F.col("n") / F.col("sn")) / (F.col("g") / F.col("gn") + 1e-7), 6))
    return r.select("token", "n", "spec").orderBy(F.desc("spec"), F.desc("n"), F.desc("token")).limit(300)


@query("a16_keywords", f"select regexp_replace(token, '(ing|tion|ment)$', '') as stem, count(*) as n from ({TOKENS}) where length(token) >= 4 and token not in ('that', 'with') group by 1")
def _(t):
    tok = t("chunks").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("token"))
    tok = tok.where((F.length("token") >= 4) & ~F.col("token").isin("that", "with"))
    return tok.groupBy(F.regexp_replace("token", "(ing|tion|ment)$", "").alias("stem")).agg(F.count("*").alias("n"))


@query("e1_char_errors", "select user_id, levenshtein(email, lower(team) || '#' || user_id) as errors from {users}")
def _(t):
    return t("users").select("user_id", F.levenshtein("email", F.concat(F.lower("team"), F.lit("#"), F.col("user_id").cast("string"))).alias("errors"))


@query("a14_corpus_rate", "select workspace_id, round(sum(levenshtein(email, lower(team))) * 1.0 / greatest(sum(length(email)), 1), 9) as rate from {users} group by workspace_id")
def _(t):
    d = t("users").select("workspace_id", F.levenshtein("email", F.lower("team")).alias("errors"), F.length("email").alias("total"))
    return d.groupBy("workspace_id").agg(F.round(E.corpus_rate("errors", "total"), 9).alias("rate"))


HEARD = "replace(replace(coalesce(text, ''), ' thou ', ' though '), 'ing', 'in g')"
PLAIN = "trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
BARE = "replace(" + PLAIN.replace("{x}", "{y}") + ", ' ', '')"


@query(
    "e2_term_recall",
    "with p as (select question_id, " + BARE.replace("{y}", "text") + " as a, " + BARE.replace("{y}", HEARD) + " as b from {questions}), n as (select question_id, unnest(['thou', 'ing', 'hou']) as term, a, b from p),\n"
    "c as (select question_id, (length(a) - length(replace(a, term, ''))) // length(term) as na, (length(b) - length(replace(b, term, ''))) // length(term) as nb from n)\n"
    "select question_id, sum(na)::bigint as expected, sum(least(na, nb))::bigint as found from c group by question_id",
)
def _(t):
    r = E.term_recall(C.normal_text(F.col("text")), C.normal_text(F.expr(HEARD)), ["thou", "ing", "Hou!"])
    return t("questions").select("question_id", r.alias("r")).select("question_id", "r.*")


def _heard(t):
    return t("questions").select(F.col("question_id").alias("id"), F.col("text").alias("ref"), F.expr(HEARD).alias("hyp"))


@query("e3_aligned")
def _(t):
    return E.aligned(_heard(t))


@query("e4_biased_errors")
def _(t):
    return E.biased_errors(E.aligned(_heard(t)), ["thou", "though"])


@query("e1_word_errors")
def _(t):
    return _heard(t).select("id", E.word_distance(F.col("ref"), F.col("hyp")).alias("errors"))


CURVE = """p as (select event_id, score, label, sum(label) over w as tp, sum(1 - label) over w as fp, sum(label) over () as np, sum(1 - label) over () as nn from (select event_id, value / 500 as score, (event_id % 3 = 0)::int as label from events)
 window w as (order by score desc, event_id rows unbounded preceding)), c as (select *, 1 - tp * 1.0 / np as frr, fp * 1.0 / nn as far from p)"""


def _curve(t):
    d = t("activity").select("event_id", (F.col("value") / 500).alias("score"), (F.col("event_id") % 3 == 0).cast("int").alias("label"))
    return E.curve(d, "score", "label", "event_id")


@query("e6_equal_error", f"with {CURVE} select round((far + frr) / 2, 9) as eer from c order by round(abs(far - frr), 12), tp + fp limit 1")
def _(t):
    return E.equal_error_rate(_curve(t), "event_id").select(F.round("eer", 9).alias("eer"))


@query("e7_min_cost", f"with {CURVE} select round(min(0.01 * frr + 0.99 * far) / 0.01, 9) as min_dcf from c")
def _(t):
    return E.min_cost(_curve(t)).select(F.round("min_dcf", 9).alias("min_dcf"))


@query("e9_page_rate")
def _(t):
    d = E.page_errors(t("chunks").select(F.col("collection").alias("group"), F.col("text").alias("ref"), F.regexp_replace("text", "[#*`]", "").alias("hyp")))
    return d.groupBy(F.col("group").alias("lang")).agg(E.corpus_rate("char_errors", "chars").alias("cer"), E.corpus_rate("word_errors", "words").alias("wer"))


@query(
    "e12_z_scores",
    """with r as (select session_id, value, row_number() over (partition by session_id order by value desc, event_id) as n from {activity})
select session_id, round(max(value), 6) as top, round(coalesce(max(value) - max(value) filter (n > 1), 0), 6) as margin, round(case when count(*) > 2 then (max(value) - avg(value) filter (n > 1)) / (stddev_pop(value) filter (n > 1) + 1e-6) else 0 end, 6) as z from r group by session_id""",
)
def _(t):
    z = E.z_scores(t("activity"), "session_id", "value")
    return z.select("session_id", *(F.round(c, 6).alias(c) for c in ("top", "margin", "z")))


def _name_errors(t):
    other = F.regexp_replace("email", "[02468]", "")
    return t("users").select("user_id", F.levenshtein("email", F.lower("team")).alias("errors"), F.levenshtein("email", other).alias("errors_b"), F.length("email").alias("total"))


@query("e5_bootstrap")
def _(t):
    return E.bootstrap(_name_errors(t), "user_id", "errors", "total")


@query("e5_paired")
def _(t):
    return E.paired_bootstrap(_name_errors(t).withColumn("total_b", F.col("total")), "user_id", ("errors", "total"), ("errors_b", "total_b"))


@query("u7_unseen", "select chunk_id from {chunks} where chunk_id not in (select chunk_id from {marks}) order by md5(chunk_id::varchar), chunk_id limit 100")
def _(t):
    return E.unseen(t("chunks"), t("marks"), "chunk_id", 100).select("chunk_id")


@query(
    "e11_trials",
    """with w as (select session_id, event_id, kind, row_number() over (partition by session_id order by md5(event_id::varchar), event_id) as n from {activity})
select a.session_id, a.event_id as a, b.event_id as b, (a.kind = b.kind)::int as label from w a join w b on a.session_id = b.session_id and b.n in (a.n + 1, a.n + 2)""",
)
def _(t):
    return E.speaker_trials(t("activity"), "session_id", "kind", "event_id")
