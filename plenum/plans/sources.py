"""Queries of readers and sinks: rows are written in a source's format to the shared folder and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.shared import shared_folder
from plenum.sources import readers

from .registry import query


@query("io13_manifest", "select 'clip' || event_id || '.wav' as audio, kind || ' é' as text from {activity}")
def _(t):
    path = shared_folder(t.spark, "manifest")
    t("activity").select(F.concat(F.lit("clip"), F.col("event_id").cast("string"), F.lit(".wav")).alias("audio"), F.concat("kind", F.lit(" é")).alias("text")).write.json(path)
    return readers.read_manifest(t.spark, path)


@query("io14_trials", "select event_id % 2 as label, kind || '.zip' as zip1, 'm' || event_id as member1, 'b.zip' as zip2, props as member2 from {activity}")
def _(t):
    path = shared_folder(t.spark, "trials")
    e = F.col("event_id")
    rows = t("activity").select((e % 2).alias("label"), F.concat("kind", F.lit(".zip")), F.concat(F.lit("m"), e.cast("string")), F.lit("b.zip"), F.col("props"))
    rows.toDF("a", "b", "c", "d", "e").write.options(sep="\t", quote="", escape="").csv(path)
    return readers.read_trials(t.spark, path)


@query("io15_script", "select speaker, 'meeting ' || meeting_id || ': ' || segment_index as text, segment_index % 3 = 0 as overlapped from {segments}")
def _(t):
    path = shared_folder(t.spark, "scripts")
    i = F.col("segment_index")
    line = F.concat(F.when(i % 3 == 0, "[overlap]  ").otherwise("  "), "speaker", F.lit(" : meeting "), F.col("meeting_id").cast("string"), F.lit(": "), i.cast("string"), F.when(i % 2 == 0, "\n# a comment\n\nno speaker here").otherwise(""))
    # Sixteen scripts, each of many meetings; a reader takes a file for a script.
    t("segments").select((F.col("meeting_id") % 16).alias("script"), line.alias("value")).repartition("script").write.partitionBy("script").text(path)
    return readers.read_script(t.spark, path).select("speaker", "text", "overlapped")


@query("io9_json_sink", "select chunk_id, collection, case when chunk_id % 3 = 0 then null else n_chars end as n_chars from {chunks}")
def _(t):
    path = shared_folder(t.spark, "json")
    rows = t("chunks").select("chunk_id", "collection", F.when(F.col("chunk_id") % 3 != 0, F.col("n_chars")).alias("n_chars"))
    readers.write_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("io9_chunk_sink", "select collection, count(*) as n from {chunks} where collection in ('en', 'de') group by collection")
def _(t):
    path = shared_folder(t.spark, "chunks")
    readers.write_chunks(t("chunks"), path)
    return t.spark.read.parquet(path).where("collection in ('en', 'de')").groupBy("collection").agg(F.count("*").alias("n"))


@query("io12_transcript", "select segment_index, start_ms, text from {segments} where meeting_id = 7 order by start_ms, segment_index")
def _(t):
    path = shared_folder(t.spark, "transcript")
    s = t("segments")
    for half in (1, 0):  # later segments come first
        readers.append_rows(s.where(F.col("segment_index") % 2 == half).withColumn("part", readers.part_of(F.col("meeting_id"))).repartition("part"), path, "part")
    return readers.transcript(t.spark, path, 7).select("segment_index", "start_ms", "text")


@query("io17_notifications", "select session_id, kind, count(*) as n from {activity} where kind in ('error', 'signup') group by all")
def _(t):
    path = shared_folder(t.spark, "notifications")
    for kind in ("error", "signup"):
        readers.append_rows(t("activity").where(F.col("kind") == kind).select("session_id", "event_id", "kind"), path, "kind")
    return t.spark.read.parquet(path).groupBy("session_id", "kind").agg(F.count("*").alias("n"))


@query("io2_collection", "select 'v' || vec_id as id, label as workspace_id, len(embedding) as n from {vectors} where label % 2 = 0")
def _(t):
    path = shared_folder(t.spark, "vectors")
    empty = readers.collection(t.spark, path, "meetings", 64)
    null = F.lit(None).cast("string")
    new = t("vectors").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), null.alias("document_id"), F.col("label").cast("long").alias("workspace_id"), F.col("embedding").alias("v"), null.alias("text"), null.alias("metadata"))
    empty.unionByName(new).write.mode("append").parquet(f"{path}/collection=meetings/dimensions=64")
    return readers.collection(t.spark, path, "meetings", 64).where("workspace_id % 2 = 0").select("id", "workspace_id", F.size("v").alias("n"))
