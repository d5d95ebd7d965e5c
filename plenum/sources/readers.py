"""Sources and sinks: tables, manifests, trials, scripts, JSON with alternative keys, chunk files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.functions import tables as T


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (audio, text)."""
    return spark.read.schema("audio string, text string").json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated: label and two archive members."""
    return spark.read.schema("label int, zip1 string, member1 string, zip2 string, member2 string").csv(path, sep="\t")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, line of text files, large ones in several tasks: a line's number from 0 is that in its split and the lines of its file's splits before."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("row"))
    splits = d.groupBy("path", "at").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(splits.select("path", "at", "first", before.alias("before")), ["path", "at"]).select("path", (F.col("before") + F.col("row") - F.col("first")).alias("pos"), "line")


def read_script(spark: SparkSession, path: str, overlap: str = "[overlap]") -> DataFrame:
    """path, pos, speaker, text, overlapped of script files: ``name: text`` lines; # starts a comment. One file is one script."""
    line = F.trim("line")
    marked = line.startswith(overlap)
    body = F.when(marked, F.trim(F.substr(line, F.lit(len(overlap) + 1)))).otherwise(line)
    rows = read_lines(spark, path).where((line != "") & ~line.startswith("#")).select("path", "pos", body.alias("body"), marked.alias("overlapped"))
    return rows.where(F.contains("body", F.lit(":"))).select("path", "pos", F.trim(F.substring_index("body", ":", 1)).alias("speaker"), F.trim(F.substr("body", F.instr("body", ":") + 1)).alias("text"), "overlapped")


def first_present(json: str, *paths: str) -> Column:
    """The first of several JSON paths that holds something."""
    return F.coalesce(*(F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths))


def kind_of(path: str, kinds: dict[str, list[str]], default: str = "code") -> Column:
    """The kind of a file by its extension."""
    ext = F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1)
    return reduce(lambda c, k: c.when(ext.isin(*kinds[k]), k), kinds, F.when(F.lit(False), "")).otherwise(default)


def page_kind(pages: DataFrame, key: str, chars: str, least: int = 50, share: float = 0.7) -> DataFrame:
    """scanned, digital or mixed, by the share of pages with more than ``least`` characters."""
    text = F.avg((F.col(chars) > least).cast("double"))
    return pages.groupBy(key).agg(text.alias("t")).select(key, F.when(1 - F.col("t") >= share, "scanned").when(F.col("t") >= share, "digital").otherwise("mixed").alias("kind"))


def page_tables(tables: DataFrame, cells: str = "cells") -> DataFrame:
    """``tables`` (page_height, top, bottom, cells) that are filled and no headers or footers, with their ``markdown``."""
    ok = T.usable(F.col(cells), F.col("top"), F.col("bottom"), F.col("page_height"))
    return tables.where(F.coalesce(ok, F.lit(False))).withColumn("markdown", T.to_markdown(F.col(cells)))


def collection(spark: SparkSession, path: str, name: str, dimensions: int) -> DataFrame:
    """The vectors of one collection below ``path``; a collection that isn't there yet is made, empty. Similarity is the cosine."""
    schema = "id string, document_id string, workspace_id long, v array<float>, text string, metadata string"
    where = f"{path.rstrip('/')}/collection={name}/dimensions={dimensions}"
    try:
        return spark.read.schema(schema).parquet(where)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    spark.createDataFrame([], schema).write.mode("append").parquet(where)
    return spark.read.schema(schema).parquet(where)


def part_of(key: Column, parts: int = 64) -> Column:
    """The folder, of a fixed number, that holds the rows of a key; a folder for each key would be as many files as keys and tasks."""
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(parts)).cast("int")


def transcript(spark: SparkSession, path: str, meeting: int) -> DataFrame:
    """One meeting's appended segments in the order of their start; ``streaming.rules.append`` writes them."""
    rows = spark.read.parquet(path)
    if "part" in rows.columns:  # only the meeting's folder is read
        rows = rows.where(F.col("part") == part_of(F.lit(meeting)))
    return rows.where(F.col("meeting_id") == meeting).orderBy("start_ms", "segment_index")


def write_chunks(chunks: DataFrame, path: str, collection: str = "collection") -> None:
    """Chunk files, a folder for each collection, so that a search reads its own."""
    chunks.write.mode("append").partitionBy(collection).parquet(path)


def write_text(docs: DataFrame, path: str, column: str) -> None:
    docs.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; null fields are written, so that every line has all keys."""
    rows.write.option("ignoreNullFields", False).json(path)


def append_rows(rows: DataFrame, path: str, *partition: str) -> None:
    """Appends notifications, messages or other records."""
    rows.write.mode("append").partitionBy(*partition).parquet(path)
