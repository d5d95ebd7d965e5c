"""Chunks of documents and transcripts: the pieces of a document are walked in order, one open chunk is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.scores import stripped


class _Document:
    """The open chunk of a document: a title and lines."""

    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.lines, self.title, self.page, self.chars = [], "", 1, 0

    def close(self) -> tuple | None:
        content = "\n".join(x for x in (self.title, "\n".join(self.lines)) if x)
        return (content, self.page) if content else None

    def add(self, style: str, text: str, page: int) -> tuple | None:
        head = style in ("title", "heading")
        full = self.chars + len(text) > self.most and self.chars >= self.least
        ended = bool(self.lines) if head else full
        out = self.close() if ended else None
        self.chars = (0 if ended else self.chars) + (0 if head else len(text))
        self.lines = ([] if ended or head else self.lines) + ([] if head else [text])
        self.title, self.page = text if head else self.title, page
        return out


class _Transcript:
    """The open chunk of a transcript: lines of one speaker."""

    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.lines, self.chars, self.who, self.start, self.end = [], 0, None, 0, 0

    def close(self) -> tuple | None:
        return ("\n".join(self.lines), self.start, self.end) if self.lines else None

    def add(self, who: str, text: str, start: int, end: int) -> tuple | None:
        line, out = f"[{who}]: {text}", None
        if self.lines and (who != self.who or (self.chars + len(line) > self.most and self.chars >= self.least)):
            out, self.lines, self.chars = self.close(), [], 0
        if not self.lines:
            self.start = start
        self.lines.append(line)
        self.chars, self.who, self.end = self.chars + len(line), who, end
        return out


def _walk(pieces: DataFrame, key: str, columns: list[str], opened: Callable, schema: str) -> DataFrame:
    """Walks each key's pieces (key, pos, columns) in order; whatever ``opened()`` closes becomes a row, numbered from 0. A key of any length streams through its task."""
    kind = dict(pieces.dtypes)[key]
    ordered = pieces.select(key, "pos", *columns).repartition(key).sortWithinPartitions(key, "pos", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        names = [key, "chunk", *(c.split()[0] for c in schema.split(", "))]
        now, chunk, state = object(), 0, None
        for batch in batches:
            out = []

            def put(row):
                nonlocal chunk
                if row is not None:
                    out.append((now, chunk, *row))
                    chunk += 1

            for k, _, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or k != now:
                    put(state.close() if state else None)
                    now, chunk, state = k, 0, opened()
                put(state.add(*piece))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
        if state and (row := state.close()):
            yield pa.RecordBatch.from_pylist([dict(zip(names, (now, chunk, *row)))], schema=arrow)

    full = f"{key} {kind}, chunk int, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(pieces.sparkSession.createDataFrame([], full).schema)
    return ordered.mapInArrow(run, full)


def chunk_documents(pieces: DataFrame, key: str, most: int = 1700, least: int = 500) -> DataFrame:
    """key, chunk, content, page of ``pieces`` (key, pos, style, text, page).

    Captions and blank pieces go. A title or heading closes the chunk if it has a body and heads the next one;
    of titles in a row the last counts. A chunk closes before a piece that would take it over ``most``
    characters, once it has ``least``.
    """
    clean = pieces.select(key, "pos", F.coalesce("style", F.lit("body")).alias("style"), stripped(F.col("text")).alias("text"), F.col("page").cast("bigint").alias("page"))
    return _walk(clean.where("text <> '' and style <> 'caption'"), key, ["style", "text", "page"], lambda: _Document(most, least), "content string, page long")


def chunk_transcripts(segments: DataFrame, key: str, most: int = 800, least: int = 300) -> DataFrame:
    """key, chunk, content, start_ms, end_ms of ``segments`` (key, pos, speaker, text, start_ms, end_ms).

    A chunk closes when the speaker changes, or before a line that would take it over ``most`` characters once it has ``least``.
    """
    times = [F.col(c).cast("bigint").alias(c) for c in ("start_ms", "end_ms")]
    clean = segments.select(key, "pos", F.coalesce("speaker", F.lit("SPEAKER_00")).alias("who"), stripped(F.col("text")).alias("text"), *times)
    return _walk(clean.where("text <> ''"), key, ["who", "text", "start_ms", "end_ms"], lambda: _Transcript(most, least), "content string, start_ms long, end_ms long")


def chunk_ids(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.withColumn("id", F.format_string("%s_chunk_%04d", F.col(key).cast("string"), "chunk"))


def transcript(segments: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    """key, text: lines ``[i][speaker]: text`` from 0."""
    g = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("speaker", F.lit(missing)).alias("who"), F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    line = lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("]["), x["who"], F.lit("]: "), x["text"])
    return g.select(key, F.array_join(F.transform("p", line), "\n").alias("text"))
