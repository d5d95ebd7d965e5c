"""Scalar column functions: maps, dates, labels, routing, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlay(defaults: dict[str, str], stored: Column) -> Column:
    """``defaults`` with the stored values over them; unknown keys are kept."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.when(stored.isNull(), base).otherwise(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(stored, k)), stored))


def clamp_score(value: Column) -> Column:
    """0 to 1; what is no number is 0."""
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def routes(text: Column, signals: dict[str, list[str]]) -> Column:
    """The collections whose signal words occur in the text; all of them if none does."""
    hit = F.filter(F.array(*(F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words]), name) for name, words in signals.items())), lambda x: x.isNotNull())
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(*map(F.lit, signals)))


def refine(text: Column, patterns: list[str], least: int = 5) -> Column:
    """The text without the patterns; the text itself if less than ``least`` characters would be left."""
    out = F.trim(F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, p, " "), patterns, text), r"\s+", " "))
    return F.when(F.length(out) < least, text).otherwise(out)


def citations(answer: Column, n_sources: Column) -> Column:
    """Source numbers of a marker ``[출처: 1,3]`` at the end of an answer; all sources if it is missing or holds no valid one."""
    inner = F.regexp_extract(answer, r"\[출처\s*:\s*([0-9,\s]+)\]\s*$", 1)
    found = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull() & (x >= 1) & (x <= n_sources))
    everything = F.when(n_sources > 0, F.sequence(F.lit(1), n_sources)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(everything)


def clock_label(ts: Column, zone: str = "Asia/Seoul") -> Column:
    """A 12-hour label such as ``오후 3:05`` of a UTC time."""
    local = F.from_utc_timestamp(ts, zone)
    hour = F.hour(local)
    return F.format_string("%s %d:%02d", F.when(hour < 12, "오전").otherwise("오후"), F.when(hour % 12 == 0, 12).otherwise(hour % 12), F.minute(local))


def local_date(ts: Column, missing: str, zone: str = "Asia/Seoul") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd"), F.lit(missing))


def due_date(text: Column) -> Column:
    """A date written yyyy-mm-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def shorten(text: Column, n: int, end: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(end))).otherwise(text)


def whitelisted(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*allowed), F.lower(F.trim(value))).otherwise(F.lit(default))


def json_block(text: Column) -> Column:
    """The part from the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def number_of(text: Column) -> Column:
    """A number after units, separators and brackets are taken away; else null."""
    return F.regexp_replace(text, r"[,억조원%()\[\]\s]", "").try_cast("double")


def common_prefix(a: Column, b: Column) -> Column:
    """The leading words that both arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False)).cast("int")
    n = F.when(stop == 0, F.least(F.size(a), F.size(b))).otherwise(stop - 1)
    return F.slice(a, F.lit(1), n)
