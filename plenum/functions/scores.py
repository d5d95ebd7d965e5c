"""Quality scores from 0 to 1 of texts, blocks, tables and documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the block score.
BROKEN = "□▯�\\x00"
ALLOWED = r""".,!?:;()\[\]{}%+\-=@#/\\"'…—·"""
HANGUL = "가-힣"
#: White space as a class of a pattern and as characters.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def share(text: Column, pattern: str) -> Column:
    """The share of characters that match; 0 for an empty text."""
    return F.coalesce(F.try_divide((F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double"), F.length(text).cast("double")), F.lit(0.0))


def let(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def most_repeated(items: Column, least: int) -> Column:
    """The share of the most frequent item; 0 for fewer than ``least`` items. One sort if there are repeats, so long lists are fine."""

    def longest(s: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("top"))

        def step(a, x):
            n = F.when(a["last"].eqNullSafe(x), a["n"] + 1).otherwise(F.lit(1))
            return F.struct(x.alias("last"), n.alias("n"), F.greatest(a["top"], n).alias("top"))

        return F.aggregate(F.array_sort(s), start, step, lambda a: a["top"])

    def share(x: Column) -> Column:
        n = F.size(x)
        return F.when(n < least, 0.0).when(F.size(F.array_distinct(x)) == n, 1 / n).otherwise(longest(x) / n)

    return let(items, share)


def ocr_quality(text: Column) -> Column:
    """.45 of letters and digits, .35 of lines with any, .20 against a line that repeats; blank is 0."""

    def score(x: Column) -> Column:
        letters = F.least(share(x["solid"], f"[A-Za-z0-9{HANGUL}]+") / 0.40, F.lit(1.0))
        valid = F.size(F.filter(x["lines"], lambda line: line.rlike(f"[A-Za-z0-9{HANGUL}]"))) / F.size(x["lines"])
        steady = F.greatest(1 - most_repeated(x["lines"], 3) * 2, F.lit(0.0))
        return F.when(x["solid"] == "", F.lit(0.0)).otherwise(F.round(letters * 0.45 + valid * 0.35 + steady * 0.20, 3))

    parts = let(stripped(text), lambda s: F.struct(F.regexp_replace(s, r"[ \n\t]+", "").alias("solid"), lines_of(s).alias("lines")))
    return let(parts, score)


def block_quality(text: Column) -> Column:
    """One text block before the structure bonus."""
    s = stripped(text)
    noise = F.least(share(s, rf"[^\p{{L}}\p{{N}}\s\p{{P}}{ALLOWED}]") * 5, F.lit(1.0))
    blank = F.least(share(s, r"\s") * 2, F.lit(1.0))
    out = share(s, "[가-힣ᄀ-ᇿ]") * 0.15 + F.least(F.length(s) / 50.0, F.lit(1.0)) * 0.25 + (1 - share(s, f"[{BROKEN}]")) * 0.30 + (1 - noise) * 0.15 + (1 - blank) * 0.10
    return F.when(s == "", F.lit(0.0)).otherwise(out)


def text_quality(mean_block: Column, has_title: Column) -> Column:
    """A page's score from the mean of its blocks; without blocks 1."""
    return F.when(mean_block.isNull(), F.lit(1.0)).otherwise(F.round(F.least(mean_block * 0.95 + F.when(has_title, 1.0).otherwise(0.5) * 0.05, F.lit(1.0)), 3))


def gate(text: str, least_chars: int = 3, most_special: float = 0.5, most_words: float | None = None, most_lines: float = 0.6, confidence: Column | None = None, least_confidence: float = 0.0) -> Column:
    """ok, or the first reason against a text."""
    s = stripped(F.col(text))
    out = F.when(F.coalesce(confidence < least_confidence, F.lit(False)), "low_confidence") if confidence is not None else F.when(F.lit(False), "")
    out = out.when(F.length(s) < least_chars, "too_short").when(share(s, r"[\p{L}\p{N}\s]") < 1 - most_special, "high_special")
    if most_words is not None:
        out = out.when(most_repeated(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 4) > most_words, "repeated_words")
    return out.when(most_repeated(lines_of(s), 3) > most_lines, "repeated_lines").otherwise("ok")


def overall(*parts: Column) -> Column:
    """The mean of the components that there are; 1 without any."""
    present = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(present) == 0, 1.0).otherwise(F.round(F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present), 3))


def document_status(pages: Column, score: Column) -> Column:
    return F.when(pages == 0, "error").when(score < 0.7, "uploaded").otherwise("processed")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def table_quality(rows: Column) -> Column:
    """.25 header, .25 filled cells, .20 equal widths, .20 size, .10 text beside numbers; ``rows``: arrays of cells; no rows: 0."""
    zero, n = F.lit(0.0), F.size(rows)
    texts = lambda r: F.transform(F.filter(r, lambda c: c.isNotNull()), _strip)
    full = lambda r: F.filter(texts(r), lambda c: c != "")
    first = F.get(rows, F.lit(0))
    filled = F.size(full(first)) / F.greatest(F.size(first), F.lit(1))
    header = filled * F.when(n < 2, 0.7).when(texts(first) != texts(F.get(rows, F.lit(1))), 1.0).otherwise(0.5)
    cells, kept = F.flatten(rows), full(F.flatten(rows))
    present = F.coalesce(F.try_divide(F.size(kept).cast("double"), F.size(cells).cast("double")), zero)
    even = most_repeated(F.transform(rows, lambda r: F.size(r).cast("string")), 1)
    size = (F.least(n / 10.0, F.lit(1.0)) + F.least(F.array_max(F.transform(rows, lambda r: F.size(r))) / 4.0, F.lit(1.0))) / 2
    number = lambda c: F.regexp_replace(c, "[.,]", "").rlike(r"^\p{Nd}+$")
    content = F.when(F.size(kept) == 0, 0.0).when(F.exists(kept, number) & F.exists(kept, lambda c: ~number(c)), 1.0).otherwise(0.7)
    return F.when(n == 0, zero).otherwise(header * 0.25 + present * 0.25 + even * 0.20 + size * 0.20 + content * 0.10)


def image_quality(text: Column, agreement: Column) -> Column:
    """.30 agreement of two readings, .15 length, .15 Hangul, .20 lines without noise, .10 few marks, .10 few repeats; blank: 0."""
    s = stripped(text)
    lines = lines_of(s)
    noisy = F.filter(lines, lambda x: x.rlike(f"^[^{HANGUL}a-zA-Z0-9]{{1,3}}$") | x.rlike(r"^[.\-_|/\\]+$"))
    marks = F.least(share(s, r"[^\p{L}\p{N}\s]") * 3, F.lit(1.0))
    repeats = F.least(most_repeated(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 4) * 2, F.lit(1.0))
    out = agreement * 0.30 + F.least(F.length(s) / 100.0, F.lit(1.0)) * 0.15 + share(s, f"[{HANGUL}]") * 0.15
    out = out + (1 - F.size(noisy) / F.size(lines)) * 0.20 + (1 - marks) * 0.10 + (1 - repeats) * 0.10
    return F.when(s == "", F.lit(0.0)).otherwise(out)


def mean_quality(score: Column) -> Column:
    """Aggregate: the mean of a page's tables or images; 1 without any."""
    return F.round(F.coalesce(F.avg(score), F.lit(1.0)), 3)
