"""Tables inside texts and charts, as column expressions. A table is rows of cells; a record is an array of (name, text, number)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import number_of
from .scores import WHITE, WS

#: The line under a header, titles without content, and how titles that name a source start.
SEPARATOR = r"^\s*\|(?:[\s\-:]+\|)+\s*$"
EMPTY_TITLES = ["차트 데이터", "차트", "데이터", "데이터 표", "데이터 테이블", "그래프", "표", "인포그래픽"]
SOURCES = r"^(?:자료|출처|주:|주1|※|Source)"
_ROW, _CELL, _CUT = "\x1d", "\x1f", "\x1e"


def _text(cell: Column) -> Column:
    return F.btrim(F.coalesce(cell.cast("string"), F.lit("")), F.lit(WHITE))


def markdown_tables(text: Column) -> Column:
    """All tables of a text: array<table>. Rows need two filled cells, tables two rows; any other line ends a table; empty cells and separators go."""

    def row(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.btrim(line, F.lit(" |")), r"\|"), _text), lambda c: c != "")
        return F.when(F.contains(line, F.lit("|")) & (F.size(cells) >= 2), F.array_join(cells, _CELL)).otherwise(F.lit(_CUT))

    lines = F.transform(F.split(F.translate(text, _ROW + _CELL + _CUT, ""), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    marked = F.array_join(F.transform(F.filter(lines, lambda x: ~x.rlike(SEPARATOR)), row), _ROW)
    blocks = F.transform(F.split(marked, f"{_ROW}?{_CUT}{_ROW}?"), lambda b: F.filter(F.split(b, _ROW), lambda r: r != ""))
    return F.transform(F.filter(blocks, lambda b: F.size(b) >= 2), lambda b: F.transform(b, lambda r: F.split(r, _CELL)))


def records(table: Column) -> Column:
    """The rows below the header: array<array<struct<name, text, number>>>. A cell beyond the header is named col<i>; without such a row none."""
    header = table[0]
    name = lambda i: F.when(i < F.size(header), F.get(header, i)).otherwise(F.concat(F.lit("col"), i.cast("string")))
    cell = lambda c, i: F.struct(name(i).alias("name"), c.alias("text"), number_of(c).alias("number"))
    return F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), lambda r: F.transform(r, cell))


def clean_table(table: Column) -> Column:
    """Without empty rows, all rows as wide as the widest, the header with single blanks; null if nothing is left."""
    rows = F.filter(table, lambda r: F.exists(r, lambda c: _text(c) != ""))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    even = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r))))
    head = lambda r, i: F.when(i == 0, F.transform(r, lambda c: F.regexp_replace(_text(c), f"[{WS}]+", " "))).otherwise(r)
    return F.when(F.size(rows) > 0, F.transform(even, head))


def to_markdown(table: Column) -> Column:
    """The first row as header; line ends in cells become blanks, bars are escaped, short rows are filled up."""
    width = F.array_max(F.transform(table, lambda r: F.size(r)))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    bar = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(table[0]), bar), F.transform(F.slice(table, 2, F.size(table)), line))
    return F.when(F.size(table) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def usable(table: Column, top: Column | None = None, bottom: Column | None = None, height: Column | None = None, fill: float = 0.6, margin: float = 0.10) -> Column:
    """Two filled cells or more, ``fill`` of all cells filled, and not within the ``margin`` of the page's top or bottom."""
    cells = F.flatten(table)
    full = F.size(F.filter(cells, lambda c: _text(c) != ""))
    out = (full >= 2) & (full >= fill * F.size(cells))
    return out if top is None else out & ~((bottom < height * margin) | (top > height * (1 - margin)))


def is_echo(record: Column) -> Column:
    """A header that came as a record: its first value is its own name."""
    return F.coalesce(F.get(record, F.lit(0))["name"] == F.get(record, F.lit(0))["text"], F.lit(False))


def title_valid(title: Column) -> Column:
    """Whether a chart's title says something: no number, source, unit in brackets or word for a chart."""
    t = F.btrim(title, F.lit(WHITE))
    bad = t.rlike(r"^-?\p{Nd}+(\.\p{Nd}+)?$") | t.rlike(SOURCES) | t.rlike(r"^\([^\n]*\)$") | t.isin(EMPTY_TITLES)
    return F.coalesce((F.length(title) > 0) & ~bad, F.lit(False))


def _numbers(record: Column) -> Column:
    return F.filter(F.transform(record, lambda c: c["number"] + 0.0), lambda x: x.isNotNull())  # no negative zero


def made_up(rows: Column, least: int = 8) -> Column:
    """``least`` numbers or more that are all the same."""
    n = F.flatten(F.transform(rows, _numbers))
    return (F.size(n) >= least) & (F.size(F.array_distinct(n)) == 1)


def same_series(rows: Column, share: float = 0.8) -> Column:
    """Of the rows with two numbers or more, ``share`` hold one number only."""
    many = F.filter(F.transform(rows, _numbers), lambda n: F.size(n) >= 2)
    flat = F.filter(many, lambda n: F.size(F.array_distinct(n)) == 1)
    return (F.size(many) > 0) & (F.size(flat) >= share * F.size(many))


def reliable(rows: Column) -> Column:
    """Whether a chart's records may be shown as numbers."""
    return F.coalesce((F.size(rows) > 0) & ~made_up(rows) & ~same_series(rows), F.lit(False))


def has_content(rows: Column, description: Column) -> Column:
    """Records that aren't made up, or without records a description with a table that holds a number."""
    rest = F.regexp_replace(description, rf"[{WS}|#\-]", "")
    told = description.rlike(r"\|\s*-?\d+\.?\d*\s*\|") & (F.length(rest) > 5)
    return F.when(F.coalesce(F.size(rows) > 0, F.lit(False)), ~made_up(rows)).otherwise(F.coalesce(told, F.lit(False)))
