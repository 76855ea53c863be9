"""Benchmark results of conversions: headings, reading order, tables, totals of modes, and the report as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: How well a table came through.
CLASSES = ("not_applicable", "plain_text", "flattened_markdown_table", "structured_markdown_table")
_RULE = r"^[| :\-]+\z"


def heading_levels(text: Column, titles: Column) -> Column:
    """For each expected title (array) the level of the first line that is a heading with just this text, in any case; null
    if there is none. Closing number signs belong to the text here."""
    found = F.transform(T.lines(text), lambda line: T.marked(line))
    own = F.transform(F.filter(found, lambda m: m["level"].between(1, 6) & m["rest"].rlike(f"^{T.SPACE}")), lambda m: F.struct(m["level"].alias("level"), F.lower(T.trimmed(m["rest"])).alias("title")))
    return F.transform(titles, lambda t: F.get(F.filter(own, lambda h: h["title"] == F.lower(t)), F.lit(0))["level"])


def in_raw_order(text: Column, markers: Column) -> Column:
    """Whether a text holds all markers as they are written, none before the one that comes first in the list."""
    at = F.transform(markers, lambda m: F.instr(text, m))
    return F.forall(at, lambda i: i > 0) & (F.array_sort(at) == at)


def table_of(text: Column, expected: Column, blanks: str = T.BLANKS) -> Column:
    """struct<class, rows, columns> from all lines with two bars or more: a line of dashes and colons makes them a table, one
    with two cells that are not blank a structured one. rows and columns (the most of such cells) are null where no table is
    expected; a null text has none. `blanks` are the characters that do not count at the ends of lines and cells: all
    white space, unless a caller's rule takes fewer."""
    bare = lambda value: F.btrim(value, F.lit(blanks))
    barred = F.filter(T.lines(F.coalesce(text, F.lit(""))), lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)
    trimmed = F.transform(barred, bare)
    data = F.filter(trimmed, lambda line: ~line.rlike(_RULE))
    cells = F.transform(data, lambda line: F.size(F.filter(F.split(F.btrim(line, F.lit("|")), r"\|", -1), lambda c: bare(c) != "")))
    widest = F.coalesce(F.array_max(cells), F.lit(0))
    kind = F.when(~expected, CLASSES[0]).when((F.size(barred) < 2) | (F.size(data) == F.size(barred)), CLASSES[1]).when(widest >= 2, CLASSES[3]).otherwise(CLASSES[2])
    return F.struct(kind.alias("class"), F.when(expected, F.size(data)).alias("rows"), F.when(expected, widest).alias("columns"))


def mode_totals(results: DataFrame, caches: DataFrame) -> DataFrame:
    """mode, cases, seconds, succeeded (all of them) and growth, what the model cache (mode, before, after) grew by: never
    negative. Seconds are rounded to three places. A mode without a cache grew by nothing. Empty input: no rows."""
    sums = results.groupBy("mode").agg(F.count("*").alias("cases"), F.round(F.sum("seconds"), 3).alias("seconds"), F.bool_and("success").alias("succeeded"))
    grown = caches.groupBy("mode").agg(F.sum(F.greatest(F.col("after") - F.col("before"), F.lit(0))).alias("growth"))
    return sums.join(grown, "mode", "left").select("mode", "cases", "seconds", "succeeded", F.coalesce("growth", F.lit(0).cast("long")).alias("growth"))


def as_text(rows: DataFrame, report: str, order: str, heads: dict[str, bool], rest: str = "") -> DataFrame:
    """A row for each report: report and `body`, a Markdown table of its rows with the columns named in heads (true: numbers,
    to the right), in their order, and what the column `rest` says below it. Bars and line ends within a cell become blanks.

    The lines are put together where the groups are: no report passes through the driver. A report is one string, so it
    must fit into a row; rows that are equal in their order come by their line."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, heads)), F.lit(" |"))
    top = f"| {' | '.join(heads)} |\n|{'|'.join('---:' if right else '---' for right in heads.values())}|\n"
    lines = rows.select(F.col(report).alias("report"), F.col(order).alias("place"), line.alias("line"), (F.col(rest) if rest else F.lit(None).cast("string")).alias("rest"))
    told = lines.groupBy("report").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.max("rest").alias("rest"))
    return told.select("report", F.concat(F.lit(top), "lines", F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), "rest", F.lit("\n")), F.lit(""))).alias("body"))
