"""Runtime quality warnings and expectation metrics of Markdown texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SHORT_BELOW = 40
#: Warning categories in their order, and metric names in theirs.
WARNINGS = ("empty-output", "short-output", "absolute-path", "traceback", "control-character")
METRICS = ("minimum_length", "headings", "body_text", "bullet_list", "table_structure", "page_boundary", "key_phrases", "contamination")


def _listed(*names: Column) -> Column:
    """The names that are not null, as an array; compiled functions only, so what the rules share is computed once."""
    return F.array_remove(F.split(F.concat_ws(",", *names), ","), "")


def warnings(text: Column, short_below: int = SHORT_BELOW, visible: Column | None = None) -> Column:
    """Categories (array<string>) that apply to a text; an empty one is not also short. visible: its visible length,
    where that is a column already."""
    n = T.visible_length(text) if visible is None else visible
    return _listed(
        F.when(n == 0, "empty-output").when(n < short_below, "short-output"),
        F.when(T.has_absolute_path(text), "absolute-path"),
        F.when(T.has_traceback(text), "traceback"),
        F.when(T.has_control(text), "control-character"),
    )


def status_of(found: Column) -> Column:
    return F.when(F.size(found) > 0, "warned").otherwise("passed")


def judged(docs: DataFrame, text: str = "text", short_below: int = SHORT_BELOW) -> DataFrame:
    """docs with `warnings` and `status`. A text that cannot be read (null) has the one warning quality-read-error."""
    kept = [c for c in docs.columns if c not in ("warnings", "status")]
    rows = T.measured(docs.select(F.struct(*kept).alias("own"), F.col(text).alias("text")), "text")
    found = F.when(F.col("text").isNull(), F.array(F.lit("quality-read-error"))).otherwise(warnings(F.col("text"), short_below, F.col("visible")))
    return rows.select("own", found.alias("warnings")).select("own.*", "warnings", status_of(F.col("warnings")).alias("status"))


def summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "warned").alias("warned"))


def contamination(text: Column) -> Column:
    return _listed(F.when(T.has_traceback(text), "traceback"), F.when(T.has_absolute_path(text), "absolute_path"), F.when(T.has_control(text), "control_character"))


@dataclass(frozen=True)
class Expectation:
    """What a document is expected to hold; columns may take the place of literals."""

    minimum_characters: Column | int = 0
    headings: Column = field(default_factory=lambda: F.array().cast("array<struct<level:int,text:string>>"))
    body_phrases: Column = field(default_factory=lambda: F.array().cast("array<string>"))
    bullet_items: Column = field(default_factory=lambda: F.array().cast("array<string>"))
    table_rows: Column = field(default_factory=lambda: F.array().cast("array<array<string>>"))
    boundary_phrases: Column = field(default_factory=lambda: F.array().cast("array<string>"))
    key_phrases: Column = field(default_factory=lambda: F.array().cast("array<string>"))


def failed_metrics(text: Column, expected: Expectation, visible: Column | None = None, plain: Column | None = None) -> Column:
    """Names (array<string>) of the metrics that a text fails, in their order. visible and plain: its visible length and
    its normalised form, where these are columns already."""
    least = expected.minimum_characters if isinstance(expected.minimum_characters, Column) else F.lit(expected.minimum_characters)
    own = T.normalised(text) if plain is None else plain
    heads = F.transform(expected.headings, lambda h: F.struct(h["level"].alias("level"), T.normalised(h["text"]).alias("text")))
    rows = F.transform(expected.table_rows, lambda r: F.transform(r, T.normalised))
    holds = (
        (T.visible_length(text) if visible is None else visible) >= least,
        F.size(F.array_except(heads, T.headings(text))) == 0,
        F.size(T.missing(own, expected.body_phrases)) == 0,
        F.size(F.array_except(F.transform(expected.bullet_items, T.normalised), T.bullets(text))) == 0,
        F.size(F.array_except(rows, T.first_table(text))) == 0,
        T.in_order(own, expected.boundary_phrases),
        F.size(T.missing(own, expected.key_phrases)) == 0,
        F.size(contamination(text)) == 0,
    )
    return _listed(*(F.when(~ok, name) for name, ok in zip(METRICS, holds, strict=True)))
