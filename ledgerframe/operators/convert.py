"""Conversion of documents with a pluggable converter: errors are data, one converter serves a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ledger, normalize

Converter = Callable[[bytes], str]


class InputError(ValueError):
    """The document cannot be converted as it is."""


class ConverterError(RuntimeError):
    """The converter failed."""


def converted(documents: DataFrame, factory: Callable[[], Converter]) -> DataFrame:
    """documents (input_path, content) with text, status, exception and error. A converter that cannot be built fails
    all documents of its partition; a document's failure does not touch others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broken: Exception | None = None
        try:
            converter = factory()
        except Exception as e:
            broken = e
        for batch in batches:
            out: list[tuple] = []
            for content in batch.column("content"):
                try:
                    if broken:
                        raise broken
                    if content.as_py() is None:
                        raise InputError("no content")
                    out.append((converter(content.as_py()), "succeeded", None, None))
                except Exception as e:  # errors are part of the result
                    out.append((None, "failed", type(e).__name__, str(e)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("input_path"), *(pa.array(c, pa.string()) for c in columns)], names=["input_path", "text", "status", "exception", "error"])

    rows = documents.select("input_path", "content").mapInArrow(run, "input_path string, text string, status string, exception string, error string")
    category = F.when(F.col("status") == "failed", ledger.failure_category(F.col("exception")))
    return rows.withColumn("category", category).withColumn("error", T.sanitised(F.col("error"), F.col("input_path")))


def table_function(factory: Callable[[], Callable[[bytes], str | tuple[str, Sequence[str]]]]):
    """A table function of a document's content (binary), for DataFrames and, registered, for SQL with LATERAL.

    Rows: kind, seq, value. A converter gives a text, or a text and warnings: the text is one row (`text`, 0), each warning
    one more (`warning`, numbered from 0). A document that fails, or has no content, is one row (`error`, 0) with the
    kind of its error. The converter is built once a partition; if that fails, all documents of the partition do."""

    class Converted:
        def __init__(self) -> None:
            self._broken: Exception | None = None
            try:
                self._converter = factory()
            except Exception as e:
                self._broken = e

        def eval(self, content: bytes):
            try:
                if self._broken:
                    raise self._broken
                if content is None:
                    raise InputError("no content")
                found = self._converter(bytes(content))
                text, warnings = (found, ()) if isinstance(found, str) else found
            except Exception as e:  # errors are part of the result
                yield "error", 0, type(e).__name__
                return
            yield "text", 0, text
            for i, warning in enumerate(warnings):
                yield "warning", i, warning

    return F.udtf(Converted, returnType="kind string, seq int, value string", useArrow=True)


def normalised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), normalize.normalised(F.col("text"))))


def pending(requests: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Requests whose output does not exist yet, or all if forced; before the converter, which nothing is pushed below."""
    return requests if force else requests.join(existing.select(F.col("path").alias("output_path")), "output_path", "left_anti")


def already_there(requests: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    return requests.limit(0) if force else requests.join(existing.select(F.col("path").alias("output_path")), "output_path", "left_semi")
