"""Comparison keys: full case folding in the JVM, after NFC in Arrow batches where a value is not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text

_ASCII = r"^[\x00-\x7f]*\z"


@F.pandas_udf(StringType())
def _nfc_folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v).casefold(), na_action="ignore")


def path_key(value: Column) -> Column:
    """Key by which paths are the same document: NFC, then case folding. Only the first needs Python: Spark has no function
    for it."""
    return F.coalesce(F.when(value.rlike(_ASCII), F.lower(value)), _nfc_folded(F.when(~value.rlike(_ASCII), value)))


def folded(value: Column) -> Column:
    """Full case folding without normalisation, as the processing order uses it."""
    return text.folded(value)


@F.pandas_udf(ArrayType(StringType()))
def _each_nfc_folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [x if x is None else unicodedata.normalize("NFC", x).casefold() for x in v], na_action="ignore")


def path_keys(values: Column) -> Column:
    """path_key of every element of an array."""
    plain = F.forall(values, lambda v: F.coalesce(v.rlike(_ASCII), F.lit(True)))
    return F.coalesce(F.when(plain, F.transform(values, F.lower)), _each_nfc_folded(F.when(~plain, values)))
