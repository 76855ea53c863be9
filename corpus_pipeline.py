"""A corpus pipeline over documents: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import bpe, decontam, jaccard_join, quality, suffix_dedup
from ledgerframe.llm.common import remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL: the classifier of the first stage is trained, and the vocabulary of the last is a file.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is judged as an empty one, texts are judged whole; null sources and languages are sites of their
    own; repeated rows are judged alike, so ties go or stay together. Without labels of both classes, or rows, all stay.
    Columns other than those of documents are dropped."""
    return quality.judged(docs, table(spark, sf_dir, "labels")).filter("keep").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word n-grams with a Jaccard similarity of 0.8 the smallest id stays.

    Rows with a null id, or without words (null and empty texts), are near copies of nothing and stay; all rows of an id
    that stays do. Texts of any length are compared whole. Empty input: no rows. Other columns are dropped."""
    return jaccard_join.kept(docs, k=5, percent=80).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has are cut out, and n_chars is counted anew.

    Rows with a null id keep their text; a null text stays null; rows of one id do not count against each other. A text of
    any length is searched whole. A document of which all is cut stays, with an empty text. Empty input: no rows. Other
    columns are dropped."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of them alike.

    Null and empty texts hold none; items that are null or empty are held by none; ids play no part. Texts are searched
    whole. An empty table on either side takes nothing away. Other columns are dropped."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian unsigned 32-bit integers), and digests of these and of the
    text decoded from them.

    A null text is encoded as an empty one and decoded as an empty text; rows are independent, whatever their ids; texts are
    encoded whole. Empty input: no rows. Columns other than those of documents are dropped."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select(*COLUMNS), vocabulary, pattern)
    decoded = bpe.decode(encoded, vocabulary, pattern)
    n_tokens = F.expr("octet_length(bpe_ids) div 4")
    return decoded.select(*COLUMNS, n_tokens.alias("n_tokens"), "bpe_ids", F.sha2("bpe_ids", 256).alias("ids_sha256"), F.sha2(F.col("bpe_text").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again; the last one's rows."""
    shared_dir(spark)
    top = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4()}")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            remove(spark, f"{top}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
