"""Inputs for the registered queries: documents with deterministic Markdown features, and ledgers over them.

The test tables hold prose only; these rules, integer arithmetic on the ids, give them every feature that the
operators look for. The same rules are stated in SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Words with a final sigma, a long s, ligatures, the micro sign, a dotted I, an iota below, and a letter that folds upwards.
FOLDING = "ΟΔΟΣ Wiſdom ﬁn eﬄux µm Straße İx ᾳ ꭰ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out over the cores where the scan has fewer parts than these: a small file is one part, and heavy
    rules would run in one task. A table with more parts is not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def decorated(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and a text with headings, lists, tables, fences, paths, tracebacks, control characters, and
    characters whose case folding is not their lower case."""
    i = F.col("doc_id")
    x = F.col("text")
    add = lambda n, value: F.when(i % n == 0, value).otherwise(F.lit(""))
    number = i.cast("string")
    x = F.concat(x, add(7, F.lit("\nTraceback (most recent call last):")), add(11, F.lit(" C:\\tmp\\x.txt")), add(13, F.lit(" /srv/a/b.txt")), add(17, F.lit("\u202e")))
    x = F.concat(x, add(4, F.lit(f"\n{FOLDING}")))
    head = F.concat(F.lit("# Title "), number, add(2, F.lit(f" {FOLDING} ##")), F.lit("\n\n- item "), number, F.lit("\n\n| a | b |\n| --- | --- |\n| x"), number, F.lit(" | y |\n\n"))
    x = F.concat(add(5, head), x)
    x = F.when(i % 3 == 0, F.concat(F.lit("~~~~\nbody  \n~~~\ncode \n~~~~\n"), x, F.lit("\t \n\n"))).otherwise(x)
    x = F.when(i % 23 == 0, F.concat(x, F.lit("\n```\nopen \n\n"))).otherwise(x)
    x = F.when(i % 29 == 0, F.replace(x, F.lit("\n"), F.lit("\r\n"))).otherwise(x)
    x = F.when(i % 31 == 0, F.concat(F.lit("\ufeff"), x)).otherwise(x)
    x = F.when(i % 19 == 0, F.lit("")).otherwise(x)
    return docs.select("doc_id", "lang", "source", x.alias("text"))


#: The same in SQL.
DECORATED = rf"""
d0 AS (SELECT doc_id, lang, source, text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'Traceback (most recent call last):' ELSE '' END
   || CASE WHEN doc_id % 11 = 0 THEN ' C:\tmp\x.txt' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN ' /srv/a/b.txt' ELSE '' END
   || CASE WHEN doc_id % 17 = 0 THEN chr(8238) ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '{FOLDING}' ELSE '' END AS x FROM documents),
d1 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN '# Title ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' {FOLDING} ##' ELSE '' END || chr(10) || chr(10) || '- item ' || doc_id || chr(10) || chr(10)
   || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x' || doc_id || ' | y |' || chr(10) || chr(10) ELSE '' END || x AS x FROM d0),
d2 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN '~~~~' || chr(10) || 'body  ' || chr(10) || '~~~' || chr(10) || 'code ' || chr(10) || '~~~~' || chr(10)
   || x || chr(9) || ' ' || chr(10) || chr(10) ELSE x END AS x FROM d1),
d3 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 23 = 0 THEN x || chr(10) || '```' || chr(10) || 'open ' || chr(10) || chr(10) ELSE x END AS x FROM d2),
d4 AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 29 = 0 THEN replace(x, chr(10), chr(13) || chr(10)) ELSE x END AS x FROM d3),
d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 31 = 0 THEN chr(65279) || x ELSE x END AS text FROM d4)
"""
