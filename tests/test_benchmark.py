"""Benchmark results: by hand-written texts."""

import duckdb
from pyspark.sql import functions as F

from ledgerframe.operators import benchmark
from ledgerframe.plans import benchmark_queries

#: Text: class, rows and columns where a table is expected.
TABLES = {
    "": ("plain_text", 0, 0), "| a | b |": ("plain_text", 1, 2), "| a | b |\n|---|:-:|\n| 1 |  |\n\nx | y\n| 2 | 3 | 4 |": ("structured_markdown_table", 3, 3), "| a |\n|---|\n| b |": ("flattened_markdown_table", 2, 1),
    "|---|\n|---|": ("flattened_markdown_table", 0, 0), "| a | b |\n| c | d |": ("plain_text", 2, 2), "||\n|-|\n| |": ("flattened_markdown_table", 0, 0), None: ("plain_text", 0, 0),
}


def test_tables(spark):
    got = {r.t: tuple(r.x) for r in spark.createDataFrame([(t,) for t in TABLES], "t string").select("t", benchmark.table_of(F.col("t"), F.lit(True)).alias("x")).collect()}
    assert got == TABLES
    assert spark.range(1).select(benchmark.table_of(F.lit("| a | b |\n|-|-|"), F.lit(False)).alias("x")).first().x == ("not_applicable", None, None)


def test_headings_and_order(spark):
    text = "#  One \n## ONE\n### two ##\n####### no\n#three\n"
    titles = F.array(*map(F.lit, ["one", "two", "Two ##", "no", "three", ""]))
    assert spark.range(1).select(benchmark.heading_levels(F.lit(text), titles).alias("x")).first().x == [1, None, 3, None, None, None]
    order = lambda *m: spark.range(1).select(benchmark.in_raw_order(F.lit(text), F.array(*map(F.lit, m))).alias("x")).first().x
    assert (order("One", "ONE"), order("ONE", "One"), order("One", "none")) == (True, False, False)


def test_totals_and_report(spark):
    results = spark.createDataFrame([("a", 1.2344, True), ("a", 2.0, False), ("b", 1.0, True)], "mode string, seconds double, success boolean")
    caches = spark.createDataFrame([("a", 5, 3), ("c", 1, 2)], "mode string, before long, after long")
    assert sorted(map(tuple, benchmark.mode_totals(results, caches).collect())) == [("a", 2, 3.234, False, 0), ("b", 1, 1.0, True, 0)]
    rows = spark.createDataFrame([("r", 2, "x|y\n", "end"), ("r", 1, None, "end"), ("s", 1, "z", None)], "report string, n int, v string, more string")
    got = {r.report: r.body for r in benchmark.as_text(rows, "report", "n", {"n": True, "v": False}, "more").collect()}
    assert got == {"r": "| n | v |\n|---:|---|\n| 1 |  |\n| 2 | x y  |\n\nend\n", "s": "| n | v |\n|---:|---|\n| 1 | z |\n"}
    assert benchmark.as_text(rows.limit(0), "report", "n", {"n": True}).count() == 0


def test_tables_that_end_in_tabs_are_those_of_the_sql(spark, tmp_path):
    """Every third text gets a tab at its end: behind a last bar, SQL's trim keeps it as a cell."""
    texts = ["a | b | c |", "| a | b |\n|---|---|", "| a | b |\t\n|---|---|\t\n| c |\u3000| d |\xa0", "|\t|\n|-|", "\u2003| x | y |\u2003\n|\t-|-|\n| 1 |", ""]
    spark.createDataFrame([(i, "en", "s", texts[i % len(texts)] + " | z |" * (i % 2)) for i in range(1, 400)], "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, query in ((k, benchmark_queries.QUERIES[k]) for k in ("table_reproduction", "benchmark_report")):
        got, want = query(spark, str(tmp_path)), con.execute(benchmark_queries.ORACLES[name])
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
