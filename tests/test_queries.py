"""Every registered query that has SQL gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values):
    place = [names.index(c) for c in sorted(names)]
    rounded = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(str([rounded(v[i]) for i in place]) for v in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, sql, name):
    got = entry.queries()[name](spark, sf_dir)
    found = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tree_hash_of_small_sessions(spark):
    import hashlib

    from ledgerframe.operators import backup

    data = [("a", "B/x", b"1"), ("a", "b/É", b""), ("a", "b/a", b"22"), ("b", "z", b"3")]
    got = {r.session: r.tree_sha256 for r in backup.tree_digests(spark.createDataFrame(data, "session string, path string, content binary")).collect()}

    def frame(path, content):
        return b"file\x00" + len(path.encode()).to_bytes(8, "big") + path.encode() + len(content).to_bytes(8, "big") + content

    want = {"a": frame("b/a", b"22") + frame("B/x", b"1") + frame("b/É", b""), "b": frame("z", b"3")}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()}
