"""Resolution of WARC revisit records for not-modified answers.

A revisit is joined, as of its time, to the latest earlier full response of its canonical URL. Its validators
must agree with the response's; then the response's payload stands, with those headers that a not-modified
answer may update taken from the revisit.

The as-of join is one sort by URL and time over range partitions, so a URL with any share of all records is
spread over many tasks; within one, the last response is carried forward by a window, and over the borders of
partitions by the few rows that tell each one's last response of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, default_partitions

#: The header fields that a 304 answer may update, after RFC 9110 section 15.4.5.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical(url: Column) -> Column:
    """Host and path by which captures of one resource meet: no scheme, fragment, default port or tracking parameters;
    host in lower case, parameters sorted, an empty path as /. What is no URL only loses its fragment and the spaces around it."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, _URL + r"([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    rest = F.regexp_replace(bare, _URL + r"[^/?]*", "")
    path = F.regexp_replace(rest, r"(?s)\?.*$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    joined = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare.rlike(_URL), joined).otherwise(bare)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _lowered(entries: Column) -> Column:
    """Headers by name in lower case; of equal names the last one."""
    again = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: F.lower(o["key"]) == F.lower(e["key"]))
    return F.map_from_entries(F.transform(F.filter(entries, lambda e, i: ~again(e, i)), lambda e: F.struct(F.lower(e["key"]), e["value"])))


def resolved(records: DataFrame) -> DataFrame:
    """One row for each revisit record: record_id, url (canonical), response_id, status, headers and payload.

    records: record_id long, url string, at long (time), status int, headers map<string,string>, payload string (a
    reference to or digest of the body; bodies themselves are better left out); other columns are ignored. A record
    with status 304 is a revisit, with 200 a full response; others take no part. The response is the latest of the
    canonical URL that is earlier than the revisit; of several at that time the one of largest record_id.

    status: `resolved` if the entity tags agree weakly or, where the revisit has none, the last-modified dates agree;
    `mismatch` if they don't; `unverified` if the revisit has neither; `unresolved` without an earlier response, or
    with a null url or time. Only `resolved` rows have merged headers and a payload. Header names count in lower case
    (of equal ones the last), a null map as empty. Rows repeating a revisit are each resolved. Empty input: no rows."""
    spark = records.sparkSession
    lower = F.coalesce(_lowered(F.map_entries("headers")), F.create_map().cast("map<string,string>"))
    rows = records.filter("status in (200, 304)").select("record_id", canonical(F.col("url")).alias("url"), "at", (F.col("status") == 200).cast("int").alias("full"), lower.alias("headers"), "payload")
    apart = rows.filter("url is null or at is null")
    rows = rows.filter("url is not null and at is not null")
    # The number of a range partition is kept with its rows, as another run could cut the ranges elsewhere.
    rows = checkpointed(rows.repartitionByRange(default_partitions(spark), "url", "at", "full", "record_id").withColumn("seg", F.spark_partition_id()))
    response = F.when(F.col("full") == 1, F.struct(F.col("record_id").alias("id"), "headers", "payload"))
    inside = Window.partitionBy("url", "seg").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    revisits = rows.withColumn("near", F.last(response, ignorenulls=True).over(inside)).filter("full = 0")
    ends = rows.groupBy("url", "seg").agg(F.max_by(response, F.when(F.col("full") == 1, F.struct("at", "record_id"))).alias("last"), F.max("full").alias("any"))
    back = Window.partitionBy("url").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("last", ignorenulls=True).over(back)).filter("far is not null").select("url", "seg", "far")
    joined = revisits.join(carried, ["url", "seg"], "left").withColumn("from", F.coalesce("near", "far"))
    mine, theirs = F.col("headers"), F.col("from.headers")
    tag, old = _strong(mine["etag"]), _strong(theirs["etag"])
    dated, since = F.trim(mine["last-modified"]), F.trim(theirs["last-modified"])
    agree = F.when(tag.isNotNull(), F.coalesce(tag == old, F.lit(False))).when(dated.isNotNull(), F.coalesce(dated == since, F.lit(False)))
    status = F.when(F.col("from").isNull(), "unresolved").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    may = lambda name: name.isin(*PERMITTED)
    merged = F.map_concat(F.map_filter(theirs, lambda n, v: ~(may(n) & F.map_contains_key(mine, n))), F.map_filter(mine, lambda n, v: may(n)))
    fine = F.col("status") == "resolved"
    out = joined.withColumn("status", status).select("record_id", "url", F.col("from.id").alias("response_id"), "status", F.when(fine, merged).alias("headers"), F.when(fine, F.col("from.payload")).alias("payload"))
    none = apart.filter("full = 0").select("record_id", "url", F.lit(None).cast("long").alias("response_id"), F.lit("unresolved").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("payload"))
    return out.unionByName(none)


def captures(pages: DataFrame) -> DataFrame:
    """Capture records for a table of pages (page_id, url, html), as resolved() takes them.

    Each page is a full response at time 100 * page_id, visited again and found not modified under a URL that
    differs in case and fragment: some too early, some with another entity tag, some with none."""
    digest = F.md5(F.col("html").cast("binary"))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    text = lambda *x: F.create_map(*(F.lit(v) if isinstance(v, str) else v for v in x))
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (100 * F.col("page_id")).alias("at"), F.lit(200).alias("status"),
        text("Content-Type", "text/html", "ETag", tag, "Cache-Control", "max-age=60", "Last-Modified", day, "Date", day).alias("headers"), digest.alias("payload"),
    )
    p = F.col("page_id")
    late = F.concat(F.lit("later "), p.cast("string"))
    head = F.when(p % 11 == 0, text("Date", late)).when(p % 7 == 0, text("Date", late, "Last-Modified", day)).when(p % 5 == 0, text("Date", late, "ETag", '"other"', "Server", "x")).otherwise(text("Date", late, "ETag", F.concat(F.lit("W/"), tag), "Cache-Control", "max-age=90", "Content-Type", "none"))
    again = pages.select(
        (2 * p + 1).alias("record_id"), F.concat(F.regexp_replace(F.col("url"), r"^https?://", "HTTP://"), F.lit("#again")).alias("url"),
        F.when(p % 13 == 0, 100 * p - 1).otherwise(100 * p + 50).alias("at"), F.lit(304).alias("status"), head.alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)
