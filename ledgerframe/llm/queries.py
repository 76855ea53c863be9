"""Queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, jaccard_join, pieces, quality, runs, structure, substring_dedup, suffix_dedup, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.judged(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolved(warc.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    return found.select("record_id", "url", "response_id", "status", headers.alias("headers"), "payload")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which one in ten by the checksum of its id repeats some of its words to its end. A document
    without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    rows = rows.withColumn("a", F.expr("g % nullif(size(w), 0)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.size("w") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.detected(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    order = lambda a, b: F.when(longer(a, b) != 0, -F.signum(longer(a, b))).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.array_sort("runs", order), F.lit(0)).alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")
    )
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with nulls as one space and faults by the checksum of id and turn: a turn is dropped,
    emptied, robbed of its ends, repeated, or said to be the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations all of whose turns were dropped are reported as empty ones."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = structure.repaired(damaged(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(b""), 256)}
    return every.select("conv_id", *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in structure.REPORT))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_quality_classifier, op3_nearest_neighbours, op4_warc_revisits, op5_byte_bpe,
        op6_suffix_array_dedup, op7_benchmark_decontamination, op8_toxicity, op9_jaccard_join, op10_substring_dedup,
        op11_periodic_runs, op12_structure_repair, op13_sentencepiece,
    )
}

_CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, turn // 256 AS chunk, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece,
      string_agg(md5(role || chr(0) || text), '') OVER w AS prefix FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_logged, any_value(n) AS n FROM p WHERE place = n GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY chunk) - 1)::INTEGER AS part, n AS n_turns, n_logged, text FROM (
  SELECT p.conv_id, chunk, kept.n, n_logged, string_agg(piece, '' ORDER BY place) AS text FROM p JOIN kept ON p.conv_id = kept.conv_id GROUP BY ALL)"""
_CANONICAL = r"""CASE WHEN regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
  regexp_replace(lower(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), CASE WHEN lower(b) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '')
  || CASE WHEN regexp_replace(r, '\?.*$', '') = '' THEN '/' ELSE regexp_replace(r, '\?.*$', '') END
  || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_sort(q), '&') END ELSE b END"""
_WARC = rf"""
WITH raw AS (SELECT 2 * page_id AS id, url, 100 * page_id AS ts, 1 AS f, page_id AS p, md5(html) AS h FROM pages
  UNION ALL SELECT 2 * page_id + 1, regexp_replace(url, '^https?://', 'HTTP://') || '#again', CASE WHEN page_id % 13 = 0 THEN 100 * page_id - 1 ELSE 100 * page_id + 50 END AS ts, 0, page_id, md5(html) FROM pages),
bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS b FROM raw),
rest AS (SELECT *, regexp_replace(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS r FROM bare),
parts AS (SELECT *, list_filter(string_split(regexp_extract(r, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS q FROM rest),
c AS (SELECT id, {_CANONICAL} AS u, ts, f, p, h FROM parts),
one AS (SELECT v.*, r.id AS rid, r.p AS rp, r.h AS rh FROM (SELECT * FROM c WHERE f = 0) v ASOF LEFT JOIN (SELECT * FROM c WHERE f = 1) r ON v.u = r.u AND v.ts > r.ts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'unresolved' WHEN p % 11 = 0 THEN 'unverified' WHEN p % 7 = 0 THEN CASE WHEN rp = p THEN 'resolved' ELSE 'mismatch' END
  WHEN p % 5 = 0 THEN 'mismatch' WHEN h = rh THEN 'resolved' ELSE 'mismatch' END AS status FROM one)
SELECT id AS record_id, u AS url, rid AS response_id, status, CASE WHEN status = 'resolved' THEN
    'cache-control: max-age=' || CASE WHEN p % 7 = 0 THEN '60' ELSE '90' END || chr(10) || 'content-type: text/html' || chr(10) || 'date: later ' || p || chr(10)
    || 'etag: ' || CASE WHEN p % 7 = 0 THEN '' ELSE 'W/' END || '"' || rh || '"' || chr(10) || 'last-modified: day ' || rp END AS headers,
  CASE WHEN status = 'resolved' THEN rh END AS payload FROM s"""
_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _late(n: int) -> str:
    """Windows of n words (i from 1) that a smaller doc_id also has."""
    return f"""{_WORDS},
v AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)),
f AS (SELECT t, min(doc_id) AS m FROM v GROUP BY t),
l AS (SELECT DISTINCT v.doc_id, v.i FROM v JOIN f ON v.t = f.t WHERE v.doc_id > f.m)"""


_SUFFIX = f"""WITH {_late(50)},
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM l),
q AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s)
SELECT doc_id, (min(i) - 1)::BIGINT AS first_word, (max(i) - min(i) + 50)::BIGINT AS n_words FROM q GROUP BY doc_id, g"""
_SUBSTRING = f"""WITH {_late(13)},
g AS (SELECT DISTINCT doc_id, i + k AS p FROM l, (SELECT unnest(range(13)) AS k)),
u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.p) FILTER (g.p IS NULL) AS kept, count(*) FILTER (g.p IS NOT NULL) AS gone FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.node)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node"""
_NO_FAULT = "y.f NOT IN ('blank', 'duplicate')"


def _way(state: str, edit: str, price: int, text: str) -> str:
    """The way that ends in a state, gone on by an edit."""
    return f"CASE WHEN a.{state}.c IS NOT NULL THEN {{'c': a.{state}.c + {price} + CASE WHEN '{edit}' <> 'D' AND y.f = 'truncated' THEN 1 ELSE 0 END, 'e': a.{state}.e || '{edit}', 'x': a.{state}.x || {text}}} END"


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))[1]"


def _kept(role: str, initial: str, between: dict[str, str]) -> list[str]:
    """Ways that keep or rerole a turn as this role, after each state with the turns inserted before it."""
    out = []
    for state, inserted in between.items():
        n, before = inserted.count(":"), f"'{inserted}' || " if inserted else ""
        out.append(f"CASE WHEN {_NO_FAULT} AND y.i = '{initial}' THEN {_way(state, 'I' * n + 'K', 2 * n, before + 'y.r')} END")
        if role:
            out.append(f"CASE WHEN {_NO_FAULT} AND y.i <> '{initial}' THEN {_way(state, 'I' * n + 'R', 2 * n + 2, f"{before}chr(10) || '{role}:' || y.t")} END")
    return out


_STRUCTURE = rf"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT c.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i:i])::BIGINT), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h FROM c, tab),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS m FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN m > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS f,
  role[1:1] AS i, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
  count(*) FILTER (p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal, list({{'i': i, 'f': f, 'r': chr(10) || role || ':' || text, 't': text}} ORDER BY n) AS ys FROM f GROUP BY conv_id),
w AS (SELECT * EXCLUDE (ys), list_reduce(ys, lambda a, y: {{
  'n': {_way('n', 'D', 3, "''")},
  's': {_best(_way('s', 'D', 3, "''"), *_kept('', 's', {'n': ''}))},
  'u': {_best(_way('u', 'D', 3, "''"), *_kept('user', 'u', {'n': '', 's': '', 'a': '', 'u': '~assistant:'}))},
  'a': {_best(_way('a', 'D', 3, "''"), *_kept('assistant', 'a', {'u': '', 'n': '~user:', 's': '~user:', 'a': '~user:'}))}}},
  {{'n': {{'c': 0, 'e': '', 'x': ''}}, 's': {{'c': NULL::INTEGER, 'e': '', 'x': ''}}, 'u': {{'c': NULL::INTEGER, 'e': '', 'x': ''}}, 'a': {{'c': NULL::INTEGER, 'e': '', 'x': ''}}}}) AS a FROM g),
z AS (SELECT * EXCLUDE (a), {_best("a.n", "a.a", *(f"CASE WHEN a.{k}.c IS NOT NULL THEN {{'c': a.{k}.c + {2 * v.count(':')}, 'e': a.{k}.e || '{'I' * v.count(':')}', 'x': a.{k}.x || '{v}'}} END" for k, v in (('u', '~assistant:'), ('s', '~user:~assistant:'))))} AS b FROM w)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit,
  sha256(coalesce(b.x[2:], '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id""".replace("'~assistant:'", "chr(10) || 'assistant:'").replace("'~user:~assistant:'", "chr(10) || 'user:' || chr(10) || 'assistant:'").replace("'~user:'", "chr(10) || 'user:'")
ORACLES: dict[str, str] = {"op12_structure_repair": _STRUCTURE, "op1_chat_formatting": _CHAT, "op4_warc_revisits": _WARC, "op6_suffix_array_dedup": _SUFFIX, "op9_jaccard_join": _JACCARD, "op10_substring_dedup": _SUBSTRING}
