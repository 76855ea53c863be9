"""Registered queries over texts, and their SQL."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import normalize, quality
from .synth import DECORATED, FOLDING, decorated, read, spread

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT = "[^" + _SPACE[1:]
_WORD = r"\pL\pN_"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spread(read(spark, sf_dir, "documents")))


def _each_warning(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each warning. An outer explode: a plain one would have the optimizer test the size of the array first,
    with all rules written out once more below every projection."""
    return quality.judged(docs).select(*keys, F.explode_outer("warnings").alias("category")).filter("category is not null")


def quality_warnings_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_warning(_docs(spark, sf_dir), "doc_id")


def quality_summary_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_docs(spark, sf_dir))
    return judged.groupBy("lang").agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "warned").alias("warned"))


def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_warnings_by(_docs(spark, sf_dir), "lang")


def quality_warnings_by(docs: DataFrame, *keys: str) -> DataFrame:
    return _each_warning(docs, *keys).groupBy(*keys, "category").agg(F.count("*").alias("n"))


def quality_conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spread(read(spark, sf_dir, "conversations"))).select("conv_id", "turn", F.array_join("warnings", ",").alias("warnings"), "status")


def page_path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    pages = T.measured(spread(read(spark, sf_dir, "pages")).select("page_id", "html"), "html")
    return pages.select("page_id", html.rlike(T.WINDOWS_PATH).alias("windows_path"), html.rlike(T.POSIX_PATH).alias("posix_path"), T.has_control(html).alias("control"), F.col("visible").cast("long").alias("visible"))


def normalized_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = normalize.normalised(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("sha256"), F.octet_length("t").cast("long").alias("bytes"))


def normalize_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("lang", "text", normalize.normalised(F.col("text")).alias("t"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("t") != F.col("text")).alias("changed"), F.sum((F.octet_length("text") - F.octet_length("t")).cast("long")).alias("bytes_saved"))


def heading_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.headings(F.col("text"))).alias("seq", "h")).select("doc_id", "seq", F.col("h.level").alias("level"), F.col("h.text").alias("heading"))


def bullet_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.bullets(F.col("text"))).alias("seq", "item"))


def first_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.first_table(F.col("text"))).alias("seq", "cells")).select("doc_id", "seq", F.array_join("cells", " | ").alias("cells"))


def expectation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against one benchmark item, dealt out over all items by their place; three of the item's words, the
    first, the middle and the last, are its key phrases."""
    place = F.row_number().over(Window.orderBy("item_id")) - 1  # the benchmark: a bounded table
    items = read(spark, sf_dir, "benchmark").filter("item_id is not null").select(place.alias("place"), F.split("text", " ").alias("b"), F.count("*").over(Window.partitionBy()).alias("n"))
    docs = _docs(spark, sf_dir).crossJoin(F.broadcast(items.select(F.col("n").alias("many")).limit(1))).withColumn("place", F.col("doc_id") % F.col("many"))  # one row
    both = docs.join(F.broadcast(items), "place")
    both = T.measured(both.drop("n", "many", "place"), "text").withColumn("plain", T.normalised(F.col("text")))
    number = F.col("doc_id").cast("string")
    title = F.concat(F.lit("TITLE  "), number, F.when(F.col("doc_id") % 2 == 0, F.lit(f" {FOLDING.casefold()}")).otherwise(""))
    expected = quality.Expectation(
        minimum_characters=100,
        headings=F.array(F.struct(F.lit(1).alias("level"), title.alias("text"))),
        body_phrases=F.array(F.lit("the"), F.when(F.col("doc_id") % 4 == 0, "WISDOM  fin").otherwise("")),
        bullet_items=F.array(F.concat(F.lit("ITEM "), number)),
        table_rows=F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.concat(F.lit("x"), number), F.lit("y"))),
        boundary_phrases=F.array(F.lit("title"), F.lit("item")),
        key_phrases=F.array(*(F.get("b", F.floor((F.size("b") - 1) * k / 2).cast("int")) for k in (0, 1, 2))),
    )
    return both.select("doc_id", F.array_join(quality.failed_metrics(F.col("text"), expected, F.col("visible"), F.col("plain")), ",").alias("failed"))


def phrase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalised(F.col("text")).alias("plain")).select("doc_id", T.in_order(F.col("plain"), F.array(F.lit("Title"), F.lit(" the "), F.lit("and"))).alias("in_order"))


QUERIES = {
    f.__name__: f
    for f in (quality_warnings_per_doc, quality_summary_by_lang, quality_by_lang, quality_conversation_turns, page_path_flags, normalized_digest, normalize_changed, heading_inventory, bullet_inventory, first_table_rows, expectation_metrics, phrase_order)
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _fold(x: str) -> str:
    """Case folding from a table of all characters: one to one, then each that folds to more."""
    every = [(c, c.casefold()) for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and c.casefold() != c]
    one = [(c, f) for c, f in every if len(f) == 1]
    whole = f"translate({x}, {_quoted(''.join(c for c, _ in one))}, {_quoted(''.join(f for _, f in one))})"
    for c, f in every:
        if len(f) > 1 and c in _LONGER:
            whole = f"replace({whole}, {_quoted(c)}, {_quoted(f)})"
    return whole


#: Characters with a longer folding that the test texts hold: the SQL replaces these only, each for every text.
_LONGER = "ßẞﬁﬄİᾳ"


def _norm(x: str) -> str:
    return _fold(f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'), ' ')")


def _visible(x: str) -> str:
    bare = rf"regexp_replace({x}, '[#|*_`~>\-\[\]()]', ' ', 'g')"
    return f"length({_norm(bare)})"


_WIN, _POSIX = rf"(^|[^{_WORD}])[A-Za-z]:[\\/]", rf"(^|[^{_WORD}/:])/([^/\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+/)+"
_CTRL = r"[\p{Cf}\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]"


def _flags(x: str, table: str, keys: str) -> str:
    return f"""SELECT {keys}, {_visible(x)} AS n, regexp_matches({x}, '{_WIN}') OR regexp_matches({x}, '{_POSIX}') AS p,
    contains(lower({x}), 'traceback (most recent call last)') AS t, regexp_matches({x}, '{_CTRL}') AS c FROM {table}"""


_CATEGORIES = """list_filter([CASE WHEN n = 0 THEN 'empty-output' WHEN n < 40 THEN 'short-output' END, CASE WHEN p THEN 'absolute-path' END,
    CASE WHEN t THEN 'traceback' END, CASE WHEN c THEN 'control-character' END], lambda w: w IS NOT NULL)"""
_W = f"WITH {DECORATED}, f AS ({_flags('text', 'd', 'doc_id, lang')}), w AS (SELECT *, {_CATEGORIES} AS ws FROM f)"
_LINES = r"string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10))"
_HEAD = rf"^{_SPACE}*(#{{1,6}}){_SPACE}+(.+?){_SPACE}*#*{_SPACE}*$"
_ITEM = rf"^{_SPACE}*[-*+]{_SPACE}+(.+?){_SPACE}*$"
_H = f"h AS (SELECT doc_id, list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '{_HEAD}')), lambda l: {{'level': length(regexp_extract(l, '{_HEAD}', 1)), 'text': {_norm(f"regexp_extract(l, '{_HEAD}', 2)")}}}) AS hs FROM d)"
_B = f"b AS (SELECT doc_id, list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '{_ITEM}')), lambda l: {_norm(f"regexp_extract(l, '{_ITEM}', 1)")}) AS bs FROM d)"


def _cells(line: str) -> str:
    return f"list_transform(string_split(trim(regexp_replace({line}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '|'), '|'), lambda c: {_norm('c')})"


_TABLE = f"""ln AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, {_LINES} AS ls FROM d)),
lc AS (SELECT doc_id, i, l, {_cells('l')} AS cells FROM ln WHERE contains(l, '|') OR contains(l, '-')),
st AS (SELECT a.doc_id, min(a.i) AS s FROM lc a JOIN lc b ON a.doc_id = b.doc_id AND b.i = a.i + 1
    WHERE len(a.cells) >= 2 AND len(a.cells) = len(b.cells) AND len(list_filter(b.cells, lambda c: NOT regexp_full_match(c, ':?-{{3,}}:?'))) = 0 GROUP BY 1),
hd AS (SELECT st.doc_id, s, len(cells) AS w, cells FROM st JOIN lc ON st.doc_id = lc.doc_id AND lc.i = s),
bd AS (SELECT ln.doc_id, ln.i, {_cells('ln.l')} AS cells, ln.i >= hd.s + 2 AND contains(ln.l, '|') AND len({_cells('ln.l')}) = w AS ok, s, w FROM ln JOIN hd ON ln.doc_id = hd.doc_id WHERE ln.i >= hd.s + 2),
en AS (SELECT doc_id, min(CASE WHEN NOT ok THEN i END) AS e FROM bd GROUP BY 1),
tr AS (SELECT doc_id, 0 AS seq, cells FROM hd UNION ALL SELECT bd.doc_id, bd.i - bd.s - 1, bd.cells FROM bd JOIN en ON bd.doc_id = en.doc_id WHERE e IS NULL OR bd.i < e)"""
_NORMAL = r"""n0 AS (SELECT doc_id, lang, text, string_split(replace(replace(CASE WHEN starts_with(text, chr(65279)) THEN text[2:] ELSE text END, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM d),
n1 AS (SELECT doc_id, lang, text, list_reduce(ls, lambda a, l: {
    'm': CASE WHEN a.m <> '' THEN CASE WHEN regexp_full_match(l, ' {0,3}[`~]+[ \t]*') AND starts_with(ltrim(l, ' '), a.m) AND rtrim(ltrim(l, ' '), chr(9) || ' ' || a.m[1]) = '' THEN '' ELSE a.m END
              WHEN regexp_matches(l, '^ {0,3}(`{3,}|~{3,})') THEN regexp_extract(l, '^ {0,3}(`{3,}|~{3,})', 1) ELSE '' END,
    'o': a.o || [CASE WHEN a.m <> '' OR regexp_matches(l, '^ {0,3}(`{3,}|~{3,})') THEN l
              WHEN regexp_matches(rtrim(l, chr(9)), '(^|[^ ]) $') THEN regexp_replace(rtrim(l, chr(9)), ' $', '') ELSE rtrim(l, chr(9)) END]},
    {'m': '', 'o': []::VARCHAR[]}) AS r FROM n0),
n AS (SELECT doc_id, lang, text, CASE WHEN r.m <> '' THEN CASE WHEN ends_with(array_to_string(r.o, chr(10)), chr(10)) THEN array_to_string(r.o, chr(10)) ELSE array_to_string(r.o, chr(10)) || chr(10) END
    ELSE regexp_replace(array_to_string(r.o, chr(10)), '(^|\n)[ \t]*(\n[ \t]*)*$', '') || chr(10) END AS t FROM n1)"""
_EXPECT = f"""WITH {DECORATED}, f AS ({_flags('text', 'd', 'doc_id, text')}), {_H}, {_B}, {_TABLE},
tt AS (SELECT doc_id, list(array_to_string(cells, ' | ')) AS ts FROM tr GROUP BY 1),
e AS (SELECT f.*, {_norm('f.text')} AS own, hs, bs, coalesce(ts, []) AS ts, bm.ws AS ws, len(bm.ws) - 1 AS z FROM f JOIN h USING (doc_id) JOIN b USING (doc_id) LEFT JOIN tt USING (doc_id)
  JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, string_split(text, ' ') AS ws FROM benchmark WHERE item_id IS NOT NULL) bm ON bm.place = f.doc_id % (SELECT count(*) FROM benchmark WHERE item_id IS NOT NULL))
SELECT doc_id, array_to_string(list_filter([CASE WHEN n < 100 THEN 'minimum_length' END,
  CASE WHEN NOT list_contains(hs, {{'level': 1, 'text': 'title ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' {FOLDING.casefold()}' ELSE '' END}}) THEN 'headings' END, CASE WHEN NOT contains(own, 'the') OR (doc_id % 4 = 0 AND NOT contains(own, 'wisdom fin')) THEN 'body_text' END,
  CASE WHEN NOT list_contains(bs, 'item ' || doc_id) THEN 'bullet_list' END, CASE WHEN NOT (list_contains(ts, 'a | b') AND list_contains(ts, 'x' || doc_id || ' | y')) THEN 'table_structure' END,
  CASE WHEN strpos(own, 'title') = 0 OR strpos(own, 'item') < strpos(own, 'title') THEN 'page_boundary' END, CASE WHEN NOT (contains(own, {_norm('ws[1]')}) AND contains(own, {_norm('ws[1 + z // 2]')}) AND contains(own, {_norm('ws[1 + z]')})) THEN 'key_phrases' END,
  CASE WHEN p OR t OR c THEN 'contamination' END], lambda m: m IS NOT NULL), ',') AS failed FROM e"""

ORACLES = {
    "quality_warnings_per_doc": f"{_W} SELECT doc_id, unnest(ws) AS category FROM w",
    "quality_summary_by_lang": f"{_W} SELECT lang, count(*) AS checked, count(*) FILTER (len(ws) = 0) AS passed, count(*) FILTER (len(ws) > 0) AS warned FROM w GROUP BY lang",
    "quality_by_lang": f"{_W} SELECT lang, category, count(*) AS n FROM (SELECT lang, unnest(ws) AS category FROM w) GROUP BY lang, category",
    "quality_conversation_turns": f"WITH f AS ({_flags('text', 'conversations', 'conv_id, turn')}), w AS (SELECT *, {_CATEGORIES} AS ws FROM f) SELECT conv_id, turn, array_to_string(ws, ',') AS warnings, CASE WHEN len(ws) > 0 THEN 'warned' ELSE 'passed' END AS status FROM w",
    "page_path_flags": f"SELECT page_id, regexp_matches(html, '{_WIN}') AS windows_path, regexp_matches(html, '{_POSIX}') AS posix_path, regexp_matches(html, '{_CTRL}') AS control, {_visible('html')} AS visible FROM pages",
    "normalized_digest": f"WITH {DECORATED}, {_NORMAL} SELECT doc_id, sha256(t) AS sha256, strlen(t) AS bytes FROM n",
    "normalize_changed": f"WITH {DECORATED}, {_NORMAL} SELECT lang, count(*) AS n, count(*) FILTER (t <> text) AS changed, sum(strlen(text) - strlen(t))::BIGINT AS bytes_saved FROM n GROUP BY lang",
    "heading_inventory": f"WITH {DECORATED}, {_H}, x AS (SELECT doc_id, unnest(hs) AS h, unnest(range(len(hs))) AS seq FROM h) SELECT doc_id, seq::INTEGER AS seq, h.level::INTEGER AS level, h.text AS heading FROM x",
    "bullet_inventory": f"WITH {DECORATED}, {_B} SELECT doc_id, unnest(range(len(bs)))::INTEGER AS seq, unnest(bs) AS item FROM b",
    "first_table_rows": f"WITH {DECORATED}, {_TABLE} SELECT doc_id, seq::INTEGER AS seq, array_to_string(cells, ' | ') AS cells FROM tr",
    "expectation_metrics": _EXPECT,
    "phrase_order": f"WITH {DECORATED}, o AS (SELECT doc_id, {_norm('text')} AS own FROM d) SELECT doc_id, strpos(own, 'title') > 0 AND strpos(own, 'the') >= strpos(own, 'title') AND strpos(own, 'and') >= strpos(own, 'the') AS in_order FROM o",
}
