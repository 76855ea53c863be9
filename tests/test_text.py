"""Text rules against row-at-a-time statements of the same rules."""

import random
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerframe.functions import keys, paths
from ledgerframe.functions import text as T
from ledgerframe.operators import normalize, quality

EMPTY, SHORT, PATH, TRACE, CONTROL = quality.WARNINGS

#: Text: visible length, warnings, headings, list items, rows of the first table; written by hand.
CASES = {
    "": (0, [EMPTY]),
    " ": (0, [EMPTY]),
    "#|*_`~>-[]()": (0, [EMPTY]),
    "short": (5, [SHORT]),
    "x" * 40: (40, []),
    "x" * 39: (39, [SHORT]),
    "# x" * 20: (39, [SHORT], [(1, "x# x" + "# x" * 18)]),
    "Straße ẞ ﬁ ŉ ΐ İ ς": (25, [SHORT]),
    "a\u00a0b\u2003c\x1cd\x85e": (9, [SHORT, CONTROL]),
    "C:\\x": (4, [SHORT, PATH]),
    "xC:\\x": (5, [SHORT]),
    "éC:/": (4, [SHORT]),
    "(C:/a": (4, [SHORT, PATH]),
    "see /srv/a/b.txt": (16, [SHORT, PATH]),
    "http://a/b/c": (12, [SHORT]),
    "a/b/c": (5, [SHORT]),
    "é/a/b": (5, [SHORT]),
    "/a/": (3, [SHORT, PATH]),
    "/a": (2, [SHORT]),
    "//a/b": (5, [SHORT]),
    "TraceBack (most recent call last): x": (35, [SHORT, TRACE]),
    "traceback (moſt recent call last)": (31, [SHORT, TRACE]),
    "Traceback (moﬆ)": (14, [SHORT]),
    "\u202e": (1, [SHORT, CONTROL]),
    "\x00": (1, [SHORT, CONTROL]),
    "tab\there\r\n": (8, [SHORT]),
    "zero\u200bwidth": (10, [SHORT, CONTROL]),
    "\ufeffbom": (4, [SHORT, CONTROL]),
    "🙂": (1, [SHORT]),
    "# One #\n## two  words\n####### no\n #3\n# \n": (18, [SHORT], [(1, "one"), (2, "two words")]),
    "- a\n* B  b\n+ c\n-d\n1. e": (16, [SHORT], [], ["a", "b b", "c"]),
    "| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 |\n| 4 | 5 |": (17, [SHORT]),  # a dash alone makes no table
    "| a | b |\n|---|:---:|\n| 1 | 2 |\n| 3 |\n| 4 | 5 |": (17, [SHORT], [], [], [["a", "b"], ["1", "2"]]),
    "x\n| a | b |\n| --- | - |\n": (5, [SHORT]),
    "a|b\n---|---\n1|2\nno bar\n3|4": (18, [SHORT], [], [], [["a", "b"], ["1", "2"]]),
    "| A |\n| --- |\n| 1 |": (3, [SHORT]),
    "h | h2\n--- | ---": (4, [SHORT], [], [], [["h", "h2"]]),
    "a\x0bb\x0c# H\u2028- item": (10, [SHORT, CONTROL], [(1, "h")], ["item"]),
}


@pytest.fixture(scope="module")
def judged(spark):
    t = F.col("t")
    frame = spark.createDataFrame([(s,) for s in CASES], "t string").select("t", quality.warnings(t).alias("w"), T.visible_length(t).alias("n"), T.headings(t).alias("h"), T.bullets(t).alias("b"), T.first_table(t).alias("r"))
    return {r.t: r for r in frame.collect()}


@pytest.mark.parametrize("sample", CASES)
def test_rules(judged, sample):
    r, (n, warned, *found) = judged[sample], CASES[sample]
    assert (r.n, r.w) == (n, warned)
    assert [[tuple(x) for x in r.h], r.b, r.r] == [*found, *[[], [], []][len(found) :]]


@given(st.text(st.characters(codec="utf-8"), max_size=30))
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_properties_of_the_rules(spark, text):
    """What holds for every text: markup and repeated spaces never count, and a rule finds what is put in."""
    t = F.col("t")
    variants = [text, f" {text} ", f"**{text}**", f"{text} C:\\x", f"{text} /a/b", f"{text} traceback (most recent call last)", f"{text}\u202e"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(variants)], "i int, t string")
    got = {r.i: r for r in frame.select("i", T.visible_length(t).alias("n"), quality.warnings(t).alias("w")).collect()}
    assert got[0].n == got[1].n == got[2].n
    assert [w in got[i].w for i, w in ((3, PATH), (4, PATH), (5, TRACE), (6, CONTROL))] == [True] * 4


def test_unreadable_text(spark):
    assert quality.judged(spark.createDataFrame([(None,)], "text string")).first().warnings == ["quality-read-error"]


def test_metrics(spark):
    text = "# Title\n\nThe first phrase, then the second.\n\n- Item  one\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n"
    s = lambda *x: F.array(*map(F.lit, x))
    good = dict(minimum_characters=20, headings=F.array(F.struct(F.lit(1).alias("level"), F.lit("title").alias("text"))), body_phrases=s("FIRST  phrase"), bullet_items=s("item one"), table_rows=F.array(s("a", "b"), s("1", "2")), boundary_phrases=s("first", "second"), key_phrases=s("then"))
    bad = dict(minimum_characters=9999, headings=F.array(F.struct(F.lit(2).alias("level"), F.lit("title").alias("text"))), body_phrases=s("none"), bullet_items=s("item"), table_rows=F.array(s("1", "3")), boundary_phrases=s("second", "first"), key_phrases=s("nothing"))
    frame = spark.createDataFrame([(text, 1), (text + "\u202e", 2)], "t string, i int")
    fails = lambda **e: {r.i: r.f for r in frame.select("i", quality.failed_metrics(F.col("t"), quality.Expectation(**e)).alias("f")).collect()}
    assert fails(**good) == {1: [], 2: ["contamination"]}
    for (name, value), metric in zip(bad.items(), quality.METRICS[:7], strict=True):
        assert fails(**good | {name: value})[1] == [metric]


#: Texts and what they become, written by hand.
NORMAL = {
    "": "\n",
    " \t\n \n": "\n",
    "a": "a\n",
    "a \nb  \nc\t\t\nd \t\ne\t \t\n": "a\nb  \nc\nd\ne\t\n",
    "\ufeffa\r\nb \r\r\n": "a\nb\n",
    "a\n\n\nb\n\n \n": "a\n\n\nb\n",
    "a  \n\n": "a  \n",
    "```\nx \n```\ny \n": "```\nx \n```\ny\n",
    "```\nx \n``` z\ny \n\n": "```\nx \n``` z\ny \n\n",  # nothing closes it
    "````\na \n```\nb\t\n`````  \nc \n": "````\na \n```\nb\t\n`````  \nc\n",
    "~~~ x \n```\n~~~\t\nd \n": "~~~ x \n```\n~~~\t\nd\n",
    "    ```\nx \n": "    ```\nx\n",
    "   ```\nx \n    ```\ny \n   ```\nz ": "   ```\nx \n    ```\ny \n   ```\nz\n",
    "```": "```\n",
    "```\n": "```\n",
    "```\n\n \n": "```\n\n \n",
    "x\n~~~\n~~~\n\n\n": "x\n~~~\n~~~\n",
    "a `x` ~~b~~ \n": "a `x` ~~b~~\n",
    "\ufdd1 \n```\n\ufdd1 ": "\ufdd1\n```\n\ufdd1 \n",
}


def normal(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.normalised(F.col("t")).alias("n"))
    return [r.n for r in frame.collect()]


def test_normalisation(spark):
    assert dict(zip(NORMAL, normal(spark, NORMAL), strict=True)) == NORMAL
    assert normal(spark, [None]) == [None]


def test_properties_of_normalisation(spark):
    """Once is enough, fences stay as they are, and line ends do not matter."""
    pick = random.Random(2)
    lines = ["", "a", "a ", "a  ", "b\t", "c \t", " \t", "~~~ x", "  ```", "    ```", "``", "`````"]
    bodies = ["\n".join(pick.choice(lines[:7]) for _ in range(pick.randrange(6))) for _ in range(400)]
    mixed = ["\n".join(pick.choice(lines) for _ in range(pick.randrange(9))) for _ in range(400)]
    once = normal(spark, mixed + bodies)
    assert normal(spark, once) == once
    assert normal(spark, [t.replace("\n", "\r\n") for t in mixed + bodies]) == normal(spark, [t.replace("\n", "\r") for t in mixed + bodies]) == once
    fences = [f"~~~\n{b}\n~~~" for b in bodies]
    assert normal(spark, fences) == [f"{f}\n" for f in fences]
    assert normal(spark, [f"x \n{f}\ny " for f in fences]) == [f"x\n{f}\ny\n" for f in fences]
    assert all(n.endswith("\n") for n in once) and not any(n.endswith("\n\n") for n in normal(spark, bodies))


def test_case_folding_of_every_character(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(every[k : k + 32]) for k in range(0, len(every), 32)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.folded(F.col("t")).alias("f"), keys.folded(F.col("t")).alias("k")).collect()
    assert [r.t for r in got if not r.f == r.k == r.t.casefold()] == []


def test_case_folding_of_random_texts(spark):
    pick = random.Random(6)
    odd = [c for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c]
    texts = ["".join(pick.choice("aB ß“") if pick.random() < 0.7 else pick.choice(odd) for _ in range(pick.randrange(20))) for _ in range(10_000)] + ["ΟΔΟΣ", "ΟΔΟΣΑ", "Wiſdom", "eﬃgy", "5 µM", "İI", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", T.folded(F.col("t")).alias("f")).collect()
    assert [r.t for r in got if r.f != (r.t and r.t.casefold())] == []
    phrases = F.array(*map(F.lit, ["ΟΔΟΣ", "wisdom", "EFFIGY", "5 μm"]))
    rest = spark.createDataFrame([("οδοσα Wiſdom eﬃgy 5 µM",)], "t string").select(T.missing(T.normalised(F.col("t")), phrases).alias("m")).first().m
    assert rest == []


#: Texts on which a pattern with a repeated group or a second look at the same blanks would run out of stack or of time.
LONG = {
    "parts of a path": "/a" * 100_000,
    "blank lines at the end": "x" + "\n" * 100_000,
    "blank lines within": "x" + "\n" * 100_000 + "y",
    "blanks in a heading": "# a" + " " * 20_000 + "b",
    "number signs": "# " + "#" * 100_000 + "x",
    "blanks in an item": "- a" + " \t" * 50_000 + "b",
    "blanks": " " * 100_000 + "x",
    "tabs": "\t" * 100_000 + "x",
    "blanks in a row": "|" + " " * 100_000 + "|b|\n|---|---|\n",
    "fences": "```\n" * 50_000,
    "fences that nothing closes": "~~~x\n" * 30_000 + "````\n",
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts(spark, name):
    """Every rule, 2 seconds each at most."""
    t = F.col("t")
    frame = spark.createDataFrame([(LONG[name],)], "t string")
    rules = {"normal": normalize.normalised(t), "warnings": quality.warnings(t), "headings": T.headings(t), "bullets": T.bullets(t), "table": T.first_table(t), "error": T.sanitised(t, F.lit("q")), "plain": T.normalised(t)}
    for rule, column in rules.items():
        frame.limit(0).select(column).collect()
        began = time.perf_counter()
        frame.select(column).write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - began < 2, rule
    got = frame.select(T.has_absolute_path(t).alias("p"), F.size(T.headings(t)).alias("h"), F.length(normalize.normalised(t)).alias("n")).first()
    assert got.p == (name == "parts of a path")
    assert got.h == ("heading" in name or "signs" in name)
    if name == "blank lines at the end":
        assert got.n == 2


def test_long_paths_match_patterns(spark):
    frame = spark.createDataFrame([("a/" * 50_000 + "b.pdf",)], "p string")
    assert frame.filter(paths.matches(F.col("p"), ("**/*.pdf",), ("x/**", "a/**/c.pdf"))).count() == 1


def test_keys(spark):
    values = ["A/b", "É", "É", "Straße", "STRASSE", "ﬁ", "ǅ", None, ""]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", keys.path_key(F.col("v")), keys.folded(F.col("v"))).collect()]
    assert got == [(v, None if v is None else unicodedata.normalize("NFC", v).casefold(), None if v is None else v.casefold()) for v in values]


def test_paths(spark):
    from pathlib import PurePosixPath

    values = ["a/b.md", "a", ".md", "a/.x", "a.b/c", "a/b.c.d", "a/./b.md", "a//b", "a/", ".", "..", "a/../b", "/a", "C:x", "a\\b", "", "a\u202eb", "x/y.tar.gz"]
    p = F.col("p")
    frame = spark.createDataFrame([(v,) for v in values], "p string").select("p", paths.is_safe(p).alias("safe"), paths.is_relative(p).alias("rel"), paths.is_printable(p).alias("print"), paths.is_canonical(p).alias("canon"), paths.sidecar_of(p).alias("side"), paths.ancestors(p).alias("up"))
    from ledgerframe.plans import reports as R

    for r in frame.collect():
        assert (r.safe, r.rel, r.print) == (R.safe(r.p), R.relative(r.p), R.printable(r.p)), r.p
        assert r.canon == R.canonical(r.p) or r.p == ".", r.p
        if r.safe and R.canonical(r.p):
            assert r.side == PurePosixPath(r.p).with_suffix(".metadata.json").as_posix()
            assert r.up == [x.as_posix() for x in reversed(PurePosixPath(r.p).parents) if x.parts]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.pdf", ["a.pdf", "A.PDF"], ["a/b.pdf", "a.pdfx"]),
        ("**/*.pdf", ["a.pdf", "x/a.pdf", "x/y/a.pdf"], ["a.txt"]),
        ("x/**", ["x", "x/a", "x/a/b"], ["y/a", "xx"]),
        ("x/**/b?.pdf", ["x/b1.pdf", "x/q/r/b2.pdf"], ["x/b.pdf", "b1.pdf"]),
        ("[!a]*/[bc].md", ["x/b.md", "yy/c.md"], ["a/b.md", "x/d.md", "x/y/b.md"]),
        ("a.b+(c)/*", ["a.b+(c)/x"], ["aXb+(c)/x"]),
    ],
)
def test_patterns(spark, pattern, yes, no):
    frame = spark.createDataFrame([(v,) for v in yes + no], "p string").filter(paths.matches(F.col("p"), (pattern,)))
    assert {r.p for r in frame.collect()} == set(yes)


def test_exclude_wins(spark):
    frame = spark.createDataFrame([("a/x.pdf",), ("b/x.pdf",)], "p string")
    assert [r.p for r in frame.filter(paths.matches(F.col("p"), ("**",), ("b/**",))).collect()] == ["a/x.pdf"]


def test_sanitised(spark):
    rows = [("cannot read in/a.pdf", "in/a.pdf", "cannot read a.pdf"), ("bad   /home/me/x.txt\nand C:\\u\\v end", "q", "bad <local-path> and <local-path> end"), ("x" * 200, "q", "x" * 157 + "...")]
    got = spark.createDataFrame(rows, "m string, p string, w string").select("w", T.sanitised(F.col("m"), F.col("p")).alias("g")).collect()
    assert all(r.w == r.g for r in got)
