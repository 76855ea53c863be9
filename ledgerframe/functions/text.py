"""Text rules as column expressions that stay in the JVM."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space, as line ends and as markup.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = "[^" + SPACE[1:]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
MARKUP = r"[#|*_`~>\-\[\]()]"
WORD = r"\p{L}\p{N}_"
WINDOWS_PATH = rf"(?<![{WORD}])[A-Za-z]:[\\/]"
POSIX_PATH = rf"(?<![{WORD}/:])/[^/{SPACE[1:]}+/"  # one part tells; a repeated group would need stack for each part
CONTROL = r"[\p{Cc}\p{Cf}\p{Cs}&&[^\n\r\t]]"
TRACEBACK = "traceback (most recent call last)"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # the characters of SPACE


def _class_of(length: int) -> str:
    """The characters whose full case folding has `length` characters, while lower-casing keeps one."""
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and len(c.casefold()) == length]
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in found) + "]"


_DOUBLE, _TRIPLE = _class_of(2), _class_of(3)


def _runs_of(more: str = "") -> str:
    """Runs of white space, or of characters of the class `more`, other than single blanks: those stay as they are."""
    every = f"[{more}{SPACE[1:]}"
    return f"[{every}&&[^ ]]{every}*| {every}+"


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, _runs_of(), " "), F.lit(" "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed, and written, once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """From Unicode's full case folding: the characters beyond ASCII that fold to one other character, these characters,
    and those that fold to more."""
    found = [(c, c.casefold()) for c in map(chr, range(0x80, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and c.casefold() != c]
    single = [(c, f) for c, f in found if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), [(c, f) for c, f in found if len(f) > 1]


_ONE, _ITS, _LONGER = _foldings()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """Full case folding, exact for every character.

    Lower-casing settles ASCII and Latin-1, where only sharp s and the micro sign fold otherwise; texts with characters
    beyond are folded by the tables alone, which no version of Unicode in the JVM can differ from."""
    longer = "".join(c for c, _ in _LONGER)
    table = F.split(F.lit(",".join(c + f for c, f in _LONGER)), ",")  # each with its folding

    def beyond(own: Column) -> Column:
        one = F.replace(F.translate(own, _UPPER + _ONE, _LOWER + _ITS), F.lit("ß"), F.lit("ss"))
        more = F.aggregate(table, one, lambda so_far, e: F.replace(so_far, F.left(e, F.lit(1)), F.substr(e, F.lit(2))))
        return F.when(F.translate(own, longer, "") != own, more).otherwise(one)

    latin = lambda own: F.replace(F.replace(F.lower(own), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    return _let(text, lambda own: F.when(own.rlike(r"^[\x00-\xff]*+\z"), latin(own)).otherwise(beyond(own)))


def normalised(text: Column) -> Column:
    return folded(collapsed(text))


def _bare(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, _runs_of(MARKUP[1:-1]), " "), F.lit(" "))


def _high(bare: Column) -> Column:
    return F.regexp_replace(bare, r"[\x00-\xff]+", "")


def _visible(bare: Column, high: Column) -> Column:
    # Of Latin-1 only sharp s folds to more characters; the large classes see the few characters beyond it.
    longer = F.length(F.regexp_replace(F.regexp_replace(high, _DOUBLE, "aa"), _TRIPLE, "aaa")) - F.length(high)
    return F.length(bare) + F.length(bare) - F.length(F.replace(bare, F.lit("ß"), F.lit(""))) + F.when(high == "", 0).otherwise(longer)


def visible_length(text: Column) -> Column:
    """Characters of the case-folded text without markup and repeated white space; exact for every character."""
    return _visible(_bare(text), _high(_bare(text)))


def measured(rows: DataFrame, text: str) -> DataFrame:
    """rows with the column `visible`, the visible length of a text; each step is a projection, so it runs once."""
    own = [F.col(f"`{c}`") for c in rows.columns]
    steps = rows.select(*own, _bare(F.col(f"`{text}`")).alias("_bare")).select(*own, "_bare", _high(F.col("_bare")).alias("_high"))
    return steps.select(*own, _visible(F.col("_bare"), F.col("_high")).alias("visible"))


def has_absolute_path(text: Column) -> Column:
    windows = (text.contains(":\\") | text.contains(":/")) & text.rlike(WINDOWS_PATH)  # the plain tests spare most texts the patterns
    return windows | (text.contains("/") & text.rlike(POSIX_PATH))


def has_traceback(text: Column) -> Column:
    plain = F.replace(F.replace(F.replace(text, F.lit("ſ"), F.lit("s")), F.lit("ﬅ"), F.lit("st")), F.lit("ﬆ"), F.lit("st"))
    return F.lower(plain).contains(TRACEBACK)


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def lines(text: Column) -> Column:
    """The lines of a text at every line end; a last empty one does not count."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def marked(line: Column) -> Column:
    """struct<level, rest>: the number signs that a line begins with, and what comes after them."""
    begun = F.ltrim(line, F.lit(BLANKS))
    rest = F.ltrim(begun, F.lit("#"))
    return F.struct((F.length(begun) - F.length(rest)).alias("level"), rest.alias("rest"))


def _opens(rest: Column) -> Column:
    """White space and at least one more character, be it white space as well."""
    return rest.rlike(f"^{SPACE}") & (F.length(rest) > 1)


def _title(rest: Column) -> Column:
    """The text of a heading, without closing number signs; one that consists of them is the first."""
    whole = trimmed(rest)
    return _let(F.rtrim(F.rtrim(whole, F.lit("#")), F.lit(BLANKS)), lambda own: F.when((own == "") & (whole != ""), "#").otherwise(own))


def headings(text: Column) -> Column:
    """array<struct<level:int, text:string>> in order: lines of one to six number signs, white space and a text."""
    own = F.filter(F.transform(F.filter(lines(text), lambda line: line.contains("#")), marked), lambda m: m["level"].between(1, 6) & _opens(m["rest"]))
    found = F.transform(own, lambda m: F.struct(m["level"].alias("level"), normalised(_title(m["rest"])).alias("text")))
    return F.when(text.contains("#"), found).otherwise(F.when(text.isNotNull(), F.array().cast("array<struct<level:int,text:string>>")))  # the plain test spares most texts the lines


def bullets(text: Column) -> Column:
    begun = F.transform(lines(text), lambda line: F.ltrim(line, F.lit(BLANKS)))
    items = F.filter(begun, lambda line: F.substring(line, 1, 1).isin("-", "*", "+") & _opens(F.substr(line, F.lit(2))))
    found = F.transform(items, lambda line: normalised(F.substr(line, F.lit(2))))
    return F.when(text.contains("-") | text.contains("*") | text.contains("+"), found).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(trimmed(line), F.lit("|")), r"\|", -1), normalised)


def _upto(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


def first_table(text: Column) -> Column:
    """Rows (array<array<string>>) of the first table: a header over a line of dashes of the same width, then the
    lines of that width that hold a bar."""
    dashes = lambda cells: F.forall(cells, lambda c: c.rlike("^:?-{3,}:?$"))

    def within(every: Column) -> Column:
        at = lambda i: F.get(every, i)
        last = F.size(every) - 1
        pair = lambda i: F.size(_cells(at(i))) == F.size(_cells(at(i + 1)))
        starts = lambda i: at(i).contains("|") & at(i + 1).contains("---") & (F.size(_cells(at(i))) >= 2) & pair(i) & dashes(_cells(at(i + 1)))

        def rest(start: Column, head: Column) -> Column:
            after = _upto(start + 2, last)
            ends = F.get(F.filter(after, lambda i: ~at(i).contains("|") | (F.size(_cells(at(i))) != F.size(head))), F.lit(0))
            return _let(F.coalesce(ends, last + 1), lambda stop: F.concat(F.array(head), F.transform(_upto(start + 2, stop - 1), lambda i: _cells(at(i)))))

        def found(start: Column) -> Column:
            return F.when(start.isNull(), F.array().cast("array<array<string>>")).otherwise(_let(_cells(at(start)), lambda head: rest(start, head)))

        return _let(F.get(F.filter(_upto(F.lit(0), last - 1), starts), F.lit(0)), found)

    none = F.when(text.isNotNull(), F.array().cast("array<array<string>>"))
    return F.when(text.contains("|") & text.contains("---"), _let(lines(text), within)).otherwise(none)


def missing(own: Column, expected: Column) -> Column:
    """The expected phrases (array) that a normalised text does not hold."""
    return F.filter(expected, lambda p: ~F.contains(own, normalised(p)))


def in_order(own: Column, phrases: Column) -> Column:
    """True if a normalised text holds all phrases and their first places do not go back."""
    place = lambda p: F.when(normalised(p) == "", F.lit(1)).otherwise(F.instr(own, normalised(p)))
    return _let(F.transform(phrases, place), lambda at: F.forall(at, lambda i: i > 0) & (F.array_sort(at) == at))


def sanitised(message: Column, own_path: Column, limit: int = 160) -> Column:
    """An error message without local paths: white space collapsed, the document's path as its name, others hidden."""
    name = F.element_at(F.split(own_path, "/"), -1)
    short = F.replace(collapsed(message), own_path, name)
    short = F.regexp_replace(short, rf"(?<![{WORD}])(?:[A-Za-z]:[\\/]{NOT_SPACE}*)", "<local-path>")
    part = f"[^/{SPACE[1:]}"
    short = F.regexp_replace(short, rf"(?<![{WORD}/:<])/(?:{part}++/)++{part}*", "<local-path>")  # possessive: no stack for each part
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit - 3), F.lit("..."))).otherwise(short)
