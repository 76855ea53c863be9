"""Conservative normalisation of Markdown: line ends, trailing blanks outside code fences, one final line end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Put after the text, so that a match can tell that it reached the end.
_LAST = "\ufdd1"
#: Where a line begins, and where it ends.
_BEGIN, _END = r"(?<![^\n])", rf"(?=\n|{_LAST}?\z)"
#: A fence from its first line to the line that closes it (the same mark, at least as often), or to the end of the text.
_FENCE = rf"({_BEGIN} {{0,3}}(([`~])\3{{2,}}+)[\s\S]*?(?:\n {{0,3}}\2\3*+[ \t]*+{_END}|{_LAST}\z))"
#: What goes at the end of other lines: tabs, and a blank that stands alone.
_LOOSE = rf"(?<! ) \t*+{_END}|(?<!\t)\t++{_END}"


def normalised(text: Column) -> Column:
    """The text with one kind of line end, without loose blanks outside code fences, and with one line end at the end. What
    a fence encloses stays as it is; one that nothing closes keeps its blank end too.

    One replacement passes through fences and lines in turn and puts a fence back as it is found. The mark after the text
    survives it only within a fence that is still open."""
    unified = F.regexp_replace(F.regexp_replace(text, r"\A\x{feff}", ""), r"\r\n?", "\n")
    passed = F.regexp_replace(F.concat(unified, F.lit(_LAST)), rf"{_FENCE}|{_LOOSE}|{_LAST}\z", "$1")
    is_open = passed.endswith(_LAST)
    kept = F.substr(passed, F.lit(1), F.length(passed) - is_open.cast("int"))
    full = F.rtrim(kept, F.lit(" \t\n"))  # up to the last character; the rest of its line belongs to it
    ended = F.concat(full, F.when(full != "", F.substring_index(F.substr(kept, F.length(full) + 1), "\n", 1)).otherwise(""))
    return F.when(is_open & kept.endswith("\n"), kept).otherwise(F.concat(F.when(is_open, kept).otherwise(ended), F.lit("\n")))
