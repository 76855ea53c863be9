"""JSON as VARIANT: typed tests of its values as columns.

JSON is taken strictly: no NaN, no repeated keys, nothing after the value. A value of a kind that a test does not expect
fails the test; nothing is cast silently."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

Test = Callable[[Column], Column]
#: A test, fields with theirs (others are ignored), or that of every element of an array.
Shape = Test | dict[str, "Shape"] | list["Shape"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed(content: Column) -> Column:
    """The value as VARIANT, null if the text is not one JSON value. Spark's parser stops after a first value, so the text
    is read as the first of two elements, of which the second, its digest, must have been reached."""
    inside = lambda mark: F.try_parse_json(F.concat(F.lit("["), content, F.lit(',"'), mark, F.lit('"]')))
    return let(F.md5(content.cast("binary")), lambda mark: let(inside(mark), lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == mark, at(v, "[0]"))))


def at(value: Column, path: str) -> Column:
    """What is at a path such as .a.b or [0], as VARIANT; null if there is nothing. JSON's null is a value."""
    return F.try_variant_get(value, f"${path}", "variant")


def kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("NOTHING"))


def string(value: Column) -> Column:
    """The text of a string, null for other kinds."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    """The value of a whole number, null for other kinds and for what a long cannot hold."""
    return F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "long"))


def boolean(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def elements(value: Column) -> Column:
    """array<variant> of an array, null for other kinds."""
    return F.try_variant_get(value, "$", "array<variant>")


def names(value: Column) -> Column:
    """The fields of an object, null for other kinds."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def _holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def is_string(value: Column) -> Column:
    return kind(value) == "STRING"


def text(value: Column) -> Column:
    return _holds(string(value) != "")


def flag(value: Column) -> Column:
    return kind(value) == "BOOLEAN"


def count(value: Column) -> Column:
    """A whole number of 0 or more: not true, not 1.0."""
    return _holds(number(value) >= 0) | (kind(value).rlike(r"^DECIMAL\((19|[23]\d),0\)\z") & _holds(F.try_variant_get(value, "$", "decimal(38,0)") >= 0))


def digest(value: Column) -> Column:
    return _holds(string(value).rlike(paths.SHA256))


def attempt(value: Column) -> Column:
    return _holds(string(value).rlike(paths.ATTEMPT))


def relative(value: Column) -> Column:
    return _holds(paths.is_relative(string(value)))


def safe(value: Column) -> Column:
    return _holds(paths.is_safe(string(value)))


def printable(value: Column) -> Column:
    return _holds(paths.is_printable(string(value)))


def name(value: Column) -> Column:
    """One printable part of a path."""
    return text(value) & ~_holds(string(value).rlike(r"[/\\\p{Cc}\p{Cf}]"))


def loosely_one(value: Column) -> Column:
    """1 in any notation, or true."""
    return _holds(boolean(value)) | one(value)


def one(value: Column) -> Column:
    """1, also as 1.0; not true."""
    return kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE)") & _holds(F.try_variant_get(value, "$", "double") == 1)


def exactly_one(value: Column) -> Column:
    return _holds(number(value) == 1)


def of(*values: str) -> Test:
    return lambda v: _holds(string(v).isin(*values))


def true(value: Column) -> Column:
    return _holds(boolean(value))


def maybe(test: Test) -> Test:
    """Null or missing, or as the test says."""
    return lambda v: kind(v).isin("VOID", "NOTHING") | test(v)


def every(shape: Shape) -> Shape:
    return [shape]


def is_object(value: Column) -> Column:
    """Asked without a look at what the object holds."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def _layout(shape: Shape) -> str:
    if isinstance(shape, dict):
        return f"struct<{','.join(f'`{k}`:{_layout(s)}' for k, s in shape.items())}>"
    return f"array<{_layout(shape[0])}>" if isinstance(shape, list) else "variant"


def typed(value: Column, shape: Shape, path: str = "") -> Column:
    """What a shape names, taken out at once: structs and arrays, null for other kinds, with VARIANTs for its tests."""
    return F.try_variant_get(value, f"${path}", _layout(shape))


def holds(own: Column, shape: Shape) -> Column:
    """Whether what `typed` took out is as the shape says."""
    if isinstance(shape, dict):
        return reduce(lambda a, b: a & b, (holds(own[k], s) for k, s in shape.items()), own.isNotNull())
    return _holds(F.forall(own, lambda e: holds(e, shape[0]))) if isinstance(shape, list) else shape(own)


def fits(value: Column, shape: Shape) -> Column:
    """Whether a value is as a shape says."""
    return let(typed(value, shape), lambda own: holds(own, shape))
