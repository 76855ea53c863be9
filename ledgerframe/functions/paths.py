"""Relative paths: safety, suffixes, patterns, ancestors."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256 = r"^[0-9a-f]{64}\z"
ATTEMPT = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z"


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", "."))


def canonical(path: Column) -> Column:
    """Without empty and single-dot parts."""
    return F.array_join(_parts(path), "/")


def is_relative(path: Column) -> Column:
    """Stays below its root: no backslash, drive, leading slash or parent part. May still be a bare dot."""
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|\z)"), F.lit(False))


def is_safe(path: Column) -> Column:
    """Relative and names something."""
    return is_relative(path) & (F.size(_parts(path)) > 0)


def is_printable(path: Column) -> Column:
    """Relative, and free of control and format characters."""
    return is_relative(path) & ~path.rlike(r"[\p{Cc}\p{Cf}]")


def is_canonical(path: Column) -> Column:
    """Printable, and written as canonical() writes it."""
    return is_printable(path) & (canonical(path) == path) & (path != "")


def with_suffix(path: Column, suffix: str) -> Column:
    """The last suffix of the last part replaced; a part that only begins with a dot has none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+\z", ""), F.lit(suffix))


def sidecar_of(output_path: Column) -> Column:
    return with_suffix(output_path, ".metadata.json")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def pattern_regex(pattern: str) -> str:
    """A case-insensitive regex for a path pattern: part by part, ** standing for any number of parts. No repeated groups,
    which would need stack for each part of a path."""
    out, between = "", False
    for part in pattern.split("/"):
        if part == "**":
            out, between = out + ("(?:/.*[^/])?" if between else "(?:[^/](?:.*[^/])?)?"), True
            continue
        body, i = "", 0
        while i < len(part):
            end = part.find("]", i + 2 if part[i + 1 : i + 2] in ("!", "]") else i + 1) if part[i] == "[" else -1
            if part[i] == "*":
                body += "[^/]*"
            elif part[i] == "?":
                body += "[^/]"
            elif end > 0:
                inner = part[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                body += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
                i = end
            else:
                body += re.escape(part[i])
            i += 1
        out += ("/" if between else "") + body
        between = True
    out = re.sub(r"^\(\?:\[\^/\]\(\?:\.\*\[\^/\]\)\?\)\?/", "(?:[^/].*/)?", out)
    return rf"(?is)^{out}\z"


def matches(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Matches any of include (or there is none) and none of exclude."""
    any_of = lambda patterns: reduce(lambda a, b: a | b, (path.rlike(pattern_regex(p)) for p in patterns))
    wanted = any_of(include) if include else F.lit(True)
    return wanted & ~any_of(exclude) if exclude else wanted
