"""Files as DataFrames. Listing happens on the driver, as links, hidden names and case matter; contents are read by Spark."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator, Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

LISTED = "path string, is_link boolean, is_dir boolean, is_file boolean, bytes long, inside_root boolean"


def is_linked(path: Path) -> bool:
    """A symbolic link or a junction."""
    return path.is_symlink() or getattr(path, "is_junction", lambda: False)()


def uses_link(root: Path, path: Path) -> bool:
    """Whether any part of path below root is a link."""
    now = root
    for part in path.relative_to(root).parts:
        now = now / part
        if is_linked(now):
            return True
    return False


def walk(root: Path, *, recursive: bool = True, prune: Sequence[Path] = ()) -> Iterator[tuple]:
    """Entries below root, depth first, not through links or into pruned folders."""
    top = root.resolve()
    todo = [root]
    while todo:
        for entry in sorted(os.scandir(todo.pop()), key=lambda e: e.name):
            path = Path(entry.path)
            link = is_linked(path)
            folder = entry.is_dir(follow_symlinks=False) and not link
            plain = entry.is_file(follow_symlinks=False) and not link
            size = entry.stat(follow_symlinks=False).st_size if plain else None
            yield path.relative_to(root).as_posix(), link, folder, plain, size, path.resolve().is_relative_to(top)
            if folder and recursive and path not in prune:
                todo.append(path)


def listing(spark: SparkSession, root: str | Path, *, recursive: bool = True, prune: Sequence[Path] = ()) -> DataFrame:
    return spark.createDataFrame(list(walk(Path(root), recursive=recursive, prune=prune)), LISTED)


def with_suffix(entries: DataFrame, suffix: str) -> DataFrame:
    """Plain files of a suffix, whatever its case."""
    return entries.filter("is_file").filter(F.lower("path").endswith(suffix.lower()))


def documents(spark: SparkSession, root: str | Path, suffix: str = ".pdf", *, recursive: bool = False, output: str | Path | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Input documents with their output paths, in processing order (`seq`)."""
    from pyspark.sql import Window

    from ..functions import keys

    top = Path(root)
    below = [Path(output)] if output and Path(output).resolve() != top.resolve() else []
    found = with_suffix(listing(spark, top, recursive=recursive, prune=below), suffix).filter(paths.matches(F.col("path"), include, exclude))
    order = Window.orderBy(keys.folded(F.col("path")), "path")  # a listing made on the driver
    return found.select((F.row_number().over(order) - 1).alias("seq"), F.col("path").alias("input_path"), paths.with_suffix(F.col("path"), ".md").alias("output_path"))


def _literal(path: str) -> str:
    """A path whose special characters stand for themselves."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def contents(spark: SparkSession, root: str | Path, relative: Sequence[str]) -> DataFrame:
    """path and content of the named files, read by the executors; hidden names are read too."""
    if not relative:
        return spark.createDataFrame([], "path string, content binary, bytes long")
    plain = [p for p in relative if not any(part.startswith(("_", ".")) for part in PurePosixPath(p).parts)]
    hidden = [p for p in relative if p not in set(plain)]
    base = Path(root).resolve().as_posix()
    out = spark.createDataFrame([(p, Path(base, p).read_bytes()) for p in hidden], "path string, content binary").withColumn("bytes", F.octet_length("content").cast("long"))
    if plain:
        read = spark.read.format("binaryFile").load([f"{_literal(base)}/{_literal(p)}" for p in plain])
        full = F.regexp_replace("path", r"^file:/*", "/")
        out = read.select(F.substring(full, len(base) + 2, 1 << 20).alias("path"), "content", F.col("length").alias("bytes")).unionByName(out)
    return out


def directory_size(spark: SparkSession, root: str | Path) -> int:
    return int(listing(spark, root).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])


def read_stable(path: Path) -> bytes:
    """The bytes of a plain file that is no link anywhere and does not change while it is read."""
    at = Path(os.path.abspath(path))
    if any(is_linked(p) for p in [at, *at.parents]):
        raise OSError("a link is in the path")
    same = lambda s: (s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns)
    before = at.lstat()
    if not stat.S_ISREG(before.st_mode):
        raise OSError("not a plain file")
    with at.open("rb") as source:
        opened = os.fstat(source.fileno())
        data = source.read()
        after = os.fstat(source.fileno())
    if not same(before) == same(opened) == same(after) == same(at.lstat()):
        raise OSError("the file changed while it was read")
    return data


def read_markdown(spark: SparkSession, root: str | Path, relative: Sequence[str]) -> DataFrame:
    """path and text; the text of what is no valid UTF-8 is null."""
    return contents(spark, root, relative).select("path", F.when(F.is_valid_utf8("content"), F.col("content").cast("string")).alias("text"))
