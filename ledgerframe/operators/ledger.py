"""Manifest items, their digests, and the reconciliation of manifest, sidecars and files.

Relations:
  items     seq, input_path, output_path, status, input struct<bytes,sha256>, output struct<bytes,sha256>
  sidecars  seq, sidecar_path, input_path, output_path, status, source and artifact struct<bytes,sha256>,
            engine struct<name,version>, settings struct<table_structure,normalization_profile,artifacts_path_configured>
  files     path, bytes, sha256
  issues    path, severity, category, detail
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.keys import path_key

#: Statuses, and the categories of conversion failures.
STATUSES = ("succeeded", "skipped", "failed")
FAILURES = ("input", "output", "converter", "unexpected")
_ISSUE = "array<struct<path:string,severity:string,category:string,detail:string>>"


def digest(content: Column) -> Column:
    data = content.cast("binary")
    return F.struct(F.octet_length(data).cast("long").alias("bytes"), F.sha2(data, 256).alias("sha256"))


def nothing() -> Column:
    return F.struct(F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"))


def digested(results: DataFrame) -> DataFrame:
    """results with `input` and `output`, the digests of their contents (null: none), in place of input_content and
    output_content. From here on a document is a narrow row."""
    of = lambda c: F.when(F.col(c).isNotNull(), digest(F.col(c))).otherwise(nothing())
    own = [c for c in results.columns if c not in ("input_content", "output_content", "input", "output")]
    return results.select(*own, of("input_content").alias("input"), of("output_content").alias("output"))


def items_of(results: DataFrame) -> DataFrame:
    """Digested results as items: a failed one has no output digest and may lack its input; others must have both, or are
    left out with `complete` false."""
    failed = F.col("status") == "failed"
    complete = failed | (F.col("input.sha256").isNotNull() & F.col("output.sha256").isNotNull())
    return results.select("seq", "input_path", "output_path", "status", "input", F.when(failed, nothing()).otherwise(F.col("output")).alias("output"), complete.alias("complete"))


def manifest_items(results: DataFrame) -> DataFrame:
    """results (seq, input_path, output_path, status, input_content, output_content) as items."""
    return items_of(digested(results))


def manifest_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def failure_category(exception: Column) -> Column:
    """Category of a failed conversion from the kind of its error."""
    return F.when(exception.isin("InputError"), "input").when(exception.isin("FileExistsError", "OSError", "PermissionError", "OutputError"), "output").when(exception == "ConverterError", "converter").otherwise("unexpected")


def failure_breakdown(items: DataFrame) -> DataFrame:
    """Totals by status, and failures of every category, also those that do not occur."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return items.agg(F.count("*").alias("total"), *counts, *(F.count_if((F.col("status") == "failed") & (F.col("category") == c)).alias(f"failed_{c}") for c in FAILURES))


def collisions(items: DataFrame, path: str = "output_path") -> DataFrame:
    """Output paths that are the same document by their keys."""
    return items.groupBy(path_key(F.col(path)).alias("key")).agg(F.count("*").alias("n"), F.min(path).alias("first")).filter("n > 1")


def sidecar_rows(items: DataFrame, engine: Column, settings: Column) -> DataFrame:
    """The sidecars that a complete set of items should have."""
    fine = items.filter("status <> 'failed' and output.sha256 is not null and input.sha256 is not null")
    return fine.select("seq", paths.sidecar_of(F.col("output_path")).alias("sidecar_path"), "input_path", "output_path", "status", F.col("input").alias("source"), F.col("output").alias("artifact"), engine.alias("engine"), settings.alias("settings"))


def _issue(path: Column, category: str, detail: str, severity: str = "error") -> Column:
    return F.struct(path.alias("path"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(detail).alias("detail"))


def _listed(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull()).cast(_ISSUE)


def _keyed(rows: DataFrame, **keys: Column) -> DataFrame:
    """rows with the comparison keys of paths, all in one projection: one pass through Python for what is not ASCII."""
    return rows.select("*", *(path_key(c).alias(n) for n, c in keys.items()))


def reconcile(items: DataFrame | None, sidecars: DataFrame, files: DataFrame, engine: Column | None = None, settings: Column | None = None, strict: bool = False) -> DataFrame:
    """Issues between manifest, sidecars and files; without items only what sidecars say against themselves. Sidecars meet their files by path, then the items by the key of the
    sidecar's path: of sidecars with one key the latest counts. What a sidecar says against itself goes along as a column."""
    p, out = F.col("sidecar_path"), F.col("output_path")
    disk = files.select(F.col("path").alias("output_path"), F.struct("bytes", "sha256").alias("disk"))
    right = _keyed(sidecars, key=p, own_key=paths.sidecar_of(out), in_key=F.col("input_path"), out_key=out).join(disk, "output_path", "left")
    there = F.col("disk").isNotNull()
    own = _listed(
        F.when(F.col("key") != F.col("own_key"), _issue(p, "path-mismatch", "sidecar path")),
        F.when(~there, _issue(p, "missing-artifact", "no file")),
        F.when(there & (F.col("disk.bytes") != F.col("artifact.bytes")), _issue(p, "artifact-size-mismatch", "size")),
        F.when(there & (F.col("disk.sha256") != F.col("artifact.sha256")), _issue(p, "artifact-digest-mismatch", "digest")),
    )
    if items is None:
        return right.select(F.explode(own).alias("i")).select("i.*")
    latest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    right = right.select("key", latest.alias("r"), own.alias("own"), F.struct("sidecar_path", "status", "source", "artifact", "engine", "settings", "in_key", "out_key").alias("side"))
    expected = paths.sidecar_of(out)
    left = _keyed(items, key=expected, in_key=F.col("input_path"), out_key=out).withColumn("expected", expected)
    both = left.select("key", F.lit(1).alias("r"), F.struct("expected", "status", "input", "output", "in_key", "out_key").alias("item")).join(right, ["key", "r"], "full_outer")
    item, side = F.col("item"), F.col("side")
    p, failed = side["sidecar_path"], item["status"] == "failed"
    matched = item.isNotNull() & side.isNotNull() & ~failed
    differ = lambda a, b: ~a.eqNullSafe(b)
    moved = differ(side["in_key"], item["in_key"]) | differ(side["out_key"], item["out_key"])
    found = _listed(
        F.when(item.isNotNull() & failed & side.isNotNull(), _issue(p, "stale-sidecar", "failed item")),
        F.when(item.isNotNull() & ~failed & side.isNull(), _issue(item["expected"], "missing-sidecar", "no sidecar")),
        F.when(matched & moved, _issue(p, "path-mismatch", "document path")),
        F.when(matched & (differ(side["status"], item["status"]) | differ(side["engine"], engine)), _issue(p, "manifest-sidecar-mismatch", "status or engine")),
        F.when(matched & differ(side["settings"], settings), _issue(p, "settings-mismatch", "settings")),
        F.when(matched & (differ(side["source"], item["input"]) | differ(side["artifact"], item["output"])), _issue(p, "manifest-sidecar-mismatch", "digest")),
        F.when(item.isNull() & (F.col("r") == 1), _issue(p, "orphan-sidecar", "no item")),
    )
    issues = both.select(F.explode(F.concat(F.coalesce("own", F.array().cast(_ISSUE)), found)).alias("i")).select("i.*")
    return issues.unionByName(extra_artifacts(items, files, strict))


def extra_artifacts(items: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """Markdown files that no manifest item names."""
    known = items.select(path_key(F.col("output_path")).alias("key"))
    marked = files.filter(F.lower("path").endswith(".md")).withColumn("key", path_key(F.col("path")))
    return marked.join(known, "key", "left_anti").select("path", F.lit("error" if strict else "warning").alias("severity"), F.lit("extra-artifact").alias("category"), F.lit("not in manifest").alias("detail"))


def validation_summary(items: DataFrame, sidecars: DataFrame, issues: DataFrame) -> DataFrame:
    """checked, passed, failed, warnings: distinct paths of sidecars, of the sidecars that items should have and of extra
    artifacts, and those of each severity; passed is never negative. One grouping by path counts them all."""
    none = F.lit(None).cast("string")
    marks = sidecars.select(F.col("sidecar_path").alias("path"), none.alias("severity"), F.lit(True).alias("counts"))
    marks = marks.unionByName(items.select(paths.sidecar_of(F.col("output_path")).alias("path"), none.alias("severity"), F.lit(True).alias("counts")))
    marks = marks.unionByName(issues.select("path", "severity", (F.col("category") == "extra-artifact").alias("counts")))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    by_path = marks.groupBy("path").agg(has(F.col("counts")).alias("checked"), has(F.col("severity") == "error").alias("failed"), has(F.col("severity") == "warning").alias("warned"))
    totals = by_path.agg(*(F.count_if(c).alias(c) for c in ("checked", "failed", "warned")))
    return totals.select("checked", F.greatest(F.col("checked") - F.col("failed"), F.lit(0)).alias("passed"), "failed", F.col("warned").alias("warnings"))
