"""Command line: one subcommand for each step of converting a folder of documents and keeping its ledger."""

from __future__ import annotations

import argparse
import csv
import importlib
import io
import json
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from . import __version__
from .plans import builders as B
from .plans import reports as R

#: Exit codes: done, done but something is wrong with the package, could not be done.
FINE, WRONG, REFUSED = 0, 1, 2


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.appName("ledgerframe").getOrCreate()


def _converter(spec: str) -> Callable[[], Callable[[bytes], str]]:
    """module:name of a factory of converters."""
    module, _, attribute = spec.partition(":")
    return getattr(importlib.import_module(module), attribute)


def plain_text() -> Callable[[bytes], str]:
    """The built-in converter, for documents that are text already."""
    return lambda content: content.decode("utf-8")


def _out(path: str, content: bytes, family: R.Family, producer: str, inputs: Sequence[str] = ()) -> None:
    from .plans.executor import OutputError, write_report

    if any(Path(path).resolve() == Path(i).resolve() for i in inputs):
        raise OutputError("an output must not be an input")
    write_report(Path(path), content, family, producer)


def _new(path: str, content: bytes) -> None:
    from .plans.executor import write_new

    write_new(Path(path), content)


def convert(a: argparse.Namespace) -> int:
    from .operators import convert as C
    from .plans import executor
    from .sources import files

    spark, top = _spark(), Path(a.input)
    root, base = (top, Path(a.output)) if top.is_dir() else (top.parent, Path(a.output).parent)
    if top.is_dir():
        found = files.documents(spark, root, a.suffix, recursive=a.recursive, output=base, include=a.include, exclude=a.exclude)
    elif top.is_file():
        found = spark.createDataFrame([(0, top.name, Path(a.output).name)], "seq long, input_path string, output_path string")
    else:
        raise FileNotFoundError("no such input")
    requests = [tuple(r) for r in found.sort("seq").toLocalIterator()]
    if not requests and not (a.include or a.exclude):
        print("no documents", file=sys.stderr)
        return REFUSED
    seen: dict[str, str] = {}
    for _, _, o in requests:
        if R.key(o) in seen:
            raise ValueError("two documents have the same output")
        seen[R.key(o)] = o
    there = {o for _, _, o in requests if (base / o).is_file() and not a.force}
    if there and not top.is_dir():
        raise FileExistsError("the output is there already")
    todo = [i for _, i, o in requests if o not in there]
    content = files.contents(spark, root, todo).withColumnRenamed("path", "input_path")
    rows = C.converted(content.select("input_path", "content"), _converter(a.converter))
    if a.normalize:
        rows = C.normalised(rows)
    by, done = {i: o for _, i, o in requests}, {}

    def texts():
        for r in rows.toLocalIterator():  # a text is written before the next one is fetched, and not kept
            done[r.input_path] = (r.status, r.category, r.error)
            if r.status == "succeeded":
                yield by[r.input_path], r.text

    wrong = executor.write_texts(base, texts(), a.force)
    results = []
    for seq, i, o in requests:
        r = done.get(i)
        if o in there:
            results.append((seq, i, o, "skipped", None, None))
        elif o in wrong:
            results.append((seq, i, o, "failed", "output", wrong[o]))
        else:
            results.append((seq, i, o, *r))
    failed = sum(r[3] == "failed" for r in results)
    code = WRONG if failed else FINE
    settings = {"recursive": a.recursive, "include": a.include, "exclude": a.exclude, "force": a.force, "normalization_profile": "conservative" if a.normalize else None}
    try:
        _reports(a, spark, root, base, results, settings)
    except (OSError, ValueError, RuntimeError) as e:
        print(type(e).__name__, file=sys.stderr)
        code = REFUSED
    if a.batch_json:
        rows_ = [dict(zip(("input", "output", "status", "error_category", "message"), r[1:], strict=True)) for r in results]
        n = [r["status"] for r in rows_]
        payload = {"exit_code": code, "summary": {"total": len(n), **{s: n.count(s) for s in ("succeeded", "skipped", "failed")}}, "items": rows_}
        executor.write_atomically(Path(a.batch_json), R.rendered(payload))
    print(f"converted {len(results) - failed - len(there)}, skipped {len(there)}, failed {failed}")
    return code


def _reports(a, spark, root: Path, base: Path, results: list[tuple], settings: dict) -> None:
    from pyspark.sql import functions as F

    from .operators import ledger, quality
    from .plans import executor
    from .sources import files

    frame = spark.createDataFrame(results, "seq long, input_path string, output_path string, status string, error_category string, message string")
    written = [r[2] for r in results if r[3] != "failed"]
    if a.quality_json:
        judged = quality.judged(files.read_markdown(spark, base, written)).withColumnRenamed("path", "output")
        items = frame.select("seq", F.col("input_path").alias("input"), F.col("output_path").alias("output")).join(judged.select("output", "status", "warnings"), "output")
        executor.write_atomically(Path(a.quality_json), R.rendered(B.quality_report(items)))
    if a.csv:
        out = io.StringIO()
        table = csv.writer(out)
        table.writerow(["input", "output", "status", "error_category", "message"])
        table.writerows(["" if v is None else v for v in r[1:]] for r in results)
        executor.write_atomically(Path(a.csv), b"\xef\xbb\xbf" + out.getvalue().encode())
    if a.manifest or a.sidecars:
        present = [r[1] for r in results if (root / r[1]).is_file()]
        source = files.contents(spark, root, present).select(F.col("path").alias("input_path"), F.col("content").alias("input_content"))
        target = files.contents(spark, base, written).select(F.col("path").alias("output_path"), F.col("content").alias("output_content"))
        digests = ledger.manifest_items(frame.join(source, "input_path", "left").join(target, "output_path", "left")).join(frame.select("seq", "error_category", "message"), "seq")
        if digests.filter("not complete").head(1):
            raise OSError("a digest is missing")
        content = B.manifest(digests, settings, __version__, a.producer)
        document = R.MANIFEST.parse(content, a.producer)
        if a.sidecars:
            for item in document["items"]:
                if item["status"] != "failed":
                    executor.write_atomically(base / B.sidecar_name(item["output"]["path"]), B.sidecar(item, document["engine"], document["settings"], a.producer))
        if a.manifest:
            executor.write_atomically(Path(a.manifest), content)


def validate(a: argparse.Namespace) -> int:
    from .plans.executor import write_atomically
    from .plans.package import Package

    report = Package(_spark(), a.package, a.manifest, a.producer).validation(a.strict)
    if a.report:
        write_atomically(Path(a.report), R.rendered(report))
    s = report["summary"]
    print(f"checked {s['checked']}, passed {s['passed']}, failed {s['failed']}, warnings {s['warnings']}")
    return WRONG if s["failed"] else FINE


def repair_plan(a: argparse.Namespace) -> int:
    from .plans.package import Package

    _out(a.output, Package(_spark(), a.package, a.manifest, a.producer).plan(a.strict), R.PLAN, a.producer)
    return FINE


def approve_repair(a: argparse.Namespace) -> int:
    _out(a.output, B.approval(B.read(a.plan), a.producer), R.APPROVAL, a.producer, [a.plan])
    return FINE


def repair_preflight(a: argparse.Namespace) -> int:
    from .plans.package import Package

    plan, approval = B.read(a.plan), B.read(a.approval)
    approved = B.bound_approval(plan, approval, a.producer)
    content = B.preflight(plan, approval, Package(_spark(), a.package, a.manifest, a.producer).preflight_rows(approved), a.producer)
    _out(a.output, content, R.PREFLIGHT, a.producer, [a.plan, a.approval])
    return WRONG if R.PREFLIGHT.parse(content, a.producer)["summary"]["blocked"] else FINE


def _receipt(a: argparse.Namespace, kind: str, inputs: Sequence[bytes]) -> bytes | None:
    if not a.receipt:
        return None
    content = B.intent(kind, a.attempt_id, inputs, a.producer)
    _new(a.receipt, content)
    return content


def repair_execute(a: argparse.Namespace) -> int:
    from .plans import executor

    inputs = [a.manifest, a.plan, a.approval, a.preflight]
    receipt = _receipt(a, "repair-execution", [B.read(p) for p in inputs])
    report = executor.execute_repair(_spark(), Path(a.package), *map(Path, inputs), Path(a.backup_root), a.tag, receipt, a.producer)
    _new(a.output, report)
    return executor.repair_exit(report, a.producer)


def backup_inventory(a: argparse.Namespace) -> int:
    from .plans.package import inventory, inventory_exit

    content = inventory(a.backup_root, a.producer)
    _out(a.output, content, R.INVENTORY, a.producer)
    return inventory_exit(content, a.producer)


def backup_cleanup_plan(a: argparse.Namespace) -> int:
    _out(a.output, B.cleanup_plan(B.read(a.inventory), a.session, a.producer), R.CLEANUP_PLAN, a.producer, [a.inventory])
    return FINE


def approve_backup_cleanup(a: argparse.Namespace) -> int:
    _out(a.output, B.cleanup_approval(B.read(a.plan), a.producer), R.CLEANUP_APPROVAL, a.producer, [a.plan])
    return FINE


def backup_cleanup_execute(a: argparse.Namespace) -> int:
    from .plans import executor

    inputs = [a.inventory, a.plan, a.approval]
    receipt = _receipt(a, "backup-cleanup", [B.read(p) for p in inputs])
    report = executor.execute_cleanup(Path(a.backup_root), *map(Path, inputs), receipt, a.producer)
    _new(a.output, report)
    return executor.cleanup_exit(report, a.producer)


def _sources(a: argparse.Namespace) -> list[tuple[str, bytes]]:
    return [("repair-execution", B.read(p)) for p in a.repair] + [("backup-cleanup-audit", B.read(p)) for p in a.cleanup]


def audit(a: argparse.Namespace) -> int:
    _new(a.output, B.audit(_sources(a), a.producer))
    return FINE


def audit_verify(a: argparse.Namespace) -> int:
    found = B.audit_verified(B.read(a.audit), _sources(a), a.producer)
    print(json.dumps(found))
    return found["exit_code"]


def audit_context(a: argparse.Namespace) -> int:
    _new(a.output, B.context(B.read(a.audit), [B.read(p) for p in a.status], a.producer))
    return FINE


def audit_context_verify(a: argparse.Namespace) -> int:
    found = B.context_verified(B.read(a.context), B.read(a.audit), [B.read(p) for p in a.status], a.producer)
    print(json.dumps(found))
    return found["exit_code"]


def intent_status(a: argparse.Namespace) -> int:
    receipt = B.read(a.receipt)
    lifecycle = current = None
    if a.inputs:
        inputs = [B.read(p) for p in a.inputs]
        lifecycle = B.lifecycle_of(receipt, inputs, a.producer)
        if a.package and lifecycle == (True, True) and R.INTENT.parse(receipt, a.producer)["operation_type"] == "repair-execution":
            from .plans.package import Package

            approved = B.bound_approval(inputs[1], inputs[2], a.producer)
            current = B.preflight(inputs[1], inputs[2], Package(_spark(), a.package, a.inputs[0], a.producer).preflight_rows(approved), a.producer) == inputs[3]
        elif a.package and lifecycle == (True, True):
            from .plans.package import inventory

            current = inventory(a.package, a.producer) == inputs[0]
    content = B.intent_status(receipt, _sources(a), lifecycle, current, a.producer)
    sys.stdout.write(content.decode())
    return FINE if R.STATUS.parse(content, a.producer)["classification"] == "paired" else WRONG


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerframe")
    commands = top.add_subparsers(required=True, metavar="command")

    def add(run: Callable[[argparse.Namespace], int], *needed: str, optional: Sequence[str] = (), many: Sequence[str] = (), flags: Sequence[str] = ()) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__.replace("_", "-"), help=(run.__doc__ or "").strip())
        p.set_defaults(run=run)
        p.add_argument("--producer", default=R.PRODUCER, help="name in the report types")
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n in optional:
            p.add_argument(f"--{n}")
        for n in many:
            p.add_argument(f"--{n}", action="append", default=[])
        for n in flags:
            p.add_argument(f"--{n}", action="store_true")
        return p

    c = add(convert, "input", "output", optional=("quality-json", "csv", "manifest", "batch-json"), many=("include", "exclude"), flags=("recursive", "force", "normalize", "sidecars"))
    c.add_argument("--suffix", default=".pdf")
    c.add_argument("--converter", default="ledgerframe.cli:plain_text", help="module:name of a converter factory")
    add(validate, "package", optional=("manifest", "report"), flags=("strict",))
    add(repair_plan, "package", "output", optional=("manifest",), flags=("strict",))
    add(approve_repair, "plan", "output")
    add(repair_preflight, "package", "manifest", "plan", "approval", "output")
    add(repair_execute, "package", "manifest", "plan", "approval", "preflight", "backup-root", "tag", "output", optional=("receipt", "attempt-id"))
    add(backup_inventory, "backup-root", "output")
    add(backup_cleanup_plan, "inventory", "output", many=("session",))
    add(approve_backup_cleanup, "plan", "output")
    add(backup_cleanup_execute, "backup-root", "inventory", "plan", "approval", "output", optional=("receipt", "attempt-id"))
    add(audit, "output", many=("repair", "cleanup"))
    add(audit_verify, "audit", many=("repair", "cleanup"))
    add(audit_context, "audit", "output", many=("status",))
    add(audit_context_verify, "context", "audit", many=("status",))
    add(intent_status, "receipt", optional=("package",), many=("repair", "cleanup", "inputs"))
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (OSError, ValueError, RuntimeError) as e:
        print(f"{a.run.__name__.replace('_', '-')}: {type(e).__name__}", file=sys.stderr)
        return REFUSED


if __name__ == "__main__":
    sys.exit(main())
