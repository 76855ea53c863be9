"""A package on disk as relations, and its validation, preflight and inventory."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backup, ledger, repair
from ..sources import files as disk
from . import builders
from . import reports as R

_DIGEST = "struct<bytes:bigint,sha256:string>"
_ENGINE = "struct<name:string,version:string>"
_SETTINGS = "struct<table_structure:boolean,normalization_profile:string,artifacts_path_configured:boolean>"
ITEMS = f"seq long, input_path string, output_path string, status string, input {_DIGEST}, output {_DIGEST}"
SIDECARS = f"seq long, sidecar_path string, input_path string, output_path string, status string, source {_DIGEST}, artifact {_DIGEST}, engine {_ENGINE}, settings {_SETTINGS}"
ISSUES = "path string, severity string, category string, detail string"


def _escapes(value: object) -> bool:
    return isinstance(value, str) and not R.safe(value)


def _clean(path: str) -> str:
    return PurePosixPath(path).as_posix()


def read_sidecar(content: bytes, producer: str) -> tuple[str, dict | None]:
    """Category of what is wrong with a sidecar (empty: nothing), and its document."""
    try:
        p = json.loads(content.decode("utf-8"))
    except (UnicodeError, ValueError):
        return "invalid-json", None
    if not isinstance(p, dict):
        return "invalid-schema", None
    if p.get("schema_version") != 1:
        return "unsupported-schema", None
    parts = [p.get(k) for k in ("engine", "document", "artifact", "source", "settings")]
    if p.get("report_type") != R.SIDECAR.report_type(producer) or not all(isinstance(x, dict) for x in parts):
        return "invalid-schema", None
    if _escapes(parts[1].get("input_path")) or _escapes(parts[1].get("output_path")):
        return "outside-package-root", None
    try:
        p = R.SIDECAR.check(p, producer)
    except R.ReportError:
        return "invalid-schema", None
    return ("", p) if p["engine"]["name"] == producer else ("invalid-schema", None)


def read_manifest(content: bytes, producer: str) -> tuple[str, dict | None]:
    """As read_sidecar; the first item that is wrong decides for the whole manifest."""
    try:
        p = json.loads(content.decode("utf-8"))
    except (UnicodeError, ValueError):
        return "invalid-json", None
    if not isinstance(p, dict):
        return "invalid-schema", None
    if p.get("schema_version") != 1:
        return "unsupported-schema", None
    if not R.fits(p, {k: s for k, s in R.MANIFEST.shape.items() if k != "items"} | {"items": lambda v: isinstance(v, list)}) or p.get("report_type") != R.MANIFEST.report_type(producer) or p["engine"]["name"] != producer:
        return "invalid-schema", None
    for item in p["items"]:
        if not R.fits(item, {"input": {}, "output": {}}):
            return "invalid-schema", None
        if any(_escapes(item[k].get("path")) for k in ("input", "output")):
            return "outside-package-root", None
        try:
            R.need(R.fits({"items": [item]}, {"items": R.MANIFEST.shape["items"]}), "item")
            R.MANIFEST.rule({"items": [item]})
        except R.ReportError:
            return "invalid-schema", None
    return "", p


def sidecars(spark: SparkSession, root: Path, relative: Sequence[str], producer: str) -> tuple[DataFrame, DataFrame]:
    """The sidecars of the named files, parsed by the executors, and the issues of those that cannot be."""
    order = {p: i for i, p in enumerate(relative)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                wrong, p = read_sidecar(content.as_py(), producer)
                out.append((order[path.as_py()], path.as_py(), wrong, json.dumps(p) if p else None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["seq", "path", "wrong", "p"])

    read = disk.contents(spark, root, relative).select("path", "content").mapInArrow(run, "seq long, path string, wrong string, p string").persist()
    shape = f"document struct<input_path:string,output_path:string,status:string>, source {_DIGEST}, artifact {_DIGEST}, engine {_ENGINE}, settings {_SETTINGS}"
    d = read.filter("wrong = ''").select("seq", "path", F.from_json("p", shape).alias("d"))
    rows = d.select("seq", F.col("path").alias("sidecar_path"), "d.document.input_path", "d.document.output_path", "d.document.status", "d.source", "d.artifact", "d.engine", "d.settings")
    bad = read.filter("wrong <> ''").select("path", F.lit("error").alias("severity"), F.col("wrong").alias("category"), F.lit("sidecar").alias("detail"))
    return rows, bad


def items_of(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(i, _clean(x["input"]["path"]), _clean(x["output"]["path"]), x["status"], (x["input"]["bytes"], x["input"]["sha256"]), (x["output"]["bytes"], x["output"]["sha256"])) for i, x in enumerate(manifest["items"])]
    return spark.createDataFrame(rows, ITEMS)


class Package:
    """The relations of a package, read once."""

    def __init__(self, spark: SparkSession, root: str | Path, manifest: str | Path | None = None, producer: str = R.PRODUCER) -> None:
        self.spark, self.root, self.producer = spark, Path(root), producer
        self.entries = list(disk.walk(self.root))
        plain = sorted((e for e in self.entries if not e[2]), key=lambda e: R.key(e[0]))
        named = [e for e in plain if e[0].casefold().endswith(".metadata.json")]
        inside = [e[0] for e in named if e[3] and e[5]]
        self.sidecar_paths = [e[0] for e in named]
        self.outside = [e[0] for e in named if not e[5]]
        rows, bad = sidecars(spark, self.root, inside, producer)
        lost = [(p, "error", "outside-package-root", "sidecar") for p in self.outside]
        links = [(e[0], "error", "invalid-json", "sidecar") for e in named if e[5] and not e[3]]
        self.bad = bad.unionByName(spark.createDataFrame(lost + links, ISSUES))
        self.sidecars = rows
        wanted = {e[0] for e in plain if e[3] and e[0].casefold().endswith(".md")} | {r.output_path for r in rows.select("output_path").toLocalIterator() if (self.root / r.output_path).is_file()}
        content = disk.contents(spark, self.root, sorted(wanted))
        self.files = content.select("path", "bytes", F.sha2("content", 256).alias("sha256")).persist()
        self.manifest_name, self.manifest, self.items, self.engine, self.settings = None, None, None, None, None
        if manifest is not None:
            self._take(Path(manifest))

    def _take(self, path: Path) -> None:
        self.manifest_name = path.name
        try:
            wrong, p = read_manifest(path.read_bytes(), self.producer)
        except OSError:
            wrong, p = "invalid-json", None
        if p is None:
            self.bad = self.bad.unionByName(self.spark.createDataFrame([(path.name, "error", wrong, "manifest")], ISSUES))
            return
        self.manifest, self.items = p, items_of(self.spark, p)
        s = p["settings"]
        self.engine = F.struct(F.lit(p["engine"]["name"]).alias("name"), F.lit(p["engine"]["version"]).alias("version"))
        self.settings = F.struct(F.lit(s["table_structure"]).alias("table_structure"), F.lit(s.get("normalization_profile")).cast("string").alias("normalization_profile"), F.lit(s["artifacts_path_configured"]).alias("artifacts_path_configured"))
        top = self.root.resolve()
        out = [x["output"]["path"] for x in p["items"] if not (self.root / x["output"]["path"]).resolve().is_relative_to(top)]
        if out:
            self.bad = self.bad.unionByName(self.spark.createDataFrame([(builders.sidecar_name(o), "error", "outside-package-root", "manifest output") for o in out], ISSUES))

    def issues(self, strict: bool = False) -> DataFrame:
        return self.bad.unionByName(ledger.reconcile(self.items, self.sidecars, self.files, self.engine, self.settings, strict))

    def checked(self) -> list[str]:
        paths = set(self.sidecar_paths)
        if self.items is not None:
            paths |= {builders.sidecar_name(_clean(x["output"]["path"])) for x in self.manifest["items"]}
            paths |= {r.path for r in ledger.extra_artifacts(self.items, self.files).select("path").toLocalIterator()}
        return sorted(paths, key=R.key)

    def validation(self, strict: bool = False) -> dict:
        rows = [{"path": r.path, "severity": r.severity, "category": r.category, "message": r.detail} for r in self.issues(strict).toLocalIterator()]
        return builders.validation(self.checked(), rows)

    def plan(self, strict: bool = False) -> bytes:
        issues = self.issues(strict)
        rows = [{"path": r.path, "action": r.action, "reason_category": r.reason, "safe": r.safe} for r in repair.plan(issues, self.manifest_name).toLocalIterator()]
        return builders.plan(issues.count(), rows, self.producer)

    def preflight_rows(self, approved: Sequence[dict]) -> list[dict]:
        """Readiness of approved actions. Links in a target's path make it unsafe."""
        actions = self.spark.createDataFrame([(a["path"], a["action"], a["reason_category"], a["safe"]) for a in approved], "path string, action string, reason string, safe boolean")
        targets = sorted({a["path"] for a in approved})
        unsafe = {t for t in targets if disk.uses_link(self.root, self.root / t) or not (self.root / t).resolve().is_relative_to(self.root.resolve())}
        there = [t for t in targets if t not in unsafe and (self.root / t).is_file()]
        known = disk.contents(self.spark, self.root, there).select("path", "bytes", F.sha2("content", 256).alias("sha256"))
        rows = repair.preflight(actions, self.issues(), self.items, self.files.filter(~F.lower("path").endswith(".metadata.json")).unionByName(known))
        out = []
        for r in rows.toLocalIterator():
            row = {"path": r.path, "action": r.action, "reason": r.reason, "status": r.status, "block_reason": r.block_reason, "backup_required": r.backup_required, "target": {"exists": r.target.exists, "bytes": r.target.bytes, "sha256": r.target.sha256}}
            if r.path in unsafe and self.items is not None:
                row |= {"status": "blocked", "block_reason": "path-unsafe"}
            out.append(row)
        return out


# backup sessions


def session_tree(session: Path) -> tuple[set[str], set[str], bool]:
    """Files, folders, and whether there is anything else."""
    found, folders, odd = set(), set(), False
    for path, link, folder, plain, *_ in disk.walk(session):
        odd |= link or not (folder or plain)
        if folder and not link:
            folders.add(path)
        elif plain and not link:
            found.add(path)
    return found, folders, odd


def _framed(session: Path, relative: Sequence[str]) -> tuple[str, dict[str, tuple[int, str]]]:
    tree, each = hashlib.sha256(), {}
    for p in relative:
        data, name = disk.read_stable(session / p), p.encode()
        tree.update(b"file\x00" + len(name).to_bytes(8, "big") + name + len(data).to_bytes(8, "big"))
        tree.update(data)
        each[p] = (len(data), hashlib.sha256(data).hexdigest())
    return tree.hexdigest(), each


def inspect(session: Path, producer: str = R.PRODUCER) -> dict:
    """The inventory entry of one session folder."""
    named = re.fullmatch(rf"{re.escape(producer)}-repair-v1-[A-Za-z0-9_-]+", session.name)
    shown = session.name if R.name(session.name) and session.name not in (".", "..") else f"invalid-session-{R.sha256(os.fsencode(session.name))}"

    def bad(kind: str, state: str | None = None) -> dict:
        return {"session": shown, "classification": kind, "state": state, "planning_eligible": False, "session_manifest_sha256": None, "tree_sha256": None, "items": []}

    if disk.is_linked(session) or not session.is_dir():
        return bad("unexpected-entry")
    if not named:
        if not session.name.startswith(f"{producer}-repair-") or session.name.startswith(f"{producer}-repair-v1-"):
            return bad("unexpected-entry")
        found, _, odd = session_tree(session)
        return bad("unexpected-entry" if odd or any(not f.casefold().endswith(".bak") for f in found) else "legacy-unmanaged")
    own = session / backup.MANIFEST
    if not os.path.lexists(own):
        return bad("missing-session-manifest")
    try:
        content = disk.read_stable(own)
        manifest = R.SESSION.parse(content, producer)
    except R.BindingError:
        return bad("binding-unverifiable")
    except (OSError, R.ReportError):
        return bad("invalid-session-manifest")
    items, state = [R.picked(i, *R.ITEM) for i in manifest["items"]], manifest["state"]
    expected = {backup.MANIFEST} | {i["backup"] for i in items}
    folders = {p.as_posix() for i in items for p in PurePosixPath(i["backup"]).parents if p.parts}
    found, there, odd = session_tree(session)
    if odd or found != expected or there != folders:
        return bad("unexpected-entry", state)
    try:
        tree, each = _framed(session, sorted(expected, key=lambda p: (R.key(p), p)))
    except OSError:
        return bad("invalid-session-manifest", state)
    if any(each[i["backup"]] != (i["bytes"], i["sha256"]) for i in items):
        return bad("invalid-session-manifest", state)
    kind = "interrupted-open-session" if state == "open" else "managed"
    return {"session": session.name, "classification": kind, "state": state, "planning_eligible": state == "complete", "session_manifest_sha256": R.sha256(content), "tree_sha256": tree, "items": items}


def inventory(root: str | Path, producer: str = R.PRODUCER) -> bytes:
    sessions = [inspect(Path(e.path), producer) for e in sorted(os.scandir(root), key=lambda e: (R.key(e.name), e.name))]
    sessions.sort(key=lambda s: (R.key(s["session"]), s["session"]))
    return R.INVENTORY.build({"summary": R.inventory_summary(sessions), "sessions": sessions}, producer)


def inventory_exit(content: bytes, producer: str = R.PRODUCER) -> int:
    return int(any(s["classification"] != "managed" or s["state"] == "rollback-failed" for s in R.INVENTORY.parse(content, producer)["sessions"]))
