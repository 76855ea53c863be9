"""The only code that changes files, on the driver: create-only and guarded writes, repairs, cleanup.

Executors cannot keep the promises made here (nothing is overwritten, nothing is changed that is not as it was
approved), so Spark decides and this module acts.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import backup, histories
from ..sources import files as disk
from . import builders
from . import reports as R
from .package import Package, inspect, session_tree


class OutputError(RuntimeError):
    """An output cannot be written as asked."""


def _beside(path: Path, content: bytes) -> Path:
    handle, name = tempfile.mkstemp(prefix=f".{path.name}.", suffix=".tmp", dir=path.parent)
    with os.fdopen(handle, "wb") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())
    return Path(name)


def write_atomically(path: Path, content: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    made = _beside(path, content)
    try:
        made.replace(path)
    finally:
        made.unlink(missing_ok=True)


def write_new(path: Path, content: bytes) -> None:
    """Create a file with exactly these bytes, or fail if there is one."""
    made = _beside(path, content)
    try:
        os.link(made, path)
    except OSError as e:
        raise OutputError(f"{path.name} is there already or cannot be made") from e
    finally:
        made.unlink(missing_ok=True)
    if path.read_bytes() != content:
        raise OutputError(f"{path.name} did not keep its bytes")


def write_report(path: Path, content: bytes, family: R.Family, producer: str = R.PRODUCER) -> None:
    """Write a report; what is there is replaced only if it is a report of the same family."""
    if os.path.lexists(path) and (disk.is_linked(path) or not path.is_file() or not family.recognises(path.read_bytes(), producer)):
        raise OutputError(f"{path.name} is there and no report of this kind")
    write_atomically(path, content)


def _state(path: Path) -> dict:
    if not os.path.lexists(path):
        return {"exists": False, "bytes": None, "sha256": None}
    try:
        data = disk.read_stable(path)
    except OSError:
        return {"exists": True, "bytes": None, "sha256": None}
    return {"exists": True, "bytes": len(data), "sha256": R.sha256(data)}


#: The states that a session may go to; a new one is open.
TRANSITIONS = {None: ("open",)} | histories.TRANSITIONS


def next_state(now: str | None, then: str) -> str:
    """then, if a session may go there."""
    if then not in TRANSITIONS[now]:
        raise OutputError(f"a session that is {now} cannot become {then}")
    return then


class _Session:
    """A backup session: its manifest follows every change, each time from exactly the bytes it had."""

    def __init__(self, root: Path, tag: str, bindings: dict, producer: str) -> None:
        self.folder = root / f"{producer}-repair-v1-{tag}"
        self.folder.mkdir()
        self.producer, self.bindings, self.items, self.content, self.state = producer, bindings, [], b"", None
        self._put("open", first=True)

    def _put(self, state: str, first: bool = False) -> None:
        path, state = self.folder / backup.MANIFEST, next_state(self.state, state)
        if not first and disk.read_stable(path) != self.content:
            raise OutputError("the session's manifest was changed")
        items = sorted(self.items, key=lambda i: (R.key(i["backup"]), i["backup"]))
        content = R.SESSION.build({"state": state, "bindings": self.bindings, "items": items}, self.producer)
        write_new(path, content) if first else write_atomically(path, content)
        self.content, self.state = content, state

    def keep(self, source: str, content: bytes) -> None:
        place = f"{len(self.items):04d}/{source}.bak"
        (self.folder / place).parent.mkdir(parents=True, exist_ok=True)
        write_new(self.folder / place, content)
        self.items.append({"source": source, "backup": place, "bytes": len(content), "sha256": R.sha256(content)})
        self._put("open")

    def close(self, state: str) -> None:
        self._put(state)


def execute_repair(spark: SparkSession, root: Path, manifest: Path, plan: Path, approval: Path, preflight: Path, backup_root: Path, tag: str, receipt: bytes | None = None, producer: str = R.PRODUCER) -> bytes:
    """Run the ready actions of a preflight that is still what the present state gives; back up before removing, and
    undo everything if one fails. Returns the execution report: also where the present state cannot be told, or the
    session that backups need cannot be started. Inputs that change after the receipt was read are refused."""
    inputs = [disk.read_stable(p) for p in (manifest, plan, approval, preflight)]
    approved = builders.bound_approval(inputs[1], inputs[2], producer)
    known = R.PREFLIGHT.parse(inputs[3], producer)
    R.need(known["plan"]["sha256"] == R.sha256(inputs[1]) and known["approval"]["sha256"] == R.sha256(inputs[2]), "preflight of another plan")
    R.need(all(a["status"] == "ready" for a in known["actions"]), "blocked actions")
    bound = None
    if receipt is not None:
        r = R.INTENT.parse(receipt, producer)
        R.need(r["operation_type"] == "repair-execution" and builders.lifecycle_of(receipt, inputs, producer) == (True, True), "receipt of another operation")
        bound = {"schema_version": 1, "attempt_id": r["attempt_id"], "sha256": R.sha256(receipt)}
        if [disk.read_stable(p) for p in (manifest, plan, approval, preflight)] != inputs:
            raise OutputError("an input changed after the receipt")
    items = {R.key(builders.sidecar_name(i["output"]["path"])): i for i in R.MANIFEST.parse(inputs[0], producer)["items"]}
    document = R.MANIFEST.parse(inputs[0], producer)
    actions = sorted(known["actions"], key=lambda a: (R.key(a["path"]), a["action"]))
    rows = [{"path": a["path"], "action": a["action"], "status": "not-run", "before": R.picked(a["target"], "exists", "bytes", "sha256"), "after": R.picked(a["target"], "exists", "bytes", "sha256"), "rollback": "not-required"} for a in actions]
    try:
        now = R.PREFLIGHT.parse(builders.preflight(inputs[1], inputs[2], Package(spark, root, manifest, producer).preflight_rows(approved), producer), producer)["actions"]
    except Exception:  # whatever keeps the present state from being told, nothing may be changed
        now = []
    stale = [i for i, a in enumerate(actions) if R.picked(a, *a) not in now]
    removals = [i for i, a in enumerate(actions) if a["action"] == "remove-stale-sidecar"]
    post, session, refused = "not-run", None, False
    if removals and not stale:  # only what is removed needs a backup
        names = ("manifest", "plan", "approval", "preflight")
        try:
            session = _Session(backup_root, tag, {k: {"sha256": R.sha256(b), "schema_version": 1} for k, b in zip(names, inputs, strict=True)}, producer)
        except (OSError, OutputError, R.ReportError):
            rows[removals[0]]["status"], refused = "failed", True
    if stale:
        rows[stale[0]]["status"] = "failed-precondition"
        rows[stale[0]]["before"] = rows[stale[0]]["after"] = _state(root / actions[stale[0]]["path"])
    elif actions and not refused:
        done: list[tuple[int, bytes | None]] = []
        failed = False
        for i, a in enumerate(actions):
            target = root / a["path"]
            if _state(target) != rows[i]["before"] or disk.uses_link(root, target):
                rows[i]["status"], failed = "failed-precondition", True
                rows[i]["before"] = rows[i]["after"] = _state(target)
                break
            try:
                if a["action"] == "regenerate-sidecar":
                    write_new(target, builders.sidecar(items[R.key(a["path"])], document["engine"], document["settings"], producer))
                    done.append((i, None))
                else:
                    content = disk.read_stable(target)
                    session.keep(a["path"], content)
                    target.unlink()
                    done.append((i, content))
                rows[i] |= {"status": "succeeded", "after": _state(target), "rollback": "available"}
            except (OSError, OutputError, R.ReportError):
                rows[i] |= {"status": "failed", "after": _state(target)}
                failed = True
                break
        if not failed:
            left = Package(spark, root, manifest, producer).validation()["issues"]
            touched = {R.key(a["path"]) for a in actions}
            post = "failed" if any(x["severity"] == "error" and R.key(x["path"]) in touched for x in left) else "passed"
            failed = post == "failed"
        state = "complete"
        if failed:
            state = "rolled-back"
            for i, content in reversed(done):
                target = root / actions[i]["path"]
                try:
                    if content is None:
                        if _state(target) != rows[i]["after"]:
                            raise OutputError("changed since")
                        target.unlink()
                    else:
                        write_new(target, content)
                    rows[i] |= {"status": "rolled-back", "after": rows[i]["before"], "rollback": "completed"}
                except (OSError, OutputError):
                    rows[i] |= {"status": "rollback-failed", "after": _state(target), "rollback": "failed"}
                    state = "rollback-failed"
        if session is not None:
            session.close(state)
    body = {"summary": R.execution_summary(rows), **{k: {"sha256": R.sha256(b)} for k, b in zip(("plan", "approval", "preflight"), inputs[1:], strict=True)}, "post_validation": post, "actions": rows}
    return R.EXECUTION.build(body | ({"intent_receipt": bound} if bound else {}), producer)


def repair_exit(report: bytes, producer: str = R.PRODUCER) -> int:
    p = R.EXECUTION.parse(report, producer)
    return int(p["post_validation"] == "failed" or any(a["status"] != "succeeded" for a in p["actions"]))


def execute_cleanup(backup_root: Path, inventory: Path, plan: Path, approval: Path, receipt: bytes | None = None, producer: str = R.PRODUCER) -> bytes:
    """Delete the approved sessions, one file at a time, as long as what remains is what was approved. After a failure
    nothing more is run. Returns the cleanup audit."""
    inputs = [disk.read_stable(p) for p in (inventory, plan, approval)]
    known, planned, given = R.INVENTORY.parse(inputs[0], producer), R.CLEANUP_PLAN.parse(inputs[1], producer), R.CLEANUP_APPROVAL.parse(inputs[2], producer)
    R.need(planned["inventory"]["sha256"] == R.sha256(inputs[0]) and given["plan"]["sha256"] == R.sha256(inputs[1]), "inventory, plan and approval do not belong together")
    want = [R.picked(a, *R.CLEANUP) for a in planned["actions"] if a["eligible"]]
    R.need([R.picked(a, *R.CLEANUP) for a in given["approved_actions"]] == want, "approval of another plan")
    bound = None
    if receipt is not None:
        r = R.INTENT.parse(receipt, producer)
        R.need(r["operation_type"] == "backup-cleanup" and builders.lifecycle_of(receipt, inputs, producer) == (True, True), "receipt of another operation")
        bound = {"schema_version": 1, "attempt_id": r["attempt_id"], "sha256": R.sha256(receipt)}
    entries = {R.key(s["session"]): s for s in known["sessions"]}
    rows, failed = [], False
    for a in want:
        folder, entry = backup_root / a["session"], entries[R.key(a["session"])]
        row = {"session": a["session"], "status": "not-run", "before": {"files": a["backup_files"], "bytes": a["backup_bytes"], "tree_sha256": a["tree_sha256"]}, "after": {"exists": folder.exists()}}
        if not failed:
            seen = inspect(folder, producer)
            want_files = {i["backup"]: i["sha256"] for i in entry["items"]} | {backup.MANIFEST: entry["session_manifest_sha256"]}
            gone = seen == {k: entry[k] for k in seen} and _remove(folder, want_files)
            failed = not gone
            row |= {"status": "deleted" if gone else "failed", "after": {"exists": os.path.lexists(folder)}}
        rows.append(row)
    body = {"bindings": dict(zip(("inventory_sha256", "plan_sha256", "approval_sha256"), map(R.sha256, inputs), strict=True)), "summary": R.cleanup_summary(rows), "actions": rows}
    return R.CLEANUP_AUDIT.build(body | ({"intent_receipt": bound} if bound else {}), producer)


def _identity(path: Path) -> tuple:
    """What tells a file or folder from another one put in its place; links are no files."""
    at = path.lstat()
    if disk.is_linked(path):
        raise OutputError(f"{path.name} is a link")
    return (at.st_dev, at.st_ino) if path.is_dir() else (at.st_dev, at.st_ino, at.st_size, at.st_mtime_ns)


def _remove(folder: Path, want: dict[str, str]) -> bool:
    """Delete the files of a session, whose digests are given, and its folders, deepest first. Before each step all that
    remains must be the very files and folders that were there at first, in the same root, and a file must still
    have its digest."""
    found, folders, odd = session_tree(folder)
    if odd or found != set(want):
        return False
    order = sorted(found | folders, key=lambda p: (-p.count("/"), R.key(p)))
    try:
        root, known = _identity(folder.parent), {p: _identity(folder / p) for p in ("", *order)}
        for step in [*(p for p in order if p in found), *(p for p in order if p in folders), ""]:
            if session_tree(folder) != (found, folders, False) or _identity(folder.parent) != root or any(_identity(folder / p) != known[p] for p in ("", *found, *folders)):
                return False
            at = folder / step
            if step in found:
                if R.sha256(disk.read_stable(at)) != want[step] or _identity(at) != known[step]:
                    return False
                at.unlink()
            else:
                at.rmdir()
            found, folders = found - {step}, folders - {step}
    except (OSError, OutputError):
        return False
    return not os.path.lexists(folder)


def cleanup_exit(report: bytes, producer: str = R.PRODUCER) -> int:
    return int(any(a["status"] == "failed" for a in R.CLEANUP_AUDIT.parse(report, producer)["actions"]))


def write_texts(root: Path, rows: Iterable[tuple[str, str]], force: bool = False) -> dict[str, str]:
    """Write converted texts below root, one at a time as they come; returns what failed by path."""
    wrong: dict[str, str] = {}
    for path, text in rows:
        target = root / path
        try:
            target.parent.mkdir(parents=True, exist_ok=True)
            write_atomically(target, text.encode()) if force else write_new(target, text.encode())
        except (OSError, OutputError) as e:
            wrong[path] = type(e).__name__
    return wrong


@contextlib.contextmanager
def unchanged(root: Path):
    """For commands that only read: fails if the tree below root is another one afterwards."""
    before = sorted(disk.walk(root))
    yield
    if sorted(disk.walk(root)) != before:
        raise OutputError("a command that only reads changed files")
