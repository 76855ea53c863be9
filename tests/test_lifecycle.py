"""From documents to audits on disk, with faults on the way."""

import json
import os
import shutil

import pytest

from ledgerframe import cli
from ledgerframe.plans import builders as B
from ledgerframe.plans import executor
from ledgerframe.plans import reports as R


def run(*args):
    return cli.main([str(a) for a in args])


@pytest.fixture
def package(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "_hidden.PDF").write_text("# Hidden\n\nenough visible characters to be neither empty nor short\n")
    (src / "a b%.pdf").write_text("# A\n\nsee /srv/a/b.txt for more than forty visible characters  \n\n\n")
    (src / "sub" / "c.pdf").write_text("short")
    (src / "sub" / "bad.pdf").write_bytes(b"\xff\xfe")
    code = run("convert", "--input", src, "--output", out, "--recursive", "--normalize", "--sidecars", "--manifest", tmp_path / "manifest.json", "--quality-json", tmp_path / "q.json", "--csv", tmp_path / "r.csv", "--batch-json", tmp_path / "batch.json")
    assert code == 1
    return tmp_path


def test_convert(package):
    batch = json.loads((package / "batch.json").read_text())
    assert batch["exit_code"] == 1 and batch["summary"] == {"total": 4, "succeeded": 3, "skipped": 0, "failed": 1}
    assert [i["input"] for i in batch["items"]] == ["_hidden.PDF", "a b%.pdf", "sub/bad.pdf", "sub/c.pdf"]
    assert batch["items"][2]["error_category"] == "unexpected" and str(package) not in json.dumps(batch)
    q = json.loads((package / "q.json").read_text())
    assert [[w["category"] for w in i["warnings"]] for i in q["items"]] == [[], ["absolute-path"], ["short-output"]]
    lines = (package / "r.csv").read_bytes().split(b"\r\n")
    assert lines[0] == b"\xef\xbb\xbfinput,output,status,error_category,message" and len(lines) == 6
    m = R.MANIFEST.parse((package / "manifest.json").read_bytes())
    assert [i["status"] for i in m["items"]] == ["succeeded", "succeeded", "failed", "succeeded"] and m["items"][2]["output"]["sha256"] is None
    assert (package / "out/a b%.md").read_text().endswith("characters  \n")
    before = (package / "manifest.json").read_bytes()
    run("convert", "--input", package / "in", "--output", package / "out", "--recursive", "--force", "--normalize", "--manifest", package / "again.json")
    again = json.loads((package / "again.json").read_text())
    assert [i["output"] for i in again["items"]] == [i["output"] for i in json.loads(before)["items"]]
    assert run("convert", "--input", package / "in", "--output", package / "out", "--batch-json", package / "b2.json") == 0
    assert json.loads((package / "b2.json").read_text())["summary"]["skipped"] == 2


def test_validate_and_its_issues(package):
    out, man = package / "out", package / "manifest.json"
    with executor.unchanged(out):
        assert run("validate", "--package", out, "--manifest", man) == 0
    (out / "extra.md").write_text("x")
    assert run("validate", "--package", out, "--manifest", man, "--report", package / "v.json") == 0
    assert json.loads((package / "v.json").read_text())["summary"] == {"checked": 5, "passed": 5, "failed": 0, "warnings": 1}
    assert run("validate", "--package", out, "--manifest", man, "--strict") == 1
    (out / "sub/c.md").write_text("other\n")
    (out / "a b%.metadata.json").write_text("{")
    (out / "sub/lost.metadata.json").write_text('{"schema_version": 2}')
    (out / "sub/bad.metadata.json").write_bytes((out / "sub/c.metadata.json").read_bytes())
    run("validate", "--package", out, "--manifest", man, "--report", package / "v.json")
    found = {(i["path"], i["category"]) for i in json.loads((package / "v.json").read_text())["issues"]}
    assert found == {
        ("a b%.metadata.json", "invalid-json"), ("a b%.metadata.json", "missing-sidecar"), ("extra.md", "extra-artifact"), ("sub/bad.metadata.json", "artifact-digest-mismatch"), ("sub/bad.metadata.json", "path-mismatch"),
        ("sub/bad.metadata.json", "stale-sidecar"), ("sub/c.metadata.json", "artifact-digest-mismatch"), ("sub/lost.metadata.json", "unsupported-schema"),
    }
    man.write_text("[]")
    run("validate", "--package", out, "--manifest", man, "--report", package / "v.json")
    assert ("manifest.json", "invalid-schema") in {(i["path"], i["category"]) for i in json.loads((package / "v.json").read_text())["issues"]}


def broken(package):
    """One sidecar missing, one stale."""
    out = package / "out"
    (out / "sub/c.metadata.json").unlink()
    side = json.loads((out / "a b%.metadata.json").read_text())
    side["document"] |= {"input_path": "sub/bad.pdf", "output_path": "sub/bad.md"}
    (out / "sub/bad.metadata.json").write_text(json.dumps(side))
    (package / "backup").mkdir()
    args = {k: package / f"{k}.json" for k in ("manifest", "plan", "approval", "preflight")}
    assert run("repair-plan", "--package", out, "--manifest", args["manifest"], "--output", args["plan"]) == 0
    assert run("approve-repair", "--plan", args["plan"], "--output", args["approval"]) == 0
    assert run("repair-preflight", "--package", out, *(x for k in ("manifest", "plan", "approval") for x in (f"--{k}", args[k])), "--output", args["preflight"]) == 0
    return out, args


def execute(package, out, args, *more):
    return run("repair-execute", "--package", out, *(x for k, v in args.items() for x in (f"--{k}", v)), "--backup-root", package / "backup", "--tag", "t1", "--output", package / "execution.json", *more)


def test_repair_backup_cleanup_and_audit(package):
    out, args = broken(package)
    assert execute(package, out, args, "--receipt", package / "receipt.json", "--attempt-id", "try-1") == 0
    report = R.EXECUTION.parse((package / "execution.json").read_bytes())
    assert [a["status"] for a in report["actions"]] == ["succeeded", "succeeded"] and report["post_validation"] == "passed"
    assert not (out / "sub/bad.metadata.json").exists() and run("validate", "--package", out, "--manifest", args["manifest"]) == 0
    assert execute(package, out, args) == 2  # the report is there already

    backup, inv = package / "backup", package / "inventory.json"
    assert run("backup-inventory", "--backup-root", backup, "--output", inv) == 0
    name = R.INVENTORY.parse(inv.read_bytes())["sessions"][0]["session"]
    plan, approval, done = (package / f"cleanup-{k}.json" for k in ("plan", "approval", "audit"))
    assert run("backup-cleanup-plan", "--inventory", inv, "--session", name.upper(), "--session", "none", "--output", plan) == 0
    assert [a["eligible"] for a in R.CLEANUP_PLAN.parse(plan.read_bytes())["actions"]] == [True, False]
    assert run("approve-backup-cleanup", "--plan", plan, "--output", approval) == 0
    assert run("backup-cleanup-execute", "--backup-root", backup, "--inventory", inv, "--plan", plan, "--approval", approval, "--output", done) == 0
    assert list(backup.iterdir()) == []

    audit = package / "audit.json"
    assert run("audit", "--repair", package / "execution.json", "--cleanup", done, "--output", audit) == 0
    assert R.AUDIT.parse(audit.read_bytes())["summary"] == {"operations": 3, "succeeded": 3, "partial": 0, "failed": 0, "rolled_back": 0, "not_run": 0, "operator_action_required": 0, "package_change_observed": True}
    assert run("audit-verify", "--audit", audit, "--repair", package / "execution.json", "--cleanup", done) == 0
    assert run("audit-verify", "--audit", audit, "--repair", package / "execution.json") == 1

    status = package / "status.json"
    status.write_bytes(B.intent_status((package / "receipt.json").read_bytes(), [("repair-execution", (package / "execution.json").read_bytes())]))
    assert R.STATUS.parse(status.read_bytes())["classification"] == "paired"
    assert run("intent-status", "--receipt", package / "receipt.json", "--repair", package / "execution.json") == 0
    assert run("intent-status", "--receipt", package / "receipt.json") == 1
    assert run("intent-status", "--receipt", package / "receipt.json", "--cleanup", done) == 2  # no receipt in it, and another kind
    inputs = [x for k in ("manifest", "plan", "approval", "preflight") for x in ("--inputs", args[k])]
    assert run("intent-status", "--receipt", package / "receipt.json", *inputs, "--package", out) == 1
    ctx = package / "context.json"
    assert run("audit-context", "--audit", audit, "--status", status, "--output", ctx) == 0
    assert run("audit-context-verify", "--context", ctx, "--audit", audit, "--status", status) == 0
    assert run("audit-context-verify", "--context", ctx, "--audit", audit) == 1


def test_a_changed_package_is_not_repaired(package):
    out, args = broken(package)
    (out / "sub/c.md").write_text("changed since")
    assert execute(package, out, args) == 1
    assert sorted(a["status"] for a in R.EXECUTION.parse((package / "execution.json").read_bytes())["actions"]) == ["failed-precondition", "not-run"]
    assert (out / "sub/bad.metadata.json").exists() and not (out / "sub/c.metadata.json").exists() and list((package / "backup").iterdir()) == []


def test_a_failure_rolls_back(package, monkeypatch):
    out, args = broken(package)
    before = (out / "sub/bad.metadata.json").read_bytes()
    write = executor.write_new

    def failing(path, content):
        if path.name == "c.metadata.json":
            raise OSError("disk full")
        write(path, content)

    monkeypatch.setattr(executor, "write_new", failing)
    assert execute(package, out, args) in (1, 2)
    monkeypatch.undo()
    assert (out / "sub/bad.metadata.json").read_bytes() == before
    assert run("backup-inventory", "--backup-root", package / "backup", "--output", package / "inventory.json") == 0
    assert R.INVENTORY.parse((package / "inventory.json").read_bytes())["sessions"][0]["state"] == "rolled-back"


def test_inventory_of_odd_entries(package):
    root = package / "sessions"
    root.mkdir()
    (root / "file.txt").write_text("x")
    (root / "ledgerframe-repair-old").mkdir()
    (root / "ledgerframe-repair-old" / "x.bak").write_text("x")
    (root / "ledgerframe-repair-v1-none").mkdir()
    (root / "ledgerframe-repair-v1-bad").mkdir()
    (root / "ledgerframe-repair-v1-bad" / "session-manifest.json").write_text("{}")
    (root / "ledgerframe-repair-v1-link").symlink_to(package)
    assert run("backup-inventory", "--backup-root", root, "--output", package / "i.json") == 1
    kinds = [s["classification"] for s in R.INVENTORY.parse((package / "i.json").read_bytes())["sessions"]]
    assert kinds == ["unexpected-entry", "legacy-unmanaged", "invalid-session-manifest", "unexpected-entry", "missing-session-manifest"]


def test_overwrite_guard(package):
    mine = package / "plan.json"
    mine.write_text("precious")
    assert run("repair-plan", "--package", package / "out", "--manifest", package / "manifest.json", "--output", mine) == 2
    assert mine.read_text() == "precious"


def _change(payload, path, value):
    at = payload
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return payload


@pytest.mark.parametrize(
    ("path", "value"),
    [(("schema_version",), True), (("schema_version",), 2), (("summary", "actions"), 9), (("summary", "manual_review"), True), (("actions", 0, "safe"), False), (("actions", 0, "path"), "../x"), (("actions", 0, "path"), "/x"), (("actions", 0, "reason_category"), "stale-sidecar"), (("report_type",), "x"), (("actions",), {})],
)
def test_tampered_plans_are_refused(path, value):
    action = {"path": "a/b.metadata.json", "action": "regenerate-sidecar", "reason_category": "missing-sidecar", "safe": True}
    good = B.plan(3, [action])
    assert R.PLAN.recognises(good)
    assert R.PLAN.recognises(R.rendered(_change(json.loads(good), ("schema_version",), 1.0)))
    assert not R.PLAN.recognises(R.rendered(_change(json.loads(good), path, value)))


def test_version_strictness_differs_by_family():
    own = lambda f, v: f.version(v)
    assert [own(R.SIDECAR, v) for v in (1, 1.0, True)] == [True, True, True]
    assert [own(R.PLAN, v) for v in (1, 1.0, True)] == [True, True, False]
    assert [own(R.AUDIT, v) for v in (1, 1.0, True)] == [True, False, False]


def test_streaming_conversion(spark, tmp_path):
    from ledgerframe.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello ")
    (tmp_path / "in/b.txt").write_bytes(b"\xff")
    go = lambda: incremental.run_available(incremental.converted(spark, str(tmp_path / "in"), lambda b: b.decode()), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    go()
    (tmp_path / "in/c.txt").write_text("more")
    go()
    got = {r.input_path.rsplit("/", 1)[1]: (r.status, r.text) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"a.txt": ("succeeded", "hello\n"), "b.txt": ("failed", None), "c.txt": ("succeeded", "more\n")}


@pytest.fixture
def cleanup(package):
    """A repaired package whose backup session is approved for deletion: the session, and the arguments of the cleanup."""
    out, args = broken(package)
    assert execute(package, out, args) == 0
    backup, inv = package / "backup", package / "inventory.json"
    assert run("backup-inventory", "--backup-root", backup, "--output", inv) == 0
    plan, approval = package / "cleanup-plan.json", package / "cleanup-approval.json"
    session = next(backup.iterdir())
    assert run("backup-cleanup-plan", "--inventory", inv, "--session", session.name, "--output", plan) == 0
    assert run("approve-backup-cleanup", "--plan", plan, "--output", approval) == 0
    return session, (backup, inv, plan, approval)


def deleted(arguments):
    return [a["status"] for a in R.CLEANUP_AUDIT.parse(executor.execute_cleanup(*arguments))["actions"]]


def test_a_file_that_changes_after_the_inspection_is_not_deleted(cleanup, monkeypatch):
    session, arguments = cleanup
    file = next(session.rglob("*.bak"))
    look = executor.inspect

    def looking(folder, producer):
        seen = look(folder, producer)
        file.write_text("other bytes")
        return seen

    monkeypatch.setattr(executor, "inspect", looking)
    assert deleted(arguments) == ["failed"]
    assert file.read_text() == "other bytes" and (session / "session-manifest.json").exists()


@pytest.mark.parametrize("what", ["file", "folder", "root", "link"])
def test_what_is_swapped_during_the_cleanup_is_not_deleted(cleanup, monkeypatch, what):
    """The same name and bytes, but another file or folder."""
    session, arguments = cleanup
    file, read, asked = next(session.rglob("*.bak")), executor.disk.read_stable, []

    def reading(path):
        content = read(path)
        if path == file and asked and not asked.pop():
            if what == "root":
                session.parent.rename(session.parent.parent / "gone")
                shutil.copytree(session.parent.parent / "gone", session.parent)
            elif what == "folder":
                file.parent.rename(session.parent.parent / "gone")
                shutil.copytree(session.parent.parent / "gone", file.parent)
            else:
                file.rename(session.parent.parent / "gone")
                file.symlink_to(session.parent.parent / "gone") if what == "link" else file.write_bytes(content)
        return content

    look = executor.inspect
    monkeypatch.setattr(executor, "inspect", lambda *a: (look(*a), asked.append(0))[0])
    monkeypatch.setattr(executor.disk, "read_stable", reading)
    assert deleted(arguments) == ["failed"]
    assert os.path.lexists(file)


def test_an_untouched_session_is_deleted(cleanup):
    session, arguments = cleanup
    assert deleted(arguments) == ["deleted"] and not session.exists()


def test_transitions_of_sessions():
    assert executor.next_state(None, "open") == "open"
    assert [executor.next_state("open", s) for s in R.STATES] == list(R.STATES)
    for now in (None, *R.STATES[1:]):
        for then in R.STATES:
            if (now, then) != (None, "open"):
                with pytest.raises(executor.OutputError):
                    executor.next_state(now, then)


def test_a_present_state_that_cannot_be_told_is_reported(package, monkeypatch):
    out, args = broken(package)

    def unreadable(*_):
        raise ValueError("no")

    monkeypatch.setattr(executor, "Package", unreadable)
    assert execute(package, out, args) == 1
    assert [a["status"] for a in R.EXECUTION.parse((package / "execution.json").read_bytes())["actions"]] == ["failed-precondition", "not-run"]
    assert list((package / "backup").iterdir()) == []


def test_a_session_that_cannot_be_opened_is_reported(package, monkeypatch):
    out, args = broken(package)

    def taken(*_):
        raise FileExistsError("there already")

    monkeypatch.setattr(executor, "_Session", taken)
    assert execute(package, out, args) == 1
    report = R.EXECUTION.parse((package / "execution.json").read_bytes())
    assert {a["action"]: a["status"] for a in report["actions"]} == {"remove-stale-sidecar": "failed", "regenerate-sidecar": "not-run"}
    assert (out / "sub/bad.metadata.json").exists() and not (out / "sub/c.metadata.json").exists()


def test_inputs_that_change_after_the_receipt_are_refused(package, monkeypatch):
    out, args = broken(package)
    check = executor.builders.lifecycle_of

    def checking(*a):
        found = check(*a)
        args["manifest"].write_bytes(args["manifest"].read_bytes() + b" ")
        return found

    monkeypatch.setattr(executor.builders, "lifecycle_of", checking)
    assert execute(package, out, args, "--receipt", package / "receipt.json", "--attempt-id", "try-1") == 2
    assert (out / "sub/bad.metadata.json").exists() and not (package / "execution.json").exists()


def test_directory_size(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"12345")
    (tmp_path / "y").write_bytes(b"678")
    assert executor.disk.directory_size(spark, tmp_path) == 8
