"""From rows and bytes to report documents: what each subcommand writes.

Relations are computed by the operators and fetched here, in order, when a document is rendered: a package's
ledger is as large as its list of documents, and a report is one file.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame

from ..operators import intent as intent_rules
from . import reports as R

SETTINGS = {"recursive": False, "include": [], "exclude": [], "force": False, "table_structure": False, "artifacts_path_configured": False, "normalization_profile": None}


def sidecar_name(output_path: str) -> str:
    return PurePosixPath(output_path).with_suffix(".metadata.json").as_posix()


def quality_report(items: DataFrame) -> dict:
    """items: seq, input, output, status, warnings array<string>."""
    rows = [{"input": r.input, "output": r.output, "status": r.status, "warnings": [{"category": w, "message": w} for w in r.warnings]} for r in items.sort("seq").toLocalIterator()]
    warned = sum(r["status"] == "warned" for r in rows)
    return {"report_type": "markdown-quality", "schema_version": 1, "summary": {"checked": len(rows), "passed": len(rows) - warned, "warned": warned}, "items": rows}


def manifest(items: DataFrame, settings: dict, version: str, producer: str = R.PRODUCER) -> bytes:
    rows = []
    for r in items.sort("seq").toLocalIterator():
        side = lambda p, d: {"path": p, "bytes": d.bytes, "sha256": d.sha256}
        rows.append({"input": side(r.input_path, r.input), "output": side(r.output_path, r.output), "status": r.status, "error_category": r.error_category, "message": r.message})
    n = Counter(r["status"] for r in rows)
    return R.MANIFEST.build({"engine": {"name": producer, "version": version}, "settings": SETTINGS | settings, "summary": {"items": len(rows), **{k: n[k] for k in ("succeeded", "skipped", "failed")}}, "items": rows}, producer)


def sidecar(item: dict, engine: dict, settings: dict, producer: str = R.PRODUCER) -> bytes:
    """item: an entry of a manifest with both digests."""
    own = R.picked(settings, "table_structure", "normalization_profile", "artifacts_path_configured")
    return R.SIDECAR.build({"engine": R.picked(engine, "name", "version"), "document": {"input_path": item["input"]["path"], "output_path": item["output"]["path"], "status": item["status"]}, "artifact": R.picked(item["output"], "bytes", "sha256"), "source": R.picked(item["input"], "bytes", "sha256"), "settings": own}, producer)


def validation(checked: Sequence[str], issues: Sequence[dict]) -> dict:
    failed, warned = ({i["path"] for i in issues if i["severity"] == s} for s in ("error", "warning"))
    ordered = sorted(issues, key=lambda i: (R.key(i["path"]), i["category"], i["severity"], i["message"]))
    summary = {"checked": len(checked), "passed": max(0, len(checked) - len(failed)), "failed": len(failed), "warnings": len(warned)}
    return {"report_type": "knowledge-package-validation", "schema_version": 1, "summary": summary, "issues": ordered}


def plan(issues: int, actions: Sequence[dict], producer: str = R.PRODUCER) -> bytes:
    ordered = sorted(actions, key=lambda a: (R.key(a["path"]), a["action"], a["reason_category"]))
    return R.PLAN.build({"summary": {"issues": issues, "actions": len(ordered), "manual_review": sum(a["action"] == "manual-review" for a in ordered)}, "actions": ordered}, producer)


def approval(plan_bytes: bytes, producer: str = R.PRODUCER) -> bytes:
    p = R.PLAN.parse(plan_bytes, producer)
    chosen = [R.picked(a, *R.PLAN_ACTION) for a in p["actions"] if a["safe"] and a["action"] != "manual-review"]
    return R.APPROVAL.build({"plan": {"sha256": R.sha256(plan_bytes), "schema_version": 1}, "scope": {"mode": "all-safe"}, "approved_actions": chosen}, producer)


def preflight(plan_bytes: bytes, approval_bytes: bytes, rows: Sequence[dict], producer: str = R.PRODUCER) -> bytes:
    """rows: path, action, reason, status, block_reason, backup_required and target of each approved action."""
    out = []
    for r in sorted(rows, key=lambda r: (R.key(r["path"]), r["action"], r["reason"])):
        checks = {"plan_approved": True, "safe": True, "package_state_matches": r["status"] == "ready", "backup_required": r["backup_required"]}
        out.append({"path": r["path"], "action": r["action"], "reason_category": r["reason"], "status": r["status"], "block_reason": r["block_reason"], "preconditions": checks, "target": {"path": r["path"], **r["target"]}})
    ready = sum(r["status"] == "ready" for r in out)
    return R.PREFLIGHT.build({"summary": {"actions": len(out), "ready": ready, "blocked": len(out) - ready}, "plan": {"sha256": R.sha256(plan_bytes)}, "approval": {"sha256": R.sha256(approval_bytes)}, "actions": out}, producer)


def bound_approval(plan_bytes: bytes, approval_bytes: bytes, producer: str = R.PRODUCER) -> list[dict]:
    """The approved actions, if the approval is for exactly this plan and all that may be approved of it."""
    p, a = R.PLAN.parse(plan_bytes, producer), R.APPROVAL.parse(approval_bytes, producer)
    want = [R.picked(x, *R.PLAN_ACTION) for x in p["actions"] if x["safe"] and x["action"] != "manual-review"]
    R.need(a["plan"]["sha256"] == R.sha256(plan_bytes) and [R.picked(x, *R.PLAN_ACTION) for x in a["approved_actions"]] == want, "plan and approval do not belong together")
    return want


def cleanup_plan(inventory_bytes: bytes, requested: Sequence[str], producer: str = R.PRODUCER) -> bytes:
    R.need(bool(requested) and all(R.name(s) and s not in (".", "..") for s in requested) and len({R.key(s) for s in requested}) == len(requested), "requested sessions")
    known = {R.key(s["session"]): s for s in R.INVENTORY.parse(inventory_bytes, producer)["sessions"]}
    actions = []
    for wanted in sorted(requested, key=R.key):
        s = known.get(R.key(wanted))
        fine = bool(s and s["planning_eligible"])
        actions.append({
            "action": R.CLEANUP_ACTION, "reason_category": R.CLEANUP_REASON, "session": s["session"] if s else wanted, "session_manifest_sha256": s["session_manifest_sha256"] if fine else None,
            "tree_sha256": s["tree_sha256"] if fine else None, "backup_files": len(s["items"]) if fine else 0, "backup_bytes": sum(i["bytes"] for i in s["items"]) if fine else 0, "eligible": fine,
        })
    planned = sum(a["eligible"] for a in actions)
    return R.CLEANUP_PLAN.build({"inventory": {"sha256": R.sha256(inventory_bytes), "schema_version": 1}, "policy": {"mode": "explicit-sessions"}, "summary": {"requested": len(actions), "planned": planned, "blocked": len(actions) - planned}, "actions": actions}, producer)


def cleanup_approval(plan_bytes: bytes, producer: str = R.PRODUCER) -> bytes:
    p = R.CLEANUP_PLAN.parse(plan_bytes, producer)
    return R.CLEANUP_APPROVAL.build({"plan": {"sha256": R.sha256(plan_bytes), "schema_version": 1}, "scope": {"mode": "all-planned"}, "approved_actions": [R.picked(a, *R.CLEANUP) for a in p["actions"] if a["eligible"]]}, producer)


def intent(kind: str, attempt_id: str, inputs: Sequence[bytes], producer: str = R.PRODUCER) -> bytes:
    """The receipt for an operation: inputs are the bound documents in their fixed order, the last but one or last of
    which names the actions."""
    bindings = [{"artifact_type": t, "schema_version": 1, "sha256": R.sha256(b)} for t, b in zip(R.BINDINGS[kind], inputs, strict=True)]
    if kind == "repair-execution":
        found = [(a["path"], a["action"], a["reason_category"]) for a in R.PREFLIGHT.parse(inputs[-1], producer)["actions"]]
    else:
        found = [(a["session"], a["action"], a["reason_category"]) for a in R.CLEANUP_APPROVAL.parse(inputs[-1], producer)["approved_actions"]]
    found.sort(key=lambda x: (R.key(x[0]), x[1], x[2]))
    actions = [{"action_index": i, "action": a, "target": t, "reason_category": r, "intent": "approved-for-execution"} for i, (t, a, r) in enumerate(found)]
    return R.INTENT.build({"attempt_id": attempt_id, "operation_type": kind, "bindings": bindings, "actions": actions}, producer)


def operations_of(source: str, digest: str, report: dict) -> list[dict]:
    out = []
    for i, a in enumerate(report["actions"]):
        if source == "repair-execution":
            before, after = (R.picked(a[k], "exists", "bytes", "sha256") for k in ("before", "after"))
            change = R.change_of(before, after)
            outcome, reason = R.outcome_of(a["status"], change)
            row = {"action": f"repair-{a['action']}", "target": a["path"], "mutation_scope": "package", "rollback": a["rollback"]}
        else:
            before, after, change = R.picked(a["before"], "files", "bytes", "tree_sha256"), R.picked(a["after"], "exists"), "unknown"
            outcome, reason = R.cleanup_outcome(a["status"])
            row = {"action": "backup-delete-session", "target": a["session"], "mutation_scope": "backup", "rollback": None}
        out.append({
            "source_type": source, "source_sha256": digest, "source_action_index": i, "action": row["action"], "target": row["target"], "mutation_scope": row["mutation_scope"], "source_status": a["status"], "outcome": outcome,
            "before": before, "after": after, "rollback": row["rollback"], "package_change": change, "operator_action_required": outcome != "succeeded", "reason": reason,
        })
    return out


_SOURCE_FAMILY = {"repair-execution": R.EXECUTION, "backup-cleanup-audit": R.CLEANUP_AUDIT}


def audit(sources: Sequence[tuple[str, bytes]], producer: str = R.PRODUCER) -> bytes:
    """sources: (source type, exact bytes) of the reports to audit."""
    R.need(bool(sources) and len({b for _, b in sources}) == len(sources), "sources: none, or one twice")
    found = sorted((t, R.sha256(b), b) for t, b in sources)
    operations = [o for t, d, b in found for o in operations_of(t, d, _SOURCE_FAMILY[t].parse(b, producer))]
    return R.AUDIT.build({"summary": R.audit_summary(operations), "sources": [{"source_type": t, "schema_version": 1, "sha256": d} for t, d, _ in found], "operations": operations}, producer)


def audit_verified(audit_bytes: bytes, sources: Sequence[tuple[str, bytes]], producer: str = R.PRODUCER) -> dict:
    """Counts of matched, missing, unexpected and invalid sources, and the exit code. Sources are read only if all match."""
    a = R.AUDIT.parse(audit_bytes, producer)
    want, have = Counter((s["source_type"], s["sha256"]) for s in a["sources"]), Counter((t, R.sha256(b)) for t, b in sources)
    out = {"sources_expected": want.total(), "sources_provided": have.total(), "matched": (want & have).total(), "missing": (want - have).total(), "unexpected": (have - want).total(), "invalid": 0}
    if not out["missing"] and not out["unexpected"]:
        for t, b in sources:
            out["invalid"] += not _SOURCE_FAMILY[t].recognises(b, producer)
        if not out["invalid"]:
            again = R.AUDIT.parse(audit(sources, producer), producer)
            out["invalid"] = int(any(again[k] != [R.picked(x, *y) for x, y in zip(a[k], again[k], strict=False)] or len(again[k]) != len(a[k]) for k in ("sources", "operations")))
    return out | {"exit_code": 2 if out["invalid"] else 1 if out["missing"] or out["unexpected"] else 0}


def context(audit_bytes: bytes, statuses: Sequence[bytes], producer: str = R.PRODUCER) -> bytes:
    a, s = projections(audit_bytes, statuses, producer)
    return R.CONTEXT.build({"operational_audit": a, "intent_statuses": s, "summary": R.context_summary(a, s)}, producer)


def projections(audit_bytes: bytes, statuses: Sequence[bytes], producer: str = R.PRODUCER) -> tuple[dict, list[dict]]:
    operations = R.AUDIT.parse(audit_bytes, producer)["operations"]
    R.need(len({R.sha256(b) for b in statuses}) == len(statuses), "a status twice")
    a = {"schema_version": 1, "sha256": R.sha256(audit_bytes), "operations": len(operations), "operator_action_required_count": sum(o["operator_action_required"] for o in operations)}
    return a, sorted(({"schema_version": 1, "sha256": R.sha256(b), "operator_action_required": R.STATUS.parse(b, producer)["operator_action_required"]} for b in statuses), key=lambda s: s["sha256"])


def context_verified(context_bytes: bytes, audit_bytes: bytes, statuses: Sequence[bytes], producer: str = R.PRODUCER) -> dict:
    c = R.CONTEXT.parse(context_bytes, producer)
    a, s = projections(audit_bytes, statuses, producer)
    want, have = ({x["sha256"]: x["operator_action_required"] for x in y} for y in (c["intent_statuses"], s))
    common = want.keys() & have.keys()
    out = {
        "audit_matches": R.picked(c["operational_audit"], *a) == a, "statuses_expected": len(want), "statuses_provided": len(have), "matched": len(common), "missing": len(want.keys() - have.keys()), "unexpected": len(have.keys() - want.keys()),
        "projections_match": all(want[k] == have[k] for k in common), "summary_matches": R.context_summary(a, s) == R.picked(c["summary"], *R.context_summary(a, s)),
    }
    fine = out["audit_matches"] and not out["missing"] and not out["unexpected"] and out["projections_match"] and out["summary_matches"]
    return out | {"exit_code": 0 if fine else 1}


def intent_status(receipt_bytes: bytes, finals: Sequence[tuple[str, bytes]], lifecycle: tuple[bool, bool | None] | None = None, current: bool | None = None, producer: str = R.PRODUCER) -> bytes:
    """Classifies a receipt against final reports (source type, bytes). lifecycle: whether the inputs' digests and their
    actions are the receipt's, None if not checked; current: whether the present state still allows the actions."""
    R.need(len({b for _, b in finals}) == len(finals), "a final report twice")
    receipt, digest = R.INTENT.parse(receipt_bytes, producer), R.sha256(receipt_bytes)
    kind = receipt["operation_type"]
    late = None if lifecycle is None else R.LIFECYCLE[0] if not lifecycle[0] else R.LIFECYCLE[1] if lifecycle[1] is False else ""
    life = "not-provided" if late is None else "mismatch" if late else "verified"
    evidence = sorted((t, R.sha256(b), b) for t, b in finals)
    state, pair, reason = "orphan", "missing", "final-report-missing"
    if not evidence:
        if late:
            state, reason = "stale", late
    elif len(evidence) > 1:
        state, pair, reason = "conflicting", "conflicting", "multiple-final-reports"
    else:
        clash = _conflict(receipt, digest, evidence[0][0], _SOURCE_FAMILY[evidence[0][0]].parse(evidence[0][2], producer))
        state, pair, reason = ("conflicting", "conflicting", clash) if clash else ("paired", "verified", late or "paired")
    now = "not-provided"
    if state == "orphan" and life == "verified" and current is not None:
        now = "verified" if current else "mismatch"
    elif lifecycle is not None and state == "paired":
        now = "not-applicable"
    body = {
        "receipt": {"sha256": digest, "operation_type": kind, "attempt_id": receipt["attempt_id"]}, "classification": state, "final_reports": [{"source_type": t, "sha256": d} for t, d, _ in evidence],
        "bindings": {"receipt_final_report": pair, "lifecycle_inputs": life, "current_preconditions": now}, "operator_action_required": state != "paired" or life == "mismatch", "reason": reason,
    }
    return R.STATUS.build(body, producer)


def _claimed(report: dict, source: str) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """The actions that a final report tells of, and the artifacts it is bound to."""
    if source == R.SOURCES["backup-cleanup"]:
        bound = {kind: report["bindings"][f"{k}_sha256"] for k, kind in zip(("inventory", "plan", "approval"), R.BINDINGS["backup-cleanup"], strict=True)}
        return [(R.CLEANUP_ACTION, a["session"]) for a in report["actions"]], bound
    return [(a["action"], a["path"]) for a in report["actions"]], {f"repair-{k}": report[k]["sha256"] for k in ("plan", "approval", "preflight")}


def _conflict(receipt: dict, digest: str, source: str, report: dict) -> str | None:
    """The first reason, in the order that operators.intent fixes, why a final report is not that of the receipt."""
    own, (did, bound) = report.get("intent_receipt"), _claimed(report, source)
    told, known = own or {}, {b["artifact_type"]: b["sha256"] for b in receipt["bindings"]}
    agrees = {
        "legacy-final-report": own is not None,
        "receipt-sha256-mismatch": told.get("sha256") == digest,
        "attempt-id-mismatch": told.get("attempt_id") == receipt["attempt_id"],
        "operation-type-mismatch": R.SOURCES[receipt["operation_type"]] == source,
        "action-scope-mismatch": did == [(a["action"], a["target"]) for a in receipt["actions"]],
        "binding-scope-mismatch": bound.items() <= known.items(),
    }
    return next((reason for reason in intent_rules.CONFLICTS if not agrees[reason]), None)


def lifecycle_of(receipt_bytes: bytes, inputs: Sequence[bytes], producer: str = R.PRODUCER) -> tuple[bool, bool | None]:
    """Whether the lifecycle inputs are the bound ones, and then whether their actions are the receipt's."""
    receipt = R.INTENT.parse(receipt_bytes, producer)
    same = [b["sha256"] for b in receipt["bindings"]] == [R.sha256(b) for b in inputs]
    if not same:
        return False, None
    again = R.INTENT.parse(intent(receipt["operation_type"], receipt["attempt_id"], inputs, producer), producer)
    return True, [R.picked(a, *x) for a, x in zip(receipt["actions"], again["actions"], strict=False)] == again["actions"] and len(receipt["actions"]) == len(again["actions"])


def read(path: str | Path) -> bytes:
    from ..sources.files import read_stable

    return read_stable(Path(path))
