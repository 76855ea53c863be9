"""Readers of sidecars, manifests and reports as relations: a category for what is wrong first, typed columns for the rest.

Relations:
  sidecar texts   path, content                   manifest texts  manifest, content (the header) and manifest, seq, content
  report texts    any columns, family, content    (a line an item: a manifest of any length is spread over tasks)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, paths
from ..functions import variants as V

#: Fixed values of the formats, down to the end of SHAPES: report types, field names and the values that they take.
SIDECAR_TYPE, MANIFEST_TYPE = "knowledge-document-metadata", "knowledge-artifact-manifest"
_SETTINGS = {"table_structure": V.flag, "normalization_profile": V.maybe(V.is_string), "artifacts_path_configured": V.flag}
_DIGEST = {"bytes": V.count, "sha256": V.digest}
_REASONS = {"regenerate-sidecar": "missing-sidecar", "remove-stale-sidecar": "stale-sidecar"}
_ROLLBACKS = {"succeeded": "available", "failed-precondition": "not-required", "failed": "not-required", "rolled-back": "completed", "rollback-failed": "failed", "not-run": "not-required"}
_PLANNED = {"path": V.relative, "action": V.of("regenerate-sidecar", "remove-stale-sidecar", "regenerate-manifest", "verify-artifact", "manual-review"), "reason_category": V.text, "safe": V.flag}
_STATE = {"exists": V.flag, "bytes": V.maybe(V.count), "sha256": V.maybe(V.digest)}
_CLEANED = {"action": V.of("delete-backup-session"), "reason_category": V.of("explicit-retention-release"), "session": V.name, "session_manifest_sha256": V.maybe(V.digest), "tree_sha256": V.maybe(V.digest), "backup_files": V.count, "backup_bytes": V.count, "eligible": V.flag}
_VERSIONED, _BOUND = {"sha256": V.digest, "schema_version": V.one}, {"sha256": V.digest}
_counts = lambda *names: dict.fromkeys(names, V.count)
_DONE = ("planned", "executed", "succeeded", "failed", "rolled_back", "not_run")
#: By family: the test of its version, the field with its actions, and its shape.
SHAPES: dict[str, tuple[V.Test, str, dict]] = {
    "plan": (V.one, "actions", {"summary": _counts("issues", "actions", "manual_review"), "actions": V.every(_PLANNED)}),
    "approval": (V.one, "approved_actions", {"plan": _VERSIONED, "scope": {"mode": V.of("all-safe")}, "approved_actions": V.every(_PLANNED)}),
    "preflight": (V.one, "actions", {
        "summary": _counts("actions", "ready", "blocked"), "plan": _BOUND, "approval": _BOUND,
        "actions": V.every({
            "path": V.relative, "action": V.of(*_REASONS), "reason_category": V.text, "status": V.of("ready", "blocked"), "block_reason": V.maybe(V.text),
            "preconditions": {"plan_approved": V.true, "safe": V.true, "package_state_matches": V.flag, "backup_required": V.flag}, "target": {"path": V.text, **_STATE}})}),
    "execution": (V.exactly_one, "actions", {
        "summary": _counts(*_DONE), "plan": _BOUND, "approval": _BOUND, "preflight": _BOUND, "post_validation": V.of("passed", "failed", "not-run"),
        "actions": V.every({"path": V.printable, "action": V.of(*_REASONS), "status": V.of(*_ROLLBACKS), "before": _STATE, "after": _STATE, "rollback": V.text})}),
    "cleanup-plan": (V.one, "actions", {"inventory": _VERSIONED, "policy": {"mode": V.of("explicit-sessions")}, "summary": _counts("requested", "planned", "blocked"), "actions": V.every(_CLEANED)}),
    "cleanup-approval": (V.one, "approved_actions", {"plan": _VERSIONED, "scope": {"mode": V.of("all-planned")}, "approved_actions": V.every(_CLEANED)}),
    "cleanup-audit": (V.one, "actions", {
        "bindings": {"inventory_sha256": V.digest, "plan_sha256": V.digest, "approval_sha256": V.digest}, "summary": _counts("planned", "deleted", "failed", "not_run"),
        "actions": V.every({"session": V.name, "status": V.of("deleted", "failed", "not-run"), "before": {"files": V.count, "bytes": V.count, "tree_sha256": V.digest}, "after": {"exists": V.flag}})}),
}
TYPES = {"plan": "knowledge-package-repair-plan", "approval": "knowledge-package-repair-approval", "preflight": "knowledge-package-repair-preflight", "execution": "knowledge-package-repair-execution"}


def report_type(family: str, producer: str) -> str:
    return TYPES.get(family) or f"{producer}-backup-{family}"


def _escapes(path: Column) -> Column:
    """A string that is no safe path; what is no string is another fault."""
    return path.isNotNull() & ~paths.is_safe(path)


def _first(*faults: tuple[Column, str]) -> Column:
    """The category of the first fault that holds, empty if none does."""
    return reduce(lambda so_far, f: so_far.when(f[0], f[1]), faults[1:], F.when(*faults[0])).otherwise("")


def _digests(value: Column) -> Column:
    return F.struct(V.number(V.at(value, ".bytes")).alias("bytes"), V.string(V.at(value, ".sha256")).alias("sha256"))


def _settings(value: Column) -> Column:
    return F.struct(V.boolean(V.at(value, ".table_structure")).alias("table_structure"), V.string(V.at(value, ".normalization_profile")).alias("normalization_profile"), V.boolean(V.at(value, ".artifacts_path_configured")).alias("artifacts_path_configured"))


def sidecars(texts: DataFrame, producer: str) -> DataFrame:
    """path, category, and of sound ones input_path, output_path, status, source, artifact, engine and settings.

    Categories in their order: invalid-json, invalid-schema (no object), unsupported-schema, invalid-schema (type, missing
    parts), outside-package-root, invalid-schema (fields). A null text is no JSON. Rows are independent; other columns of
    texts are dropped. Empty input: no rows."""
    parts = ("engine", "document", "artifact", "source", "settings")
    v = texts.select("path", V.parsed(F.col("content")).alias("v"))
    v = v.select("path", "v", *(V.at(F.col("v"), f".{p}").alias(p) for p in parts))
    v = v.withColumns({n: V.string(V.at(F.col("document"), f".{n}")) for n in ("input_path", "output_path", "status")})
    own = F.col("v")
    typed = (V.string(V.at(own, ".report_type")) == SIDECAR_TYPE) & reduce(lambda a, b: a & b, (V.is_object(F.col(p)) for p in parts))
    fields = V.fits(own, {"engine": {"name": V.of(producer), "version": V.text}, "document": {"input_path": V.safe, "output_path": V.safe, "status": V.of("succeeded", "skipped")}, "artifact": _DIGEST, "source": _DIGEST, "settings": _SETTINGS})
    category = _first(
        (own.isNull(), "invalid-json"), (~V.is_object(own), "invalid-schema"), (~V.loosely_one(V.at(own, ".schema_version")), "unsupported-schema"), (~F.coalesce(typed, F.lit(False)), "invalid-schema"),
        (_escapes(F.col("input_path")) | _escapes(F.col("output_path")), "outside-package-root"), (~fields, "invalid-schema"),
    )
    engine = F.struct(V.string(V.at(F.col("engine"), ".name")).alias("name"), V.string(V.at(F.col("engine"), ".version")).alias("version"))
    rows = v.select("path", category.alias("category"), F.struct("input_path", "output_path", "status", _digests(F.col("source")).alias("source"), _digests(F.col("artifact")).alias("artifact"), engine.alias("engine"), _settings(F.col("settings")).alias("settings")).alias("d"))
    sound = F.col("category") == ""
    return rows.select("path", "category", *(F.when(sound, F.col(f"d.{c}")).alias(c) for c in ("input_path", "output_path", "status", "source", "artifact", "engine", "settings")))


def manifests(headers: DataFrame, lines: DataFrame, producer: str) -> tuple[DataFrame, DataFrame]:
    """manifest, category, at (seq of the item that decides, null if the header does or nothing is wrong) and n_items; and
    the items of sound manifests: manifest, seq, input_path, output_path, status, input and output digests.

    The header's fault comes first, then that of the first item that has one: a minimum by seq, so items are dealt out and
    combined before they are shuffled. Of items with one seq the one of least category counts. A manifest without lines
    has no items; lines without a header are dropped."""
    v = headers.select("manifest", V.parsed(F.col("content")).alias("v"))
    own = F.col("v")
    fields = V.fits(own, {"report_type": V.of(MANIFEST_TYPE), "engine": {"name": V.of(producer), "version": V.is_string}, "settings": _SETTINGS})
    heads = v.select("manifest", _first((own.isNull(), "invalid-json"), (~V.is_object(own), "invalid-schema"), (~V.loosely_one(V.at(own, ".schema_version")), "unsupported-schema"), (~fields, "invalid-schema")).alias("head"))
    rows = lines.select("manifest", "seq", V.parsed(F.col("content")).alias("v"))
    rows = rows.select("manifest", "seq", "v", *(V.string(V.at(own, p)).alias(n) for n, p in (("input_path", ".input.path"), ("output_path", ".output.path"), ("status", ".status"))))
    whole = V.fits(own, {"input": {"path": V.safe}, "output": {"path": V.safe}, "status": V.of("succeeded", "skipped", "failed")})
    digests = V.fits(own, {"input": _DIGEST, "output": _DIGEST}) | (F.col("status") == "failed")
    fault = _first(
        (own.isNull(), "invalid-json"), (~(V.is_object(V.at(own, ".input")) & V.is_object(V.at(own, ".output"))), "invalid-schema"), (_escapes(F.col("input_path")) | _escapes(F.col("output_path")), "outside-package-root"),
        (~whole | ~F.coalesce(digests, F.lit(False)), "invalid-schema"),
    )
    items = rows.select("manifest", "seq", "input_path", "output_path", "status", _digests(V.at(own, ".input")).alias("input"), _digests(V.at(own, ".output")).alias("output"), fault.alias("fault"))
    bad = F.struct("seq", "fault")
    told = items.groupBy("manifest").agg(F.count("*").alias("n_items"), F.min(F.when(F.col("fault") != "", bad)).alias("bad"))
    found = heads.join(told, "manifest", "left").select(
        "manifest", F.when(F.col("head") != "", F.col("head")).otherwise(F.coalesce("bad.fault", F.lit(""))).alias("category"), F.when(F.col("head") == "", F.col("bad.seq")).alias("at"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items")
    )
    sound = found.filter("category = ''").select("manifest")
    return found, items.drop("fault").join(sound, "manifest", "left_semi")


def _all(actions: Column, test) -> Column:
    return F.forall(actions, lambda a: F.coalesce(test(a), F.lit(False)))


def _state(thing: Column) -> Column:
    return F.struct(V.boolean(thing["exists"]).alias("exists"), V.number(thing["bytes"]).alias("bytes"), V.string(thing["sha256"]).alias("sha256"))


def _whole(s: Column) -> Column:
    """Bytes and digest come together, and only with a file."""
    return (s["bytes"].isNull() == s["sha256"].isNull()) & (s["exists"] | s["bytes"].isNull())


def _planned(a: Column) -> Column:
    kind, reason = V.string(a["action"]), V.string(a["reason_category"])
    due = F.create_map(*(F.lit(x) for pair in {**_REASONS, "regenerate-manifest": "extra-artifact"}.items() for x in pair))
    return (V.boolean(a["safe"]) == kind.isin(*_REASONS)) & (F.coalesce(due[kind], reason) == reason)


def _cleaned(a: Column) -> Column:
    bound = lambda f: V.string(a[f]).isNotNull() == V.boolean(a["eligible"])
    none = (V.number(a["backup_files"]) == 0) & (V.number(a["backup_bytes"]) == 0)
    return bound("session_manifest_sha256") & bound("tree_sha256") & ~V.string(a["session"]).isin(".", "..") & (V.boolean(a["eligible"]) | none)


def _preflighted(a: Column) -> Column:
    kind, ready, target = V.string(a["action"]), V.string(a["status"]) == "ready", _state(a["target"])
    makes = kind == "regenerate-sidecar"
    reason = F.when(makes, "missing-sidecar").otherwise("stale-sidecar")
    fit = F.when(makes, ~target["exists"]).otherwise(target["exists"] & target["sha256"].isNotNull())
    return (V.string(a["reason_category"]) == reason) & (V.boolean(a["preconditions"]["backup_required"]) == ~makes) & (V.string(a["target"]["path"]) == V.string(a["path"])) & _whole(target) & (V.boolean(a["preconditions"]["package_state_matches"]) == ready) & (V.string(a["block_reason"]).isNull() == ready) & (~ready | fit)


def _executed(a: Column) -> Column:
    status, before, after = V.string(a["status"]), _state(a["before"]), _state(a["after"])
    due = F.create_map(*(F.lit(x) for pair in _ROLLBACKS.items() for x in pair))
    made = ~before["exists"] & after["exists"] & after["sha256"].isNotNull()
    gone = before["exists"] & before["sha256"].isNotNull() & ~after["exists"]
    done = F.when(V.string(a["action"]) == "regenerate-sidecar", made).otherwise(gone)
    kept = ~status.isin("failed-precondition", "not-run", "rolled-back") | before.eqNullSafe(after)
    return (due[status] == V.string(a["rollback"])) & _whole(before) & _whole(after) & kept & ((status != "succeeded") | done)


def _summary(own: Column, **counts: Column) -> Column:
    """The counts that a report claims are those of its actions."""
    return reduce(lambda a, b: a & b, (V.number(own["summary"][k]) == c.cast("long") for k, c in counts.items()))


def _statuses(actions: Column) -> Column:
    return F.transform(actions, lambda a: V.string(a["status"]))


def _number(statuses: Column, *which: str) -> Column:
    return F.size(F.filter(statuses, lambda s: s.isin(*which)))


#: Families whose actions come in the order of their keys.
_ORDERED = ("execution", "cleanup-plan", "cleanup-approval", "cleanup-audit")


def _rule(family: str, v: Column, own: Column, ordered: Column) -> Column:
    """What holds across the fields of a family, taken out of the report v: its actions, their order, and its summary."""
    actions = own[SHAPES[family][1]]
    n, s = F.size(actions), _statuses(actions)
    eligible = lambda: F.size(F.filter(actions, lambda a: V.boolean(a["eligible"])))
    manual = lambda: F.size(F.filter(actions, lambda a: V.string(a["action"]) == "manual-review"))
    blocked = lambda: _number(s, "blocked")
    given = V.at(v, ".intent_receipt")
    receipt = (V.kind(given) == "NOTHING") | V.fits(given, {"schema_version": V.exactly_one, "attempt_id": V.attempt, "sha256": V.digest})
    return {
        "plan": lambda: _all(actions, _planned) & _summary(own, actions=n, manual_review=manual()) & (V.number(own["summary"]["issues"]) >= n),
        "approval": lambda: _all(actions, lambda a: _planned(a) & V.boolean(a["safe"])),
        "preflight": lambda: _all(actions, _preflighted) & _summary(own, actions=n, ready=n - blocked(), blocked=blocked()),
        "execution": lambda: receipt & _all(actions, _executed) & ordered & _summary(
            own, planned=n, executed=n - _number(s, "not-run"), succeeded=_number(s, "succeeded"), failed=_number(s, "failed-precondition", "failed", "rollback-failed"), rolled_back=_number(s, "rolled-back"), not_run=_number(s, "not-run")
        ),
        "cleanup-plan": lambda: _all(actions, _cleaned) & ordered & _summary(own, requested=n, planned=eligible(), blocked=n - eligible()),
        "cleanup-approval": lambda: _all(actions, lambda a: _cleaned(a) & V.boolean(a["eligible"])) & ordered,
        "cleanup-audit": lambda: receipt & _all(actions, lambda a: (V.string(a["status"]) != "deleted") | ~V.boolean(a["after"]["exists"])) & ordered & (F.size(V.names(V.at(v, ".summary"))) == 4) & _summary(own, planned=n, deleted=_number(s, "deleted"), failed=_number(s, "failed"), not_run=_number(s, "not-run")),
    }[family]()


def reports(texts: DataFrame, producer: str) -> DataFrame:
    """texts with `issue` in place of content: json, type (report type or version), fields, rule (actions, their order, the
    summary), family (not one of SHAPES), or empty. All families are judged in one pass without a shuffle: a report is a row,
    its actions an array, and all fields of its family are taken out at once. Null texts are no JSON; other columns stay.
    Empty input: no rows."""
    own = [c for c in texts.columns if c != "content"]
    v, family = F.col("_v"), F.col("family")
    rows = texts.select(*own, V.parsed(F.col("content")).alias("_v"))
    pick = lambda told, of=tuple(SHAPES): F.coalesce(*(F.when(family == f, told(f)) for f in of))
    named = [dict.fromkeys(("session", "path", "action"), V.is_string)]
    rows = rows.select("*", pick(lambda f: (V.string(V.at(v, ".report_type")) == report_type(f, producer)) & SHAPES[f][0](V.at(v, ".schema_version"))).alias("_type"), pick(lambda f: V.typed(v, named, f".{SHAPES[f][1]}"), _ORDERED).alias("_named"))
    rows = rows.select("*", F.transform("_named", lambda a: F.coalesce(V.string(a["session"]), V.string(a["path"]))).alias("_names"), F.transform("_named", lambda a: V.string(a["action"])).alias("_kinds"))
    rows = rows.withColumn("_keys", keys.path_keys(F.col("_names")))
    places = F.transform(F.arrays_zip("_keys", "_kinds"), lambda p: F.when(family == "execution", F.concat_ws("\x00", p["_keys"], p["_kinds"])).otherwise(p["_keys"]))
    rows = rows.withColumn("_places", places).withColumn("_ordered", F.col("_places") == F.array_sort(F.array_distinct("_places")))

    def judged(f: str) -> Column:
        sound = lambda test: F.coalesce(test, F.lit(False))
        return V.let(V.typed(v, SHAPES[f][2]), lambda fields: _first((~sound(V.holds(fields, SHAPES[f][2])), "fields"), (~sound(_rule(f, v, fields, F.col("_ordered"))), "rule")))

    issue = F.when(~family.isin(*SHAPES), "family").when(v.isNull(), "json").when(~F.coalesce(F.col("_type"), F.lit(False)), "type").otherwise(pick(judged))
    return rows.select(*own, issue.alias("issue"))
