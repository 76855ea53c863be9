"""Pairing of intent receipts with the final reports that claim them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are tested.
CONFLICTS = ("legacy-final-report", "receipt-sha256-mismatch", "attempt-id-mismatch", "operation-type-mismatch", "action-scope-mismatch", "binding-scope-mismatch")


def paired(receipts: DataFrame, reports: DataFrame) -> DataFrame:
    """receipts: receipt_id, sha256, attempt_id, operation_type, actions, bindings map<string,string>, lifecycle (null
    if not provided, else verified | binding-mismatch | action-scope-mismatch). reports: receipt_id they were handed in
    for, receipt_sha256, attempt_id, operation_type, actions, bindings.

    One row a receipt: classification, reason, n_reports, operator_required, exit_code."""
    final = reports.select("receipt_id", F.struct("receipt_sha256", "attempt_id", "operation_type", "actions", F.map_entries("bindings").alias("bindings")).alias("final"))
    grouped = final.groupBy("receipt_id").agg(F.count("*").alias("n"), F.min("final").alias("final"))
    rows = receipts.join(grouped, "receipt_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    f = F.col("final")
    bound = F.forall(f["bindings"], lambda e: F.coalesce(F.element_at(F.col("bindings"), e["key"]) == e["value"], F.lit(False)))
    clash = (f["receipt_sha256"].isNull(), f["receipt_sha256"] != F.col("sha256"), f["attempt_id"] != F.col("attempt_id"), f["operation_type"] != F.col("operation_type"), ~f["actions"].eqNullSafe(F.col("actions")), ~bound)
    conflict = F.lit(None).cast("string")
    for test, reason in reversed(list(zip(clash, CONFLICTS, strict=True))):
        conflict = F.when(test, reason).otherwise(conflict)
    rows = rows.withColumn("conflict", F.when(F.col("n") == 1, conflict))
    life = F.when(F.col("lifecycle").isin("binding-mismatch", "action-scope-mismatch"), F.concat(F.lit("lifecycle-"), F.col("lifecycle")))
    kind = F.when(F.col("n") == 0, F.when(life.isNotNull(), "stale").otherwise("orphan")).when((F.col("n") > 1) | F.col("conflict").isNotNull(), "conflicting").otherwise("paired")
    reason = F.when(F.col("n") == 0, F.coalesce(life, F.lit("final-report-missing"))).when(F.col("n") > 1, "multiple-final-reports").when(F.col("conflict").isNotNull(), F.col("conflict")).otherwise(F.coalesce(life, F.lit("paired")))
    required = (kind != "paired") | life.isNotNull()
    return rows.select("receipt_id", kind.alias("classification"), reason.alias("reason"), F.col("n").alias("n_reports"), required.alias("operator_required"), F.when(kind == "paired", 0).otherwise(1).alias("exit_code"))
