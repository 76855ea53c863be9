"""States over time and chains of bindings, for many sessions and packages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The states that a session may go to. One that is over goes nowhere.
TRANSITIONS: dict[str, tuple[str, ...]] = {"open": ("open", "complete", "rolled-back", "rollback-failed"), "complete": (), "rolled-back": (), "rollback-failed": ()}
#: Reports from the receipt down to what nothing is bound to, and the reason if a link is broken.
CHAIN = ("receipt", "preflight", "approval", "plan", "manifest")
REASONS = ("missing", "several", "mismatch")


def allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, every in TRANSITIONS.items() for b in every], "before string, state string")


def first_illegal(events: DataFrame, session: list[str], order: list[str], state: str = "state") -> DataFrame:
    """A row for each session: steps, last_state, illegal (steps that the table of transitions does not have), and of the
    first of these its place (from 0; the session's first state must be open), the state before and the state.

    Steps come by `order`; those that are equal in it by state. A null state is never legal, nor is what follows it. The
    table is broadcast (a handful of rows); a session's steps pass through one task in order, a row at a time, and no more
    than one of them is kept. Other columns are ignored. Empty input: no rows."""
    over = Window.partitionBy(*session).orderBy(*order, state)
    steps = events.select(*session, F.col(state).alias("state"), F.lag(state).over(over).alias("before"), (F.row_number().over(over) - 1).alias("place"))
    known = allowed(events.sparkSession).select("before", "state", F.lit(True).alias("fine"))
    told = steps.join(F.broadcast(known), ["before", "state"], "left")
    legal = F.when(F.col("place") == 0, F.coalesce(F.col("state") == "open", F.lit(False))).otherwise(F.coalesce("fine", F.lit(False)))
    bad = F.struct("place", "before", "state")
    rows = told.withColumn("legal", legal).groupBy(*session).agg(
        F.count("*").alias("steps"), F.max_by("state", "place").alias("last_state"), F.count_if(~F.col("legal")).alias("illegal"), F.min_by(F.when(~F.col("legal"), bad), F.when(~F.col("legal"), F.col("place"))).alias("bad")
    )
    return rows.select(*session, "steps", "last_state", "illegal", F.col("bad.place").alias("place"), F.col("bad.before").alias("before"), F.col("bad.state").alias("state"))


def _short(text: Column) -> Column:
    return F.unhex(F.left(F.sha2(text.cast("binary"), 256), F.lit(40)))


def chains(reports: DataFrame, package: str = "package") -> DataFrame:
    """From reports (package, kind, sha256, bindings map<string,string>: digest by kind) a row for each receipt: package,
    receipt (its digest), reached (the last kind that holds) and broken: null if every report that the receipt leads to is
    there once and is bound to the same manifest, else the kind that is `missing`, `several` (reports of one digest) or
    bound to something else (`mismatch`), as `kind: reason`, the first on the way down.

    Each report names the digests of those above it, a receipt all of them. So its links are looked up at once, by package
    and digest, whatever the number of packages: what is shuffled of a report are 160 bits for its kind and digest, 160 for
    what it is bound to further down, and their number; of a link these and 160 bits for its receipt; only broken links
    come back to the receipts. Both joins sort and merge: sizes that Spark estimates from columns which digests are made
    of are far too small, and it would broadcast all reports. A null digest is nobody's, nor is a null package. Rows that
    are no receipt and have none are ignored. Empty input: no rows."""
    own = reports.select(F.col(package).alias("package"), "kind", "sha256", "bindings").filter("sha256 is not null")
    below = lambda kind, named: _short(F.to_json(F.array(*(named[k] for k in CHAIN[CHAIN.index(kind) + 1 :]))))
    key = lambda kind, digest: _short(F.concat(kind, F.lit(" "), digest))
    kind, links = F.col("kind"), CHAIN[1:]
    bound = F.coalesce(*(F.when(kind == k, below(k, F.col("bindings"))) for k in links[:-1]))  # nothing is below the last
    counted = own.filter(kind.isin(*links)).select("package", key(kind, F.col("sha256")).alias("key"), bound.alias("bound")).groupBy("package", "key").agg(F.count("*").alias("n"), F.min("bound").alias("bound"))

    named = F.col("bindings")
    same = _short(F.to_json(F.struct("package", "sha256", F.array(*(named[k] for k in links)).alias("named"))))  # receipts that are equal fare alike
    unnamed = F.coalesce(F.when(F.col("package").isNull(), len(REASONS)), *(F.when(named[k].isNull(), i * len(REASONS)) for i, k in enumerate(links, 1)))
    receipts = own.filter(kind == CHAIN[0]).select("package", F.col("sha256").alias("receipt"), same.alias("same"), unnamed.alias("unnamed"), "bindings")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), key(F.lit(k), named[k]).alias("key"), (below(k, named) if k != CHAIN[-1] else F.lit(None).cast("binary")).alias("due")) for i, k in enumerate(links, 1)))
    rows = receipts.select("package", "same", F.inline(wanted)).filter("package is not null and key is not null")
    met = rows.join(counted.hint("merge"), ["package", "key"], "left")
    reason = F.when(F.col("n").isNull(), 0).when(F.col("n") > 1, 1).when(~F.col("bound").eqNullSafe(F.col("due")), 2)
    broken = met.select("same", (F.col("i") * len(REASONS) + reason).alias("code")).filter("code is not null").groupBy("same").agg(F.min("code").alias("code"))

    code = F.least("unnamed", "code")  # of those that are there
    place, why = F.floor(code / len(REASONS)).cast("int"), code % len(REASONS)
    of = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    told = receipts.drop("bindings").join(broken.hint("merge"), "same", "left")
    return told.select("package", "receipt", F.when(code.isNull(), CHAIN[-1]).otherwise(of(CHAIN, place - 1)).alias("reached"), F.concat(of(CHAIN, place), F.lit(": "), of(REASONS, why)).alias("broken"))
