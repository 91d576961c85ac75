"""Proposals and decisions: merges that keep what was published, checks before publishing, approvals.

Roles are rows with ``org_id`` and ``id``; a proposal is the rows that a new reading would publish.
Fields that a decision doesn't name pass through as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.changes import CRITICAL, blank

#: Fields that a reading doesn't bring and that stay; fields in which a blank reading
#: takes nothing away; facts on which two readings may not differ; outcomes that stay open.
CURATED = ("role_zones", "london_wide")
CARRIED = ("commitment", "min_term_months", "typical_shift_hours", "specific_times", "postcode_district", "who_can_apply", "skills", "eligibility", "seasonal_window", "role_zones", "london_wide")
DECISIVE = (*CRITICAL, "who_can_apply")
UNRESOLVED = ("review_required", "source_failed", "ai_unavailable", "extraction_failed", "invalid_extraction")
AI_FAILED = ("ai_unavailable", "extraction_failed", "invalid_extraction")


def empty(value: Column, kind: str) -> Column:
    """Whether a field says nothing: null, unknown, an empty text or list."""
    return value.isNull() | (F.size(value) == 0) if kind.startswith("array") else blank(value)


def merged(old: DataFrame, new: DataFrame, pairs: DataFrame, curated: tuple[str, ...] = CURATED) -> DataFrame:
    """The rows of ``new`` with what their partners keep (pairs: old_id, new_id): the published id, curated
    fields that the new row lacks, and coordinates where postcode and kind of place are the same."""
    kept = [c for c in (*curated, "coords", "postcode_district", "location_type") if c in old.columns]
    before = old.select(F.col("id").alias("old_id"), *(F.col(c).alias(f"_old_{c}") for c in kept))
    both = new.join(pairs.select("old_id", F.col("new_id").alias("id")), "id", "left").join(before, "old_id", "left")
    same = F.lit(True)
    for c in ("postcode_district", "location_type"):
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}")) if c in kept else same
    out = {"id": F.coalesce("old_id", "id")}
    for c in curated:
        if c in kept:
            out[c] = F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in new.columns else F.col(f"_old_{c}")
    if "coords" in kept:
        own = F.col("coords") if "coords" in new.columns else F.lit(None)
        out["coords"] = F.when(F.col("old_id").isNotNull() & same, F.col("_old_coords")).otherwise(own)
    return both.withColumns(out).drop("old_id", *(f"_old_{c}" for c in kept))


def beside_current(old: DataFrame, new: DataFrame, paired: DataFrame) -> DataFrame:
    """The current rows unchanged, and of a newer reading only those that none of them is paired with
    (paired: new_id): approving adds and replaces nothing."""
    return old.unionByName(new.join(paired.select(F.col("new_id").alias("id")).distinct(), "id", "left_anti"), allowMissingColumns=True)


def disagreements(both: DataFrame, fields: dict[str, tuple[Column, Column]], key: str, decisive: tuple[str, ...] = DECISIVE) -> DataFrame:
    """key, field for each decisive field (old and new value, texts) on which a fresh reading states something
    else; one that says nothing contradicts nothing."""
    hits = [F.when(~a.eqNullSafe(b) & ~blank(b), F.lit(name)) for name, (a, b) in fields.items() if name in decisive]
    return both.select(key, F.explode(F.array_compact(F.array(*hits))).alias("field"))


def checked_route(routes: DataFrame, errors: DataFrame, most: int = 400) -> DataFrame:
    """org_id, route, reasons: an update that would go out by itself goes to review where the build would
    refuse it (errors: org_id, error)."""
    found = errors.groupBy("org_id").agg(F.substring(F.array_join(F.array_sort(F.collect_set("error")), "; "), 1, most).alias("_why"))
    both = routes.join(found, "org_id", "left")
    refused = (F.col("route") != "review") & F.col("_why").isNotNull()
    why = F.array_append("reasons", F.concat(F.lit("the build would refuse this: "), F.col("_why")))
    return both.select("org_id", F.when(refused, "review").otherwise(F.col("route")).alias("route"), F.when(refused, why).otherwise(F.col("reasons")).alias("reasons"))


def stale_reason(baseline: Column, proposed: Column, last_success: Column, checked_at: Column) -> Column:
    """Why a proposal can't be decided any more, or null: its version is the baseline already, or the listing
    changed after it was made."""
    return F.when(proposed.isNotNull() & (proposed != "") & baseline.eqNullSafe(proposed), "decided").when(last_success > checked_at, "overtaken")


def approved(
    old: DataFrame,
    proposed: DataFrame,
    dropped: DataFrame | None = None,
    renamed: DataFrame | None = None,
    pairs: DataFrame | None = None,
    keep_missing: bool = False,
    take_blanks: bool = False,
    fields: tuple[str, ...] = CARRIED,
) -> DataFrame:
    """The rows that an approval publishes, of every organisation at once.

    ``dropped`` (org_id, title) names proposed rows to leave out, ``renamed`` (org_id, title, old_title)
    proposed rows that are current ones under another title: they keep the id. A field that the
    proposal leaves blank keeps its current value, a postcode only where the kind of place is the same
    (unless ``take_blanks``). With ``keep_missing`` current rows without a partner (pairs: old_id of those that have one)
    stay, with an unknown status. Titles compare without case. All rows count as reviewed by a person.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    rows = proposed
    if dropped is not None:
        rows = rows.withColumn("_t", low("title")).join(dropped.select("org_id", low("title").alias("_t")).distinct(), ["org_id", "_t"], "left_anti").drop("_t")
    same = None
    if renamed is not None:
        named = renamed.select("org_id", low("title").alias("_t"), low("old_title").alias("_o"))
        same = named.join(old.select("org_id", low("title").alias("_o"), F.col("id").alias("_id")), ["org_id", "_o"]).select("org_id", "_t", "_id")
        rows = rows.withColumn("_t", low("title")).join(same, ["org_id", "_t"], "left").withColumn("id", F.coalesce("_id", "id")).drop("_t", "_id")
    kinds, held = dict(old.dtypes), [c for c in fields if c in old.columns and c in proposed.columns]
    before = old.select("org_id", "id", F.lit(True).alias("_held"), *(F.col(c).alias(f"_old_{c}") for c in {*held, "location_type", "coords"} & set(old.columns)))
    rows = rows.join(before, ["org_id", "id"], "left")
    out = {}
    for c in held if not take_blanks else ():
        fill = empty(F.col(c), kinds[c]) & ~empty(F.col(f"_old_{c}"), kinds[c])
        if c == "postcode_district" and "location_type" in old.columns:
            fill = fill & F.col("location_type").eqNullSafe(F.col("_old_location_type"))
            if "coords" in proposed.columns and "coords" in old.columns:
                out["coords"] = F.when(fill & F.col("coords").isNull(), F.col("_old_coords")).otherwise(F.col("coords"))
        out[c] = F.when(fill, F.col(f"_old_{c}")).otherwise(F.col(c))
    rows = rows.withColumns({**out, "reviewed": F.lit(True)}).drop(*[c for c in rows.columns if c.startswith("_old_") or c == "_held"])
    if keep_missing:
        gone = old if pairs is None else old.join(pairs.where("old_id is not null").select(F.col("old_id").alias("id")).distinct(), "id", "left_anti")
        gone = gone if same is None else gone.join(same.select("org_id", F.col("_id").alias("id")), ["org_id", "id"], "left_anti")
        rows = rows.unionByName(gone.withColumn("status", F.lit("unknown")), allowMissingColumns=True)
    return rows


def refusals(rows: DataFrame, proposed: DataFrame, keep_missing: bool = False, dropped: DataFrame | None = None, broken: DataFrame | None = None, site_errors: DataFrame | None = None) -> DataFrame:
    """org_id, reason: why an approval is refused, so that its organisation stays as it was. A proposal without
    roles, a title to drop that isn't proposed, an id twice, a record that breaks a rule (broken: org_id,
    message), an error of the site's build (site_errors: org_id, error)."""
    found = [rows.groupBy("org_id", "id").count().where("count > 1").select("org_id", F.lit("two roles would share an id").alias("reason"))]
    if dropped is not None:
        titles = proposed.select("org_id", F.lower("title").alias("_t")).distinct()
        found.append(dropped.withColumn("_t", F.lower("title")).join(titles, ["org_id", "_t"], "left_anti").select("org_id", F.concat(F.lit("no proposed role has the title "), F.col("title"))))
    found += [df.select("org_id", F.col(c)) for df, c in ((broken, "message"), (site_errors, "error")) if df is not None]
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out.distinct()


def without_roles(orgs: DataFrame, proposed: DataFrame) -> DataFrame:
    """org_id, reason of organisations whose proposal is empty: approving would delete all they have."""
    return orgs.select("org_id").distinct().join(proposed.select("org_id").distinct(), "org_id", "left_anti").withColumn("reason", F.lit("the proposal has no roles"))


def published(old: DataFrame, rows: DataFrame, refused: DataFrame) -> DataFrame:
    """The listing after approvals: the approved rows of organisations that weren't refused, the old rows of
    all others (so a refused approval rolls back as a whole)."""
    bad = refused.select("org_id").distinct()
    good = rows.join(bad, "org_id", "left_anti")
    decided = good.select("org_id").distinct()
    return good.unionByName(old.join(decided, "org_id", "left_anti"), allowMissingColumns=True)


def baseline_moved(checks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Check states (org_id, content_hash, last_success, failures) after decisions (org_id, decision, fetched_hash,
    checked_at): both kinds make the read version the baseline; an approval is a success as well."""
    both = checks.join(decisions, "org_id", "left")
    yes = F.coalesce(F.col("decision") == "approved", F.lit(False))
    return both.select("org_id", F.coalesce("fetched_hash", "content_hash").alias("content_hash"), F.when(yes, F.col("checked_at")).otherwise(F.col("last_success")).alias("last_success"), F.when(yes, 0).otherwise(F.col("failures")).alias("failures"))


def recounted(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of counts of a run's report (org_id, outcome, route) once decisions (org_id, decision) have
    changed the outcomes that waited for a person."""
    both = results.join(decisions.select("org_id", "decision"), "org_id", "left")
    now = F.when((F.col("outcome") == "review_required") & F.col("decision").isNotNull(), F.col("decision")).otherwise(F.col("outcome"))
    return run_counts(both.withColumn("outcome", now))


def run_counts(results: DataFrame) -> DataFrame:
    """One row: what a run's report counts of its results (org_id, outcome, route)."""
    o = F.col("outcome")
    n = lambda *names: F.count_if(o.isin(*names))
    return results.agg(
        F.count("*").alias("checked"),
        n("confirmed").alias("confirmed_count"),
        n("published").alias("published_count"),
        n("unchanged").alias("unchanged_count"),
        n("source_refused").alias("refused_count"),
        n("ai_deferred").alias("deferred_count"),
        n("review_required").alias("human_review_count"),
        n("source_failed").alias("source_failed_count"),
        n(*AI_FAILED).alias("ai_failed_count"),
        n("source_failed", *AI_FAILED).alias("failed_count"),
        F.count_if((F.coalesce("route", F.lit("review")) == "review") & o.isin(*UNRESOLVED)).alias("needs_review"),
    )


def summary_accepted(summary: Column, description: Column, repeats: Callable[[Column, Column], Column], least: int = 40) -> Column:
    """A summary, or null: of a description of ``least`` characters or more, of which it repeats no run of words
    (``repeats``: the shared run, or null)."""
    return F.when((F.length(description) >= least) & repeats(summary, description).isNull(), summary)
