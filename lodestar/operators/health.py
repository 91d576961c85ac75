"""Reports on runs: their health, whether the model integration works, freshness as a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.values import BANNER_DAYS, FRESH_DAYS, severity
from lodestar.operators.review import run_counts

LEVELS = ["ok", "attention", "broken"]
#: So many days before the banner a report warns.
WARN_DAYS = 7
#: Failures that lie with a provider, not with one page.
PROVIDER_FAILURES = ("auth", "bad_request", "model", "quota", "rate_limited", "timeout", "network", "provider_unavailable", "input_too_large")
USED_UP = "daily AI allowance exhausted"


def ai_broken(dry: Column, configured: Column, calls: Column, successes: Column, unavailable: Column, deferred: Column, diagnostics: Column, failures: tuple[str, ...] = PROVIDER_FAILURES) -> Column:
    """Whether the integration itself fails: it was needed and isn't configured; all requests failed and one for a
    reason of the provider; or none could be sent, for another reason than a used-up daily allowance.
    ``diagnostics`` is an array of struct reason, message; ``unavailable`` and ``deferred`` count outcomes."""
    theirs = F.exists(diagnostics, lambda d: F.coalesce(d["reason"].isin(*failures), F.lit(False)))
    blocked = F.exists(diagnostics, lambda d: F.coalesce(d["reason"] == "budget_exhausted", F.lit(False)) & ~F.coalesce(d["message"].contains(USED_UP), F.lit(False)))
    failed = (~configured & (unavailable > 0)) | (configured & (calls > 0) & (successes == 0) & theirs) | (configured & (calls == 0) & (deferred > 0) & blocked)
    return ~dry & failed


def assessed(report: DataFrame, job: Column, ai: Column, median: Column, banner: Column, counts: dict[str, Column]) -> DataFrame:
    """The report's row with ``level`` and ``sections``: what a person should look at.

    ``counts`` are the numbers of results by section: waiting, boards, platforms, feed_gaps, feeds, dead. A run
    that stopped or whose model integration fails is broken; feeds that couldn't be read are only told.
    """
    n = lambda k: F.coalesce(counts[k], F.lit(0)) > 0 if k in counts else F.lit(False)
    stale = median.isNotNull() & (median >= BANNER_DAYS - WARN_DAYS)
    found = {"broken": ai | (job != "success"), "freshness": F.coalesce(banner, F.lit(False)) | stale, **{k: n(k) for k in ("waiting", "boards", "platforms", "feed_gaps", "dead")}}
    level = severity(LEVELS, *(F.when(v, "broken" if k == "broken" else "attention").otherwise("ok") for k, v in found.items()))
    told = {**found, "feeds": n("feeds")}
    return report.withColumns({"level": level, "sections": F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in told.items())))})


def run_report(results: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the counts of a run, and its results as an array; a run checks few sources."""
    listed = F.array_sort(F.collect_list(F.struct("org_id", *[c for c in columns if c != "org_id"])))
    return run_counts(results).crossJoin(results.agg(listed.alias("results")))


def freshness_report(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """One row ``report``: freshness as JSON, the summary (median_age, oldest, suppressed, banner), its thresholds
    and each source's (org_id, age, state, link, hidden) under its id."""
    each = F.struct(F.col("age").alias("days_since_check"), "state", F.col("link").alias("link_status"), F.col("hidden").alias("suppress_assertive"))
    orgs = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("org_id").cast("string").alias("key"), each.alias("value"))))).alias("orgs"))
    limits = F.struct(F.lit(FRESH_DAYS).alias("suppress_assertive_after_days"), F.lit(BANNER_DAYS).alias("site_banner_after_days"))
    both = summary.crossJoin(orgs)  # one row each
    return both.select(F.to_json(F.struct(F.col("median_age").alias("median_days_since_check"), F.col("oldest").alias("oldest_days"), "suppressed", F.col("banner").alias("site_banner"), limits.alias("thresholds"), "orgs")).alias("report"))
