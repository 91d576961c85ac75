"""Queries over proposals, decisions, boards, evidence and runs.

Orders stand for roles and customers for organisations; a proposal is what a new reading would make of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import evidence, place, values, web
from lodestar.functions import text as T
from lodestar.operators import boards, changes, health, review, runs
from lodestar.plans.tables import read
from lodestar.sources import documents

_COMMITMENT = "case o_orderpriority when '1-URGENT' then 'one_off' when '2-HIGH' then 'weekly' when '3-MEDIUM' then 'monthly' else 'flexible' end"


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("org_id"),
        F.expr("concat('r', o_orderkey)").alias("id"),
        F.expr("concat('Role ', o_orderkey)").alias("title"),
        F.expr(_COMMITMENT).alias("commitment"),
        F.expr("case o_orderstatus when 'F' then 'open' else 'closed' end").alias("status"),
        F.expr("array(o_orderpriority)").alias("skills"),
        F.expr("case when o_orderkey % 3 > 0 then concat('N', o_orderkey % 9) end").alias("postcode_district"),
        F.lit("in_person").alias("location_type"),
        F.expr("case when o_orderkey % 2 = 0 then concat('at ', o_orderkey % 9) end").alias("coords"),
        F.expr("case when o_orderkey % 4 = 0 then array('north') end").alias("role_zones"),
    )


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without every sixth role; some fields blank, some roles elsewhere, some under other titles and ids."""
    return _current(spark, sf_dir).where("k % 6 <> 0").select(
        "k",
        "org_id",
        F.expr("case when k % 13 = 0 then concat('n', k) else id end").alias("id"),
        F.expr("case when k % 13 = 0 then concat('New ', k) else title end").alias("title"),
        F.expr("case k % 5 when 0 then null when 1 then 'unknown' when 2 then 'weekly' else commitment end").alias("commitment"),
        F.expr("case when k % 10 = 9 then 'oversubscribed' else status end").alias("status"),
        F.expr("case when k % 4 = 0 then array() else array('new') end").cast("array<string>").alias("skills"),
        F.lit(None).cast("string").alias("postcode_district"),
        F.expr("case when k % 7 = 0 then 'hybrid' else location_type end").alias("location_type"),
        F.lit(None).cast("string").alias("coords"),
    )


def _lists(df: DataFrame) -> DataFrame:
    return df.withColumn("skills", F.array_join("skills", ","))


def approve_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What approvals publish: some titles dropped, some renamed, blanks filled, missing roles kept."""
    old, new = _current(spark, sf_dir).drop("k", "role_zones"), _proposed(spark, sf_dir)
    dropped = new.where("k % 11 = 0").select("org_id", F.upper("title").alias("title"))
    renamed = new.where("k % 13 = 0").select("org_id", "title", F.expr("concat('role ', k)").alias("old_title"))
    pairs = new.where("k % 13 <> 0").select(F.col("id").alias("old_id"))
    out = review.approved(old, new.drop("k"), dropped, renamed, pairs, keep_missing=True)
    return _lists(out.withColumn("reviewed", F.coalesce("reviewed", F.lit(False))))


def publish_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing after approvals of which some are refused as a whole, and roll back."""
    old, new = _current(spark, sf_dir).drop("k", "role_zones"), _proposed(spark, sf_dir)
    rows = review.approved(old, new.drop("k"))
    errors = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("org_id"), F.lit("owes").alias("error"))
    twice = rows.union(rows.where("org_id % 10 = 3"))
    refused = review.refusals(twice, new, site_errors=errors)
    out = review.published(old, rows, refused)
    return out.groupBy("org_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("reviewed", F.lit(False))).alias("reviewed"))


def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New readings with the ids, zones and coordinates that their partners keep."""
    old, new = _current(spark, sf_dir).drop("k"), _proposed(spark, sf_dir)
    pairs = new.where("k % 3 <> 1").select(F.expr("concat('r', k)").alias("old_id"), F.col("id").alias("new_id"))
    # postcodes as published for every other role, so coordinates can stay
    fresh = new.withColumn("postcode_district", F.expr("case when k % 2 = 0 and k % 3 > 0 then concat('N', k % 9) end"))
    out = review.merged(old, fresh, pairs)
    return out.select("k", "id", "coords", F.array_join("role_zones", ",").alias("zones"))


def beside_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current roles and, beside them, only what a newer reading adds, by organisation."""
    old, new = _current(spark, sf_dir).select("org_id", "id"), _proposed(spark, sf_dir)
    out = review.beside_current(old, new.select("org_id", "id"), new.where("k % 13 <> 0").select(F.col("id").alias("new_id")))
    return out.groupBy("org_id").agg(F.count("*").alias("n"), F.count_if(F.col("id").startswith("n")).alias("added"))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisive facts on which a fresh reading states something else."""
    new = _proposed(spark, sf_dir).select("k", F.expr("case when k % 10 = 4 then 'unknown' else status end").alias("n_status"), F.col("commitment").alias("n_commitment"), F.expr("case when k % 8 = 0 then 'either' when k % 8 = 1 then null else 'individual' end").alias("n_who"))
    both = _current(spark, sf_dir).join(new, "k").withColumn("who", F.lit("individual"))
    c = F.col
    return review.disagreements(both, {"status": (c("status"), c("n_status")), "commitment": (c("commitment"), c("n_commitment")), "who_can_apply": (c("who"), c("n_who"))}, "k")


def publish_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of organisations' updates once the build's errors are known."""
    customers = read(spark, sf_dir, "customer")
    routes = customers.select(F.col("c_custkey").alias("org_id"), F.expr("case when c_custkey % 3 = 0 then 'review' else 'auto' end").alias("route"), F.expr("case when c_custkey % 3 = 0 then array('status') else array() end").cast("array<string>").alias("reasons"))
    errors = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("org_id"), F.explode(F.array(F.lit("owes"), F.lit("late"))).alias("error"))
    return review.checked_route(routes, errors).select("org_id", "route", F.array_join("reasons", "; ").alias("reasons"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "array('confirmed', 'published', 'unchanged', 'source_refused', 'ai_deferred', 'review_required', 'source_failed', 'ai_unavailable', 'extraction_failed', 'invalid_extraction', 'board_failed')"
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), F.expr(f"element_at({names}, cast(c_custkey % 11 as int) + 1)").alias("outcome"), F.expr("case c_custkey % 4 when 0 then 'auto' when 1 then 'review' end").alias("route"))


def recount_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's counts once some of what waited was decided."""
    decisions = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("org_id"), F.lit("approved").alias("decision"))
    return review.recounted(_results(spark, sf_dir), decisions)


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's report: its counts and how many results it lists."""
    return health.run_report(_results(spark, sf_dir), ["outcome", "route"]).withColumn("listed", F.size("results")).drop("results")


def stale_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why proposals can't be decided any more, counted."""
    df = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("baseline"), F.expr("case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then '' else 'O' end").alias("proposed"), F.expr("case when o_orderkey % 7 > 0 then o_orderdate end").alias("last"), F.expr("timestamp_ntz '1995-06-01 00:00:00'").alias("at"))
    return df.groupBy(review.stale_reason(F.col("baseline"), F.col("proposed"), F.col("last").cast("date"), F.col("at").cast("date")).alias("reason")).agg(F.count("*").alias("n"))


def baseline_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check states after decisions of both kinds."""
    c = read(spark, sf_dir, "customer")
    checks = c.select(F.col("c_custkey").alias("org_id"), F.col("c_mktsegment").alias("content_hash"), F.col("c_nationkey").alias("last_success"), (F.col("c_custkey") % 3).alias("failures"))
    decisions = c.where("c_custkey % 5 < 2").select(F.col("c_custkey").alias("org_id"), F.expr("case when c_custkey % 5 = 0 then 'approved' else 'rejected' end").alias("decision"), F.col("c_name").alias("fetched_hash"), (F.col("c_nationkey") + 100).alias("checked_at"))
    return review.baseline_moved(checks, decisions)


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("org_id"),
        k.alias("id"),
        F.concat_ws(" ", "p_name", F.expr("element_at(array('Shop helper', 'Cook', 'Driver', 'Dreamer', 'Event steward'), cast(p_partkey % 5 as int) + 1)")).alias("title"),
        F.expr("concat('https://b.example/', p_partkey)").alias("url"),
        F.expr("case p_partkey % 4 when 0 then array('South London') when 1 then array('Leeds', 'York') when 2 then array('Hackney & Camden') else array() end").cast("array<string>").alias("places"),
        F.expr("case when p_partkey % 3 = 0 then 'Hall' end").alias("venue"),
        F.expr("case when p_partkey % 8 = 3 then '1 Road, SE1 4AB' when p_partkey % 8 = 7 then 'LS1 2AB' end").alias("address"),
        F.expr("element_at(array('Every Monday', 'One shift', 'two days a month', '', 'Saturdays, each week'), cast(p_partkey % 5 as int) + 1)").alias("timing"),
        F.expr("element_at(array('Enhanced DBS', 'None', 'Basic check', 'DBS', 'other'), cast(p_partkey % 5 as int) + 1)").alias("disclosure"),
        F.expr("case p_partkey % 3 when 0 then 'Yes' when 1 then 'No' end").alias("interview"),
        F.expr("case when p_partkey % 2 = 0 then 'adults' end").alias("age_limit"),
        F.expr("cast(p_partkey % 100 as int)").alias("minimum_age"),
        F.expr("case when p_partkey % 6 = 0 then '2027-01-31' end").alias("closes"),
        (k % 2 == 0).alias("christmas"),
        F.expr("case when p_partkey % 5 = 0 then array('Food', 'Care') else array() end").cast("array<string>").alias("kinds"),
        F.expr("case when p_partkey % 7 = 0 then 'Night team' end").alias("team"),
        (k % 9 == 0).alias("virtual"),
        F.split("p_type", " ").alias("skills"),
        F.expr("case when p_partkey % 10 = 0 then 'Own words of a person.' end").alias("summary"),
    )


def board_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a board's offers."""
    out = boards.records(_offers(spark, sf_dir), ["Camden", "Hackney", "Brent"])
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("id", "title", "what_youd_do", "commitment", text("when"), "specific_times", "activity", "location_type", text("stated_places"), "dbs", "interview", "min_age", text("eligibility"), F.col("season.start_month").alias("season"), text("verified"), text("unsupported"))


def board_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two kinds of boards that the public may apply for, counted."""
    k = F.col("p_partkey")
    yes = lambda x: F.when(x, "Yes").otherwise("No")
    items = read(spark, sf_dir, "part").select((k % 10 == 0).alias("archived"), F.when(k % 7 == 0, "2026-01-01").alias("deleted_at"), yes(k % 2 == 0).alias("public"), yes(k % 3 > 0).alias("publish"), F.when(k % 11 > 0, yes(k % 5 > 0)).alias("can_self_apply"))
    adverts = read(spark, sf_dir, "part").select(F.when(k % 2 == 0, "Published").otherwise("Draft").alias("status"), F.when(k % 3 == 0, k % 6 == 0).alias("unlisted"), F.when(k % 5 > 0, "public").alias("advert_target"), F.expr("case p_partkey % 4 when 0 then 'volunteer' when 1 then 'trustee' when 2 then 'staff' end").alias("kind"))
    return boards.public_items(items).agg(F.count("*").alias("n")).withColumn("board", F.lit("items")).unionByName(boards.public_adverts(adverts).agg(F.count("*").alias("n")).withColumn("board", F.lit("adverts")))


def evidence_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and statuses after a manual check: kept, backed by a quotation, or forced."""
    df = read(spark, sf_dir, "orders").select(
        F.expr("element_at(array('none', 'basic', 'enhanced', 'required_unspecified', 'unknown'), cast(o_orderkey % 5 as int) + 1)").alias("dbs"),
        F.expr("element_at(array('No check at all', 'a DBS form', 'enhanced disclosure', 'nothing', '', 'police'), cast(o_orderkey % 6 as int) + 1)").alias("quote"),
        F.expr("case when o_orderkey % 7 = 0 then 'ftp://x' else 'https://x' end").alias("url"),
        F.expr("case when o_orderkey % 4 = 0 then 'none' end").alias("before"),
    )
    out = df.select(evidence.settled("screening.dbs", F.col("dbs"), F.col("quote"), F.col("url"), F.col("before")).alias("s"))
    return out.groupBy(F.col("s.value").alias("value"), F.col("s.verified").alias("verified"), F.col("s.cleared").alias("cleared")).agg(F.count("*").alias("n"))


def quote_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether quotations back numbers, seasons, checks and titles, counted."""
    df = read(spark, sf_dir, "part").select((F.col("p_size")).alias("n"), F.concat_ws(" ", "p_name", F.lit("over"), (F.col("p_size") + F.col("p_partkey") % 2 * 100).cast("string"), F.expr("element_at(array('from Nov to April', 'May only', 'a DBS check'), cast(p_partkey % 3 as int) + 1)")).alias("quote"), F.concat(F.col("p_type"), F.lit(" "), F.substring_index("p_name", " ", -1)).alias("title"))
    q = F.col("quote")
    return df.groupBy(T.quote_backs_number(q, F.col("n")).alias("number"), T.quote_backs_season(q, F.lit(11), F.lit(4)).alias("season"), T.quote_backs_check(q, F.lit("none")).alias("check"), T.quote_backs_words(q, F.col("title")).alias("words")).agg(F.count("*").alias("n"))


def ai_broken_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by whether the model integration failed in them, and their level."""
    k, c = F.col("c_custkey"), F.col
    found = F.expr("case c_custkey % 4 when 0 then array(named_struct('reason', 'quota', 'message', 'x')) when 1 then array(named_struct('reason', 'budget_exhausted', 'message', 'daily AI allowance exhausted')) when 2 then array(named_struct('reason', 'budget_exhausted', 'message', 'push failed')) else array(named_struct('reason', 'malformed', 'message', cast(null as string))) end")
    df = read(spark, sf_dir, "customer").select((k % 13 == 0).alias("dry"), (k % 3 > 0).alias("configured"), F.when(k % 5 > 1, k % 5).otherwise(0).alias("calls"), F.when(k % 5 == 4, 1).otherwise(0).alias("successes"), (k % 2).alias("unavailable"), (k % 7 % 2).alias("deferred"), found.alias("diagnostics"), F.when(k % 17 == 0, "failure").otherwise("success").alias("job"), F.when(k % 6 > 0, (k % 70)).alias("median"), (k % 2).alias("waiting"))
    df = df.withColumn("broken", health.ai_broken(c("dry"), c("configured"), c("calls"), c("successes"), c("unavailable"), c("deferred"), c("diagnostics")))
    out = health.assessed(df, c("job"), c("broken"), c("median"), c("median") >= 60, {"waiting": c("waiting")})
    return out.groupBy("broken", "level", F.array_join("sections", ",").alias("sections")).agg(F.count("*").alias("n"))


def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of customers as one JSON document, its summary made from the same rows."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), F.expr("case when c_custkey % 4 > 0 then cast(c_custkey % 40 as int) end").alias("age"), F.expr("case c_custkey % 9 when 0 then 'dead' when 1 then null else 'ok' end").alias("link"))
    rows = rows.withColumn("state", values.freshness(F.col("age")))
    rows = rows.withColumn("hidden", values.suppressed(F.col("state"), F.col("link")))
    return health.freshness_report(rows, runs.freshness_summary(rows, "age", "hidden").drop("rows"))


def summaries_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of benchmark items that don't repeat them: some are cut out of the item, some have their words turned round."""
    words = F.split("text", r"\s+")
    df = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, F.substring("text", 1, 30)).otherwise(F.col("text")).alias("text"), F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 150)).otherwise(F.array_join(F.reverse(words), " ")).alias("summary"))
    df = df.withColumns({"a": T.words(F.col("summary")), "b": T.words(F.col("text"))})
    ok = review.summary_accepted(F.col("summary"), F.col("text"), lambda s, d: T.longest_free_run(F.col("a"), F.col("b")))
    return df.select("item_id", ok.isNotNull().alias("accepted"))


def place_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two places of each document that stand if its text names both: a word of it, and one of the benchmark item that its
    number leads to."""
    count = read(spark, sf_dir, "benchmark").agg(F.count("*").alias("items"))
    item = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("of"), F.get(F.split(T.squeezed(F.col("text")), " "), F.lit(1)).alias("word"))
    docs = read(spark, sf_dir, "documents").crossJoin(F.broadcast(count)).withColumn("of", F.col("doc_id") % F.col("items")).join(item, "of")
    places = F.array(F.concat(F.lit(" "), F.get(F.split(T.squeezed(F.col("text")), " "), F.lit(4)), F.lit("  ")), F.col("word"))
    df = docs.select("doc_id", "text", places.alias("places"))
    found = F.transform("places", lambda p: T.place_key(F.col("text")).contains(T.place_key(p)) & (T.place_key(p) != ""))
    return df.select("doc_id", F.array_join(place.stated_places(F.col("places"), found), ",").alias("places"))


def newest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the reports of three event types (the last time, how many), the newest; one of them has no time."""
    one = lambda kind, stamp: read(spark, sf_dir, "events").where(F.col("event_type") == kind).agg(F.lit(kind).alias("kind"), stamp.alias("generated_at"), F.count("*").alias("n"))
    last = F.max("ts")
    return documents.newest_version([one("click", last), one("view", F.lit(None).cast("timestamp_ntz")), one("error", last)]).select("kind", "n")


def findings_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all findings on a supplier, that of the first file, then the first place: files are return flags, places order keys."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("org_id"), F.concat("l_returnflag", F.lit(".json")).alias("_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_pos"))
    return documents.first_findings(rows).select("org_id", F.col("_file").alias("file"), F.col("_pos").alias("pos"))


def seed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as a seed, without those that nations' regions hold already by slug or by name, and without some left out."""
    parts = [tuple(r) for r in read(spark, sf_dir, "region").select(F.lower("r_name"), "r_name").collect()]
    seed = [*parts, ("new-one", "New One"), ("left-out", "Left Out"), ("other-slug", "ASIA"), ("asia", "Other name")]
    known = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey < 3").select(F.lower("r_name").alias("slug"), F.initcap("r_name").alias("name"))
    return documents.seeded(spark, seed, ["slug", "name"], known, ["Left Out"])


def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of content by its first bytes, of pages that such bytes are put before."""
    first = F.expr("case page_id % 7 when 0 then unhex('89504E470D0A1A0A') when 1 then unhex('FFD8FF') when 2 then concat(unhex('52494646'), unhex('00000000'), cast('WEBP' as binary)) when 3 then cast('<svg ' as binary) when 4 then cast('  <?xml version=\"1.0\"?><svg>' as binary) when 5 then unhex('FFD8') else cast('' as binary) end")
    df = read(spark, sf_dir, "pages").select("page_id", F.concat(first, F.col("html").cast("binary")).alias("content"))
    return df.select("page_id", web.image_kind(F.col("content")).alias("kind"))


def pages_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each site that are read again: those that its roles link to, without the landing page, documents and repeats."""
    url = F.col("url")
    links = F.array(F.concat(url, F.lit("#part")), url, F.concat(url, F.lit("/")), F.concat(url, F.lit("/Guide.PDF")), F.when(F.col("page_id") % 2 == 0, F.lit("https://other.org/a/#x")), F.lit("mailto:a@b.org"), F.lit("https://land.org/"))
    landing = F.when(F.col("page_id") % 3 == 0, url).otherwise(F.lit("https://land.org"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(web.known_pages(links, landing), " ").alias("again"))


def notes_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of orders after a new reading: old ones that name the link's domain stay where the domain did."""
    k = F.col("o_orderkey")
    old = F.array(F.lit("apply on a.org"), F.concat(F.lit("see "), F.col("o_orderpriority")), F.lit("fee at a.org"))
    new = F.when(k % 3 == 0, F.array(F.lit("apply on a.org"), F.lit("new"))).otherwise(F.array(F.lit("new")))
    domain = F.when(k % 4 == 0, F.lit("b.org")).otherwise(F.lit("a.org"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(changes.carried_notes(old, new, F.lit("a.org"), domain), "; ").alias("notes"))


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons joined and cut, minutes of seconds, and dates for people, of every order."""
    k = F.col("o_orderkey")
    reasons = F.array(F.col("o_orderpriority"), F.lit("late"), F.col("o_orderpriority"), F.when(k % 2 == 0, F.lit("a reason that needs some room")).otherwise(F.lit("late")))
    return read(spark, sf_dir, "orders").select("o_orderkey", values.joined_reasons(reasons, 30).alias("reasons"), values.minutes(k % 600).alias("minutes"), values.human_date(F.col("o_orderdate")).alias("day"))


def usable_for_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that can be reached: with coordinates, in person or hybrid."""
    df = _current(spark, sf_dir).withColumn("location_type", F.expr("element_at(array('in_person', 'hybrid', 'remote', 'own_home'), cast(k % 4 as int) + 1)"))
    return place.usable_for_reach(df).groupBy("location_type").agg(F.count("*").alias("n"))


def load_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations with roles in the city, and their roles' statuses as of a day."""
    k = F.col("k")
    roles = _current(spark, sf_dir).select("org_id", F.when(k % 2 == 0, "seasonal_closed").otherwise(F.col("status")).alias("status"), (k % 5 > 0).alias("in_city"), F.when(k % 3 == 0, 11).alias("start_month"), F.when(k % 3 == 0, 4).alias("end_month"))
    kept, orgs = documents.load(roles, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), "c_mktsegment"), F.to_date(F.lit("2026-12-01")))
    return kept.join(orgs, "org_id").groupBy("c_mktsegment", "status").agg(F.count("*").alias("n"))


def load_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that are in the city by the places that they state, with their status as of a day and the freshness of their
    organisation's last check."""
    k, name = F.col("o_orderkey"), lambda i: F.concat(F.lit("nation_"), (i % 40).cast("string"))
    orders = read(spark, sf_dir, "orders")
    roles = orders.select(
        k.alias("id"), F.col("o_custkey").alias("org_id"), F.when(k % 2 == 0, "seasonal_closed").otherwise("open").alias("status"), F.when(k % 13 == 0, "remote").otherwise("in_person").alias("location_type"),
        F.when(k % 3 == 0, F.array(name(k), F.lit("Elsewhere"))).when(k % 3 == 1, F.array(F.when(k % 2 == 0, F.lit(" the City ")).otherwise(F.lit("Elsewhere")))).alias("stated_places"),
        F.when(k % 5 < 3, (k % 12 + 1).cast("int")).alias("start_month"), F.when(k % 5 < 3, (k % 7 + 1).cast("int")).alias("end_month"),
    )
    gazetteer = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("borough")).unionByName(spark.range(1).select(F.lit("City").alias("name"), F.lit(None).cast("string").alias("borough")))
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("last_success"))
    orgs = last.select(F.col("o_custkey").alias("org_id"), F.when(F.col("o_custkey") % 10 > 0, F.col("last_success")).alias("last_success"), F.when(F.col("o_custkey") % 8 == 0, "dead").otherwise("ok").alias("link_status"))
    kept, shown = documents.catalogue(roles, orgs, gazetteer, F.to_date(F.lit("2001-08-06")), F.expr("timestamp '2001-08-06 12:00:00'"))
    return kept.join(shown, "org_id").select("id", "status", "age", "state", "hidden")


def role_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a conversation's turns belong to a role: the first, the one it links to, those that name it."""
    turn = F.struct("turn", F.concat(F.lit("https://c/"), F.col("turn").cast("string"), F.lit("/")).alias("url"), "text")
    df = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("s"))
    own = T.role_text(F.col("s"), F.when(F.col("conv_id") % 2 == 0, "https://c/1#x"), F.lit("the"))
    return df.select("conv_id", F.size(own).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        approve_roles, publish_roles, merge_fields, beside_current, contradictions, publish_check, recount_run, run_report, stale_proposals, baseline_moves, board_records, board_public,
        evidence_settled, quote_backs, ai_broken_runs, freshness_report, summaries_accepted, place_evidence, newest_report, findings_first, seed_list, image_kinds, pages_again, notes_carried, display_values, usable_for_reach, load_listing, load_catalogue, role_sections,
    )
}

_CUR = f"""cur as (select o_orderkey k, o_custkey org_id, 'r' || o_orderkey id, 'Role ' || o_orderkey title, {_COMMITMENT} commitment, case o_orderstatus when 'F' then 'open' else 'closed' end status, o_orderpriority skills, case when o_orderkey % 3 > 0 then 'N' || o_orderkey % 9 end postcode_district, 'in_person' location_type, case when o_orderkey % 2 = 0 then 'at ' || o_orderkey % 9 end coords from orders),
pro as (select k, org_id, commitment old_c, case k % 5 when 0 then null when 1 then 'unknown' when 2 then 'weekly' else commitment end new_c, case when k % 10 = 9 then 'oversubscribed' else status end status, skills, case when k % 7 = 0 then 'hybrid' else 'in_person' end location_type, postcode_district pd, coords from cur where k % 6 <> 0)"""
_RESULTS = "r as (select c_custkey org_id, (['confirmed', 'published', 'unchanged', 'source_refused', 'ai_deferred', 'review_required', 'source_failed', 'ai_unavailable', 'extraction_failed', 'invalid_extraction', 'board_failed'])[c_custkey % 11 + 1] o0, case c_custkey % 4 when 0 then 'auto' when 1 then 'review' end route from customer)"
_COUNTS = "count(*) checked, count(*) filter (o = 'confirmed') confirmed_count, count(*) filter (o = 'published') published_count, count(*) filter (o = 'unchanged') unchanged_count, count(*) filter (o = 'source_refused') refused_count, count(*) filter (o = 'ai_deferred') deferred_count, count(*) filter (o = 'review_required') human_review_count, count(*) filter (o = 'source_failed') source_failed_count, count(*) filter (o in ('ai_unavailable', 'extraction_failed', 'invalid_extraction')) ai_failed_count, count(*) filter (o in ('source_failed', 'ai_unavailable', 'extraction_failed', 'invalid_extraction')) failed_count, count(*) filter (coalesce(route, 'review') = 'review' and o in ('review_required', 'source_failed', 'ai_unavailable', 'extraction_failed', 'invalid_extraction')) needs_review"

ORACLE = {
    "approve_roles": f"""with {_CUR} select org_id, 'r' || k id, case when k % 13 = 0 then 'New ' || k else 'Role ' || k end title, case when new_c is null or new_c = 'unknown' then old_c else new_c end commitment, status,
 case when k % 4 = 0 then skills else 'new' end skills, case when location_type = 'in_person' then pd end postcode_district, location_type, case when location_type = 'in_person' and pd is not null then coords end coords, true reviewed from pro where k % 11 <> 0
 union all select org_id, id, title, commitment, 'unknown', skills, postcode_district, location_type, coords, false from cur where k % 6 = 0""",
    "publish_roles": f"""with {_CUR}, bad as (select c_custkey org_id from customer where c_acctbal < 0 union select org_id from pro where org_id % 10 = 3), good as (select org_id from pro where org_id not in (select org_id from bad) group by 1)
 select org_id, count(*) n, count(*) reviewed from pro join good using (org_id) group by 1 union all select org_id, count(*), 0 from cur where org_id not in (select org_id from good) group by 1""",
    "merge_fields": f"with {_CUR} select k, case when k % 3 <> 1 then 'r' || k when k % 13 = 0 then 'n' || k else 'r' || k end id, case when k % 3 <> 1 and k % 7 <> 0 and (k % 3 = 0 or k % 2 = 0) then coords end coords, case when k % 3 <> 1 and k % 4 = 0 then 'north' end zones from pro",
    "beside_current": f"with {_CUR} select org_id, count(*) n, count(*) filter (a) added from (select org_id, false a from cur union all select org_id, true from pro where k % 13 = 0) group by 1",
    "contradictions": f"with {_CUR}, b as (select p.k, c.status s, case when p.k % 10 = 4 then 'unknown' else p.status end n from pro p join cur c using (k)) select k, 'status' field from b where n <> 'unknown' and n <> s union all select k, 'who_can_apply' from pro where k % 8 = 0",
    "publish_check": "select c_custkey org_id, case when c_custkey % 3 = 0 or c_acctbal < 0 then 'review' else 'auto' end route, case when c_custkey % 3 = 0 then 'status' when c_acctbal < 0 then 'the build would refuse this: late; owes' else '' end reasons from customer",
    "recount_run": f"with {_RESULTS}, q as (select *, case when o0 = 'review_required' and org_id % 2 = 0 then 'approved' else o0 end o from r) select {_COUNTS} from q",
    "run_report": f"with {_RESULTS}, q as (select *, o0 o from r) select {_COUNTS}, count(*) listed from q",
    "stale_proposals": "select case when o_orderkey % 5 > 1 and o_orderstatus = 'O' then 'decided' when o_orderkey % 7 > 0 and cast(o_orderdate as date) > date '1995-06-01' then 'overtaken' end reason, count(*) n from orders group by 1",
    "baseline_moves": "select c_custkey org_id, case when c_custkey % 5 < 2 then c_name else c_mktsegment end content_hash, case when c_custkey % 5 = 0 then c_nationkey + 100 else c_nationkey end last_success, case when c_custkey % 5 = 0 then 0 else c_custkey % 3 end failures from customer",
    "board_records": """with o as (select *, p_partkey k, p_name || ' ' || (['Shop helper', 'Cook', 'Driver', 'Dreamer', 'Event steward'])[p_partkey % 5 + 1] t, (['Every Monday', 'One shift', 'two days a month', '', 'Saturdays, each week'])[p_partkey % 5 + 1] timing, t || case when k % 3 = 0 then ' at Hall' else '' end || case when k % 7 = 0 then ' (Night team)' else '' end || '.' || case when k % 5 = 0 then ' Work areas: food, care.' else '' end d from part)
 select p_brand || '-board-' || k id, t title, case when k % 10 = 0 then 'Own words of a person.' else d || case when length(d) < 15 then ' A volunteer role on the charity''s own volunteering board.' else '' end end what_youd_do,
 case k % 5 when 0 then 'weekly' when 1 then case when k % 2 = 0 then 'one_off' else 'unknown' end when 2 then 'monthly' when 3 then 'unknown' else 'weekly' end commitment, case k % 5 when 0 then 'weekday_daytime' when 4 then 'weekend_daytime' else 'flexible' end "when", nullif(timing, '') specific_times,
 (['shop_warehouse', 'cooking_serving', 'practical', 'varies', 'fundraising'])[k % 5 + 1] activity, case when k % 9 = 0 then 'remote' else 'in_person' end location_type,
 case k % 4 when 0 then 'London' when 1 then 'Leeds' when 2 then 'Camden,Hackney' else case when k % 8 = 3 then 'London' else '' end end stated_places, (['enhanced', 'none', 'basic', 'required_unspecified', 'unknown'])[k % 5 + 1] dbs,
 case k % 3 when 0 then true when 1 then false end interview, case when k % 100 between 13 and 80 then k % 100 end min_age, case when k % 2 = 0 then 'adults' else '' end eligibility, case when k % 2 = 0 then 12 end season,
 'title,stated_places,status,screening.dbs' || case when k % 3 < 2 then ',screening.interview' else '' end || case when k % 5 <> 3 then ',specific_times' else '' end verified,
 case when k % 10 = 0 then 'what_youd_do: model summary of the board''s description' else 'what_youd_do: built from structured fields' end || case when k % 6 = 0 then ',closes 2027-01-31' else '' end unsupported from o""",
    "board_public": "select 'items' board, count(*) n from part where p_partkey % 10 <> 0 and p_partkey % 7 <> 0 and p_partkey % 2 = 0 and p_partkey % 3 > 0 and p_partkey % 11 > 0 and p_partkey % 5 > 0 union all select 'adverts', count(*) from part where p_partkey % 2 = 0 and p_partkey % 6 <> 0 and p_partkey % 5 > 0 and p_partkey % 4 in (0, 3)",
    "evidence_settled": """with d as (select (['none', 'basic', 'enhanced', 'required_unspecified', 'unknown'])[o_orderkey % 5 + 1] v, lower((['No check at all', 'a DBS form', 'enhanced disclosure', 'nothing', '', 'police'])[o_orderkey % 6 + 1]) q, o_orderkey % 7 <> 0 web, o_orderkey % 4 = 0 held from orders),
 b as (select *, v <> 'unknown' said, q <> '' and web and regexp_matches(q, case v when 'none' then '\\bno\\b|none|not (?:need|require)|without' when 'basic' then 'basic|dbs|criminal|disclosure' when 'enhanced' then 'enhanced' else 'dbs|disclosure|criminal|police|background|checks?' end) backed from d),
 s as (select *, said and not backed and not (held and v = 'none') cleared from b) select case when cleared then 'unknown' else v end "value", said and backed verified, cleared, count(*) n from s group by all""",
    "quote_backs": """with d as (select p_size, p_partkey k, p_name, lower(p_name || ' over ' || (p_size + p_partkey % 2 * 100) || ' ' || (['from Nov to April', 'May only', 'a DBS check'])[p_partkey % 3 + 1]) q, lower(p_type || ' ' || regexp_extract(p_name, '[^ ]+$')) t from part)
 select k % 2 = 0 "number", k % 3 = 0 season, k % 3 = 2 "check", len(list_filter(regexp_extract_all(t, '[a-z]{4,}'), lambda w: contains(q, w))) > 0 words, count(*) n from d group by all""",
    "ai_broken_runs": """with d as (select c_custkey k, c_custkey % 13 = 0 dry, c_custkey % 3 > 0 conf, case when c_custkey % 5 > 1 then c_custkey % 5 else 0 end calls, c_custkey % 5 = 4 won, c_custkey % 2 un, c_custkey % 7 % 2 de, c_custkey % 4 x, case when c_custkey % 6 > 0 then c_custkey % 70 end med from customer),
 b as (select *, not dry and ((not conf and un > 0) or (conf and calls > 0 and not won and x = 0) or (conf and calls = 0 and de > 0 and x = 2)) broken, k % 17 = 0 stopped from d),
 s as (select *, broken or stopped bad, coalesce(med >= 53, false) stale, un > 0 waits from b)
 select broken, case when bad then 'broken' when stale or waits then 'attention' else 'ok' end as level, array_to_string(list_filter([case when bad then 'broken' end, case when stale then 'freshness' end, case when waits then 'waiting' end], lambda z: z is not null), ',') sections, count(*) n from s group by all""",
    "freshness_report": """with r as (select c_custkey k, case when c_custkey % 4 > 0 then c_custkey % 40 end age, case c_custkey % 9 when 0 then 'dead' when 1 then null else 'ok' end link from customer),
s as (select *, case when age is null then 'never_checked' when age >= 21 then 'stale' else 'fresh' end state from r), h as (select *, state <> 'fresh' or coalesce(link = 'dead', false) hidden from s),
m as (select list_sort(list(age) filter (age is not null)) a, max(age) oldest, count(*) filter (hidden) n from h),
o as (select string_agg('"' || k || '":{' || coalesce('"days_since_check":' || age || ',', '') || '"state":"' || state || '",' || coalesce('"link_status":"' || link || '",', '') || '"suppress_assertive":' || hidden || '}', ',' order by cast(k as varchar)) j from h)
select '{"median_days_since_check":' || a[len(a) // 2 + 1] || ',"oldest_days":' || oldest || ',"suppressed":' || n || ',"site_banner":' || (a[len(a) // 2 + 1] >= 60) || ',"thresholds":{"suppress_assertive_after_days":21,"site_banner_after_days":60},"orgs":{' || j || '}}' report from m, o""",
    "summaries_accepted": """with b as (select item_id, case when item_id % 4 = 0 then substr(text, 1, 30) else text end t, case when item_id % 2 = 0 then substr(text, 1, 150) else array_to_string(list_reverse(regexp_split_to_array(text, '\\s+')), ' ') end s from benchmark),
 w as (select *, regexp_extract_all(lower(s), '[a-z0-9'']+') a, regexp_extract_all(lower(t), '[a-z0-9'']+') c from b)
 select item_id, length(t) >= 40 and (len(a) < 8 or not list_has_any(list_transform(range(1, greatest(len(a) - 6, 1)), lambda i: array_to_string(a[i:i+7], ' ')), list_transform(range(1, greatest(len(c) - 6, 1)), lambda i: array_to_string(c[i:i+7], ' ')))) accepted from w""",
    "place_evidence": r"""with n as (select count(*) c from benchmark), b as (select item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[2] w from benchmark),
d as (select doc_id, text, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[5] v, w from documents, n, b where b.item_id = doc_id % c),
k as (select *, trim(regexp_replace(replace(replace(lower(text), '&', ' and '), '’', chr(39)), '\s+', ' ', 'g'), ' ,.;:') t, trim(regexp_replace(replace(replace(lower(v), '&', ' and '), '’', chr(39)), '\s+', ' ', 'g'), ' ,.;:') a, trim(regexp_replace(replace(replace(lower(w), '&', ' and '), '’', chr(39)), '\s+', ' ', 'g'), ' ,.;:') b from d)
select doc_id, case when a <> '' and b <> '' and contains(t, a) and contains(t, b) then v || ',' || w else '' end places from k""",
    "newest_report": "select event_type kind, count(*) n from events where event_type in ('click', 'error') group by 1 order by max(ts) desc, 1 limit 1",
    "findings_first": "with f as (select l_suppkey org_id, l_returnflag || '.json' f, l_orderkey * 10 + l_linenumber p from lineitem) select org_id, f \"file\", p pos from f qualify row_number() over (partition by org_id order by f, p) = 1",
    "seed_list": "with k as (select lower(r_name) s from region where r_regionkey < 3 and r_regionkey in (select n_regionkey from nation)), z as (select lower(r_name) slug, r_name \"name\" from region union all select unnest(['new-one', 'other-slug', 'asia']), unnest(['New One', 'ASIA', 'Other name'])) select slug, \"name\" from z where slug not in (select s from k) and lower(\"name\") not in (select s from k)",
    "image_kinds": "select page_id, case page_id % 7 when 0 then 'png' when 1 then 'jpg' when 2 then 'webp' when 3 then 'svg' when 4 then 'svg' end kind from pages",
    "pages_again": "with l as (select page_id, rtrim(regexp_replace(url, '#.*$', ''), '/') u, rtrim(url, '/') raw from pages), m as (select page_id, case when page_id % 3 = 0 then raw else 'https://land.org' end land, u, u || '/Guide.PDF' g, contains(raw, '#') frag from l) select page_id, array_to_string(list_filter([case when u <> land then u end, case when page_id % 2 = 0 then 'https://other.org/a' end, case when page_id % 3 = 0 then 'https://land.org' end], lambda x: x is not null), ' ') again from m",
    "notes_carried": "select o_orderkey, array_to_string(list_concat(case when o_orderkey % 3 = 0 then ['apply on a.org', 'new'] else ['new'] end, case when o_orderkey % 4 = 0 then [] when o_orderkey % 3 = 0 then ['fee at a.org'] else ['apply on a.org', 'fee at a.org'] end), '; ') notes from orders",
    "display_values": "with r as (select *, o_orderpriority || '; late' || case when o_orderkey % 2 = 0 then '; a reason that needs some room' else '' end t from orders) select o_orderkey, case when length(t) <= 30 then t else substr(t, 1, 29) || '…' end reasons, cast(round_even(o_orderkey % 600 / 60, 0) as int) \"minutes\", strftime(o_orderdate, '%A, %-d %B %Y') \"day\" from r",
    "usable_for_reach": "select case o_orderkey % 4 when 0 then 'in_person' else 'hybrid' end location_type, count(*) n from orders where o_orderkey % 2 = 0 and o_orderkey % 4 < 2 group by 1",
    "load_listing": "with r as (select o_custkey c, case when o_orderkey % 2 = 0 then case when o_orderkey % 3 = 0 then 'unknown' else 'seasonal_closed' end when o_orderstatus = 'F' then 'open' else 'closed' end status from orders where o_orderkey % 5 > 0) select c_mktsegment, status, count(*) n from r join customer on c = c_custkey group by all",
    "load_catalogue": """with r as (select o_orderkey k, o_custkey c, o_orderkey % 13 = 0 or case o_orderkey % 3 when 0 then o_orderkey % 40 < 25 when 1 then o_orderkey % 2 = 0 else true end city,
 case when o_orderkey % 5 < 3 then o_orderkey % 12 + 1 end s, case when o_orderkey % 5 < 3 then o_orderkey % 7 + 1 end e from orders),
l as (select o_custkey c, case when o_custkey % 10 > 0 then max(o_orderdate) end t from orders group by 1),
a as (select c, greatest(0, date_sub('day', t, timestamp '2001-08-06 12:00:00')) age from l where t is not null union all select c, null from l where t is null),
f as (select c, age, case when age is null then 'never_checked' when age >= 21 then 'stale' else 'fresh' end state from a)
select k id, case when k % 2 = 0 then case when s is not null and case when s <= e then 8 between s and e else 8 >= s or 8 <= e end then 'unknown' else 'seasonal_closed' end else 'open' end status, age, state, state <> 'fresh' or c % 8 = 0 hidden from r join f using (c) where city""",
    "role_sections": "with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn, 'https://c/' || turn || '/', text) i, count(*) over (partition by conv_id) n from conversations), c as (select conv_id, any_value(n) n, count(*) filter (i = 1 or (conv_id % 2 = 0 and turn = 1) or contains(lower(text), 'the')) own from t group by conv_id) select conv_id, case when own > 1 then own else n end n from c",
}
