"""Operators on small cases: pairing, diffs, facets, rules, geometry, sources, sinks, streams."""

import json
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lodestar.functions import place
from lodestar.operators import changes, facets, geometry, matching, pages, ranking, rules, runs
from lodestar.sources import documents, paged, sinks
from lodestar.streaming import checks

ROLE = "id long, ord long, title string, org string, summary string, commitment string, status string, activity string, areas array<string>, zones array<string>, `when` array<string>, location_type string, who_can_apply string, min_term_months int, typical_shift_hours double, confidence double, location_basis string"


def role(i, **over):
    base = {"id": i, "ord": i, "title": f"Role {i}", "org": "Org", "summary": "", "commitment": "weekly", "status": "open", "activity": "advice", "areas": ["Camden"], "zones": ["north"], "when": ["weekend_daytime"], "location_type": "in_person", "who_can_apply": "individual", "min_term_months": None, "typical_shift_hours": 2.0, "confidence": 0.9, "location_basis": "role_areas"}
    return tuple({**base, **over}.values())


@pytest.fixture(scope="module")
def roles(spark):
    return spark.createDataFrame(
        [
            role(1),
            role(2, commitment="flexible", when=["flexible"]),
            role(3, commitment="unknown", when=[]),
            role(4, areas=[], zones=[], commitment="monthly"),
            role(5, location_type="remote", areas=[], zones=[], status="closed"),
            role(6, commitment="one_off", activity="varies", who_can_apply="team_only", when=None),
            role(7, commitment="fortnightly", status="seasonal_closed", typical_shift_hours=None, areas=["Brent", "Camden", "Brent"]),
        ],
        ROLE,
    )


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_filters(roles):
    q = lambda **k: ids(facets.matching(roles, facets.Query(**k).predicates()))
    assert q() == [1, 2, 3, 4, 5, 6, 7]
    assert q(door="weekly") == [1, 2, 4, 5, 7]
    assert q(when=["weekend_daytime"]) == [1, 3, 4, 5, 6, 7]  # a role with flexible times only is left out
    assert q(borough="Brent") == [4, 5, 7]
    assert q(zones=["south"]) == [4, 5]
    assert q(frequency="once") == [2, 3, 6]
    assert q(who="team_only") == [6]
    assert q(activity="advice", remote=True) == [5]
    assert q(text=" ROLE 3 ") == [3]


def test_facet_counts_equal_one_scan_for_each_option(roles):
    chosen = facets.Query(door="weekly", borough="Camden", when=["weekend_daytime"]).predicates()
    options = {"borough": F.col("areas"), "activity": F.col("activity")}
    got = {(r.facet, r.option): r.n for r in facets.facet_counts(roles, chosen, options).collect()}
    for facet in options:
        others = {k: v for k, v in chosen.items() if k != facet}
        rows = facets.matching(roles, others).select(options[facet].alias("o")).collect()
        want = {}
        for r in rows:
            for o in set(r.o) if isinstance(r.o, list) else {r.o}:
                want[o] = want.get(o, 0) + 1
        assert {o: n for (f, o), n in got.items() if f == facet} == want
    listed = roles.sparkSession.createDataFrame([("activity", "advice"), ("activity", "none")], "facet string, option string")
    zero = {r.option: r.n for r in facets.with_zeros(facets.facet_counts(roles, chosen, options), listed).collect()}
    assert zero["none"] == 0


def test_orders_differ(roles):
    page = [r.id for r in facets.top(roles, facets.page_order(), 9).orderBy("place").collect()]
    soon = [r.id for r in facets.top(roles, facets.soonest_order(), 9).orderBy("place").collect()]
    assert page == [6, 2, 4, 1, 3, 7, 5] and soon == [6, 2, 1, 4, 3, 7, 5]
    assert [r.id for r in facets.top(roles, facets.title_order(), 2).orderBy("place").collect()] == [1, 2]


def test_no_hours_come_last(roles):
    spark = roles.sparkSession
    rows = spark.createDataFrame([role(1, typical_shift_hours=0.0), role(2, typical_shift_hours=None), role(3, typical_shift_hours=8.0)], ROLE)
    for order in (facets.page_order(), facets.soonest_order(), facets.least_order()):
        assert [r.id for r in facets.top(rows, order, 9).orderBy("place").collect()] == [3, 1, 2]


def test_relaxations_and_binding(roles):
    query = facets.Query(door="one_off", activity="advice", borough="Leeds")
    got = [(r.relaxed, r.n) for r in facets.relaxations(roles, query).orderBy("place").collect()]
    # every change counts beside the others; the door is already one_off, so that isn't offered
    assert got == [("door_weekly", 2), ("borough", 1)]
    assert facets.binding(query.predicates()) == "borough"
    assert facets.relaxations(roles, facets.Query(door="one_off", activity="none")).orderBy("place").first().relaxed == "activity"


def scored(spark, p, **over):
    return spark.createDataFrame([role(1, **over)], ROLE).select(ranking.fit(p).alias("f")).first().f


@pytest.mark.parametrize(
    "p,over,score,conflicts",
    [
        (None, {}, 8, 0),
        (dict(commitment="once"), dict(commitment="one_off"), 38, 0),
        (dict(commitment="once"), dict(commitment="one_off", min_term_months=6), 8, 1),  # a one-off with a term is ongoing
        (dict(commitment="once"), dict(commitment="one_off", location_type="own_home"), 8, 1),
        (dict(commitment="once"), dict(commitment="flexible"), 8, 0),  # flexible doesn't confirm a single visit
        (dict(commitment="once"), dict(commitment="weekly"), 8, 1),
        (dict(commitment="regular"), dict(commitment="long_term"), 38, 0),
        (dict(commitment="regular"), dict(commitment="flexible"), 8, 0),
        (dict(commitment="regular"), dict(commitment="one_off"), 8, 1),
        (dict(commitment="regular"), dict(commitment="unknown"), 8, 0),
        (dict(remote=True), dict(location_type="hybrid"), 33, 0),
        (dict(remote=True), dict(), 8, 1),
        (dict(zones=["south"]), dict(location_type="remote"), 23, 0),  # remote answers any area, without full points
        (dict(zones=["south"]), dict(location_type="own_home"), 8, 0),
        (dict(zones=["north"]), dict(), 20, 0),  # named areas aren't a venue
        (dict(zones=["north"]), dict(location_basis="charity_coverage"), 20, 0),
        (dict(zones=["north"]), dict(location_basis="postcode"), 33, 0),
        (dict(zones=["south"]), dict(location_basis="london_wide", zones=[]), 8, 0),
        (dict(zones=["south"]), dict(zones=[]), 8, 0),
        (dict(zones=["south"]), dict(), 8, 1),
        (dict(zones=["north"], remote=True), dict(location_type="remote"), 33, 0),  # one branch, never both
        (dict(when=["weekend_daytime"]), dict(), 33, 0),
        (dict(when=["weekday_evening"]), dict(when=["flexible"]), 8, 0),
        (dict(when=["weekday_evening"]), dict(when=None), 8, 0),
        (dict(when=["weekday_evening"]), dict(), 8, 1),
    ],
)
def test_fit(spark, p, over, score, conflicts):
    f = scored(spark, None if p is None else ranking.Preferences(**p), **over)
    assert (f.score, f.conflicts) == (score, conflicts)


def test_fit_says_why(spark, roles):
    for status, n in (("open", 0), ("seasonal_closed", 1), ("oversubscribed", 1), ("unknown", 1)):
        assert len(scored(spark, None, status=status).cautions) == n
    assert "runs across the city" in scored(spark, ranking.Preferences(zones=["south"]), zones=[], location_basis="london_wide").reasons
    assert 6 not in ids(ranking.ranked(roles, ranking.Preferences(commitment="once"), roles.where("id = 6").select("id")))


def test_pairs_greedily_with_late_ties(spark):
    old = spark.createDataFrame([("o", "a", "Kitchen helper", 0), ("o", "b", "Kitchen helper", 1), ("p", "c", "Driver", 0)], "g string, id string, title string, ord int")
    new = spark.createDataFrame([("o", "x", "Kitchen helper", 0), ("o", "y", "Kitchen helpers", 1), ("q", "z", "Cook", 0)], "g string, id string, title string, ord int")
    got = {(r.g, r.old_id, r.new_id) for r in changes.paired(old, new, "g").collect()}
    assert got == {("o", "b", "x"), ("o", "a", "y"), ("p", "c", None), ("q", None, "z")}
    assert SequenceMatcher(None, "tide", "diet").ratio() != SequenceMatcher(None, "diet", "tide").ratio()


def test_pairs_equal_plain_greedy_pairing(spark):
    import random

    draw, olds, news = random.Random(4), [], []
    words = ["kitchen", "helper", "night", "shelter", "driver", "cook", "mentor", "shop", "Tea"]
    for rows in (olds, news):
        for i in range(90):
            rows.append((f"g{draw.randint(0, 3)}", f"{'on'[rows is news]}{i}", draw.choice([None, "", " ".join(draw.choices(words, k=draw.randint(1, 4)))]) if draw.random() < 0.2 else " ".join(draw.choices(words, k=3)), draw.choice([i, i, 7 * i % 90])))
    want = set()
    for g in {r[0] for r in olds + news}:
        a, b = (sorted((r for r in rows if r[0] == g), key=lambda r: r[3]) for rows in (olds, news))
        scores = [(r, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (r := SequenceMatcher(None, (x[2] or "").lower(), (y[2] or "").lower()).ratio()) >= 0.72]
        left, right = set(range(len(a))), set(range(len(b)))
        for _, i, j in sorted(scores, reverse=True):
            if i in left and j in right:
                left.remove(i), right.remove(j)
                want.add((g, a[i][1], b[j][1]))
        want |= {(g, a[i][1], None) for i in left} | {(g, None, b[j][1]) for j in right}
    kind = "g string, id string, title string, ord int"
    got = {(r.g, r.old_id, r.new_id) for r in changes.paired(spark.createDataFrame(olds, kind), spark.createDataFrame(news, kind), "g").collect()}
    assert got == want


@pytest.mark.parametrize("changed,confidence,want", [([], 0.1, "auto"), (["status"], 0.99, "review"), (["title"], 0.9, "auto"), (["title"], 0.8, "review"), (["title"], None, "review"), (None, 0.9, "review"), *[([f], 0.99, "review") for f in changes.CRITICAL]])
def test_route(spark, changed, confidence, want):
    df = spark.createDataFrame([(changed, confidence)], "c array<string>, f double")
    assert df.select(changes.route(F.col("c"), F.col("f")).alias("r")).first().r == want


def test_diff_and_carry(spark):
    df = spark.createDataFrame([(1, None, ["a", "b"], "unknown", "x"), (1, 2, None, None, "")], "a int, b int, l array<string>, u string, w string")
    rows = df.select(changes.diff({"n": (F.col("a"), F.col("b")), "l": (F.array_sort("l"), F.array_sort(F.reverse("l")))}).alias("d"), changes.carried(F.col("w"), F.col("u")).alias("c")).collect()
    assert [r.d for r in rows] == [["n"], ["n"]] and [r.c for r in rows] == ["x", None]


def test_flattened_lists_compare_in_any_order(spark):
    df = spark.createDataFrame([((("basic", 18), ["b", "a"]), (("basic", 18), ["a", "b"]))], "o struct<screening:struct<dbs:string,min_age:int>,skills:array<string>>, n struct<screening:struct<dbs:string,min_age:int>,skills:array<string>>")
    kinds = {"screening.dbs": "scalar", "screening.min_age": "scalar", "skills": "array"}
    a, b = changes.flattened(F.col("o"), kinds), changes.flattened(F.col("n"), kinds)
    assert df.select(changes.diff({k: (a[k], b[k]) for k in kinds}).alias("d")).first().d == []


def test_rules(spark):
    df = spark.createDataFrame([("a", "open", 5, ["x", "x"]), ("b", "odd", None, ["x"])], "id string, status string, n int, tags array<string>")
    found = rules.violations(df, "id", [rules.enum_rule("status", ("open",)), rules.range_rule("n", 0, 3), rules.unique_rule("tags")])
    assert {(r.id, r.rule) for r in found.collect()} == {("a", "n"), ("a", "tags"), ("b", "status")}
    with pytest.raises(ValueError):
        rules.refuse_if_any(found)
    assert rules.unknown_columns(df, df.drop("n").schema) == ["n"]


def test_feed_gaps(spark):
    feed = spark.createDataFrame([("Cook", "https://a.org/x/1"), ("Driver (van)", "https://a.org/x/2"), ("Tea &amp; talk", "https://a.org/x/3"), ("New [name]", "https://a.org/x/4/")], "title string, link string")
    held = spark.createDataFrame([("driver", "https://b.org/q/1"), ("Old", "https://a.org/x/9"), ("TEA & TALK", "https://a.org/x/3/"), ("Other", "https://a.org/x/4"), ("Far", "https://c.org/x/9")], "title string, link string")
    got = {(r.kind, r.title) for r in matching.feed_gaps(feed, held).collect()}
    assert got == {("missing", "Cook"), ("gone", "Old")}


def test_simplify_and_chain():
    line = [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    assert geometry.simplified(line, 0.1) == [(0.0, 0.0), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    square = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert geometry.simplified_ring(square, 0.1) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert geometry.chained([((2, 0), (1, 0)), ((0, 0), (1, 0)), ((5, 5), (6, 6))]) == [[(0, 0), (1, 0), (2, 0)], [(5, 5), (6, 6)]]


def test_largest_ring(spark):
    ring = "array<struct<x:double,y:double>>"
    small, big = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([([small, big],)], f"r array<{ring}>").select(geometry.largest_ring(F.col("r")).alias("r"))
    c = df.select(geometry.centroid(F.col("r")).alias("c")).first().c
    assert (c.x, c.y) == (2.0, 2.0)


def test_nested_bands(spark):
    df = spark.createDataFrame([("d", "r1", 20), ("d", "r2", 45), ("d", "r3", None)], "d string, r string, m int")
    got = {r.band: r["items"] for r in matching.bands(df, F.col("m"), [30, 45, 60], "d", "r").collect()}
    assert got == {30: ["r1"], 45: ["r1", "r2"], 60: ["r1", "r2"]}


def test_places(spark):
    gazetteer = spark.createDataFrame([("Camden", "Camden"), ("the Angel", "Islington"), ("London", None)], "name string, borough string")
    df = spark.createDataFrame([(1, ["angel ", "Camden"]), (2, ["London"]), (3, ["Leeds"]), (4, [])], "k int, p array<string>")
    got = {r.k: (r.boroughs, r.london_only, r.elsewhere) for r in place.matched(df, "k", "p", gazetteer).collect()}
    assert got == {1: (["Camden", "Islington"], False, False), 2: ([], True, False), 3: ([], False, True), 4: ([], False, False)}


def cascade(spark, **over):
    base = {"location": "in_person", "district": None, "boroughs": [], "london_only": False, "role_zones": None, "wide": False, "coverage": []}
    df = spark.createDataFrame([tuple({**base, **over}.values())], "location string, district string, boroughs array<string>, london_only boolean, role_zones array<string>, wide boolean, coverage array<string>")
    district = F.create_map(F.lit("N1"), F.lit("Islington"))
    zone = F.create_map(*map(F.lit, ("Islington", "north", "Camden", "central", "Brent", "west")))
    names = F.create_map(*map(F.lit, ("north", "North London", "west", "West London")))
    cols = [F.col(c) for c in ("location", "district", "boroughs", "london_only", "role_zones")]
    r = df.select(place.zones(*cols, F.col("coverage"), district, zone).alias("zones"), place.basis(*cols, F.col("wide"), F.col("coverage")).alias("basis"), place.area_label(*cols, F.col("wide"), F.col("coverage"), names).alias("label")).first()
    return r.zones, r.basis, r.label


@pytest.mark.parametrize(
    "over,want",
    [
        ({}, ([], "unknown", None)),
        (dict(location="remote", boroughs=["Camden"], wide=True), ([], "remote", None)),
        (dict(district=" se1 "), (["central"], "postcode", None)),
        (dict(district="n1", coverage=["Brent"]), (["north"], "postcode", None)),
        (dict(district="N22", coverage=["Brent"]), ([], "postcode", None)),  # an unplaced district inherits nothing
        (dict(boroughs=["Brent", "Camden"], role_zones=["north"]), (["central", "west"], "role_areas", "Brent, Camden")),
        (dict(london_only=True, role_zones=["north"], coverage=["Brent"]), ([], "london_wide", "London")),
        (dict(role_zones=["west", "nowhere", "north", "west"], coverage=["Brent"]), (["north", "west"], "role_areas", "North London, West London")),
        (dict(coverage=["Brent"], wide=True), (["west"], "charity_coverage", None)),
        (dict(wide=True), ([], "london_wide", "Across London")),
    ],
)
def test_place_cascade(spark, over, want):
    assert cascade(spark, **over) == want


def test_suffixes_skip_what_is_taken(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(["cook", "cook", "drive", "cook", "cook-2", "tea"])], "n int, base string")
    taken = spark.createDataFrame([("cook",), ("cook-3",), ("drive",), ("other",)], "id string")
    got = [r.id for r in changes.suffixed(df, "base", [F.col("n")], taken=taken).orderBy("n").collect()]
    assert got == ["cook-4", "cook-5", "drive-2", "cook-6", "cook-2", "tea"]
    assert [r.id for r in changes.suffixed(df, "base", [F.col("n")]).orderBy("n").collect()] == ["cook", "cook-3", "drive", "cook-4", "cook-2", "tea"]


def test_places_in_an_order_without_one_task(spark):
    last = {i: i * 7919 % 1000 for i in range(1000)}
    df = spark.createDataFrame([(x, i) for i, x in last.items()], "last int, ord int").repartition(5)
    got = [r.ord for r in runs.repair_queue(df.withColumn("last", F.when(F.col("last") > 100, F.col("last"))), "last").orderBy("place").collect()]
    assert got == sorted(last, key=lambda i: (last[i] if last[i] > 100 else -1, i))
    assert [r.place for r in runs.repair_queue(df, "last").orderBy("place").collect()] == list(range(1, 1001))


def test_crawl_known_first_and_capped(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "b", 1), ("c", "e", 2), ("d", "a", 1)], "source string, target string, pos int")
    start = spark.createDataFrame([("a",), ("d",)], "page string")
    rows = lambda **k: [(r.page, r.target, r.level) for r in matching.crawl(start, links, **k).orderBy("page", "place").collect()]
    assert rows() == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 2), ("d", "a", 1)]
    known = spark.createDataFrame([("a", "z", 1)], "page string, target string, pos int")
    assert rows(most=2, known=known) == [("a", "z", 0), ("a", "b", 1), ("d", "a", 1)]


def test_failure_runs_and_median(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, 0, 1, 1, 1])], "k string, t int, bad int")
    got = sorted((r.length, r.dead) for r in runs.failure_runs(df, "k", [F.col("t")], F.col("bad") == 1).collect())
    assert got == [(2, True), (3, True)]
    ages = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "age int").withColumn("hidden", F.col("age") > 2)
    r = runs.freshness_summary(ages, "age", "hidden").first()
    assert (r.median_age, r.oldest, r.suppressed, r.banner) == (3, 4, 2, False)
    none = runs.freshness_summary(ages.where("age is null"), "age", "hidden").first()
    assert none.median_age is None and none.banner is True


def test_stitched_outline():
    one = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    two = [(1, 0), (2, 0), (2, 1), (1, 1), (1, 0)]
    ring = geometry.stitched(one, two, [[(1, 0), (1, 1)]])
    assert len(ring) == 7 and set(ring) == {(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)} and ring[0] == ring[-1]


PAGE = "<html><body><nav>{nav}</nav><main><h1>Help</h1><p>" + "We need people to cook for us. " * 20 + "{x}</p></main><aside>{side}</aside><a href='/volunteer/cook'>Cook role</a></body></html>"


def test_main_text_ignores_chrome():
    a = pages.isolated(PAGE.format(nav="one", side="two", x=""))
    b = pages.isolated(PAGE.format(nav="three", side="four", x=""))
    c = pages.isolated(PAGE.format(nav="one", side="two", x="now closed"))
    assert a[0] == b[0] != c[0] and a[1] != b[1]
    assert ("/volunteer/cook", "Cook role") in a[3]
    assert pages.isolated(None)[0] == ""


def links_of(spark, base, *links):
    df = spark.createDataFrame([(1, base, h, t, i) for i, (h, t) in enumerate(links)], "page_id int, url string, href string, label string, pos int")
    return [(r.target, r.strong) for r in pages.role_links(df, "page_id").orderBy("place").collect()]


def test_role_links(spark):
    got = links_of(spark, "https://a.org/help", ("/news/x", "Volunteer news"), ("/drop-in", "Drop-in host"), ("/help/drive", "Drive"), ("/volunteer/cook", "Cook"), ("/volunteer/cook/", "Cook again"), ("https://b.org/volunteer", "V"), ("/volunteer/form.pdf", "Form"), ("/jobs", "Job opportunity"))
    # below the page and links that name volunteers are strong, in page order; a hint alone is weak
    assert got == [("https://a.org/help/drive", True), ("https://a.org/volunteer/cook", True), ("https://a.org/drop-in", False)]


def test_role_links_of_subdomains_and_paid_work(spark):
    got = links_of(spark, "https://www.a.org.uk/volunteer/", ("https://volunteer.a.org.uk/roles", "Roles"), ("/vacancy/7", "Volunteer befriender"), ("/vacancy/8", "Senior mentor"), ("/volunteer/donate", "Donate"), ("/volunteer/", "Volunteer"), ("/about", "About us"), ("/kitchen", "x" * 91))
    assert got == [("https://volunteer.a.org.uk/roles", True), ("https://www.a.org.uk/vacancy/7", False)]


@pytest.mark.parametrize(
    "row,want",
    [((200, True, False, False, 5000, 3), "blocked"), ((None, False, False, False, 0, 0), "dead"), ((500, False, False, False, 5000, 3), "dead"), ((200, False, True, False, 399, 9), "client_rendered"), ((200, False, False, True, 399, 9), "thin"), ((200, False, True, True, 5000, 9), "redirected"), ((200, False, False, False, 1199, 0), "thin"), ((200, False, False, False, 1199, 1), "clean"), ((200, False, False, False, 1200, 0), "clean")],
)
def test_verdict(spark, row, want):
    df = spark.createDataFrame([row], "s int, b boolean, c boolean, r boolean, n int, l int")
    assert df.select(pages.verdict(*(F.col(c) for c in "sbcrnl")).alias("v")).first().v == want


def test_documents_round_trip(spark, tmp_path):
    for name, n in (("b", 1), ("a", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"organisation": {"id": name}, "opportunities": [{"id": f"{name}{i}"} for i in range(n)]}))
    schema = spark.range(1).select(F.struct(F.lit("x").alias("id")).alias("organisation"), F.array(F.struct(F.lit("x").alias("id"))).alias("opportunities")).schema
    docs = documents.json_documents(spark, str(tmp_path), schema)
    assert [r.id for r in documents.roles_of(docs).orderBy("ord").collect()] == ["a0", "a1", "b0"]
    only = documents.json_documents(spark, str(tmp_path), schema, ["b"], F.col("organisation.id"))
    assert only.count() == 1
    flat = documents.roles_of(docs).withColumnRenamed("of_org", "org_id")
    nested = sinks.documents(docs.select(F.col("organisation.id").alias("org_id")), flat)
    assert {r.org_id: [o.id for o in r.opportunities] for r in nested.collect()} == {"a": ["a0", "a1"], "b": ["b0"]}


def test_full_pages_are_not_followed(spark):
    rows = [("full", i, 1) for i in range(15)] + [("known", 0, 0)] + [("known", i, 1) for i in range(1, 15)] + [("open", i, 1) for i in range(14)] + [("one", 1, 1)]
    found = spark.createDataFrame(rows, "page string, target int, level int")
    assert [r.page for r in matching.followed(found, 1, 2, 15).collect()] == ["open"]
    links = spark.createDataFrame([(1, t, t) for t in range(2, 20)] + [(2, 50, 0), (3, 2, 0), (3, 4, 1), (2, 51, 1)], "source int, target int, pos int")
    got = matching.crawl(spark.createDataFrame([(1,), (3,)], "page int"), links)
    assert sorted((r.target, r.level) for r in got.where("page = 1").collect()) == [(t, 1) for t in range(2, 17)]
    assert sorted((r.target, r.level) for r in got.where("page = 3").collect()) == [(2, 1), (4, 1), (50, 2), (51, 2)]


def test_lines_stay_in_their_buffers():
    line = [{"x": float(i), "y": float(i % 7)} for i in range(100)]
    lines = pa.array([line, None, [], line[:2]] * 2000, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    tracemalloc.start()
    got = geometry._udf(geometry._kept).func(lines[1:], pa.array([20.0] * (len(lines) - 1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:4].to_pylist() == [None, [], line[:2], [line[0], line[-1]]] and len(got) == len(lines) - 1
    assert peak < 30 << 20  # 200,000 points take 3.2 MB as numbers, and about 60 MB as objects


def test_roles_of_more_files_than_an_int_of_places_holds(spark):
    docs = spark.range(2200).selectExpr("named_struct('id', id) as organisation", "array(named_struct('id', 2 * id), named_struct('id', 2 * id + 1)) as opportunities", "format_string('%06d', id) as _file")
    got = documents.roles_of(docs).orderBy("ord").collect()
    assert [r.id for r in got] == list(range(4400)) and got[-1].ord == 2_200_000_001


def board(folder, name, pages_):
    (folder / name).mkdir()
    for i, body in pages_.items():
        (folder / name / f"{i}.json").write_text(json.dumps(body))


def test_paged_sources(spark, tmp_path):
    paged.register(spark)
    board(tmp_path, "one", {1: {"data": [{"id": 1, "title": "Cook"}], "next_page_url": "x"}, 2: {"data": [{"id": 2, "title": "Drive", "status": "archived"}]}})
    board(tmp_path, "two", {1: {"data": [{"id": 3}], "meta": {"pagination": {"total_pages": 1}}}})
    board(tmp_path, "bad", {1: {"oops": 1}})
    board(tmp_path, "long", {i: {"data": [], "next_page_url": "x"} for i in range(1, 21)})
    read = lambda boards, dialect: spark.read.format("offers").option("boards", boards).option("dialect", dialect).option("path", str(tmp_path)).load()
    assert [r.id for r in read("one", "next").orderBy("id").collect()] == ["1", "2"]
    assert [r.id for r in paged.public(read("one", "next")).collect()] == ["1"]
    assert [r.id for r in read("two", "total").collect()] == ["3"]
    for name in ("bad", "long"):
        with pytest.raises(PythonException):
            read(name, "next").collect()
    # Boards that a query doesn't ask for aren't read, so a bad one does no harm; other filters still hold.
    assert [r.id for r in read("one,bad,two", "next").where("board = 'one' and status = 'public'").collect()] == [r.id for r in read("one", "next").where("status = 'public'").collect()]
    assert read("one,bad", "next").where("board in ('one', 'none') and id = '2'").count() == 1
    assert read("bad,long", "next").where("board = 'none'").collect() == []


def test_other_dialects():
    read = {1: json.dumps([{"id": 1, "status": "draft"}, {"id": 2}])}.get
    assert [i["id"] for i in paged.by_short_page(read)] == [2]


def test_swap_rolls_back(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    sinks.swapped_in(spark.range(3), target, lambda df: None)
    with pytest.raises(ValueError):
        sinks.swapped_in(spark.range(5), target, lambda df: rules.refuse_if_any(df.select(F.lit("x"))))
    assert spark.read.parquet(target).count() == 3


def test_one_holds_a_lock(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    sinks.replaced(spark.range(3), target)
    with sinks.Locked(spark, target), pytest.raises(BlockingIOError):
        sinks.replaced(spark.range(5), target)
    sinks.replaced(spark.range(4), target)
    assert spark.read.parquet(target).count() == 4


def test_dotted_values_are_set(spark):
    df = spark.createDataFrame([((("basic", 18), "x"),), ((None, "y"),)], "r struct<screening:struct<dbs:string,min_age:int>,title:string>")
    got = [r.r for r in df.select(changes.with_value(F.col("r"), "screening.dbs", F.lit("none")).alias("r")).collect()]
    assert got[0].screening.dbs == "none" and got[0].screening.min_age == 18 and got[1].screening is None


def test_geo_features(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text(json.dumps({"features": [{"properties": {"name": "Camden"}, "geometry": {"type": "Point"}}, {"properties": {"LAD13NM": "Brent"}, "geometry": None}]}))
    assert [r.name for r in documents.geo_features(spark, str(f), ["name", "LAD13NM"], 2).collect()] == ["Camden", "Brent"]
    for names, n in ((["name"], 2), (["name", "LAD13NM"], 3)):
        with pytest.raises(ValueError):
            documents.geo_features(spark, str(f), names, n)


def test_report_and_pages(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string")
    assert sinks.report(df, F.col("t"), ["i"]).first().report == "a\nb"
    sinks.write_pages(df, f"{tmp_path}/p", "t")
    assert (tmp_path / "p" / "t=a").is_dir()


def test_states(spark):
    state = spark.createDataFrame([("a", 1, "h"), ("b", 0, "h"), ("c", 0, "h")], "k string, failures int, content_hash string")
    fetch = spark.createDataFrame([("a", False, 500, None), ("b", True, 200, "new"), ("d", False, 403, None)], "k string, ok boolean, status int, digest string")
    got = {r.k: (r.failures, r.outcome, r.content_hash) for r in checks.advanced(state, fetch, "k").collect()}
    assert got == {"a": (2, "dead", "h"), "b": (0, "changed", "h"), "c": (0, None, "h"), "d": (0, "refused", None)}
    df = spark.createDataFrame([(False, False, 0, 0, []), (False, True, 0, 1, []), (True, False, 1, 0, []), (True, True, 1, 2, []), (True, True, 1, 1, [])], "o boolean, b boolean, x int, y int, n array<string>")
    assert [r.a for r in df.select(checks.issue_action(*(F.col(c) for c in "obxyn")).alias("a")).collect()] == ["nothing", "opened", "closed", "commented", "updated"]
