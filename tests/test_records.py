"""Schemas, flattened records, merges, page folders, issues, check states, chains, reach and loose JSON."""

import glob
import math
import os
import random
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import evidence, place, text, web
from lodestar.operators import chains, merging, reach, rules, schema
from lodestar.plans import text_queries
from lodestar.sources import documents, listings, loose, sinks
from lodestar.streaming import issues, states

CLOSED = {
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "size", "parts"],
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2},
        "size": {"type": "integer", "minimum": 1, "maximum": 9},
        "kind": {"type": ["string", "null"], "enum": ["x", "y", None]},
        "season": {"type": ["object", "null"], "required": ["start"], "additionalProperties": False, "properties": {"start": {"type": "integer", "maximum": 12}}},
        "parts": {"type": "array", "maxItems": 2, "uniqueItems": True, "items": {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}}}}},
    },
}
RECORDS = "id string, size double, kind string, season struct<start:int,end:int>, parts array<struct<n:double,tags:array<string>>>, extra string"


def found(df, key="id"):
    return sorted((r[key], r.path, r.message) for r in df.collect())


def test_schema_names_every_violation(spark):
    rows = [
        ("ok", 3.0, None, None, [], None),
        ("A", 2.5, "z", (13, None), [(1.0, ["abcd", "a"]), (None, None)], "e"),
        ("bb", None, "x", (None, 1), [(1.0, None), (1.0, None), (2.0, [])], None),
        ("cc", 10.0, "y", None, None, None),
    ]
    got = found(schema.violations(spark.createDataFrame(rows, RECORDS), "id", CLOSED))
    assert got == sorted([
        ("A", "id", "doesn't match ^[a-z]+$"), ("A", "id", "has fewer than 2 characters"), ("A", "size", "isn't of type integer"), ("A", "kind", "isn't one of x, y"),
        ("A", "season.start", "is more than 12"), ("A", "parts.0.tags.0", "has more than 3 characters"), ("A", "parts.1.n", "is missing"), ("A", "extra", "is an unknown key"),
        ("bb", "size", "is missing"), ("bb", "season.start", "is missing"), ("bb", "season.end", "is an unknown key"), ("bb", "parts", "has more than 2 items"), ("bb", "parts", "holds an item twice"),
        ("cc", "size", "is more than 9"), ("cc", "parts", "is missing"),
    ])


def test_schema_of_other_types_and_missing_columns(spark):
    df = spark.createDataFrame([("aa", "3", {"p": 1, "q": 2})], "id string, size string, open map<string,int>")
    rules_ = {"type": "object", "required": ["size", "gone"], "properties": {"size": {"type": "integer"}, "gone": {"type": "string"}, "open": {"type": "object", "additionalProperties": False, "properties": {"p": {"type": "integer"}}}}}
    assert found(schema.violations(df, "id", rules_)) == [("aa", "gone", "is missing"), ("aa", "open.q", "is an unknown key"), ("aa", "size", "isn't of type integer")]
    assert schema.violations(df, "id", rules_).first().text.startswith("aa: ")
    with pytest.raises(ValueError):
        schema.violations(df, "id", {"type": "object", "oneOf": []})


def changed(spark, old, new, kind, new_kind=None):
    df = spark.createDataFrame([(1, old)], f"k int, o {kind}").join(spark.createDataFrame([(1, new)], f"k int, n {new_kind or kind}"), "k")
    return df.select(schema.changed(F.col("o"), df.schema["o"].dataType, F.col("n"), df.schema["n"].dataType).alias("c")).first().c


def test_records_compare_as_the_gate_does(spark):
    kind = "struct<id:string,title:string,skills:array<string>,stated_places:array<string>,screening:struct<dbs:string,coords:string>,season:struct<start:int>,provenance:struct<at:int>>"
    base = ("r1", "Cook", ["a", "b"], None, ("basic", "1"), None, (1,))
    assert changed(spark, base, ("r2", "Cook", ["b", "a"], [], ("basic", "2"), None, (9,)), kind) == []
    assert changed(spark, base, ("r1", "Chef", ["a"], ["x"], ("none", "1"), (3,), (1,)), kind) == ["screening.dbs", "season.start", "skills", "stated_places", "title"]
    # An empty list differs from a missing one but for the field that says so; a repeated item counts.
    assert changed(spark, base, ("r1", "Cook", None, None, ("basic", "1"), None, (1,)), kind) == ["skills"]
    assert changed(spark, ("r", "t", [], None, None, None, None), ("r", "t", None, None, None, None, None), kind) == ["skills"]
    assert changed(spark, base, ("r1", "Cook", ["a", "a", "b"], None, ("basic", "1"), None, (1,)), kind) == ["skills"]


def test_records_of_other_schemas(spark):
    assert changed(spark, (1, "x"), (1.0, "x"), "struct<a:int,b:string>", "struct<a:double,b:string>") == []
    assert changed(spark, (1, "x"), (1, "new"), "struct<a:int,b:string>", "struct<a:int,c:string>") == ["b", "c"]
    assert changed(spark, ("1",), (["1"],), "struct<a:string>", "struct<a:array<string>>") == ["a"]


CATALOGUE = "org_id int, id string, status string, hours int, unsupported array<string>, coords string"


def merged(spark, status="ok"):
    now = spark.createDataFrame([(1, "same", "open", 1, None, "c"), (1, "new hours", "open", 1, None, "c"), (1, "gone", "open", 1, None, "c"), (1, "quiet", "open", 1, ["dbs"], "c"), (1, "unsaid", "open", 1, None, "c"), (2, "other", "open", 1, None, "c")], CATALOGUE)
    reads = spark.createDataFrame([(1, status)], "org_id int, read_status string")
    roles = spark.createDataFrame([(1, "same", "open", 1), (1, "new hours", "open", 9), (1, "gone", "closed", 1), (1, "brand new", "open", 5), (2, "other", "closed", 0), (3, "stray", "open", 1)], "org_id int, id string, status string, hours int")
    retire = spark.createDataFrame([(1, "gone", "page_404", None), (1, "quiet", "not_recruiting", ""), (1, "unheard of", "page_404", "")], "org_id int, id string, basis string, quote string")
    return now, reads, roles.where("org_id <> 2"), retire


def test_findings_update_insert_retire_and_keep(spark):
    now, reads, roles, retire = merged(spark)
    got = {r.id: r for r in merging.merged_findings(now, reads, roles, retire, ["status", "hours"]).collect()}
    assert {k: r.action for k, r in got.items()} == {"same": "unchanged", "new hours": "updated", "gone": "retired", "quiet": "kept_unknown", "unsaid": "untouched", "other": "untouched", "brand new": "new"}
    assert got["new hours"].hours == 9 and got["new hours"].coords == "c"
    assert got["quiet"].status == "unknown" and got["quiet"].unsupported == ["dbs", "status"]
    assert got["brand new"].coords is None and got["brand new"].hours == 5


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id * 2 as v")
    table = merging.Buckets(spark, f"{tmp_path}/t", "id", 8)
    table.create(rows)
    before = files(f"{tmp_path}/t")
    touched = table.merge(spark.createDataFrame([(5,), (6,)], "id long"), lambda df: df.withColumn("v", F.when(F.col("id").isin(5, 6), -1).otherwise(F.col("v"))))
    after = files(f"{tmp_path}/t")
    own = lambda names: {f for f in names if any(f.startswith(f"{merging.BUCKET}={b}/") for b in touched)}
    assert before - own(before) == after - own(after) and not own(before) & own(after)
    got = {r.id: r.v for r in table.read().collect()}
    assert got == {i: -1 if i in (5, 6) else 2 * i for i in range(200)}
    # A bucket that loses all its rows loses its folder; a merge that fails leaves the table as it was.
    one = touched[:1]
    table.merge(rows.where(merging.bucket_of(F.col("id"), 8) == one[0]).select("id").limit(1), lambda df: df.limit(0))
    assert not glob.glob(f"{tmp_path}/t/{merging.BUCKET}={one[0]}")
    held = files(f"{tmp_path}/t")
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(0,)], "id long"), lambda df: spark.range(200).selectExpr("id", "id as v"))
    assert files(f"{tmp_path}/t") == held
    assert table.merge(spark.createDataFrame([], "id long"), lambda df: df) == []


def test_only_changed_page_folders_are_written(spark, tmp_path):
    path = f"{tmp_path}/pages"
    rows = [("a", "x/1", 1, "open"), ("a", "x/1", 2, "open"), ("a", "y", 3, None), ("b", "x/1", 4, "open")]
    make = lambda r: spark.createDataFrame(r, "door string, facet string, id int, status string")
    actions = lambda df: {(r.door, r.facet): r.action for r in df.collect()}
    assert set(actions(sinks.update_pages(make(rows), path, "door", "facet")).values()) == {"written"}
    before = files(path)
    again = actions(sinks.update_pages(make(rows[::-1]), path, "door", "facet"))
    pages = lambda names: {f for f in names if not f.startswith(sinks.DIGESTS)}
    assert set(again.values()) == {"kept"} and pages(files(path)) == pages(before)
    later = [("a", "x/1", 1, "closed"), ("a", "x/1", 2, "open"), ("b", "x/1", 4, "open"), ("b", "z", 5, "open")]
    assert actions(sinks.update_pages(make(later), path, "door", "facet")) == {("a", "x/1"): "written", ("a", "y"): "removed", ("b", "x/1"): "kept", ("b", "z"): "written"}
    held = spark.read.parquet(path).select("door", "facet", "id", "status").collect()
    assert sorted(map(tuple, held)) == sorted(later)
    # A repeated row is a change as well.
    assert actions(sinks.update_pages(make([*later, later[-1]]), path, "door", "facet"))[("b", "z")] == "written"


def one_by_one(reports):
    """The issue of one key, report by report, as a plain loop."""
    level, seen, number, out = "ok", [], 0, []
    for r in reports:
        if r["keep"] and level == "broken":
            out.append(("left broken", None, number))
            continue
        new = [w for w in r["waiting"] if w not in seen]
        if r["level"] == "ok":
            out.append(("closed", "all clear", number) if level != "ok" else ("nothing", None, number))
        elif level == "ok":
            number += 1
            out.append(("opened", None, number))
        elif issues.LEVELS[r["level"]] > issues.LEVELS[level]:
            out.append(("updated", "worse", number))
        elif r["weekly"] and r["level"] == "broken":
            out.append(("updated", "still broken", number))
        else:
            out.append(("updated", "waiting: " + ", ".join(new) if new else None, number))
        level, seen = r["level"], r["waiting"]
    return out


def reports(n, seed):
    draw = random.Random(seed)
    make = lambda i: {"key": draw.randint(0, 3), "at": i // 2, "ord": i, "level": draw.choice(["ok", "attention", "broken"]), "waiting": draw.sample(["a", "b", "c"], draw.randint(0, 2)), "weekly": draw.random() < 0.5, "keep": draw.random() < 0.4}
    return [make(i) for i in range(n)]


def test_issues_batch_by_batch_and_again(spark, tmp_path):
    rows = reports(120, 3)
    want = defaultdict(list)
    for r in rows:
        want[r["key"]].append(r)
    want = {k: one_by_one(v) for k, v in want.items()}
    make = lambda part: spark.createDataFrame([tuple(r[c] for c in ("key", "at", "ord", "level", "waiting", "weekly", "keep")) for r in part], issues.REPORT)
    sink = issues.IssueSink(spark, f"{tmp_path}/log")
    got = lambda: {k: [(r.action, r.comment, r.number) for r in sink.log().where(F.col("key") == k).orderBy("at", "ord").collect()] for k in want}
    for n, part in enumerate((rows[:50], rows[50:80], rows[80:])):
        sink.upsert(make(part), n)
    assert got() == want
    rows_before = sorted(map(str, sink.log().collect()))
    for n, part in ((1, rows[50:80]), (2, rows[80:]), (2, rows[80:])):
        sink.upsert(make(part), n)
    assert sorted(map(str, sink.log().collect())) == rows_before
    last = {r.key: r.level for r in sink.state().collect()}
    assert set(last) == set(want)


def test_check_states_step_by_step():
    fetch = lambda status, digest=None, reading=None, redirected=False, at=1: SimpleNamespace(status=status, digest=digest, reading=reading, redirected=redirected, at=at, ord=0)
    outcome, s = states.after(dict(states.NEW), fetch("read", "d1", "published"))
    assert (outcome, s["baseline"], s["link"], s["success"], s["extraction"]) == ("published", "d1", "ok", 1, 1)
    outcome, s = states.after(s, fetch("failed", at=2))
    assert (outcome, s["failures"], s["link"]) == ("source_failed", 1, "ok")
    outcome, s = states.after(s, fetch("refused", at=3))
    assert (outcome, s["failures"], s["attempt"]) == ("source_refused", 1, 3)
    outcome, s = states.after(s, fetch("failed", at=4))
    assert (s["failures"], s["link"]) == (2, "dead")
    outcome, s = states.after(s, fetch("read", "d2", "held", True, at=5))
    assert (outcome, s["baseline"], s["failures"], s["link"], s["success"], s["extraction"]) == ("review_required", "d1", 0, "redirected", 1, 5)
    outcome, s = states.after(s, fetch("read", "d1", None, at=6))
    assert (outcome, s["success"]) == ("unchanged", 6)
    assert states.after(s, fetch("read", "d3", None))[0] == "ai_unavailable"
    assert states.after(s, fetch("read", "d3", "deferred", at=9))[1]["extraction"] == 5
    assert states.after(s, fetch("blocked"))[1]["link"] == "link_only"
    # No digest is no agreement, even before there is a baseline.
    assert states.after(dict(states.NEW), fetch("read", None, None))[0] == "ai_unavailable"


def test_check_states_go_on_from_the_checkpoint(spark, tmp_path):
    day = 86_400_000_000
    arrive = lambda rows: spark.createDataFrame(rows, states.FETCHES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: {(r.source, r.at, r.outcome): r for r in states.checked(spark, f"{tmp_path}/in", f"{tmp_path}/out", stale_after=3 * 86_400).collect()}
    arrive([(1, day, 1, "read", False, "d", "published"), (1, 2 * day, 2, "failed", None, None, None), (2, day, 3, "read", False, "e", "confirmed")])
    assert {k[2] for k in run()} == {"published", "source_failed", "confirmed"}
    arrive([(1, 3 * day, 4, "failed", None, None, None), (3, 9 * day, 5, "blocked", None, None, None)])
    got = run()
    assert got[(1, 3 * day, "source_failed")].failures == 2 and got[(1, 3 * day, "source_failed")].link == "dead"
    # Neither source is heard of again: a timer says that both are stale, once.
    assert (1, 4 * day, "stale") in got and (2, 4 * day, "stale") in got
    arrive([(2, 10 * day, 6, "read", False, "e", None)])
    got = run()
    assert got[(2, 10 * day, "unchanged")].success == 10 * day and sum(k[2] == "stale" for k in got) == 2


def walks(rows):
    lines = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.place):
        lines[(r["from"], r.to, r.closed)].append((r.a, r.b))
    return lines


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_use_each_edge_once_and_leave_no_ends_to_join(spark, seed):
    draw = random.Random(seed)
    edges = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(70)} | {(100, 101), (101, 102), (100, 102)}
    given = [(a, b) if draw.random() < 0.5 else (b, a) for a, b in edges] * 2 + [(5, 5), (None, 3)]
    lines = walks(chains.chained(spark.createDataFrame(given, "a long, b long")).collect())
    used = [tuple(sorted(e)) for line in lines.values() for e in line]
    assert sorted(used) == sorted(edges)
    ends = []
    for (first, to, closed), line in lines.items():
        assert line[0] == (first, to) and all(x[1] == y[0] for x, y in zip(line, line[1:]))
        assert closed == (line[-1][1] == line[0][0])
        ends += [] if closed else [line[0][0], line[-1][1]]
        assert closed or line[0][0] < line[-1][1]
    degree = defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    assert sorted(ends) == sorted(p for p, d in degree.items() if d % 2)
    assert (100, 101, True) in lines and len(lines[(100, 101, True)]) == 3


def test_a_long_line_keeps_its_order(spark):
    points = list(range(300))
    random.Random(9).shuffle(points)
    df = spark.createDataFrame(list(zip(points, points[1:])), "a int, b int")
    (line,) = walks(chains.chained(df).collect()).values()
    got = [line[0][0], *(b for _, b in line)]
    assert got in (points, points[::-1]) and got[0] < got[-1]
    assert chains.chained(df.limit(0)).collect() == []


def test_reach_equals_all_pairs(spark):
    draw = random.Random(4)
    at = lambda n: [(i, draw.uniform(-50, 50), draw.uniform(-50, 50)) for i in range(n)]
    places, items = at(30), [*at(60), (99, None, 1.0)]
    own = [(0, 5, 12), (1, 6, None)]
    df = reach.reached(spark.createDataFrame(places, "p int, x double, y double"), spark.createDataFrame(items, "i int, x double, y double"), "p", "i", [5, 10], 2.0, table=spark.createDataFrame([*own, (2, 7, 3)], "p int, i int, minutes int"))
    want = set()
    for p, x, y in places:
        for i, u, v in items:
            if u is None:
                continue
            minutes = {(0, 5): 12, (1, 6): None, (2, 7): 3}.get((p, i), round(math.dist((x, y), (u, v)) / 2.0))
            want |= {(p, b, i, minutes) for b in (5, 10) if minutes is not None and minutes <= b}
    assert {(r.p, r.band, r.i, r.minutes) for r in df.collect()} == want


def test_loose_json_is_refused_with_a_reason(spark):
    shape = {"$": "object", "$.n": "whole", "$.rate": "number?", "$.list": "list?", "$.on": "flag?"}
    rows = ['{"n": 1, "rate": 2.5, "list": [], "on": true}', '{"n": 1, "rate": 2}', '{"n": 1, "rate": null}', '{"n": "1"}', "[1]", "{", "", None, "{}", '{"n": 1, "rate": "x"}', '{"n": 1.5}', '{"n": 2, "on": 1}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, body string")
    got = {r.i: (r.n, r.rate, r.refused) for r in loose.shaped(df, "body", shape, {"n": "$.n", "rate": "$.rate"}).collect()}
    assert got[0] == (1, 2.5, None) and got[1] == (1, 2.0, None) and got[2] == (1, None, None)
    assert [got[i][2] for i in (3, 4, 5, 6, 7, 8)] == ["$.n is of kind text, not whole", "$ is of kind list, not object", "isn't JSON", "isn't JSON", "isn't JSON", "$.n is missing"]
    assert got[9][2] == "$.rate is of kind text, not number" and got[10][2] == "$.n is of kind number, not whole" and got[11][2] == "$.on is of kind whole, not flag"
    assert all(got[i][:2] == (None, None) for i in range(3, 12))


def test_a_part_of_a_listing_is_refused(spark):
    pages = [("a", 1, None, True), ("a", 2, None, False), ("b", 1, None, True), ("b", 3, None, False), ("c", 1, None, True), ("d", 1, "isn't JSON", False), ("e", 1, None, True), ("e", 2, None, True)]
    got = {r.board: r.reason for r in loose.whole_listing(spark.createDataFrame(pages, "board string, page int, refused string, more boolean"), "board", 2).collect()}
    assert got == {"b": "pages are missing", "c": "ends before its last page", "d": "page 1: isn't JSON", "e": "has more than 2 pages"}


def near(page, title, place_):
    """The rule in plain Python."""
    import re

    norm = lambda v: " ".join(v.casefold().replace("&", " and ").replace("’", "'").split()).strip(" ,.;:")
    flat, needle, name = norm(page), norm(place_), norm(title or "")
    if not needle or needle not in flat:
        return False
    starts = [m.start() for m in re.finditer(re.escape(name), flat)] if name else []
    return any(needle in flat[s : s + len(name) + 600] for s in starts) if starts else True


def test_places_near_titles(spark):
    far = "x " * 400
    cases = [
        ("Hackney Driver wanted", "Hackney Driver", "Hackney"), ("Cook in Brent & Camden.", "Cook", "Brent and Camden"), (f"Cook {far} Leeds", "Cook", "Leeds"), (f"Leeds {far} Cook", "Cook", "Leeds"),
        (f"Leeds {far}", "Cook", "Leeds"), (f"Cook {far} Cook here: Leeds", "Cook", "Leeds"), ("Cook", "Cook", ""), ("Cook in Leeds", None, "leeds"), ("Cook in Leeds", "", " Leeds, "), ("aaa b", "aa", "b"),
        ("C\\E+ (x) Cook in York", "c\\e+ (x)", "york"), ("Cook York", "Cook", "Leeds"), ("St John’s  Wood cook", "cook", "st john's wood"),
        ("Cook " + "y" * 590 + " Leeds", "Cook", "Leeds"), ("Cook " + "y" * 594 + " Leeds", "Cook", "Leeds"), ("Cook " + "y" * 593 + " Leeds", "Cook", "Leeds"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, page string, title string, place string")
    got = {r.i: r.near for r in df.select("i", text.place_near_title(F.col("page"), F.col("title"), F.col("place")).alias("near")).collect()}
    assert got == {i: near(*c) for i, c in enumerate(cases)}
    stand = lambda places: spark.range(1).select(text.places_stand(F.lit("Cook in Leeds and York"), F.lit("Cook"), F.array(*map(F.lit, places))).alias("p")).first().p
    assert stand([" Leeds", "York"]) == ["Leeds", "York"] and stand(["Leeds", "Hull"]) == []


def test_titles_with_letters_without_a_single_capital(spark, tmp_path):
    far = " ".join(f"wort{i}" for i in range(300))
    spark.createDataFrame([(5, f"schß. {far}"), (17, f"wort schß. {far}"), (29, f"naß {far}"), (41, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b naß c", "d", "e schß. f", "g", "h schß. i", "j ﬁn"])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in text_queries.near_titles(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(text_queries.ORACLE["near_titles"]).fetchall())
    assert spark.range(1).select(text.capitals(F.lit("Straße ﬁn é😀")).alias("c")).first().c == "STRAßE ﬁN É😀"


def test_invariants_of_a_role_without_its_organisation(spark):
    kind = "id string, ord int, org_id int, commitment string, status string, apply_url string, url_specificity string, confidence double, min_term_months int, has_season boolean, dbs string, verified array<string>, unsupported array<string>, reviewed boolean"
    role = lambda id_, ord_, org: (id_, ord_, org, "one_off", "seasonal_closed", None, "org_homepage", 0.9, 3, False, "none", None, None, False)
    orgs = spark.createDataFrame([(1, False, "https://a.org/", "https://a.org/v")], "org_id int, opted_out boolean, website_url string, volunteer_url string")
    got = rules.invariants(spark.createDataFrame([role("a", 1, 1), role("a", 2, 1), role("b", 3, 9)], kind), orgs)
    by = defaultdict(list)
    for r in got.collect():
        by[r.id].append(r.rule)
    assert sorted(by["b"]) == ["organisation"]
    assert by["a"].count("duplicate") == 1 and by["a"].count("dbs") == 2 and by["a"].count("season") == 2


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    none = F.lit(None).cast("array<string>")
    where = lambda district: one(place.areas(F.lit("in_person"), F.lit(district).cast("string"), F.array(F.lit("Brent")), F.lit(False), none, none))
    assert where("") == ["Brent"] and where(None) == ["Brent"] and where("E8") == ["E8"]
    forced = one(evidence.settled("eligibility", F.lit("women only"), F.lit(None).cast("string"), F.lit("http://x"), F.lit(None).cast("string")))
    assert forced.value == "" and forced.cleared
    page = """<a href="/a"><A HREF='/b "c"'><a href = /d class=x><a href=""><a nohref='/no'>"""
    assert one(web.hrefs(F.lit(page))) == ["/a", '/b "c"', "/d", ""]


def test_versions_findings_and_image_kinds(spark):
    a = spark.createDataFrame([("a", "2024-01-02")], "name string, generated_at string")
    b = spark.createDataFrame([("b", "2024-01-03")], "name string, generated_at string")
    c = spark.createDataFrame([("c", None)], "name string, generated_at string")
    assert documents.newest_version([a, b, c]).first().name == "b"
    assert documents.newest_version([a, a.withColumn("name", F.lit("later"))]).first().name == "a"
    rows = [("A.json", 1, 7, "second"), ("A.json", 0, 7, "first"), ("B.json", 0, 7, "third"), ("B.json", 1, 8, "only")]
    got = documents.first_findings(spark.createDataFrame(rows, "_file string, _pos int, org_id int, what string")).collect()
    assert {r.org_id: r.what for r in got} == {7: "first", 8: "only"}


def test_image_kinds_by_their_first_bytes(spark):
    cases = {
        b"\x89PNG\r\n\x1a\nrest": "png", b"\xff\xd8\xff\xe0": "jpg", b"RIFF1234WEBPVP8 ": "webp", b"RIFF1234AVI ": None, b"  \n<SVG viewBox": "svg", b"<?xml version='1.0'?><!-- x --><svg>": "svg",
        b"<?xml version='1.0'?><html>": None, b"text before <svg>": None, b"": None, b"\xff\xfe\x80": None, "<svg>é".encode()[:6]: "svg", b" " * 2001 + b"<svg>": None,
    }
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, content binary")
    got = {r.i: r.kind for r in df.select("i", web.image_kind(F.col("content")).alias("kind")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_pages_that_are_read_again(spark):
    links = ["https://a.org/x/#y", "https://a.org/x", "HTTPS://b.org/", "https://a.org/f.PDF", None, "ftp://a.org", "https://land.org/", "http://c.org/a//"]
    got = spark.range(1).select(web.known_pages(F.array(*map(F.lit, links)), F.lit("https://land.org")).alias("p")).first().p
    assert got == ["https://a.org/x", "http://c.org/a"]


def test_card_searches_are_whole_or_refused(spark):
    card = lambda title, org, link: f'<div class="card shadow-0">{title}<p>Organisation: {org}</p>{link}'
    good, other = card("<h5>A &amp; <b>B</b></h5>", " our  Org", '<a href="/role/1">'), card("<h5>C</h5>", "Others", '<a href="https://x.org/role/2">')
    head = "Find Volunteer Roles "
    rows = [
        ("whole", 1, head + good + other + "?page=2"), ("whole", 2, head + other), ("none", 1, head), ("empty", 1, head + "page=2"), ("odd", 1, good), ("null", 1, None),
        ("card", 1, head + card("", "our org", "")), ("gap", 1, head + good), ("gap", 3, head + good), ("cut", 1, head + good + "page=2"), ("long", 1, head + good), ("long", 2, head + good + "page=3"),
    ]
    pages = spark.createDataFrame([(b, p, "https://l.org/find", h) for b, p, h in rows], "board string, page int, base string, html string")
    wanted = spark.createDataFrame([(b, "OUR ORG") for b in {r[0] for r in rows}], "board string, organisation string")
    found, refused = listings.card_listing(pages, wanted, most=2)
    assert [tuple(r) for r in found.collect()] == [("whole", "A & B", "https://l.org/role/1")]
    assert {r.board: r.reason for r in refused.collect()} == {"odd": "a page isn't the search", "null": "a page isn't the search", "card": "a card can't be read", "gap": "pages are missing", "cut": "a page that the last one names is missing", "long": "more than 2 pages"}


def test_searches_with_detail_pages(spark):
    number = lambda n: f"{n:08x}-0000-0000-0000-{n:012x}"
    link = lambda n: f'<a href="/PublicEnterprise/EnterpriseGvi?a=1&amp;gviGuid={number(n).upper()}" x> Listed <i>{n}</i>\n</a>'
    head = "Search Volunteer Opportunities"
    searches = [("a", head + link(10) + link(11) + link(10)), ("b", link(1)), ("c", head + link(3)), ("d", head + "".join(map(link, range(5)))), ("e", head), ("f", None)]
    about = '<meta x="y" property="og:description" content="Do &quot;it&quot;">'
    details = [("a", number(10), '<meta property="og:title" content="Own">' + about), ("a", number(11), about.upper()), ("c", number(3), "<p>no</p>"), *[("d", number(n), about) for n in range(5)]]
    found, refused = listings.search_listing(spark.createDataFrame(searches, "board string, html string"), spark.createDataFrame(details, "board string, number string, html string"), most=5)
    assert sorted((r.board, r.number, r.title, r.description) for r in found.collect()) == [("a", number(10), "Own", 'Do "it"'), ("a", number(11), "Listed 11", 'DO "IT"')]
    assert {r.board: r.reason for r in refused.collect()} == {"b": "the page isn't the search", "c": "result 00000003 has no description", "d": "too many results", "f": "the page isn't the search"}


def restated(html):
    """(main length, share of the rest, links) of a page by the rules of ``pages``, over a tree whose texts know all that they are in."""
    from html.parser import HTMLParser

    from lodestar.operators import pages

    texts, anchors = [], []

    class Tree(HTMLParser):
        above: list = []

        def handle_starttag(self, tag, attrs):
            if tag in pages.BREAKS:
                texts.append((list(self.above), "\n"))
            if tag not in pages.VOID:
                self.above = [*self.above, (tag, dict(attrs))]
                if tag == "a":
                    anchors.append(self.above)

        def handle_endtag(self, tag):
            if tag in pages.BREAKS:
                texts.append((list(self.above), "\n"))
            at = [i for i, (t, _) in enumerate(self.above) if t == tag]
            if at:
                self.above = self.above[: at[-1]]

        def handle_data(self, data):
            texts.append((list(self.above), data))

    tree = Tree(convert_charrefs=True)
    tree.feed(html)
    tree.close()
    tidy = lambda parts: "\n".join(x for x in (" ".join(y.split()) for y in "".join(parts).split("\n")) if x)
    seen = [(above, text_) for above, text_ in texts if not above or above[-1][0] not in ("script", "style", "noscript")]
    whole = tidy(t for _, t in seen)
    plain = [(above, t) for above, t in seen if not any(tag in pages.STRIPPED for tag, _ in above)]
    marked = lambda above: any(tag not in ("html", "body", "main") and pages.CHROME.search(f"{a.get('class') or ''} {a.get('id') or ''}") for tag, a in above)
    inside = {"main": lambda tag, a: tag == "main", "role": lambda tag, a: tag not in ("main", "article", "body") and a.get("role") == "main", "article": lambda tag, a: tag == "article", "body": lambda tag, a: tag == "body"}
    best = []
    for some in ([x for x in plain if not marked(x[0])], plain):
        best += [tidy(t for above, t in some if any(is_(tag, a) for tag, a in above)) for is_ in inside.values()]
        best.append(tidy(t for _, t in some))
    long = [b for i, b in enumerate(best) if len(b) >= pages.LEAST and i % 5 < 4]
    main = long[0] if long else max(best, key=len)
    links = sum(bool(above[-1][1].get("href")) and not any(tag in pages.FRAME for tag, _ in above) for above in anchors)
    return len(main), round(1 - len(main) / len(whole), 3) if whole else None, links


def test_page_text_of_the_whole_table(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the test tables aren't here")
    want = {r.page_id: restated(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: (r.n_chars, r.boilerplate, r.links) for r in entry.queries()["page_main_text"](spark, folder).collect()}
    assert got == want and len(set(got.values())) > 100
