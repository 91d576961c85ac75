"""Queries over nested records: orders with their items, checked by a schema, compared, merged and published.

The tables hold no nulls and no broken rows, so the queries put some in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import values, web
from lodestar.operators import changes, merging, schema
from lodestar.plans.tables import read
from lodestar.sources import documents, listings, sinks
from lodestar.sources.scratch import fresh_path
from lodestar.streaming import issues

#: A record as the catalogue would state it; every kind of rule is broken by some row of ``_records``.
RECORD = {
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "status", "priority", "total", "items", "placed"],
    "properties": {
        "id": {"type": "string", "pattern": "^o-[0-9]+$"},
        "status": {"type": "string", "enum": ["F", "O"]},
        "priority": {"type": "string", "minLength": 6, "maxLength": 10},
        "total": {"type": "number", "minimum": 2000, "maximum": 400000},
        "note": {"type": ["string", "null"], "maxLength": 12},
        "placed": {"type": "object", "additionalProperties": False, "required": ["day"], "properties": {"day": {"type": "string", "pattern": "^199[5-9]-"}, "clerk": {"type": ["integer", "null"], "maximum": 900}}},
        "flags": {"type": "array", "uniqueItems": True, "items": {"type": "string", "enum": ["A", "N", "R"]}},
        "items": {
            "type": "array",
            "minItems": 1,
            "maxItems": 6,
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["line", "quantity", "ship"],
                "properties": {
                    "line": {"type": "integer", "minimum": 1},
                    "quantity": {"type": "integer", "maximum": 48},
                    "ship": {"type": "object", "required": ["flag"], "additionalProperties": False, "properties": {"flag": {"type": "string", "enum": ["A", "N"]}, "status": {"type": "string"}}},
                },
            },
        },
    },
}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items; some lack a key, some have one that isn't known, some values are out of bounds."""
    item = F.struct(
        F.col("l_linenumber").alias("line"),
        F.expr("if(l_linenumber = 3 and l_orderkey % 29 = 0, l_quantity + 0.5, l_quantity)").alias("quantity"),
        F.expr("if(l_linenumber = 2 and l_orderkey % 31 = 0, null, named_struct('flag', l_returnflag, 'status', l_linestatus, 'dock', if(l_orderkey % 37 = 0, 'x', null)))").alias("ship"),
    )
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", item.alias("item")))), lambda x: x["item"]).alias("items"))
    orders = read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.expr("if(o_orderkey % 41 = 0, concat('order ', o_orderkey), concat('o-', o_orderkey))").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.expr("if(o_orderkey % 43 = 0, null, o_orderpriority)").alias("priority"),
        F.col("o_totalprice").alias("total"),
        F.expr("case o_orderkey % 47 when 0 then 'a note that is long' when 1 then 'short' end").alias("note"),
        F.expr("if(o_orderkey % 53 = 0, null, named_struct('day', date_format(o_orderdate, 'yyyy-MM-dd'), 'clerk', cast(o_custkey as int)))").alias("placed"),
        F.expr("case when o_orderkey % 59 = 0 then array('A', 'N', 'A') when o_orderkey % 59 = 1 then array('A', 'X') else array('R') end").alias("flags"),
        F.expr("coalesce(items, array())").alias("items"),
        F.expr("if(o_orderkey % 61 = 0, 'surplus', null)").alias("extra"),
    )


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation of the schema by orders and their items, as ``id: path - message``."""
    return schema.violations(_records(spark, sf_dir), "id", RECORD).select("id", "path", "text")


def _role_records(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Orders as nested roles in two versions; the later one lacks some, adds some, and states another field."""
    n = "o_orderkey"
    new = (lambda when, then, keep: f"if({when}, {then}, {keep})") if later else (lambda when, then, keep: keep)
    df = read(spark, sf_dir, "orders").where(F.expr(f"{n} % 6 <> 0" if later else f"{n} % 4 <> 1"))
    return df.select(
        n,
        F.expr(f"concat('r{int(later)}-', {n})").alias("id"),
        F.expr(new(f"{n} % 5 = 0", "upper(o_orderstatus) || '!'", "o_orderstatus")).alias("status"),
        F.expr(f"named_struct('dbs', {new(f'{n} % 7 = 0', 'null', 'o_orderpriority')}, 'age', named_struct('least', {new(f'{n} % 9 = 0', '21', '18')}, 'org_id', {int(later)}))").alias("screening"),
        F.expr(new(f"{n} % 8 = 0", "array('b', 'a')", new(f"{n} % 8 = 2", "array('a')", "array('a', 'b')"))).alias("skills"),
        F.expr(new(f"{n} % 10 = 0", "array()", f"if({n} % 10 < 5, null, array('x'))")).cast("array<string>").alias("stated_places"),
        F.expr(new(f"{n} % 11 = 0", "array()", f"if({n} % 11 < 5, null, array('y'))")).cast("array<string>").alias("eligibility"),
        F.expr(new(f"{n} % 12 = 0", "named_struct('start', 1, 'end', 3)", f"if({n} % 12 < 6, null, named_struct('start', 1, 'end', 2))")).alias("season"),
        F.struct(F.lit(int(later)).alias("at")).alias("provenance"),
        *([F.expr(f"if({n} % 13 = 0, 'new', null)").alias("intake")] if later else []),
    )


def record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between two snapshots of nested roles, found by walking their schemas."""
    out = schema.compared(_role_records(spark, sf_dir, False), _role_records(spark, sf_dir, True), "o_orderkey")
    return out.select("o_orderkey", "kind", F.array_join("changed", ",").alias("changed"))


def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after a batch of findings: a bucketed table of which the merge rewrites what it touches. Orders are
    roles; a ninth of the customers isn't in the batch, some of the others couldn't be read."""
    orders = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    current = orders.selectExpr("o_custkey as org_id", "k as id", "o_orderstatus as status", "o_orderpriority as commitment", "array(o_orderpriority) as skills", "if(k % 4 = 0, array('dbs'), null) as unsupported", "o_totalprice as price")
    reads = read(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").selectExpr("c_custkey as org_id", "case when c_custkey % 7 = 0 then 'read_failed' else 'ok' end as read_status")
    read_well = orders.join(reads.where(~F.col("read_status").isin(*merging.UNREAD)), F.col("o_custkey") == F.col("org_id"))
    again = read_well.where("k % 5 < 3").selectExpr("org_id", "k as id", "case when k % 11 = 0 then null else o_orderstatus end as status", "if(k % 6 = 0, '0-NOW', o_orderpriority) as commitment", "if(k % 10 = 0, array(o_orderpriority, 'more'), array(o_orderpriority)) as skills")
    fresh = read_well.where("k % 8 = 3").selectExpr("org_id", "-k as id", "'F' as status", "o_orderpriority as commitment", "array('new') as skills")
    retire = read_well.where("k % 13 = 0").selectExpr("org_id", "k as id", "case k % 3 when 0 then 'page_404' when 1 then 'not_recruiting' end as basis", "if(k % 5 = 0, 'we are full', '') as quote")
    table = merging.Buckets(spark, fresh_path(spark, "catalogue"), "org_id", 16)
    table.create(current)
    merge = lambda rows: merging.merged_findings(rows, reads, again.unionByName(fresh), retire, ["status", "commitment", "skills"])
    table.merge(reads.select("org_id"), lambda rows: merge(rows).where("action <> 'retired'").drop("action"))
    return table.read().withColumns({c: F.array_join(c, ",") for c in ("skills", "unsupported")})


def issue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event does to its user's issue, as a stream into a sink, in three runs that go on from each other."""
    reports = read(spark, sf_dir, "events").selectExpr(
        "user_id as key",
        "unix_micros(cast(ts as timestamp)) as at",
        "event_id as ord",
        "case event_type when 'error' then 'broken' when 'purchase' then 'attention' when 'click' then 'attention' else 'ok' end as level",
        "case when event_type in ('error', 'purchase', 'click') then array(concat('w', event_id % 3), concat('x', event_id % 2)) else array() end as waiting",
        "user_id % 2 = 0 as weekly",
        "event_id % 5 < 2 as keep",
    ).withColumn("day", F.expr("date_trunc('DAY', timestamp_micros(at))"))
    folder = fresh_path(spark, "issues")
    for part in ("day < timestamp '2024-01-10'", "day >= timestamp '2024-01-10' and day < timestamp '2024-01-20'", "day >= timestamp '2024-01-20'"):
        reports.where(part).drop("day").write.mode("append").parquet(f"{folder}/arrivals")
        sink = issues.tracked(spark, f"{folder}/arrivals", folder)
    return sink.log().select("key", "ord", "level", "action", "comment", "number")


def page_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of doors and activities after the roles of one organisation changed: which are written, kept, removed."""
    df = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = df.selectExpr("o_orderpriority as door", "concat(c_mktsegment, '/', c_nationkey) as facet", "o_orderkey as id", "o_orderstatus as status", "o_custkey")
    folder = fresh_path(spark, "pages")
    sinks.update_pages(rows.drop("o_custkey"), folder, "door", "facet")
    # A role of customer 1 closes, those of customers 2 to 50 go, one of customer 7 comes under a facet of its own.
    later = rows.where("o_custkey not between 2 and 50").withColumn("status", F.expr("if(o_custkey = 1, 'closed', status)"))
    later = later.union(rows.where("o_custkey = 7").selectExpr("door", "'new facet' as facet", "id", "status", "o_custkey"))
    return sinks.update_pages(later.drop("o_custkey"), folder, "door", "facet")


def card_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of one organisation on the card searches of every host, three pages a card page, and the searches that are refused:
    some lack a page, some have a card without a link."""
    of = F.split("url", "/")[2]
    n = F.row_number().over(Window.partitionBy("board").orderBy("page_id"))
    rows = read(spark, sf_dir, "pages").select(of.alias("board"), "page_id").withColumn("n", n).withColumn("page", F.floor((F.col("n") + 2) / 3).cast("int"))
    organisation = F.expr("element_at(array('Our  Org', 'our &#111;rg', 'Other Org'), cast(page_id % 3 as int) + 1)")
    link = F.when(F.col("page_id") % 97 == 5, F.lit("")).otherwise(F.format_string('<a href="/role/%d/?a=1&amp;b">', "page_id"))
    card = F.concat(F.format_string('<div class="card shadow-0 x"><h5 class="t">Role &amp; <b>%d</b></h5><p>Organisation : ', "page_id"), organisation, F.lit("</p>"), link)
    boards = rows.groupBy("board").agg(F.max("page").alias("last"), F.min("page_id").alias("key"))
    pages_ = rows.withColumn("card", card).groupBy("board", "page").agg(F.array_join(F.array_sort(F.collect_list("card")), "").alias("body")).join(boards, "board")
    html = F.concat(F.lit("<h1>Find Volunteer Roles</h1>"), "body", F.when(F.col("page") < F.col("last"), F.format_string('<a href="?page=%d">', F.col("page") + 1)).otherwise(F.lit("")))
    pages_ = pages_.where("not (key % 5 = 0 and page = 2)").select("board", "page", F.concat(F.lit("https://"), "board", F.lit("/find")).alias("base"), html.alias("html"))
    found, refused = listings.card_listing(pages_, boards.select("board", F.lit("OUR org").alias("organisation")))
    return found.unionByName(refused, allowMissingColumns=True)


def search_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the searches of every host, whose results are its pages, and the searches that are refused: some list a page that
    isn't there or says nothing."""
    of = F.split("url", "/")[2]
    rows = read(spark, sf_dir, "pages").select(of.alias("board"), "page_id")
    number = F.format_string("%08x-0000-0000-0000-%012x", "page_id", "page_id")
    link = F.concat(F.lit('<a href="/PublicEnterprise/EnterpriseGvi?x=1&amp;gviGuid='), F.upper(number), F.lit('" class="r"> Listed <i>'), F.col("page_id").cast("string"), F.lit("</i>\n</a>"))
    searches = rows.withColumn("link", link).groupBy("board").agg(F.array_join(F.array_sort(F.collect_list("link")), " ").alias("links"))
    searches = searches.select("board", F.concat(F.lit("Search Volunteer Opportunities "), "links", "links").alias("html"))
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta name="a" property="og:title" content="Offer &lt;'), F.col("page_id").cast("string"), F.lit('&gt;">'))).otherwise(F.lit(""))
    said = F.when(F.col("page_id") % 89 == 3, F.lit("")).otherwise(F.concat(F.lit('<META property="og:description" content="Text &amp; more '), F.col("page_id").cast("string"), F.lit('">')))
    details = rows.where("page_id % 101 <> 7").select("board", number.alias("number"), F.concat(own, said).alias("html"))
    found, refused = listings.search_listing(searches, details)
    return found.drop("number").unionByName(refused, allowMissingColumns=True)


def documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON documents with their orders nested, written, read again with their schema, and unnested: in the order of
    files, then of places."""
    orgs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("organisation"))
    roles = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("org_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("commitment"), F.struct(F.col("o_orderstatus").alias("dbs"), (F.col("o_orderkey") % 2 == 0).alias("interview")).alias("screening"))
    folder, docs = fresh_path(spark, "documents"), sinks.documents(orgs, roles)
    sinks.write_documents(docs.drop("org_id"), folder)
    again = documents.json_documents(spark, folder, docs.drop("org_id").schema, single=True)
    place = F.row_number().over(Window.partitionBy("of_org").orderBy("ord"))
    return documents.roles_of(again.withColumn("_file", F.concat("_file", F.format_string("#%012d", "organisation.id")))).withColumn("place", place).select("of_org", "place", "id", "commitment", "screening.dbs", "screening.interview")


def table_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after two replacements under a lock: one that passes its check, and one that fails and changes nothing."""
    path = fresh_path(spark, "swap")
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_totalprice as price")

    def positive(found: DataFrame) -> None:
        if found.where("price <= 0").limit(1).count():
            raise ValueError("a price that isn't positive")

    sinks.replaced(rows, path, positive)
    sinks.replaced(rows.withColumn("price", F.col("price") * 2), path, positive)
    try:
        sinks.replaced(rows.withColumn("price", -F.col("price")), path, positive)
    except ValueError:
        pass
    return spark.read.parquet(path)


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested roles by dotted paths: one set, one read, and whether texts and lists claim anything."""
    df = _role_records(spark, sf_dir, False)
    role = F.struct(*df.columns)
    new = changes.with_value(changes.with_value(role, "screening.age.least", F.col("o_orderkey") % 50), "status", F.lower("status"))
    return df.select("o_orderkey", new["screening"]["age"]["least"].alias("least"), new["screening"]["dbs"].alias("dbs"), new["status"].alias("status"), values.asserted(F.when(F.col("o_orderkey") % 3 == 0, F.lit("unknown")).otherwise(F.col("status")), "O").alias("said"), values.asserted_list(F.col("stated_places")).alias("places"))


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a label, markers in comments, secrets, marks and white space, of texts made from orders."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Intro\n  LOCATION :  Hall "), k.cast("string"), F.lit("  \nHours: 4\n\n\n\nx \t y "), F.when(k % 2 == 0, F.concat(F.lit("<!-- health level=broken waiting="), k.cast("string"), F.lit(",b -->"))).otherwise(F.lit("<!-- health -->")), F.lit(" key_"), F.lpad(k.cast("string"), 24, "z"), F.lit(" *bold* [a](b)"))
    df = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    c = F.col("text")
    return df.select("o_orderkey", T.labelled_line(c, "Location").alias("location"), T.labelled_line(c, "Pay").alias("pay"), T.marker(c, "waiting").alias("waiting"), T.redacted(c, 400).alias("redacted"), T.markdown_safe(F.substring_index(c, " ", -2)).alias("safe"), T.clean_lines(c).alias("clean"))


def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of small pieces of HTML made from parts: breaks and blocks end lines, scripts go, references are decoded."""
    name = F.col("p_name")
    html = F.concat(F.lit("<p class='x'>"), name, F.lit(" &amp; more</p><script>var a = '<p>';</script><ul><li>One</li><LI>"), F.col("p_brand"), F.lit("&#33;</LI></ul>a<br/>b <b>c</b>&nbsp;d"))
    return read(spark, sf_dir, "part").select("p_partkey", web.html_to_text(html).alias("text"))


def sparse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders as records state, as JSON: blank, unknown and empty fields are left out at any depth."""
    df = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "case o_orderkey % 4 when 0 then ' ' when 1 then 'unknown' else o_orderpriority end as priority",
        "named_struct('name', if(o_orderkey % 3 = 0, null, concat('org ', o_custkey)), 'number', if(o_orderkey % 6 = 3, '', 'n1')) as org",
        "case o_orderkey % 5 when 0 then array() when 1 then array('', 'unknown') when 2 then array('N', '', 'S') end as zones",
        "if(o_orderkey % 7 = 0, array(named_struct('place', 'unknown')), array(named_struct('place', 'x'), named_struct('place', null))) as places",
    )
    return sinks.sparse(df, ["id", "priority", "org", "zones", "places"], "record").select("record")


QUERIES = {f.__name__: f for f in (schema_violations, record_diff, merge_findings, issue_log, page_updates, card_roles, search_offers, documents_round_trip, table_swapped, record_fields, text_rules, html_lines, sparse_records)}

ORACLE = {
    "schema_violations": """with o as (select *, case when o_orderkey % 41 = 0 then 'order ' || o_orderkey else 'o-' || o_orderkey end id, strftime(o_orderdate, '%Y-%m-%d') "day" from orders),
i as (select o.id, o.o_orderkey k, l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey) - 1 as place, count(*) over (partition by l_orderkey) n from o join lineitem l on l_orderkey = o_orderkey),
v as (
select id, 'id' path, 'doesn''t match ^o-[0-9]+$' message from o where o_orderkey % 41 = 0
union all select id, 'status', 'isn''t one of F, O' from o where o_orderstatus = 'P'
union all select id, 'priority', 'is missing' from o where o_orderkey % 43 = 0
union all select id, 'priority', 'has fewer than 6 characters' from o where o_orderkey % 43 <> 0 and length(o_orderpriority) < 6
union all select id, 'priority', 'has more than 10 characters' from o where o_orderkey % 43 <> 0 and length(o_orderpriority) > 10
union all select id, 'total', 'is less than 2000' from o where o_totalprice < 2000
union all select id, 'total', 'is more than 400000' from o where o_totalprice > 400000
union all select id, 'note', 'has more than 12 characters' from o where o_orderkey % 47 = 0
union all select id, 'placed', 'is missing' from o where o_orderkey % 53 = 0
union all select id, 'placed.day', 'doesn''t match ^199[5-9]-' from o where o_orderkey % 53 <> 0 and o_orderdate >= timestamp '2000-01-01'
union all select id, 'placed.clerk', 'is more than 900' from o where o_orderkey % 53 <> 0 and o_custkey > 900
union all select id, 'flags', 'holds an item twice' from o where o_orderkey % 59 = 0
union all select id, 'flags.1', 'isn''t one of A, N, R' from o where o_orderkey % 59 = 1
union all select id, 'items', 'has fewer than 1 items' from o where o_orderkey not in (select l_orderkey from lineitem)
union all select distinct id, 'items', 'has more than 6 items' from i where n > 6
union all select id, 'items.' || place || '.quantity', 'isn''t of type integer' from i where l_linenumber = 3 and k % 29 = 0
union all select id, 'items.' || place || '.quantity', 'is more than 48' from i where l_quantity + case when l_linenumber = 3 and k % 29 = 0 then 0.5 else 0 end > 48
union all select id, 'items.' || place || '.ship', 'is missing' from i where l_linenumber = 2 and k % 31 = 0
union all select id, 'items.' || place || '.ship.flag', 'isn''t one of A, N' from i where not (l_linenumber = 2 and k % 31 = 0) and l_returnflag = 'R'
union all select id, 'items.' || place || '.ship.dock', 'is an unknown key' from i where not (l_linenumber = 2 and k % 31 = 0) and k % 37 = 0
union all select id, 'extra', 'is an unknown key' from o where o_orderkey % 61 = 0)
select id, path, id || ': ' || path || ' - ' || message as "text" from v""",
    "documents_round_trip": "select o_custkey of_org, row_number() over (partition by o_custkey order by o_orderkey) place, o_orderkey id, case when o_orderkey % 3 > 0 then o_orderpriority end commitment, o_orderstatus dbs, o_orderkey % 2 = 0 interview from orders join customer on c_custkey = o_custkey",
    "table_swapped": "select o_orderkey id, o_totalprice * 2 price from orders",
    "record_fields": "select o_orderkey, o_orderkey % 50 least, o_orderpriority dbs, lower(o_orderstatus) status, o_orderkey % 3 <> 0 and o_orderstatus <> 'O' said, o_orderkey % 10 >= 5 places from orders where o_orderkey % 4 <> 1",
    "text_rules": """with t as (select o_orderkey k, case when o_orderkey % 2 = 0 then '<!-- health level=broken waiting=' || o_orderkey || ',b -->' else '<!-- health -->' end m, lpad(o_orderkey::varchar, 24, 'z') z from orders)
select k o_orderkey, 'Hall ' || k "location", null pay, case when k % 2 = 0 then k || ',b' end waiting,
 'Intro' || chr(10) || '  LOCATION :  Hall ' || k || '  ' || chr(10) || 'Hours: 4' || repeat(chr(10), 4) || 'x ' || chr(9) || ' y ' || m || ' [redacted] *bold* [a](b)' redacted,
 '\\*bold\\* \\[a\\]\\(b\\)' safe, 'Intro' || chr(10) || ' LOCATION : Hall ' || k || ' ' || chr(10) || 'Hours: 4' || repeat(chr(10), 2) || 'x y ' || m || ' key_' || z || ' *bold* [a](b)' clean from t""",
    "html_lines": "select p_partkey, p_name || ' & more' || chr(10) || 'One' || chr(10) || p_brand || '!' || chr(10) || 'a' || chr(10) || 'b c d' as \"text\" from part",
    "sparse_records": """select '{"id":' || o_orderkey || case when o_orderkey % 4 > 1 then ',"priority":"' || o_orderpriority || '"' else '' end
 || case when o_orderkey % 6 = 3 then '' else ',"org":{' || case when o_orderkey % 3 = 0 then '' else '"name":"org ' || o_custkey || '",' end || '"number":"n1"}' end
 || case when o_orderkey % 5 = 2 then ',"zones":["N","S"]' else '' end || case when o_orderkey % 7 = 0 then '' else ',"places":[{"place":"x"}]' end || '}' record from orders""",
    "card_roles": """with r as (select string_split(url, '/')[3] board, page_id, row_number() over (partition by string_split(url, '/')[3] order by page_id) n from pages), p as (select *, (n + 2) // 3 page from r),
b as (select board, max(page) l, min(page_id) k, bool_or(page_id % 97 = 5 and not (key % 5 = 0 and page = 2)) broken from (select *, min(page_id) over (partition by board) key from p) group by board),
x as (select board, case when broken then 'a card can''t be read' when k % 5 = 0 and l > 2 then 'pages are missing' when k % 5 = 0 and l = 2 then 'a page that the last one names is missing' when l >= 20 and false then '' end reason from b)
select board, 'Role & ' || page_id title, 'https://' || board || '/role/' || page_id || '/?a=1&b' link, null reason from p join x using (board) where reason is null and page_id % 3 < 2
union all select board, null, null, reason from x where reason is not null""",
    "search_offers": """with r as (select string_split(url, '/')[3] board, page_id from pages), b as (select board, count(*) n, min(page_id) filter (page_id % 101 = 7 or page_id % 89 = 3) bad from r group by board),
x as (select board, case when n >= 200 then 'too many results' when bad is not null then 'result ' || printf('%08x', bad) || ' has no description' end reason from b)
select board, case when page_id % 2 = 0 then 'Offer <' || page_id || '>' else 'Listed ' || page_id end title, 'Text & more ' || page_id description, null reason from r join x using (board) where reason is null
union all select board, null, null, reason from x where reason is not null""",
    "merge_findings": """with o as (select o_custkey org_id, o_orderkey k, o_orderstatus st, o_orderpriority p, o_totalprice price, o_custkey % 9 <> 0 batch, o_custkey % 9 <> 0 and o_custkey % 7 <> 0 well from orders),
a as (select *, well and k % 5 < 3 found, well and k % 13 = 0 dead, k % 3 = 0 or k % 5 = 0 gone from o),
m as (select *, found and (k % 11 = 0 or k % 6 = 0 or k % 10 = 0) and  not dead upd from a where not (dead and gone))
select org_id, k id, case when dead then 'unknown' when upd and k % 11 = 0 then null else st end status,
 case when upd and k % 6 = 0 then '0-NOW' else p end commitment, case when upd and k % 10 = 0 then p || ',more' else p end skills,
 case when dead and k % 4 = 0 then 'dbs,status' when dead then 'status' when k % 4 = 0 then 'dbs' end unsupported, price from m
union all select org_id, -k, 'F', p, 'new', null, null from o where well and k % 8 = 3""",
    "issue_log": """with recursive r as materialized (select user_id key, event_id ord, row_number() over (partition by user_id order by ts, event_id) i,
 case event_type when 'error' then 2 when 'purchase' then 1 when 'click' then 1 else 0 end lv,
 case when event_type in ('error', 'purchase', 'click') then ['w' || event_id % 3, 'x' || event_id % 2] else []::varchar[] end waiting, user_id % 2 = 0 weekly, event_id % 5 < 2 keep from events),
s as (select key, 0::bigint i, null::bigint ord, 0 lv, 0 was, []::varchar[] waiting, []::varchar[] seen, 0::bigint number, false passed, false weekly from (select distinct key from r)
union all select r.key, r.i, r.ord, case when r.keep and s.lv = 2 then s.lv else r.lv end, s.lv, case when r.keep and s.lv = 2 then s.waiting else r.waiting end, s.waiting,
 s.number + case when not (r.keep and s.lv = 2) and s.lv = 0 and r.lv > 0 then 1 else 0 end, r.keep and s.lv = 2, r.weekly from s join r on r.key = s.key and r.i = s.i + 1),
f as (select s.*, r.lv own, list_filter(s.waiting, lambda x: not list_contains(s.seen, x)) fresh from s join r on r.key = s.key and r.i = s.i)
select key, ord, case own when 2 then 'broken' when 1 then 'attention' else 'ok' end "level",
 case when passed then 'left broken' when lv = 0 and was = 0 then 'nothing' when lv = 0 then 'closed' when was = 0 then 'opened' else 'updated' end "action",
 case when passed then null when lv = 0 and was > 0 then 'all clear' when lv = 0 or was = 0 then null when lv > was then 'worse' when weekly and lv = 2 then 'still broken' when len(fresh) > 0 then 'waiting: ' || array_to_string(fresh, ', ') end "comment", number from f""",
    "page_updates": """with r as (select o_orderpriority door, c_mktsegment || '/' || c_nationkey facet, o_custkey c from orders join customer on o_custkey = c_custkey),
f as (select door, facet, bool_or(c = 1 or c between 2 and 50) touched, bool_and(c between 2 and 50) emptied from r group by all)
select door, facet, case when emptied then 'removed' when touched then 'written' else 'kept' end "action" from f
union all select distinct door, 'new facet', 'written' from r where c = 7""",
    "record_diff": """with d as (select o_orderkey n, n % 4 <> 1 old, n % 6 <> 0 new from orders)
select n o_orderkey, case when not old then 'added' when not new then 'gone' else 'pair' end kind, case
 when not old then 'eligibility,intake,screening.age.least,screening.dbs,season.end,season.start,skills,stated_places,status'
 when not new then 'status'
 else array_to_string(list_filter([
  case when n % 11 = 0 then 'eligibility' end, case when n % 13 = 0 then 'intake' end, case when n % 9 = 0 then 'screening.age.least' end,
  case when n % 7 = 0 then 'screening.dbs' end, case when n % 12 = 0 then 'season.end' end, case when n % 12 = 0 then 'season.start' end,
  case when n % 8 = 2 then 'skills' end, case when n % 10 = 0 and n % 10 >= 5 then 'stated_places' end, case when n % 5 = 0 then 'status' end], lambda x: x is not null), ',') end changed
from d where old or new""",
}
