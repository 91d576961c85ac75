"""Queries over events: freshness, runs, allowances, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import values as V
from lodestar.operators import geometry, runs
from lodestar.plans.tables import read
from lodestar.sources import loose
from lodestar.sources.scratch import fresh_path
from lodestar.streaming import checks, states

NOW = "timestamp '2024-02-19 12:00:00'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    age = V.age_days(F.when(F.col("event_type") != "signup", F.col("last")), F.expr(NOW))
    out = last.select("user_id", "event_type", age.alias("age"))
    state = V.freshness(F.col("age"))
    return out.select("*", state.alias("state"), V.suppressed(state, F.when(F.col("event_type") == "error", F.lit("dead"))).alias("hidden"))


def freshness_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age in whole days, state and suppression of each user and type; signups count as never checked."""
    return _fresh(spark, sf_dir)


def freshness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median age, oldest, suppressed and banner over all of them."""
    return runs.freshness_summary(_fresh(spark, sf_dir), "age", "hidden").drop("rows")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of groups of outcomes in one pass."""
    return runs.outcome_counts(read(spark, sf_dir, "events"), F.col("event_type"), {"failed": ("error",), "read": ("view", "click"), "done": ("purchase", "signup")})


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbroken runs of errors of each user."""
    return runs.failure_runs(read(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


def trailing_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's sum of the last hour, and whether it passes a budget."""
    df = _events(spark, sf_dir)
    out = runs.trailing_sum(df, "user_id", F.unix_seconds("ts"), F.col("value").cast("decimal(18,2)"), 3600)
    return out.select("event_id", F.col("trailing").cast("double").alias("trailing"), (F.col("trailing") > 100).alias("waits"))


def allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cap of 8 a user and day, and a budget for 7, still grant to each event's ask."""
    df = _events(spark, sf_dir).withColumns({"day": F.to_date("ts"), "asked": (F.col("event_id") % 7).cast("long")})
    return runs.allowance(df, ["user_id", "day"], [F.col("ts"), F.col("event_id")], F.col("asked"), 8, usd=0.7, cost=0.1).select("event_id", "asked", "granted")


def exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without a purchase before a day."""
    df = read(spark, sf_dir, "events")
    early = df.where("event_type = 'purchase' and ts < timestamp_ntz '2024-01-04 00:00:00'").select("user_id").distinct()
    return df.select("user_id").distinct().join(early, "user_id", "left_anti")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of a JSON property; payloads without it are refused rows of their own."""
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("parsed"), F.count_if(k.isNull()).alias("refused"), F.sum(k.cast("long")).alias("total"))


_PAYLOAD = """case event_id % 23 when 0 then concat('[', props, ']') when 1 then '{"k": "7"}' when 2 then '{"k": null}' when 3 then substring(props, 1, length(props) - 1)
 when 4 then '{"k": 2.5}' when 5 then '{}' when 6 then concat('{"k": 3, "tags": ', event_id % 3, '}') when 7 then '{"k": 4, "by": {"name": "x"}, "tags": ["a"]}' when 8 then '{"k": 4, "by": {"name": 5}}'
 when 9 then '' when 10 then null else props end"""
_SHAPE = {"$": "object", "$.k": "whole", "$.tags": "list?", "$.by": "object?", "$.by.name": "text?"}


def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as variants; payloads that are cut, null, or of another shape are refused rows with a reason."""
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_PAYLOAD).alias("payload"))
    return loose.shaped(rows, "payload", _SHAPE, {"k": "$.k", "name": "$.by.name"})


def whole_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose listing must be refused as a whole: a user's events are pages of four, some refused, some missing."""
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_PAYLOAD).alias("payload"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = loose.shaped(rows, "payload", _SHAPE, {"k": "$.k"}).withColumn("page", F.floor((n + 3) / 4).cast("int"))
    # What a page lacks isn't a reason here unless it is cut; users of a kind lack their second page, some name another one.
    pages = rows.where("not (user_id % 3 = 0 and page = 2)").groupBy("user_id", "page").agg(F.min(F.when(F.col("user_id") % 5 == 0, F.when(F.col("refused") == "isn't JSON", F.col("refused")))).alias("refused"))
    last = pages.groupBy("user_id").agg(F.max("page").alias("last"))
    pages = pages.join(last, "user_id").withColumn("more", (F.col("page") < F.col("last")) | (F.col("user_id") % 7 == 0))
    return loose.whole_listing(pages, "user_id", 17)


def state_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check state of each user after the last event of the first half and one of the second."""
    df = read(spark, sf_dir, "events")
    order = [F.desc("ts"), F.desc("event_id")]
    first = checks.latest(df.where("ts < timestamp_ntz '2024-01-16 00:00:00'"), "user_id", order)
    state = first.select("user_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failures"), F.col("event_type").alias("content_hash"))
    second = checks.latest(df.where("ts >= timestamp_ntz '2024-01-16 00:00:00'"), "user_id", order)
    fetch = second.select("user_id", (F.col("event_type") != "error").alias("ok"), F.when(F.col("value") > 40, 403).otherwise(200).alias("status"), F.col("event_type").alias("digest"))
    return checks.advanced(state, fetch, "user_id")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type of the days that are closed, as a stream that reads all there is now."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = checks.event_counts(spark, f"{sf_dir}/events*.parquet", schema)
    stream = stream.select(F.col("w.start").cast("string").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
    return checks.run_available(stream, fresh_path(spark, "stream"))


_STALE = 2 * 86_400
_HALF = "2024-01-16 00:00:00"


def check_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's checks after every event, as a stream that reads the first half of the month, stops, and goes
    on from its checkpoint with the second half; and the times at which a user went two days without a success."""
    fetches = _events(spark, sf_dir).selectExpr(
        "user_id as source",
        "unix_micros(ts) as at",
        "event_id as ord",
        "case when event_type = 'signup' and value > 35 then 'blocked' when event_type = 'error' then if(value > 20, 'refused', 'failed') else 'read' end as status",
        "event_type = 'click' as redirected",
        "cast(get_json_object(props, '$.k') % 3 as string) as digest",
        "case event_id % 8 when 0 then 'deferred' when 1 then 'confirmed' when 2 then 'published' when 3 then 'held' when 4 then 'broken' when 5 then 'confirmed' when 6 then 'held' end as reading",
        "ts",
    )
    folder = fresh_path(spark, "states")
    for half in (f"ts < timestamp '{_HALF}'", f"ts >= timestamp '{_HALF}'"):
        fetches.where(half).drop("ts").write.mode("append").parquet(f"{folder}/arrivals")
        out = states.checked(spark, f"{folder}/arrivals", folder, _STALE)
    return out


def simplify_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values over time as a line with fewer points."""
    point = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("x"), F.col("value").alias("y"))
    lines = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("line"))
    out = lines.select("user_id", F.size("line").alias("before"), geometry.simplify_line(F.col("line"), 20.0).alias("line"))
    return out.select("user_id", "before", F.size("line").alias("after"))


def ring_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centroid of the ring of each user's points; a user's events are a ring that fits a row."""
    point = F.struct(F.col("ts"), F.col("event_id"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    rings = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("ring")).where(F.size("ring") >= 3)
    c = geometry.centroid(F.col("ring"))
    return rings.select("user_id", F.round(geometry.doubled_area(F.col("ring")) / 2, 3).alias("area"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"))


def daily_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day and the change from the day before."""
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return runs.change_from_last(days, [F.col("day")], "n").select(F.col("day").cast("string").alias("day"), "n", "delta")


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by how long ago they bought, those who never did first."""
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last")).withColumn("ord", F.col("user_id"))
    return runs.repair_queue(last, "last").select("user_id", "place")


QUERIES = {f.__name__: f for f in (freshness_by_key, freshness_summary, outcome_counts, failure_runs, trailing_sum, allowance, exclude_seen, json_props, loose_json, whole_listings, state_after_batch, check_states, stream_counts, simplify_line, ring_centroids, daily_change, queue_order)}

_FRESH = f"""newest as (select user_id, event_type, max(ts) t from events group by all), fresh as (select user_id, event_type, case when event_type <> 'signup' then greatest(0, date_sub('day', t, {NOW})) end age from newest),
states as (select *, case when age is null then 'never_checked' when age >= 21 then 'stale' else 'fresh' end state from fresh),
shown as (select *, state <> 'fresh' or event_type = 'error' hidden from states)"""

ORACLE = {
    "freshness_by_key": f"with {_FRESH} select * from shown",
    "freshness_summary": f"with {_FRESH}, a as (select list_sort(list(age) filter (age is not null)) s, max(age) oldest, count(*) filter (hidden) suppressed from shown) select s[len(s) // 2 + 1] median_age, oldest, suppressed, coalesce(s[len(s) // 2 + 1] >= 60, true) banner from a",
    "outcome_counts": "select count(*) filter (event_type = 'error') failed, count(*) filter (event_type in ('view', 'click')) \"read\", count(*) filter (event_type in ('purchase', 'signup')) done from events",
    "failure_runs": "with m as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) run from events) select user_id, run, count(*) length, count(*) >= 2 dead from m where event_type = 'error' group by user_id, run",
    "trailing_sum": "with s as (select *, cast(floor(epoch(ts)) as bigint) sec from events), t as (select event_id, sum(cast(value as decimal(18,2))) over (partition by user_id order by sec range between 3599 preceding and current row) t from s) select event_id, cast(t as double) \"trailing\", t > 100 waits from t",
    "allowance": "with a as (select *, event_id % 7 asked from events) select event_id, asked, greatest(0, least(asked, 7 - coalesce(sum(asked) over (partition by user_id, cast(ts as date) order by ts, event_id rows between unbounded preceding and 1 preceding), 0))) granted from a",
    "exclude_seen": "select distinct user_id from events where user_id not in (select user_id from events where event_type = 'purchase' and ts < timestamp '2024-01-04')",
    "json_props": "select event_type, count(cast(props->>'k' as int)) parsed, count(*) filter (cast(props->>'k' as int) is null) refused, sum(cast(props->>'k' as int)) total from events group by event_type",
    "loose_json": """select event_id, case event_id % 23 when 0 then '$ is of kind list, not object' when 1 then '$.k is of kind text, not whole' when 2 then '$.k is of kind nothing, not whole' when 3 then 'isn''t JSON'
 when 4 then '$.k is of kind number, not whole' when 5 then '$.k is missing' when 6 then '$.tags is of kind whole, not list' when 8 then '$.by.name is of kind whole, not text' when 9 then 'isn''t JSON' when 10 then 'isn''t JSON' end refused,
 case when event_id % 23 = 7 then 4 when event_id % 23 > 10 then cast(props->>'k' as bigint) end k, case when event_id % 23 = 7 then 'x' end "name" from events""",
    "whole_listings": """with r as (select user_id, event_id, (row_number() over (partition by user_id order by ts, event_id) + 3) // 4 page from events),
p as (select user_id, page, bool_or(user_id % 5 = 0 and event_id % 23 in (3, 9, 10)) bad from r where not (user_id % 3 = 0 and page = 2) group by all),
b as (select user_id, count(*) n, max(page) l, min(page) filter (bad) bad, user_id % 7 = 0 more from p group by user_id)
select user_id, case when bad is not null then 'page ' || bad || ': isn''t JSON' when n <> l then 'pages are missing' when more and l >= 17 then 'has more than 17 pages' else 'ends before its last page' end reason
from b where bad is not null or n <> l or more""",
    "state_after_batch": """with e as (select * from events),
a as (select * from e where ts < timestamp '2024-01-16' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
b as (select * from e where ts >= timestamp '2024-01-16' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select coalesce(a.user_id, b.user_id) user_id,
 case when b.user_id is null then case when a.event_type = 'error' then 1 else 0 end when b.event_type <> 'error' then 0 else coalesce(case when a.event_type = 'error' then 1 else 0 end, 0) + case when b.value > 40 then 0 else 1 end end failures,
 a.event_type content_hash,
 case when b.user_id is null then null when b.value > 40 then 'refused' when b.event_type = 'error' then case when coalesce(case when a.event_type = 'error' then 1 else 0 end, 0) + 1 >= 2 then 'dead' else 'failed' end when b.event_type is not distinct from a.event_type then 'unchanged' else 'changed' end outcome
from a full join b on a.user_id = b.user_id""",
    "check_states": f"""with f as (select user_id source, epoch_us(ts) "at", event_id ord,
  case when event_type = 'signup' and value > 35 then 'blocked' when event_type = 'error' then case when value > 20 then 'refused' else 'failed' end else 'read' end status,
  event_type = 'click' redirected, cast(cast(props->>'k' as int) % 3 as varchar) digest,
  case event_id % 8 when 0 then 'deferred' when 1 then 'confirmed' when 2 then 'published' when 3 then 'held' when 4 then 'broken' when 5 then 'confirmed' when 6 then 'held' end reading from events),
b as (select *, status = 'read' and coalesce(reading in ('confirmed', 'published'), false) agrees,
  last_value(case when status = 'read' and reading in ('confirmed', 'published') then digest end ignore nulls) over (w rows between unbounded preceding and 1 preceding) base from f window w as (partition by source order by "at", ord)),
u as (select *, status = 'read' and digest is not distinct from base same from b),
r as (select *, sum(case when status = 'read' then 1 else 0 end) over (w rows unbounded preceding) run,
  last_value(case when agrees or same then digest end ignore nulls) over (w rows unbounded preceding) baseline,
  last_value(case when agrees or same then "at" end ignore nulls) over (w rows unbounded preceding) success,
  last_value(case when status = 'read' and not same and reading in ('confirmed', 'published', 'held', 'broken') then "at" end ignore nulls) over (w rows unbounded preceding) extraction from u window w as (partition by source order by "at", ord)),
n as (select *, cast(sum(case when status = 'failed' then 1 else 0 end) over (partition by source, run order by "at", ord rows unbounded preceding) as int) failures from r),
l as (select *, last_value(case when status = 'blocked' then 'link_only' when status = 'failed' and failures >= 2 then 'dead' when status = 'read' then case when redirected then 'redirected' else 'ok' end end ignore nulls) over w link from n window w as (partition by source order by "at", ord rows unbounded preceding)),
s as (select *, lead("at") over (partition by source order by "at", ord) after, lead(success) over (partition by source order by "at", ord) later from l)
select source, "at", ord, case status when 'blocked' then 'link_only' when 'refused' then 'source_refused' when 'failed' then 'source_failed' else
  case when same then 'unchanged' else coalesce(case reading when 'deferred' then 'ai_deferred' when 'held' then 'review_required' when 'broken' then 'extraction_failed' else reading end, 'ai_unavailable') end end outcome,
  link, failures, baseline, success, extraction from l
union all
select source, success + {_STALE}000000, null, 'stale', link, failures, baseline, success, extraction from s
where success is not null and "at" < success + {_STALE}000000 and coalesce(after, 1::bigint << 62) >= success + {_STALE}000000 and success + {_STALE}000000 <= (select max("at") from f)""",
    "stream_counts": "select cast(date_trunc('day', ts) as timestamp)::varchar \"day\", event_type, count(*) n, round(sum(value), 2) total from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 2 day group by all",
    "simplify_line": """with recursive p as materialized (select user_id u, floor(epoch(ts))::double x, value y, row_number() over (partition by user_id order by floor(epoch(ts)), value) i from events),
n as (select u, max(i) n from p group by u),
v as (select u, 1::bigint lo, n hi, 0::bigint keep from n where n >= 2
 union all select u, unnest([lo, mid]), unnest([mid, hi]), unnest([mid, 0]) from (
  select u, lo, hi, -f.i mid from (select v.u, v.lo, v.hi, max({'d': coalesce(abs((b.x - a.x) * (a.y - p.y) - (a.x - p.x) * (b.y - a.y)) / nullif(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 0), sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y))), 'i': -p.i}) f
   from v join p a on a.u = v.u and a.i = v.lo join p b on b.u = v.u and b.i = v.hi join p on p.u = v.u and p.i > v.lo and p.i < v.hi group by v.u, v.lo, v.hi) where f.d > 20)),
k as (select u, count(distinct keep) filter (keep > 0) kept from v group by u)
select n.u user_id, n.n::int "before", (least(n.n, 2) + coalesce(kept, 0))::int "after" from n left join k on k.u = n.u""",
    "ring_centroids": """with g as (select user_id, value x, cast(event_id % 100 as double) y, row_number() over w n, count(*) over (partition by user_id) c from events window w as (partition by user_id order by ts, event_id)), h as (select a.user_id, a.n, a.x, a.y, b.x x2, b.y y2 from g a join g b on a.user_id = b.user_id and b.n = a.n % a.c + 1 where a.c >= 3),
s as (select user_id, sum(x * y2 - x2 * y order by n) d, sum((x + x2) * (x * y2 - x2 * y) order by n) sx, sum((y + y2) * (x * y2 - x2 * y) order by n) sy from h group by user_id)
select user_id, round(d / 2, 3) area, round(case when d <> 0 then sx / (3 * d) end, 3) cx, round(case when d <> 0 then sy / (3 * d) end, 3) cy from s""",
    "daily_change": "with d as (select cast(ts as date) d, count(*) n from events group by 1) select cast(d as varchar) \"day\", n, n - lag(n) over (order by d) delta from d",
    "queue_order": "with l as (select user_id, max(ts) filter (event_type = 'purchase') l from events group by user_id) select user_id, row_number() over (order by l nulls first, user_id) place from l",
}
