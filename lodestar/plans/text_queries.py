"""Queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import values as V
from lodestar.functions import web
from lodestar.operators import changes, pages, runs
from lodestar.plans.tables import read


def _words(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return read(spark, sf_dir, name).select(key, T.words(F.col("text")).alias("w"))


def _hits(spark: SparkSession, sf_dir: str, items: DataFrame | None = None, n: int = 8) -> DataFrame:
    """doc_id, item_id, run: the runs of n words that a document and an item (item_id, w, n; default: the benchmark's) share.

    A document's positions travel as hashes of their runs alone. Only the few that meet an item's hash are joined with the
    document's words again, made strings and compared, so that a hash decides nothing.
    """
    items = items if items is not None else _words(spark, sf_dir, "benchmark", "item_id").withColumn("n", F.lit(n))
    known = items.select("item_id", "n", F.explode(T.shingles(F.col("w"), F.col("n"))).alias("run")).withColumn("h", F.xxhash64(F.transform(F.split("run", " "), lambda x: F.xxhash64(x))))
    lengths = known.agg(F.collect_set("n").alias("sizes"))  # one row; callers have few lengths
    docs = _words(spark, sf_dir, "documents", "doc_id").select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    docs = docs.crossJoin(F.broadcast(lengths)).select("doc_id", "w", F.explode("sizes").alias("n"))
    # A text of fewer words has no start; a filter on its words would split the text into words twice.
    starts = F.when(F.size("w") >= F.col("n"), F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    each = docs.select("doc_id", "n", F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, F.col("n"))))).alias("at", "h"))
    met = each.join(known.select("item_id", "n", "h").distinct(), ["n", "h"])
    own = met.join(_words(spark, sf_dir, "documents", "doc_id"), "doc_id").select("doc_id", "item_id", "n", "h", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("own"))
    return own.join(known, ["item_id", "n", "h"]).where("own = run").select("doc_id", "item_id", "run").distinct()


def copy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a run of eight words with a benchmark item, and with how many runs."""
    return _hits(spark, sf_dir).select("doc_id", "run").distinct().groupBy("doc_id").agg(F.count("*").alias("hits"))


def copy_check_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share a run, with the least shared one."""
    return _hits(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.min("run").alias("span"))


def _sections(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    df = read(spark, sf_dir, "conversations")
    if not last:
        ends = df.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("t"))
        df = df.join(ends, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left_anti")
    return df.groupBy("conv_id").agg(web.content_hash(F.collect_list("text")).alias("hash"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each conversation's texts whatever their order."""
    return _sections(spark, sf_dir, True)


def hash_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by whether their digest differs without the last turn."""
    now, before = _sections(spark, sf_dir, True), _sections(spark, sf_dir, False).withColumnRenamed("hash", "old")
    return now.join(before, "conv_id", "left").select("conv_id", F.col("old").isNull().alias("fresh"), (~F.col("hash").eqNullSafe(F.col("old"))).alias("changed"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that several documents have."""
    return changes.taken_clashes(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash")), "hash")


def page_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each registrable site."""
    return read(spark, sf_dir, "pages").groupBy(web.site(F.col("url")).alias("site")).agg(F.count("*").alias("n"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page resolved against it, distinct, and how many stay on its site."""
    more = F.concat(F.col("html"), F.lit("<a href='/single'><a HREF = /bare class=x>"))
    each = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(web.hrefs(more)).alias("href"))
    full = each.select("page_id", "url", web.absolute(F.col("url"), F.col("href")).alias("target")).distinct()
    return full.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(web.same_site(F.col("url"), F.col("target"))).alias("own"), F.min("target").alias("first"))


def page_role_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links worth following, of those that the parser found outside of menus and frames."""
    found = pages.read_pages(read(spark, sf_dir, "pages")).select("page_id", "url", F.posexplode("links").alias("pos", "link"))
    menus = read(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(web.hrefs(F.col("html"))).alias("pos", "href"))
    # the pages' own links are few, so their menus' count as well, as listings of roles below the page
    below = menus.select("page_id", "url", (F.col("pos") + 1000).alias("pos"), F.concat(F.rtrim(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")), "href").alias("href"), F.substring("href", 2, 90).alias("label"))
    return pages.role_links(found.select("page_id", "url", "pos", "link.href", "link.label").unionByName(below), "page_id", 3)


def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text's length and the share of the rest of each page."""
    out = pages.share_of_chrome(pages.read_pages(read(spark, sf_dir, "pages")))
    return out.select("page_id", F.length("main").alias("n_chars"), "boilerplate", F.size("links").alias("links"))


def page_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date that a document states after the word updated, of texts that such a line is put before or after."""
    k = F.col("doc_id")
    line = F.when(k % 3 == 0, F.concat(F.lit("Last updated: 3rd May 20"), (k % 90 + 10).cast("string"))).when(k % 3 == 1, F.concat(F.lit("updated 2024-05-"), (k % 20 + 10).cast("string")))
    parts = F.when(k % 2 == 0, F.concat_ws("\n", line, "text")).otherwise(F.concat_ws("\n", "text", line))
    docs = read(spark, sf_dir, "documents").select("doc_id", parts.alias("text"))
    return docs.select("doc_id", web.updated_date(F.col("text")).alias("updated"))


def verdict_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on pages in their order, with shares and levels."""
    k = F.col("page_id")
    prose = F.length(F.regexp_replace("html", r"(?s)<[^>]*>", ""))
    status = F.when(k % 20 == 0, 404).when(k % 20 == 7, 503).when(k % 20 == 9, None).otherwise(200)
    df = read(spark, sf_dir, "pages").select(pages.verdict(status, k % 31 == 0, web.looks_client_rendered(F.col("html"), F.when(k % 2 == 0, 0).otherwise(prose)), F.col("url").contains("#top"), F.when(k % 5 == 0, prose % 1000).otherwise(prose), F.when(k % 3 == 0, 0).otherwise(2)).alias("verdict"))
    return runs.verdict_counts(df, F.col("verdict"), ["clean", "thin", "redirected", "client_rendered", "dead", "blocked"], "clean")


def derived_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed share of the labelled documents of each source."""
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    out = df.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") == 0).alias("bad"))
    return out.select("source", V.confidence(F.col("ok"), F.col("bad"), F.col("source") == "src1").alias("confidence"))


def quote_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items a document quotes from their 20th character on, white space aside; items whose number 7 divides
    give a quote of ten characters.

    A document that holds a quote holds the run of its first four inner whole words: only pairs that share it are looked at.
    Quotes of fewer inner words, which mark no few texts, are looked for in every text.
    """
    length = F.when(F.col("item_id") % 7 == 0, 10).otherwise(60)
    items = read(spark, sf_dir, "benchmark").select("item_id", F.substring("text", F.lit(20), length).alias("quote"))
    tokens = items.withColumn("w", T.words(F.col("quote"))).withColumn("inner", F.size("w") - 2)
    runs_ = tokens.where("inner >= 4").select("item_id", F.slice("w", 2, 4).alias("w"), F.lit(4).alias("n"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    near = _hits(spark, sf_dir, runs_).select("doc_id", "item_id").distinct()
    both = near.join(docs, "doc_id").join(items, "item_id").where(T.quote_supported(F.col("quote"), F.col("text"))).select("doc_id", "item_id")
    # A quote supports itself where it can count at all; texts are squeezed once, before they meet the quotes.
    short = tokens.where("inner < 4").where(T.quote_supported(F.col("quote"), F.col("quote"))).select("item_id", T.squeezed(F.col("quote")).alias("q"))
    flat = docs.select("doc_id", T.squeezed(F.col("text")).alias("flat"))
    return both.union(flat.join(short, F.col("flat").contains(F.col("q"))).select("doc_id", "item_id")).distinct()


def near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document names a place near a title. Both are words of the document or of the benchmark item that its
    number leads to; the title may hold the place, and marks around a place don't count."""
    count = read(spark, sf_dir, "benchmark").agg(F.count("*").alias("items"))
    item = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("of"), F.split(T.squeezed(F.col("text")), " ").alias("w"))
    docs = read(spark, sf_dir, "documents").crossJoin(F.broadcast(count)).withColumn("of", F.col("doc_id") % F.col("items")).withColumn("v", F.split(T.squeezed(F.col("text")), " "))
    k, w, v = F.col("doc_id"), lambda i: F.get("w", F.lit(i)), lambda i: F.get("v", F.lit(i))
    title = F.when(k % 4 == 0, F.concat_ws(" ", w(0), w(1))).when(k % 4 == 1, T.capitals(w(1))).when(k % 4 == 2, v(2))
    place = F.when(k % 3 == 0, F.concat(F.lit(" ;"), w(0), F.lit("."))).when(k % 3 == 1, v(1)).otherwise(v(200))
    both = docs.join(item, "of").select("doc_id", "text", title.alias("title"), place.alias("place"))
    near = T.place_near_title(F.col("text"), F.col("title"), F.col("place"))
    return both.select("doc_id", near.alias("near"), F.size(T.places_stand(F.col("text"), F.col("title"), F.array("place"))).alias("stand"))


def platform_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of platforms that pages lead to and that aren't covered, of pages that such links are added to."""
    k = F.col("page_id")
    more = F.concat(F.lit("<a href='https://www.Volunteer.example.org/x'>a</a><a href=\"//app"), (k % 7).cast("string"), F.lit('.betterimpact.com:8080/y">b</a><a href = "https://other.example.org/">c</a>'))
    covered = F.array(F.lit("app1.betterimpact.com"), F.lit("example.net"))
    hosts = web.unread_hosts(web.platform_hosts(F.concat("html", more), F.when(k % 2 == 0, F.lit("https://volunteer.example.org/")).otherwise(F.col("url"))), covered)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(hosts, ",").alias("hosts"))


QUERIES = {
    f.__name__: f
    for f in (copy_check, copy_check_span, content_hash, hash_changed, duplicate_ids, page_site, page_links, page_role_links, page_main_text, page_updated, verdict_census, derived_confidence, quote_support, near_titles, platform_hosts)
}

_RUNS = """
{0}_w as (select {1}, regexp_extract_all(lower(text), '[a-z0-9'']+') w from {0}),
{0}_r as (select distinct {1}, array_to_string(w[i:i+7], ' ') run from {0}_w, unnest(range(1, len(w) - 6)) u(i) where len(w) >= 8)"""
_BOTH = f"{_RUNS.format('documents', 'doc_id')}, {_RUNS.format('benchmark', 'item_id')}"
_HOST = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
_SITE = "regexp_extract(" + _HOST + ", '[^.]+\\.(?:(?:org|co|ac|gov|nhs)\\.)?[^.]+$')"
_LINKS = f"""e as (select page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') root, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), ['/single', '/bare'])) href from pages),
f as (select distinct page_id, url, regexp_replace(root || href, '#.*$', '') target from e)"""

ORACLE = {
    "copy_check": f"with {_BOTH} select doc_id, count(*) hits from documents_r where run in (select run from benchmark_r) group by doc_id",
    "copy_check_span": f"with {_BOTH} select doc_id, item_id, min(run) span from documents_r join benchmark_r using (run) group by doc_id, item_id",
    "content_hash": "select conv_id, sha256(array_to_string(list_sort(list(text)), chr(10) || chr(10))) hash from conversations group by conv_id",
    "hash_changed": "with a as (select conv_id, sha256(array_to_string(list_sort(list(text)), chr(10) || chr(10))) h from conversations group by conv_id), b as (select conv_id, sha256(array_to_string(list_sort(list(text)), chr(10) || chr(10))) o from (select * from conversations qualify turn <> max(turn) over (partition by conv_id)) group by conv_id) select conv_id, o is null \"fresh\", h is distinct from o changed from a left join b using (conv_id)",
    "duplicate_ids": "select sha256(text) hash, count(*) n from documents group by 1 having count(*) > 1",
    "page_site": f"select {_SITE.format('url')} site, count(*) n from pages group by 1",
    "page_links": f"with {_LINKS} select page_id, count(*) links, count(*) filter ({_SITE.format('url')} = {_SITE.format('target')}) own, min(target) \"first\" from f group by page_id",
    "page_role_links": f"""with e as (select page_id, url, rtrim(regexp_replace(url, '[?#].*$', ''), '/') base, regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*"([^"]*)"', 1) hs from pages),
 l as (select page_id, url, base, unnest(hs) href, unnest(range(len(hs))) pos from e), f as (select *, regexp_replace(base || href, '#.*$', '') f, trim(regexp_replace(substr(href, 2, 90), '\\s+', ' ', 'g')) label from l),
 p as (select *, rtrim(f, '/') target, regexp_extract(base, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) bp, regexp_extract(f, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) fp, label || ' ' || f hay from f),
 q as (select *, bp <> '' and starts_with(fp, bp || '/') under from p where length(label) between 1 and 90 and not regexp_matches(fp, '{pages.FILES}') and {_SITE.format('url')} = {_SITE.format('f')} and target <> rtrim(url, '/') and not regexp_matches(hay, '{pages.BLOCKED}') and (not regexp_matches(hay, '{pages.PAID}') or regexp_matches(hay, '{pages.VOLUNTEER}'))),
 g as (select page_id, target, min_by(under or regexp_matches(f, '{pages.VOLUNTEER}'), pos) strong, min(pos) pos from q where under or regexp_matches(hay, '{pages.HINT}') group by page_id, target)
 select page_id, target, strong, row_number() over (partition by page_id order by strong desc, pos, target) place from g qualify place <= 3""",
    "page_updated": r"""with d as (select doc_id, text, case doc_id % 3 when 0 then 'Last updated: 3rd May 20' || (doc_id % 90 + 10) when 1 then 'updated 2024-05-' || (doc_id % 20 + 10) end line from documents),
 p as (select doc_id, substr(case when doc_id % 2 = 0 then concat_ws(chr(10), line, text) else concat_ws(chr(10), text, line) end, 1, 20000) t from d)
 select doc_id, nullif(trim(regexp_extract(t, '(?i)(?:last\s+)?updated[:\s]*(\d{1,2}(?:st|nd|rd|th)?\s+\w+,?\s+\d{4}|\d{4}-\d{2}-\d{2})', 1)), '') updated from p""",
    "verdict_census": """with v as (select page_id k, url, html, length(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) p from pages), m as (select *, case when k % 5 = 0 then p % 1000 else p end n from v),
 c as (select case when k % 31 = 0 then 'blocked' when k % 20 in (0, 7, 9) then 'dead' when n < 400 then case when (k % 2 = 0 or p < 80) and html ilike '%<script%' then 'client_rendered' else 'thin' end when contains(url, '#top') then 'redirected' when n < 1200 and k % 3 = 0 then 'thin' else 'clean' end verdict from m),
 o as (select unnest(['clean', 'thin', 'redirected', 'client_rendered', 'dead', 'blocked']) verdict, unnest([0, 1, 2, 3, 4, 5]) place),
 g as (select verdict, count(*) n from c group by 1), h as (select verdict, place, coalesce(n, 0) n from o left join g using (verdict)), s as (select *, round_even(n / sum(n) over (), 3) share from h)
 select *, case when verdict <> 'clean' then null when share >= 0.7 then 'good' when share >= 0.4 then 'mixed' else 'poor' end level from s""",
    "derived_confidence": "with g as (select source, count(*) filter (quality = 1) ok, count(*) filter (quality = 0) bad from documents left join labels using (doc_id) group by source) select source, case when source = 'src1' then 0.0 when ok + bad = 0 then 1.0 else round_even(ok / (ok + bad), 3) end confidence from g",
    "quote_support": "with q as (select item_id, trim(regexp_replace(substr(text, 20, case when item_id % 7 = 0 then 10 else 60 end), '\\s+', ' ', 'g')) q from benchmark), d as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) t from documents) select distinct doc_id, item_id from d join q on contains(t, q) where length(q) >= 8 and not contains(q, '## Page:')",
    "near_titles": r"""with n as (select count(*) c from benchmark), b as (select item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') w from benchmark),
 d as (select doc_id, text, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') v, b.w from documents, n, b where b.item_id = doc_id % c),
 r as (select doc_id, text, coalesce(case doc_id % 4 when 0 then w[1] || ' ' || w[2] when 1 then upper(w[2]) when 2 then v[3] end, '') title, case doc_id % 3 when 0 then ' ;' || w[1] || '.' when 1 then v[2] else v[201] end place from d),
 k as (select doc_id, trim(regexp_replace(replace(replace(lower(text), '&', ' and '), '’', chr(39)), '\s+', ' ', 'g'), ' ,.;:') t, trim(regexp_replace(replace(replace(lower(title), '&', ' and '), '’', chr(39)), '\s+', ' ', 'g'), ' ,.;:') h, trim(regexp_replace(replace(replace(lower(place), '&', ' and '), '’', chr(39)), '\s+', ' ', 'g'), ' ,.;:') p from r),
 s as (select doc_id, t, h, p, unnest(string_split(t, h)) piece, generate_subscripts(string_split(t, h), 1) i from k where h <> '' and contains(t, h)),
 o as (select doc_id, t, h, p, i, sum(length(piece) + length(h)) over (partition by doc_id order by i) - length(h) pos, count(*) over (partition by doc_id) c from s),
 g as (select doc_id, bool_or(contains(substr(t, pos::bigint + 1, length(h) + 600), p)) near from o where i < c group by doc_id),
 f as (select doc_id, coalesce(case when p <> '' and contains(t, p) then coalesce(near, true) else false end, false) near, p from k left join g using (doc_id))
 select doc_id, near, case when near then 1 else 0 end stand from f""",
    "platform_hosts": "select page_id, array_to_string(list_filter([case when page_id % 7 <> 1 then 'app' || page_id % 7 || '.betterimpact.com' end, case when page_id % 2 <> 0 then 'volunteer.example.org' end], lambda x: x is not null), ',') hosts from pages",
}
