"""Column functions on small cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import place, text, values, web


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("a,b,days", [("2024-01-01 23:00:00", "2024-01-02 01:00:00", 0), ("2024-01-01 00:00:00", "2024-01-22 00:00:00", 21), ("2024-02-01 00:00:00", "2024-01-01 00:00:00", 0), (None, "2024-01-01 00:00:00", None)])
def test_age_counts_elapsed_days(spark, a, b, days):
    assert one(spark, values.age_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), a=a, b=b) == days


@pytest.mark.parametrize("xs,want", [([1, 2, 3, 4], 3), ([5], 5), ([], None)])
def test_upper_median(spark, xs, want):
    df = spark.createDataFrame([(xs,)], "xs array<int>")
    assert df.select(values.upper_median(F.col("xs")).alias("m")).first().m == want


@pytest.mark.parametrize("s,e,m,want", [(11, 4, 12, True), (11, 4, 5, False), (3, 6, 6, True), (3, 6, 7, False), (12, 12, 12, True)])
def test_season_may_pass_the_year(spark, s, e, m, want):
    assert one(spark, values.in_season(F.col("s"), F.col("e"), F.col("m")), s=s, e=e, m=m) is want


def test_half_to_even(spark):
    assert one(spark, values.ratio(F.col("a"), F.col("b")), a=1, b=16) == 0.062


@pytest.mark.parametrize("url,site", [("https://www.a.b.example.com/x", "example.com"), ("http://x.shelter.org.uk:80/", "shelter.org.uk"), ("nothing", ""), ("https://localhost/", "localhost")])
def test_site(spark, url, site):
    assert one(spark, web.site(F.col("u")), u=url) == site


def test_hash_ignores_order(spark):
    df = spark.createDataFrame([(["b", "a"], ["a", "b"], ["a", "c"])], "x array<string>, y array<string>, z array<string>")
    r = df.select(*(web.content_hash(F.col(c)).alias(c) for c in "xyz")).first()
    assert r.x == r.y != r.z


@pytest.mark.parametrize("q,t,want", [("re", "Red ring", 0), ("ing", "red ring", 1), ("rn", "red ring", 2), ("zz", "red", None), (".", "abc", None)])
def test_match_class(spark, q, t, want):
    assert one(spark, text.match_class(F.col("q"), F.col("t")), q=q, t=t) == want


def test_place_key(spark):
    assert one(spark, text.place_canon(F.col("p")), p=" The  Barking &  Dagenham. ") == "barking and dagenham"


@pytest.mark.parametrize("title,want", [("Cook (evening) - Café!", "cook caf"), ("Driver [van]", "driver van"), ("Tea &amp; Talk", "tea talk"), ("Women\u2019s Group", "women s group")])
def test_title_key(spark, title, want):
    assert one(spark, text.title_key(F.col("p")), p=title) == want


@pytest.mark.parametrize("quote,want", [("must be  eighteen", True), ("short", False), ("## Page: x must", False), (None, False)])
def test_quote(spark, quote, want):
    assert one(spark, text.quote_supported(F.col("q"), F.lit("you must\nbe eighteen ## Page: x must")), q=quote) is want


def test_number_on_its_own(spark):
    assert one(spark, text.quote_backs_number(F.lit("over 18s only"), F.lit(18))) is True
    assert one(spark, text.quote_backs_number(F.lit("room 180"), F.lit(18))) is False


def test_place_near_any_title(spark):
    page = "Cook. " + "x" * 700 + " Cook. In Leeds. " + "y" * 700 + "York"
    assert one(spark, text.place_near_title(F.lit(page), F.lit("cook"), F.lit("leeds"))) is True
    assert one(spark, text.place_near_title(F.lit(page), F.lit("cook"), F.lit("york"))) is False
    assert one(spark, text.place_near_title(F.lit(page), F.lit("driver"), F.lit("york"))) is True


def test_role_sections(spark):
    df = spark.createDataFrame([([("a", "top"), ("b", "The Cook role"), ("c", "other")],)], "s array<struct<url:string,text:string>>")
    got = df.select(text.role_text(F.col("s"), F.lit("c/#apply"), F.lit("cook")).alias("x")).first().x
    assert [r.url for r in got] == ["a", "b", "c"]
    assert [r.url for r in df.select(text.role_text(F.col("s"), F.lit("z"), F.lit("driver")).alias("x")).first().x] == ["a", "b", "c"]


@pytest.mark.parametrize(
    "timing,christmas,want",
    [
        ("Every Monday evening", False, ("weekly", ["weekday_daytime"])),
        ("Saturdays or Sundays", False, ("weekly", ["weekend_daytime"])),
        ("Tuesday and Saturday", False, ("weekly", ["weekday_daytime", "weekend_daytime"])),
        ("One full shift", True, ("one_off", ["flexible"])),
        ("One full shift", False, ("unknown", ["flexible"])),
        ("4 hours each week", False, ("weekly", ["flexible"])),
        ("a day per month", False, ("monthly", ["flexible"])),
        ("Fortnightly, flexible", False, ("unknown", ["flexible"])),
        (None, None, ("unknown", ["flexible"])),
    ],
)
def test_schedule(spark, timing, christmas, want):
    df = spark.createDataFrame([(timing, christmas)], "t string, c boolean")
    assert tuple(df.select(text.schedule(F.col("t"), F.col("c")).alias("x")).first().x) == want


@pytest.mark.parametrize("label,want", [(None, "unknown"), ("No check required", "none"), ("N/A", "none"), ("Enhanced DBS", "enhanced"), ("Basic DBS", "basic"), ("DBS check", "required_unspecified"), ("Nobody asked", "unknown")])
def test_check_of_a_label(spark, label, want):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(text.check_of(F.col("l")).alias("x")).first().x == want


@pytest.mark.parametrize("title,want", [("Charity Shop Cook", "shop_warehouse"), ("Kitchen help", "cooking_serving"), ("Minibus Driver", "practical"), ("Event steward", "fundraising"), ("Dreamer", "varies")])
def test_activity_of_a_title(spark, title, want):
    assert one(spark, text.activity_of(F.col("t")), t=title) == want


def test_quotes_that_back_values(spark):
    assert one(spark, text.quote_backs_season(F.lit("From Nov until April"), F.lit(11), F.lit(4))) is True
    assert one(spark, text.quote_backs_season(F.lit("From November"), F.lit(11), F.lit(4))) is False
    assert one(spark, text.quote_backs_check(F.lit("a background check"), F.lit("none"))) is True
    assert one(spark, text.quote_backs_check(F.lit("a DBS check"), F.lit("enhanced"))) is False
    assert one(spark, text.quote_backs_words(F.lit("our kitchens need you"), F.lit("Kitchen help"))) is True
    assert one(spark, text.quote_backs_words(F.lit("we help people"), F.lit("Help people cook"))) is False


@pytest.mark.parametrize("status,month,want", [("seasonal_closed", 12, "unknown"), ("seasonal_closed", 2, "unknown"), ("seasonal_closed", 6, "seasonal_closed"), ("open", 6, "open"), ("closed", 12, "closed")])
def test_status_inside_its_season_is_unknown(spark, status, month, want):
    assert one(spark, values.status_today(F.lit(status), F.lit(11), F.lit(4), F.make_date(F.lit(2026), F.lit(month), F.lit(5)))) == want


def test_asserted(spark):
    df = spark.createDataFrame([("individual",), ("either",), ("unknown",), ("",), (None,)], "v string")
    assert [r.a for r in df.select(values.asserted(F.col("v"), "individual").alias("a")).collect()] == [False, True, False, False, False]


def test_platform_hosts(spark):
    html = "<a href='//www.Rosterfy.com:80/x'>1</a><a href=\"/volunteer\">2</a><a HREF = 'https://do-it.org/y'>3</a><a href='https://other.com'>4</a><a href='https://volunteer.a.org/'>5</a>"
    assert one(spark, web.platform_hosts(F.lit(html), F.lit("https://volunteer.a.org/p"))) == ["do-it.org", "rosterfy.com"]


def test_places_stand_together(spark):
    df = spark.createDataFrame([(["Camden  Town", "Brent"], [True, True]), (["Camden", "Brent"], [True, False]), (None, None)], "p array<string>, f array<boolean>")
    assert [r.x for r in df.select(place.stated_places(F.col("p"), F.col("f")).alias("x")).collect()] == [["Camden Town", "Brent"], [], []]


def test_words_and_redaction(spark):
    assert one(spark, text.serial(F.array(F.lit("a"), F.lit(None), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, text.redacted(F.lit("key " + "A" * 30))) == "key [redacted]"
    assert one(spark, text.marker(F.lit("x <!-- health level=bad waiting=3 -->"), "waiting")) == "3"
    assert one(spark, text.labelled_line(F.lit("a\nMinimum age: 18 \nb"), "Minimum age")) == "18"


def test_severity(spark):
    assert one(spark, values.severity(["ok", "warn", "bad"], F.lit("warn"), F.lit("ok"))) == "warn"


def test_image_kinds(spark):
    df = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n0000"),), (bytearray(b"\xff\xd8\xff00"),), (bytearray(b"RIFF0000WEBP"),), (bytearray(b"<?xml?><SVG>"),), (bytearray(b"hello"),)], "c binary")
    assert [r.k for r in df.select(web.image_kind(F.col("c")).alias("k")).collect()] == ["png", "jpg", "webp", "svg", None]


@pytest.mark.parametrize("page,want", [("x Last updated: 3rd March 2026 y", "3rd March 2026"), ("Updated 2026-03-04", "2026-03-04"), ("last   updated 14 May, 2025.", "14 May, 2025"), ("no date was updated", None), ("x" * 20_000 + " updated 2026-03-04", None)])
def test_updated(spark, page, want):
    assert one(spark, web.updated_date(F.lit(page))) == want


def test_shell(spark):
    html = '<div id="root"></div><script></script>'
    assert one(spark, web.looks_client_rendered(F.lit(html), F.lit(500))) is True
    assert one(spark, web.looks_client_rendered(F.lit("<p>short but real"), F.lit(20))) is False


def test_html_to_text(spark):
    assert one(spark, web.html_to_text(F.lit("<p>A &amp; B</p><ul><li>c<li>d</ul><script>x</script>"))) == "A & B\nc d"


def test_offer_in_city(spark):
    f = lambda t: one(spark, place.offer_in_city(F.lit(t), "London", ["Camden"], ["SE", "N"]))
    assert f("in london now") and f("Camden Town") and f("at SE1 2AB")
    assert not f("Camdenshire M1 2AB")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1 -'&é", max_size=20), min_size=1, max_size=20))
def test_slug_agrees_with_python(spark, xs):
    import re

    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    got = {r.i: r.s for r in df.select("i", text.slug(F.col("x")).alias("s")).collect()}
    assert got == {i: re.sub(r"[^a-z0-9]+", "-", x.lower()).strip("-") for i, x in enumerate(xs)}
