"""Worked examples of the column functions."""

import datetime as dt
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boardlake.functions import analysis_json as aj, classify as cl, dates, html, links, money, regions, text as tx
from boardlake.operators import board as bd, predicates as pr


@pytest.mark.parametrize("text,low,high", [
    ("$60,000 - $90,000", 60000, 90000), ("60k-90k", 60000, 90000), ("75", 75000, 75000), ("", None, None),
    ("negotiable", None, None), ("90,000 to 60,000", 60000, 90000),
])
def test_salary_text_v1(value, text, low, high):
    assert value(money.salary_text_v1(F.lit(text))) == {"low": low, "high": high}


@pytest.mark.parametrize("text,low,high", [
    ("$50K–$80K a year", 50000, 80000), ("45 an hour", 45, 45), ("50K , 80K", None, None), ("0", None, None),
    ("1,200 a month", 1200, 1200), ("", None, None),
])
def test_salary_text_v2(value, text, low, high):
    assert value(money.salary_text_v2(F.lit(text))) == {"low": low, "high": high}


def test_salary_badge_and_range(value):
    assert value(money.salary_badge(F.lit("£70K/yr - £75K/yr"))) == {"currency": "GBP", "low": 70000, "high": 75000}
    assert value(money.salary_badge(F.lit("$120,000/yr"))) == {"currency": "USD", "low": 120000, "high": None}
    assert value(money.salary_badge(F.lit("Remote"))) == {"currency": "", "low": None, "high": None}
    got = value(money.salary_range_currency(F.lit("pays £40,000 – £50,000, not €")))
    assert got == {"low": 40000, "high": 50000, "currency": "EUR"}
    assert value(money.salary_range_currency(F.lit("pays well")))["currency"] == ""


@pytest.mark.parametrize("args,label", [
    ((60000.0, 90000.0, "USD"), "USD 60k–90k"), ((60499.0, None, "USD"), "USD 60k+"), ((None, 900.5, ""), "Up to  900.5"),
    ((0.0, 0.0, "USD"), ""), ((500.0, 1500.0, "EUR"), "EUR 500–2k"),
])
def test_salary_label(value, args, label):
    low, high = (F.lit(x).cast("double") for x in args[:2])
    assert value(money.salary_label(low, high, F.lit(args[2]))) == label


@pytest.mark.parametrize("text,day", [
    ("Reposted 2 days ago", "2024-03-29"), ("1 month ago", "2024-03-01"), ("Company re", "2024-03-31"),
    ("3 weeks ago", "2024-03-10"), ("2 years ago", "2022-04-01"), ("5 hours ago", "2024-03-31"), ("", "2024-03-31"),
    ("2024-01-02T10:00", "2024-01-02"), ("Posted just now", "2024-03-31"),
])
def test_relative_date(value, text, day):
    assert value(dates.relative_date(F.lit(text), F.lit("2024-03-31").cast("date"))) == day


@pytest.mark.parametrize("text,day", [
    ("Mon, 01 Apr 2024 10:00:00 +0000", dt.date(2024, 4, 1)), ("1 April 2024", dt.date(2024, 4, 1)),
    ("1711965600000", dt.date(2024, 4, 1)), ("2024-13-45", None), ("2024-04-01T23:59:59Z", dt.date(2024, 4, 1)), ("soon", None),
])
def test_posted_date(value, text, day):
    assert value(dates.posted_date(F.lit(text))) == day


def test_posted_recently_falls_back_to_scrape_day(value):
    scraped, as_of = F.lit("2024-03-30 08:00:00").cast("timestamp_ntz"), F.lit("2024-03-31").cast("date")
    recent = lambda text: value(pr.posted_recently(F.lit(text), scraped, 3, as_of))
    assert recent("3 days ago") is True
    assert recent("2024-03-01") is False
    assert recent("2024-13-45") is None


def test_text(value):
    assert value(tx.undouble(F.lit("EngineerEngineer"))) == "Engineer"
    assert value(tx.undouble(F.lit("aba"))) == "aba"
    assert value(tx.title_case(F.lit("node-js o'neil"))) == "Node-Js O'Neil"
    assert value(tx.strip(F.lit(" \n a b  "))) == "a b"
    assert value(tx.normalize_keywords(F.lit(" a, ,b "))) == ["a", "b"]
    assert value(tx.normalize_keywords(F.lit(" , "))) == ["job"]
    assert value(tx.display_tags(F.lit("a, b,,c,d,e,f"))) == ["a", "b", "c", "d", "e"]
    assert value(tx.unescape(F.lit("&amp;lt; &#8364;&#x41;&#xD800;&nbsp;|"))) == "&lt; €A&#xD800; |"
    assert value(tx.strip_html(F.lit("<p> a <b>b</b></p><script>x<y</script><!-- c -->d"))) == "a b d"


def test_listing_id(value):
    import hashlib
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    made = lambda url: value(links.listing_id(F.lit("RemoteOK"), F.lit(url), F.lit("T"), F.lit("C")))
    assert made("") == md5("RemoteOK|T|C")
    assert made("https://x/1") == md5("RemoteOK|https://x/1")


@pytest.mark.parametrize("text,keywords,hit", [
    ("Machine Learning lead", ["machine learning engineer"], True), ("machine operator", ["machine learning engineer"], False),
    ("anything", [], True), ("anything", ["  "], False), ("GO developer", ["rust", "go"], True), ("Data  Entry", ["data entry clerk"], False),
])
def test_matches_keywords(value, text, keywords, hit):
    assert value(pr.matches_keywords(F.lit(text), keywords)) is hit
    if keywords:
        assert value(pr.matches_keywords(F.lit(text), F.array(*[F.lit(k) for k in keywords]))) is hit
    many = keywords + [f"zzz{i}" for i in range(30)] if keywords else keywords
    assert value(pr.matches_keywords(F.lit(text), many)) is hit


@pytest.mark.parametrize("text,query,hit", [
    ("Senior Data Engineer", "eng dat", True), ("Senior Data Engineer", "gineer", False), ("C++ / Go", "+go*", True),
    ("élan vital", "éla", True), ("a b", "", True), ("front-end", "end", True),
])
def test_fulltext(value, text, query, hit):
    assert value(pr.fulltext([F.lit(text)], query)) is hit


def test_salary_floors_differ_on_unknown(value):
    none = F.lit(None).cast("double")
    assert value(pr.salary_floor_strict(none, 50000)) is False
    assert value(pr.salary_floor_lenient(none, 50000)) is True


def test_regions(value):
    assert value(regions.region_labels(F.lit("San Jose, CA"))) == ["united states", "canada"]
    assert value(regions.region_labels(F.lit("Leeds, UK"))) == ["united kingdom"]
    assert value(regions.region_filter(F.lit("Oslo"), "nowhere")) is True


def test_classes(value):
    assert value(cl.remote_by_workplace(F.lit("hybrid"), F.lit("Remote"))) == "Hybrid"
    assert value(cl.remote_by_workplace(F.lit("unspecified"), F.lit("Oslo"))) == "Unknown"
    assert value(cl.experience_from_code(F.lit("se"))) == "Senior"
    assert value(cl.experience_from_code(F.lit("zz"))) == "zz"
    assert value(cl.job_type_class(F.lit("Temporary"), temporary=True)) == "Contract"
    assert value(cl.category_guess(F.lit("Machine Learning"), cl.REMOTIVE_CATEGORIES)) == "data"
    assert value(cl.feed_select(F.lit("gardener"))) == cl.FEED_DEFAULT
    assert value(cl.feed_select(F.lit("Cloud developer"))) == ["programming", "devops"]


@pytest.mark.parametrize("page,safe", [
    ("<div class=x><p>Hi & you<br><a href='/x' onclick=1>l</a></div>",
     '<div><p>Hi &amp; you<br/><a href="/x" target="_blank" rel="noopener noreferrer">l</a></p></div>'),
    ("a<script>b</script><!-- c --><form><p>d</p></form>e", "ae"), ("<img src=a alt='b\"' width=1>", """<img src="a" alt='b"'/>"""),
    ("<!DOCTYPE html><p>x</p>", "<!DOCTYPE html>\n<p>x</p>"),
    ("plain text ", "plain text"), ("<a name=x>t</a>", "<a>t</a>"), ("<b>un<i>closed", "<b>un<i>closed</i></b>"), ("", ""),
    ("1 < 2", "1 &lt; 2"), ("<style>p{}</style><p>x</p></div>", "<p>x</p>"),
])
def test_clean_html(value, page, safe):
    assert value(html.clean_html(F.lit(page))) == safe


def test_deeply_nested_html():
    assert html.sanitize("<div>" * 5000 + "x").count("<div>") == 5000


def test_extract_json(value):
    found = lambda t: value(aj.json_object_text(F.lit(t)))
    assert found(' {"a": 1} ') == '{"a": 1}'
    assert found('Sure\n```json\n{"a": 2}\n```') == '{"a": 2}'
    assert found('so {"a": {"b": 3}} ok') == '{"a": {"b": 3}}'
    assert found("[1]") is None and found("nope {") is None


def test_board_params_from_request():
    p = bd.BoardParams.from_request({"posted_in_last_days": "-3", "salary_min": "abc", "page": "0", "order": "ASC", "sort_by": "x"})
    assert (p.posted_in_last_days, p.salary_min, p.page, p.order) == (None, None, 1, "asc")
    p = bd.BoardParams.from_request({"posted_in_last_days": "7", "salary_min": "5e4", "include_not_interested": "1"})
    assert (p.posted_in_last_days, p.salary_min, p.include_marked) == (7, 50000.0, True)
    assert [bd.clamp_page(95, x, 25) for x in (-1, 1, 4, 9)] == [1, 1, 4, 4] and bd.clamp_page(0, 3, 25) == 1


def test_sanitize_holds_no_tree_of_a_page():
    page = "<p class='aaaaaaaaaaaaaaaaaaaa'></p>" * 50_000
    tracemalloc.start()
    safe = html.sanitize(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert safe == "<p></p>" * 50_000 and peak < 15e6


def test_sanitize_closes_and_drops_like_a_tree():
    assert html.sanitize("<div><p>a<script><b>x</b></script>b</div>c</p><form><i>d<input></form>e") == "<div><p>ab</p></div>ce"
    assert html.sanitize("<b><i>a</b>c</i><br/><img src=x alt='\"'><u/>") == "<b><i>a</i></b>c<br/><img src=\"x\" alt='\"'/><u></u>"


def test_batches_are_sanitized_in_runs(spark, monkeypatch):
    assert [len(r) for r in html._runs(pa.array(["a" * html.RUN_BYTES, None, "b", "c" * html.RUN_BYTES, ""]))] == [3, 2]
    pages = [None, "<b>1", "x", "<p onclick='y'>" + "é" * 700_000] * 3
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, page string").repartition(1).select("k", html.clean_html(F.col("page")).alias("s"))
    want = ["", "<b>1</b>", "x", "<p>" + "é" * 700_000 + "</p>"] * 3
    assert [r.s for r in rows.sort("k").collect()] == want
