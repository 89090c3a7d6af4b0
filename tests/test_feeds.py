"""One small landed payload per feed, with the listings it must give."""

import json

import pytest
from pyspark.sql import functions as F

from boardlake.schema import LISTING_COLUMNS
from boardlake.sources import dims, feeds  # noqa: F401
from boardlake.sources.spec import FEEDS, FeedSpec, SearchParams, ingest, map_feed, read_items, register_feed, rejected_payloads


def rss(*items):
    body = "".join("<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in i) + "</item>" for i in items)
    return f'<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>{body}</channel></rss>'


#: Columns of cards of web pages that land as rows.
CARD = "title string, company string, location string, description string, url string, posted_attr string, posted_text string"

CASES = {
    "RemoteOK": ([{"legal": "n"}, {"position": "Dev", "company": "Acme", "description": "<p>go</p>", "tags": ["a", "b"],
                   "salary_min": 0, "salary_max": "90000", "url": "/j/1", "date": "2024-01-01"},
                  {"position": "Ops", "tags": "x", "apply_url": "https://y/2", "location": ""}],
                 [{"title": "Dev", "location": "Remote", "url": "https://remoteok.com/j/1", "salary_min": None, "salary_max": 90000.0,
                   "salary_currency": "USD", "job_type": "Full-time", "tags": "a, b", "remote": "Remote", "description": "<p>go</p>"},
                  {"title": "Ops", "location": "", "url": "https://y/2", "tags": "x"}]),
    "Arbeitnow": ({"data": [{"title": "Dev", "company_name": "A", "remote": True, "slug": "dev-1", "job_types": ["x", "y"],
                             "created_at": 1711965600, "tags": []}, {"title": "B", "remote": False, "url": "https://b", "job_types": "z"}]},
                  [{"url": "https://www.arbeitnow.com/view/dev-1", "remote": "Remote", "job_type": "x, y", "tags": "", "date_posted": "1711965600"},
                   {"url": "https://b", "remote": "On-site", "job_type": "z"}]),
    "The Muse": ({"results": [{"name": "PM", "company": {"name": "M"}, "locations": [{"name": "Flexible / Remote"}, "Oslo"],
                               "categories": [{"name": "Data"}, "Ops"], "levels": [{"name": "Mid Level"}, "skipped"],
                               "refs": {"landing_page": "https://m/1"}, "contents": "<b>c</b>"},
                              {"name": "QA", "company": "Plain", "locations": []}]},
                 [{"company": "M", "location": "Flexible / Remote; Oslo", "remote": "Remote", "tags": "Data, Ops", "experience_level": "Mid Level",
                   "url": "https://m/1", "description": "<b>c</b>"}, {"company": "Plain", "location": "", "remote": "On-site", "url": ""}]),
    "Jobicy": ({"jobs": [{"jobTitle": "A", "annualSalaryMin": "50000", "annualSalaryMax": 60000, "jobIndustry": ["x", "y"], "jobGeo": "EU"},
                         {"jobTitle": "B", "salaryCurrency": "EUR", "jobIndustry": "z"}]},
               [{"title": "A", "salary_min": 50000.0, "salary_currency": "USD", "tags": "x, y", "location": "EU"},
                {"title": "B", "salary_currency": "EUR", "tags": "z", "location": "Remote"}]),
    "Remotive": ({"jobs": [{"title": "A", "salary": "60k-90k", "job_type": "full_time", "tags": ["q"]}, {"title": "B"}]},
                 [{"salary_min": 60000.0, "salary_max": 90000.0, "job_type": "Full Time", "location": "Worldwide"},
                  {"salary_min": None, "job_type": ""}]),
    "WeWorkRemotely": (rss([("title", "Acme: Dev: Go"), ("link", "https://w/1"), ("category", "Prog"), ("category", "Go"), ("description", "&lt;p&gt;x&lt;/p&gt;"),
                            ("pubDate", "Mon, 01 Apr 2024 00:00:00 +0000")], [("title", "Solo")]),
                       [{"title": "Dev: Go", "company": "Acme", "tags": "Prog, Go", "description": "<p>x</p>", "date_posted": "Mon, 01 Apr 2024 00:00:00 +0000"},
                        {"title": "Solo", "company": "", "tags": "acme-labs"}]),
    "WorkingNomads": ([{"title": "A", "tags": "", "category_name": "Dev", "pub_date": "2024-01-02T03:04"}, {"title": "B", "tags": ["x", "y"]}],
                      [{"tags": "Dev", "date_posted": "2024-01-02"}, {"tags": "x, y", "date_posted": ""}]),
    "Lobsters": (rss([("title", "Job"), ("link", "https://l/1"), ("description", "hi")]),
                 [{"title": "Job", "company": "", "remote": "Unknown", "tags": "lobsters, job", "description": "hi"}]),
    "Greenhouse": ({"jobs": [{"title": "A", "absolute_url": "https://g/1", "location": {"name": "Remote - US"}, "first_published": "2024-05-06T01:02"},
                             {"title": "B", "company_name": "Named", "location": "Oslo"}]},
                   [{"company": "Acme-Labs", "remote": "Remote", "date_posted": "2024-05-06", "tags": "acme-labs"},
                    {"company": "Named", "location": "Oslo", "remote": "On-site"}]),
    "Lever": ([{"text": "A", "categories": {"location": "", "allLocations": ["Oslo", "Rome"], "team": "T", "department": "", "commitment": "Full time"},
                "workplaceType": "hybrid", "salaryRange": {"min": 1, "max": 2, "currency": "EUR"}, "createdAt": 1711965600000, "description": "d"},
               {"text": "B", "categories": "odd", "workplaceType": "unspecified"}],
              [{"company": "Acme Labs", "location": "Oslo, Rome", "remote": "Hybrid", "salary_max": 2.0, "salary_currency": "EUR",
                "date_posted": "2024-04-01", "job_type": "Full-time", "tags": "T, acme-labs", "description": "d"},
               {"location": "", "remote": "Unknown", "job_type": "", "date_posted": "", "tags": "acme-labs"}]),
    "Ashby": ({"jobs": [{"title": "A", "location": {"name": "Oslo"}, "isRemote": True, "compensation": {"tiers": [{"min": 10, "max": 20}], "currency": "USD"},
                         "id": "p1", "publishedAt": "2024-02-03T00:00", "employmentType": "Intern"},
                        {"title": "B", "location": "Remote", "compensation": {"compensationTierSummary": "10-20", "min": 5, "currency": "GBP"}, "applyUrl": "https://a/2"},
                        {"title": "C"}]},
              [{"company": "Acme Labs", "remote": "Remote", "salary_min": 10.0, "salary_currency": "USD", "url": "https://jobs.ashbyhq.com/acme-labs/p1",
                "date_posted": "2024-02-03", "job_type": "Internship"},
               {"location": "Remote", "remote": "Remote", "salary_min": 5.0, "salary_currency": "GBP", "url": "https://a/2"},
               {"remote": "On-site", "salary_currency": "", "url": ""}]),
    "Workable": ({"jobs": [{"title": "A", "location": {"city": "Oslo", "region": "", "country": "Norway"}, "telecommuting": True, "shortcode": "XY",
                            "type": "temporary", "published_on": "2024-01-01"}, {"title": "B", "location": {"location_str": "Remote"}}, {"title": "C", "location": "Rome"}]},
                 [{"location": "Oslo, Norway", "remote": "Remote", "url": "https://apply.workable.com/acme-labs/j/XY/", "job_type": "Contract"},
                  {"location": "Remote", "remote": "Remote", "url": ""}, {"location": "Rome", "remote": "On-site"}]),
    "JobsCollider": ([{"name": "A", "companyName": "Co", "link": "https://c/1", "salaryMin": 5, "publishedAt": "2024-01-01T00", "categories": ["x"]},
                      {"title": "dup", "url": "https://c/1"}, {"title": "no link"}, {"title": "no link either"}],
                     [{"title": "A", "company": "Co", "location": "Remote", "salary_min": 5.0, "date_posted": "2024-01-01", "tags": "x"}, {"title": "no link"}]),
    "DevITjobs": (rss([("title", "Dev"), ("dc:creator", "Co"), ("description", "£40,000 - £50,000 remote"), ("pubDate", "Mon, 01 Apr 2024 10:00:00 +0000"), ("category", "java")],
                      [("title", "Ops"), ("author", "Au"), ("location", "Leeds"), ("pubDate", "2024-02-03T04:05:06Z")]),
                  [{"company": "Co", "salary_min": 40000.0, "salary_currency": "GBP", "remote": "Remote", "date_posted": "2024-04-01", "location": "United Kingdom", "tags": "java"},
                   {"company": "Au", "location": "Leeds", "salary_currency": "", "remote": "On-site", "date_posted": "2024-02-03"}]),
    "HN Who is hiring": ({"hits": [{"title": "Ask HN: Who is hiring? (May 2024)", "objectID": "7", "created_at": "2024-05-01T00:00"}, {"title": "Who is hiring now"},
                                   {"title": "WHO IS HIRING?", "objectID": "8", "story_id": 9}]},
                         [{"url": "https://news.ycombinator.com/item?id=7", "date_posted": "2024-05-01", "company": "Hacker News"},
                          {"url": "https://news.ycombinator.com/item?id=9"}]),
    "Totaljobs": (rss([("title", "A"), ("link", "https://t/1"), ("author", "Co")], [("title", "again"), ("link", "https://t/1")], [("title", "B")], [("title", "C")]),
                  [{"title": "A", "company": "Co", "location": "Leeds"}, {"title": "B"}, {"title": "C"}]),
    "Remote.co": (CARD, [("Title & Co", "Acme", "", "Do it", "https://remote.co/job/1", "", ""), ("", "", "", "", "", "", ""),
                         ("Only link", None, None, None, "https://remote.co/job/2", None, None)],
                  [{"title": "Title & Co", "url": "https://remote.co/job/1", "company": "Acme", "description": "Do it"},
                   {"title": "Only link", "url": "https://remote.co/job/2"}]),
    "GOV.UK Find a Job": (CARD, [("Clerk", "Council", "Leeds", "", "https://findajob.dwp.gov.uk/job/5", "", ""), ("Nurse", "", "Somewhere", "", "https://f/job/6", "", "")],
                          [{"title": "Clerk", "url": "https://findajob.dwp.gov.uk/job/5", "location": "Leeds", "company": "Council", "tags": "UK, government"},
                           {"title": "Nurse", "location": "Somewhere", "company": ""}]),
    "LinkedIn (Direct)": (CARD, [("DevDev", "Acme", "Remote", "", "https://www.linkedin.com/jobs/view/77?x=1", "2024-01-05", "2 days ago"),
                                 ("ad", "", "", "", "https://www.linkedin.com/premium/products/1", "", "")],
                          [{"title": "Dev", "url": "https://www.linkedin.com/jobs/view/77?x=1", "company": "Acme", "remote": "Remote", "date_posted": "2024-01-05"}]),
    "Adzuna": ({"results": [{"redirect_url": "https://z/1", "title": "<strong>Dev</strong> job", "company": {"display_name": "Co"}, "location": {"area": ["UK", "Leeds"], "display_name": "L"},
                             "description": "remote ok", "category": {"label": "IT"}, "contract_time": "full_time", "created": "2024"}, {"redirect_url": "https://z/1"},
                            {"location": {"display_name": "Only"}, "company": "text"}]},
               [{"title": "Dev job", "company": "Co", "location": "UK, Leeds", "remote": "Remote", "job_type": "Full Time", "salary_currency": "GBP", "tags": "IT"},
                {"location": "Only", "company": "", "remote": "On-site"}]),
    "Reed": ({"results": [{"jobTitle": "A", "jobDescription": "Remote", "minimumSalary": 1, "maximumSalary": -5, "employerName": "E", "locationName": "L"}]},
             [{"title": "A", "company": "E", "remote": "Remote", "salary_min": 1.0, "salary_max": None, "salary_currency": "GBP"}]),
    "USAJobs": ({"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {
        "PositionTitle": "Clerk", "OrganizationName": "Org", "DepartmentName": "Dep", "PositionLocation": [{"LocationName": x} for x in "ABCD"],
        "QualificationSummary": "Q", "UserArea": {"Details": {"MajorDuties": "D", "TeleworkEligible": "True"}}, "PositionURI": "https://p", "ApplyURI": [],
        "PositionRemuneration": [{"MinimumRange": "100.5", "MaximumRange": "200"}], "PositionSchedule": [{"Name": "Full"}], "JobCategory": [{"Name": "Cat"}]}}]}},
        [{"company": "Org – Dep", "location": "A; B; C", "description": "Q D", "url": "https://p", "remote": "Remote", "salary_min": 100.5, "job_type": "Full", "tags": "Cat"}]),
    "Jooble": ({"jobs": [{"title": "<b>A</b>", "snippet": "x", "location": "Remote", "salary": "$50,000 - $70,000", "type": "Full", "link": "https://j"}]},
               [{"title": "A", "remote": "Remote", "salary_min": 50000.0, "salary_max": 70000.0, "job_type": "Full", "salary_currency": ""}]),
    "Google Jobs": ({"jobs_results": [{"title": "A", "location": "Oslo", "detected_extensions": {"work_from_home": True, "salary": "$50K–$80K a year", "schedule_type": "Full-time"},
                                       "apply_options": [{"link": "https://g/1"}], "via": "via X", "job_highlights": [{"title": "Q"}]},
                                      {"title": "B", "related_links": [{"link": "https://g/2"}]}]},
                    [{"remote": "Remote", "salary_min": 50000.0, "url": "https://g/1", "tags": "X, Q", "job_type": "Full-time"},
                     {"remote": "On-site", "url": "https://g/2", "tags": ""}]),
    "Findwork": ({"results": [{"role": "A", "remote": True, "location": "", "text": "", "description": "d", "keywords": ["k", "l"]}, {"role": "B", "location": None}]},
                 [{"title": "A", "location": "Remote", "remote": "Remote", "tags": "k, l", "description": "d"}, {"title": "B", "location": "", "remote": "On-site"}]),
    "CareerJet": ({"hits": [{"url": "https://c", "title": "A", "locations": ["Remote", "X"], "snippet": "s"}, {"url": "https://c"}, {"locations": "Leeds"}]},
                  [{"location": "Remote, X", "remote": "Remote", "description": "s"}, {"location": "Leeds", "remote": "Unknown"}]),
    "JobData": ({"results": [{"id": 5, "title": " A ", "company": {"name": "", "logo": " l "}, "published": "2024-01-02T00", "has_remote": True, "experience_level": "se",
                              "salary_min": "-3", "salary_max": "10"}, {"title": " "}]},
                [{"title": "A", "company": "Unknown", "url": "https://jobdataapi.com/api/jobs/5/", "experience_level": "Senior", "salary_min": None, "salary_max": 10.0,
                  "salary_currency": "USD", "company_logo": "l", "date_posted": "2024-01-02"}]),
}


def land(path, name, payload):
    folder = path / "board=acme-labs" / "keyword=dev"
    folder.mkdir(parents=True)
    text = payload if isinstance(payload, str) else json.dumps(payload)
    (folder / "page1").write_text(text)
    return str(path)


def listings(df):
    rows = [r.asDict() for r in df.orderBy("seq").collect()]
    for r in rows:
        for c in ("salary_min", "salary_max"):
            r[c] = float(r[c]) if r[c] is not None else None
    return rows


@pytest.mark.parametrize("name", list(CASES))
def test_feed(spark, tmp_path, name):
    *payload, want = CASES[name]
    if len(payload) == 2:
        spark.createDataFrame(payload[1], payload[0]).coalesce(1).write.parquet(str(tmp_path / "board=acme-labs" / "keyword=dev"))
    path = str(tmp_path) if len(payload) == 2 else land(tmp_path, name, payload[0])
    items = read_items(spark, FEEDS[name], path)
    df = ingest(items, FEEDS[name], SearchParams(location="Leeds"))
    assert df.columns[:17] == LISTING_COLUMNS
    got = listings(df)
    assert [{k: g[k] for k in w} for g, w in zip(got, want)] == want
    assert len(got) == len(want)
    assert all(g["source"] == name and len(g["job_id"]) == 32 for g in got)
    text = [c for c in LISTING_COLUMNS if c not in ("salary_min", "salary_max", "date_scraped")]
    assert all(g[c] is not None for g in got for c in text)


TABLE = [
    ("https://x/1", "", "A", "Co", "", "Remote, EU", "<p>d</p>", "linkedin", "2024-01-01", False, 1.0, 2.0, None, "full_time", "", "logo"),
    ("https://x/1", "", "again", "Co", "", "Oslo", "d", "linkedin", "2024-01-01", True, None, None, "EUR", None, "", ""),
    ("", "https://x/2", "B", None, "Other", "Oslo", "d" * 6000, "zip_recruiter", "", True, None, None, "EUR", None, "", ""),
]


def test_table_feeds_share_ids(spark, tmp_path):
    spark.createDataFrame(TABLE, feeds.TABLE_COLUMNS).coalesce(1).write.parquet(str(tmp_path / "t"))
    read = lambda n, **p: listings(ingest(read_items(spark, FEEDS[n], str(tmp_path / "t")), FEEDS[n], SearchParams(**p)))
    spy, linked = read("JobSpy"), read("LinkedIn")
    assert [(r["source"], r["title"], r["company"], r["remote"]) for r in spy] == [
        ("JobSpy (Linkedin)", "A", "Co", "On-site"), ("JobSpy (Zip_Recruiter)", "B", "Other", "Remote")]
    assert spy[0]["salary_currency"] == "USD" and spy[0]["job_type"] == "Full Time" and len(spy[1]["description"]) == 5000
    assert [(r["source"], r["job_id"]) for r in linked] == [("LinkedIn", spy[0]["job_id"])]
    assert [r["title"] for r in read("JobSpy", remote="Remote")] == ["A", "B"]
    assert read("JobSpy", remote="On-site") == []


def test_every_feed_is_tested_and_listed():
    assert set(CASES) | {"JobSpy", "LinkedIn"} == set(FEEDS) == {s[0] for s in dims.SOURCES}
    assert len(FEEDS) == 29 and len(dims.FREE_SOURCES) == 21


def test_ingest_filters_and_caps(spark, tmp_path):
    jobs = [{"position": f"Dev {i}", "company": "c", "salary_max": 1000 * i, "url": f"/{i}"} for i in range(1, 9)]
    path = land(tmp_path, "RemoteOK", [{}] + jobs)
    read = lambda **p: [r["title"] for r in listings(ingest(read_items(spark, FEEDS["RemoteOK"], path), FEEDS["RemoteOK"], SearchParams(**p)))]
    assert read(salary_min=6000) == ["Dev 6", "Dev 7", "Dev 8"]
    assert read(salary_min=3000, max_results=2) == ["Dev 3", "Dev 4"]
    assert read(keywords=("dev 5",)) == ["Dev 5"]
    assert read(remote="On-site") == []


def test_cap_counts_per_keyword(spark, tmp_path):
    for kw, links in (("a", [1, 2, 3]), ("b", [1, 3, 4, 5])):
        folder = tmp_path / f"keyword={kw}"
        folder.mkdir()
        (folder / f"{kw}.json").write_text(json.dumps({"hits": [{"url": f"https://x/{n}", "title": f"{kw}{n}"} for n in links]}))
    rows = ingest(read_items(spark, FEEDS["CareerJet"], str(tmp_path)), FEEDS["CareerJet"], SearchParams(keywords=("a", "b"), max_results=2))
    # link 3 missed keyword a's cap, so keyword b may take it
    assert sorted(r["title"] for r in rows.collect()) == ["a1", "a2", "b3", "b4"]


def test_items_of_other_keywords_and_searches_without_cap(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"hits": [{"url": f"https://x/{n}", "title": f"t{n}"} for n in range(300)]}))
    items, spec = read_items(spark, FEEDS["CareerJet"], str(tmp_path)), FEEDS["CareerJet"]
    assert ingest(items, spec, SearchParams()).count() == 300
    assert ingest(items, spec, SearchParams(keywords=("a", "b"))).count() == 300
    assert ingest(items, spec, SearchParams(keywords=("a", "b"), max_results=10)).count() == 10
    with pytest.raises(ValueError):
        ingest(items, spec, SearchParams(posted_in_last_days=3))


def test_unreadable_payload_is_reported(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"jobs": [')
    (tmp_path / "ok.json").write_text('{"jobs": []}')
    bad = rejected_payloads(spark, FEEDS["Jooble"], str(tmp_path)).collect()
    assert [(r["landed_file"].rsplit("/", 1)[1], r["reason"]) for r in bad] == [("bad.json", "payload ends too early")]
    assert read_items(spark, FEEDS["Jooble"], str(tmp_path)).count() == 0


def test_register_own_feed(spark, tmp_path):
    spec = register_feed(FeedSpec("Mine", "json", lambda r, p: {"title": r.text("t"), "url": r.text("u")}, needs="either"))
    try:
        path = land(tmp_path, "Mine", [{"t": "x"}, {"z": 1}])
        assert [r["title"] for r in listings(map_feed(read_items(spark, spec, path), spec))] == ["x"]
    finally:
        FEEDS.pop("Mine")


def test_source_dimension(spark):
    assert dims.source_dim(spark).filter("requires_api_key").count() == 7
    assert dims.superseded_rules(spark).collect()[0].asDict() == {"feed": "LinkedIn", "superseded_by": "JobSpy"}
    assert dims.source_dim(spark).filter(F.col("name").isin(dims.KEY_SOURCES)).count() == 8


def test_items_are_parsed_once_per_row(spark):
    """A filter on fields of an item does not bring the parsing of its text into every place that names the item."""
    from boardlake.plans.base import QUERIES
    import boardlake.plans.feeds  # noqa: F401

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    text = plan(QUERIES["feed_flat_json"](spark, "/root/testdata/sf0.001"))
    assert text.lower().count("parsejson(") == 1 and "Repartition " in text


def test_landed_items_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"legal": "n"}, {"position": "R dev", "salary_max": 30000}, {"position": "B", "salary_max": 1}]))
    got = ingest(read_items(spark, FEEDS["RemoteOK"], str(tmp_path)), FEEDS["RemoteOK"], SearchParams(keywords=("r",), salary_min=20000))
    assert [r.title for r in got.collect()] == ["R dev"]
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1
