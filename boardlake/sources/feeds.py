"""The 29 feeds. Hosts, default texts and field names are fixed values of the feeds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boardlake.functions import classify as cl, dates as dt, links, money, text as tx
from boardlake.functions.html import clean_html
from boardlake.sources.spec import FeedSpec, Item, SearchParams, register_feed

FULL_TIME = "Full-time"


def _iso(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))


def _day(c: Column) -> Column:
    return F.substring(c, 1, 10)


def _salary(bounds: Column) -> dict[str, Column]:
    return {"salary_min": bounds["low"], "salary_max": bounds["high"]}


# ---- JSON feeds ---------------------------------------------------------------------------
def remoteok(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": r.text("position"), "company": r.text("company"), "location": r.text("location", "Remote"),
        "description": r.text("description"),
        "url": links.absolute(r.first("apply_url", "url"), "https://remoteok.com"),
        "remote": F.lit("Remote"), "salary_min": r.number("salary_min"), "salary_max": r.number("salary_max"),
        "salary_currency": F.lit("USD"), "job_type": F.lit(p.job_type or FULL_TIME),
        "date_posted": r.text("date"), "tags": r.listed("tags"), "company_logo": r.text("company_logo"),
    }


register_feed(FeedSpec(
    "RemoteOK", "json", remoteok, skip_first=True, remote_only=True,
    searched=lambda r: [r.text("position"), r.text("company"), r.text("description"), r.listed("tags")]))


def arbeitnow(r: Item, p: SearchParams) -> dict[str, Column]:
    job_types = r.listed("job_types")
    return {
        "title": r.text("title"), "company": r.text("company_name"), "location": r.text("location"),
        "description": r.text("description"),
        "url": F.coalesce(r.raw("url", "string"), F.concat(F.lit("https://www.arbeitnow.com/view/"), r.text("slug"))),
        "remote": cl.remote_flag(r.flag("remote")), "job_type": tx.first_nonempty(job_types, F.lit(p.job_type)),
        "date_posted": r.text("created_at"), "tags": r.listed("tags"),
    }


register_feed(FeedSpec(
    "Arbeitnow", "json", arbeitnow, items=("$.data",),
    searched=lambda r: [r.text("title"), r.text("company_name"), r.text("description"), r.listed("tags")]))


def the_muse(r: Item, p: SearchParams) -> dict[str, Column]:
    location = F.array_join(r.names("locations"), "; ")
    return {
        "title": r.text("name"), "company": r.name_of("company"), "location": location,
        "description": r.text("contents"), "url": r.text("refs.landing_page"),
        "remote": cl.remote_by_text(location, ("flexible", "remote")),
        "experience_level": F.array_join(r.names("levels", plain=False), ", "),
        "tags": F.array_join(r.names("categories"), ", "), "date_posted": r.text("publication_date"),
    }


register_feed(FeedSpec(
    "The Muse", "json", the_muse, items=("$.results",),
    searched=lambda r: [r.text("name"), r.name_of("company"), r.text("contents"),
                        F.array_join(r.names("categories"), " ")]))


def jobicy(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": r.text("jobTitle"), "company": r.text("companyName"), "location": r.text("jobGeo", "Remote"),
        "description": r.text("jobDescription"), "url": r.text("url"), "remote": F.lit("Remote"),
        "salary_min": r.number("annualSalaryMin"), "salary_max": r.number("annualSalaryMax"),
        "salary_currency": r.text("salaryCurrency", "USD"), "job_type": r.listed("jobType"),
        "date_posted": r.text("pubDate"), "tags": r.listed("jobIndustry"), "company_logo": r.text("companyLogo"),
    }


register_feed(FeedSpec(
    "Jobicy", "json", jobicy, items=("$.jobs",), cap_by="keyword", remote_only=True,
    searched=lambda r: [r.text("jobTitle"), r.text("companyName"), r.text("jobDescription"),
                        r.text("jobGeo", "Remote"), r.listed("jobType")]))


def remotive(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": r.text("title"), "company": r.text("company_name"),
        "location": r.text("candidate_required_location", "Worldwide"),
        "description": r.text("description"), "url": r.text("url"), "remote": F.lit("Remote"),
        **_salary(money.salary_text_v1(r.text("salary"))), "salary_currency": F.lit("USD"),
        "job_type": tx.label_case(r.text("job_type")), "date_posted": r.text("publication_date"),
        "tags": r.listed("tags"), "company_logo": r.text("company_logo"),
    }


register_feed(FeedSpec(
    "Remotive", "json", remotive, items=("$.jobs",), cap_by="keyword", remote_only=True,
    searched=lambda r: [r.text("title"), r.text("company_name"), r.text("description"), r.listed("tags")]))


def working_nomads(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": r.text("title"), "company": r.text("company_name"), "location": r.text("location", "Remote"),
        "description": r.text("description"), "url": r.text("url"), "remote": F.lit("Remote"),
        "job_type": F.lit(p.job_type or FULL_TIME), "date_posted": _day(r.text("pub_date")),
        "tags": tx.first_nonempty(r.listed("tags"), r.text("category_name")),
    }


register_feed(FeedSpec(
    "WorkingNomads", "json", working_nomads, remote_only=True,
    searched=lambda r: [r.text("title"), r.text("company_name"), r.text("description"), r.listed("tags"),
                        r.text("category_name")]))


def greenhouse(r: Item, p: SearchParams) -> dict[str, Column]:
    place = r.name_of("location")
    return {
        "title": r.text("title"), "company": F.coalesce(r.raw("company_name", "string"), tx.title_case(r.board)),
        "location": place, "url": r.text("absolute_url"), "remote": cl.remote_by_text(place),
        "date_posted": _day(r.text("first_published")), "tags": r.board,
    }


register_feed(FeedSpec(
    "Greenhouse", "json", greenhouse, describe=tx.strip, items=("$.jobs",),
    searched=lambda r: [r.text("title"), F.coalesce(r.raw("company_name", "string"), tx.title_case(r.board)),
                        r.name_of("location")]))


def _lever_place(r: Item) -> Column:
    return tx.first_nonempty(r.raw("categories.location", "string"), r.listed("categories.allLocations"))


def lever(r: Item, p: SearchParams) -> dict[str, Column]:
    place = _lever_place(r)
    return {
        "title": r.text("text"), "company": tx.slug_to_name(r.board), "location": place,
        "description": r.first("descriptionPlain", "description"), "url": r.text("hostedUrl"),
        "remote": cl.remote_by_workplace(r.text("workplaceType"), place),
        "salary_min": r.number("salaryRange.min"), "salary_max": r.number("salaryRange.max"),
        "salary_currency": r.text("salaryRange.currency"),
        "job_type": cl.job_type_class(r.text("categories.commitment")),
        "date_posted": _iso(dt.epoch_ms_date(r.raw("createdAt", "string"))),
        "tags": tx.join_nonempty(", ", r.text("categories.team"), r.text("categories.department"), r.board),
    }


register_feed(FeedSpec(
    "Lever", "json", lever, unknown_is_remote=True,
    searched=lambda r: [r.text("text"), r.board, _lever_place(r), r.text("categories.team"),
                        r.text("categories.department")]))


def _ashby_pay(r: Item) -> dict[str, Column]:
    """First tier of the first list of tiers, else the flat fields."""
    base = "compensation"
    summary = tx.blank_to_null(r.raw(f"{base}.compensationTierSummary", "string"))
    as_list = lambda n: r.raw(f"{base}.{n}", "array<variant>")
    empty_summary = summary.isNull() | (summary == "[]")
    tiers = F.when(empty_summary, as_list("tiers")).otherwise(as_list("compensationTierSummary"))
    has = F.coalesce(F.size(tiers), F.lit(0)) > 0
    tier = lambda n: F.try_variant_get(F.get(tiers, 0), f"$.{n}", "string")
    pay = lambda n: money.safe_float(F.when(has, tier(n)).otherwise(r.raw(f"{base}.{n}", "string")))
    flat = r.text(f"{base}.currency")
    return {"salary_min": pay("min"), "salary_max": pay("max"),
            "salary_currency": F.when(has, F.coalesce(tier("currency"), flat)).otherwise(flat)}


def ashby(r: Item, p: SearchParams) -> dict[str, Column]:
    place = r.name_of("location")
    posting = r.text("id")
    by_id = F.when(posting != "", F.concat(F.lit("https://jobs.ashbyhq.com/"), r.board, F.lit("/"), posting))
    return {
        "title": r.text("title"),
        "company": F.when(F.contains(r.board, F.lit("-")), tx.slug_to_name(r.board)).otherwise(r.board),
        "location": place, "description": r.first("descriptionPlain", "descriptionHtml"),
        "url": tx.first_nonempty(r.first("jobUrl", "applyUrl"), by_id),
        "remote": cl.remote_flag(r.flag("isRemote") | F.contains(F.lower(place), F.lit("remote"))),
        **_ashby_pay(r), "job_type": cl.job_type_class(r.text("employmentType")),
        "date_posted": dt.cut_time(r.first("publishedDate", "publishedAt")),
        "tags": tx.join_nonempty(", ", r.text("department"), r.board),
    }


register_feed(FeedSpec(
    "Ashby", "json", ashby, items=("$.jobs",),
    searched=lambda r: [r.text("title"), r.board, r.name_of("location"), r.text("department")]))


def _workable_place(r: Item) -> Column:
    parts = tx.location_assemble(*[r.raw(f"location.{k}", "string") for k in ("city", "region", "country")],
                                 r.raw("location.location_str", "string"))
    is_object = F.startswith(F.schema_of_variant(r.raw("location")), F.lit("OBJECT"))
    return F.when(is_object, parts).otherwise(r.text("location"))


def workable(r: Item, p: SearchParams) -> dict[str, Column]:
    place, code = _workable_place(r), r.first("shortcode", "id")
    by_code = F.when(code != "", F.concat(F.lit("https://apply.workable.com/"), r.board, F.lit("/j/"), code, F.lit("/")))
    return {
        "title": r.text("title"), "company": tx.slug_to_name(r.board), "location": place,
        "description": r.text("description"), "url": tx.first_nonempty(r.raw("url", "string"), by_code),
        "remote": cl.remote_flag(r.flag("telecommuting") | F.contains(F.lower(place), F.lit("remote"))),
        "job_type": cl.job_type_class(r.first("employment_type", "type"), temporary=True),
        "date_posted": dt.cut_time(r.first("published_on", "created_at")),
        "tags": tx.join_nonempty(", ", r.text("department"), r.board),
    }


register_feed(FeedSpec(
    "Workable", "json", workable, items=("$.jobs", "$"),
    searched=lambda r: [r.text("title"), r.board, _workable_place(r), r.text("department")]))


def jobscollider(r: Item, p: SearchParams) -> dict[str, Column]:
    tags = tx.blank_to_null(r.listed("tags"))
    return {
        "title": r.first("title", "name"), "company": r.first("company", "companyName"),
        "location": tx.first_nonempty(r.raw("location", "string"), F.lit("Remote")),
        "description": r.text("description"), "url": r.first("url", "link"), "remote": F.lit("Remote"),
        "salary_min": r.number("salary_min", "salaryMin"), "salary_max": r.number("salary_max", "salaryMax"),
        "salary_currency": r.first("salary_currency", "salaryCurrency"),
        "job_type": r.first("type", "jobType"), "date_posted": dt.cut_time(r.first("date", "publishedAt", "pubDate")),
        "tags": F.coalesce(tags, r.listed("categories")), "company_logo": r.first("logo", "companyLogo"),
    }


register_feed(FeedSpec(
    "JobsCollider", "json", jobscollider, items=("$", "$.jobs"), dedup="all", remote_only=True,
    searched=lambda r: [r.first("title", "name"), r.first("company", "companyName"),
                        tx.first_nonempty(r.raw("location", "string"), F.lit("Remote"))]))


def hn_hiring(r: Item, p: SearchParams) -> dict[str, Column]:
    story = F.coalesce(r.raw("story_id", "string"), r.text("objectID"))
    return {
        "title": r.text("title"), "company": F.lit("Hacker News"),
        "description": F.lit("Monthly Hacker News 'Who is hiring?' thread. Click to open the thread and "
                             "browse job postings in the comments."),
        "url": F.concat(F.lit("https://news.ycombinator.com/item?id="), story),
        "date_posted": _day(r.text("created_at")), "tags": F.lit("hn, who is hiring, remote, tech"),
    }


register_feed(FeedSpec(
    "HN Who is hiring", "json", hn_hiring, describe=tx.strip, items=("$.hits",), filters_remote="none", filters_salary=False,
    keep=lambda r: r.text("title").rlike(r"(?i)who is hiring\?")))


def adzuna(r: Item, p: SearchParams) -> dict[str, Column]:
    areas = r.listed("location.area")
    description = r.text("description")
    return {
        "title": tx.strip_html(r.text("title")), "company": r.text("company.display_name"),
        "location": tx.first_nonempty(areas, r.raw("location.display_name", "string")),
        "description": description, "url": r.text("redirect_url"),
        "remote": cl.remote_by_text(F.concat_ws(" ", r.text("title"), description)),
        "salary_min": r.number("salary_min"), "salary_max": r.number("salary_max"),
        "salary_currency": F.lit("GBP" if p.country == "gb" else "USD"),
        "job_type": tx.label_case(r.text("contract_time")), "date_posted": r.text("created"),
        "tags": r.text("category.label"),
    }


register_feed(FeedSpec("Adzuna", "json", adzuna, items=("$.results",), dedup="url", cap_by="keyword",
                       filters_salary=False))


def reed(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": r.text("jobTitle"), "company": r.text("employerName"), "location": r.text("locationName"),
        "description": r.text("jobDescription"), "url": r.text("jobUrl"),
        "remote": cl.remote_by_text(F.concat_ws(" ", r.text("jobTitle"), r.text("jobDescription"))),
        "salary_min": r.number("minimumSalary"), "salary_max": r.number("maximumSalary"),
        "salary_currency": F.lit("GBP"), "job_type": F.lit(p.job_type), "date_posted": r.text("date"),
    }


register_feed(FeedSpec("Reed", "json", reed, items=("$.results", "$"), cap_by="keyword"))


def usajobs(r: Item, p: SearchParams) -> dict[str, Column]:
    d = "MatchedObjectDescriptor"
    places = F.slice(r.names(f"{d}.PositionLocation", "LocationName", plain=False), 1, 3)
    apply_link = F.get(r.raw(f"{d}.ApplyURI", "array<string>"), 0)
    telework = F.initcap(r.text(f"{d}.UserArea.Details.TeleworkEligible", "False"))
    both = F.concat_ws(" ", r.text(f"{d}.QualificationSummary"), r.listed(f"{d}.UserArea.Details.MajorDuties"))
    return {
        "title": r.text(f"{d}.PositionTitle"),
        "company": tx.org_department(r.text(f"{d}.OrganizationName"), r.text(f"{d}.DepartmentName")),
        "location": F.array_join(places, "; "), "description": tx.strip(both),
        "url": F.coalesce(apply_link, r.text(f"{d}.PositionURI")), "remote": cl.remote_flag(telework == "True"),
        "salary_min": r.number(f"{d}.PositionRemuneration[0].MinimumRange"),
        "salary_max": r.number(f"{d}.PositionRemuneration[0].MaximumRange"), "salary_currency": F.lit("USD"),
        "job_type": r.text(f"{d}.PositionSchedule[0].Name"), "date_posted": r.text(f"{d}.PublicationStartDate"),
        "tags": r.text(f"{d}.JobCategory[0].Name"),
    }


register_feed(FeedSpec("USAJobs", "json", usajobs, items=("$.SearchResult.SearchResultItems",), cap_by="keyword",
                       filters_salary=False))


def jooble(r: Item, p: SearchParams) -> dict[str, Column]:
    text = F.concat_ws(" ", r.text("title"), r.text("snippet"), r.text("location"))
    return {
        "title": tx.strip_html(r.text("title")), "company": r.text("company"), "location": r.text("location"),
        "description": r.text("snippet"), "url": r.text("link"), "remote": cl.remote_by_text(text),
        **_salary(money.salary_text_v1(r.text("salary"))),
        "job_type": tx.first_nonempty(r.raw("type", "string"), F.lit(p.job_type)), "date_posted": r.text("updated"),
    }


register_feed(FeedSpec("Jooble", "json", jooble, items=("$.jobs",), cap_by="keyword"))


def google_jobs(r: Item, p: SearchParams) -> dict[str, Column]:
    ext, place = "detected_extensions", r.text("location")
    link = tx.first_nonempty(*[r.raw(x, "string") for x in
                               ("apply_options[0].link", "share_link", "related_links[0].link")])
    via = F.replace(r.text("via"), F.lit("via "), F.lit(""))
    tags = F.concat(F.when(r.text("via") != "", F.array(via)).otherwise(F.array().cast("array<string>")),
                    r.names("job_highlights", "title", plain=False))
    return {
        "title": r.text("title"), "company": r.text("company_name"), "location": place,
        "description": r.text("description"), "url": link,
        "remote": cl.remote_flag(r.flag(f"{ext}.work_from_home") | F.contains(F.lower(place), F.lit("remote"))),
        **_salary(money.salary_text_v2(r.text(f"{ext}.salary"))), "salary_currency": F.lit("USD"),
        "job_type": tx.first_nonempty(r.raw(f"{ext}.schedule_type", "string"), F.lit(p.job_type)),
        "experience_level": F.lit(p.experience_level), "date_posted": r.text(f"{ext}.posted_at"),
        "tags": F.array_join(tags, ", "), "company_logo": r.text("thumbnail"),
    }


register_feed(FeedSpec("Google Jobs", "json", google_jobs, describe=tx.strip, items=("$.jobs_results",), cap_by="keyword"))


def findwork(r: Item, p: SearchParams) -> dict[str, Column]:
    far = r.flag("remote")
    return {
        "title": r.text("role"), "company": r.text("company_name"),
        "location": tx.first_nonempty(r.raw("location", "string"), F.when(far, "Remote")),
        "description": r.first("text", "description"), "url": r.text("url"),
        "remote": cl.remote_flag(far), "salary_min": r.number("salary_min"), "salary_max": r.number("salary_max"),
        "job_type": r.text("employment_type", p.job_type), "date_posted": r.text("date_posted"),
        "tags": r.listed("keywords"), "company_logo": r.text("company_logo"),
    }


register_feed(FeedSpec("Findwork", "json", findwork, items=("$.results",), cap_by="keyword"))


def careerjet(r: Item, p: SearchParams) -> dict[str, Column]:
    place = r.listed("locations")
    return {
        "title": r.text("title"), "company": r.text("company"), "location": place,
        "description": r.first("description", "snippet"), "url": r.text("url"),
        "remote": cl.remote_by_text(place, no="Unknown"), "date_posted": r.text("date"),
    }


register_feed(FeedSpec("CareerJet", "json", careerjet, items=("$.hits",), dedup="url", cap_by="keyword",
                       filters_remote="none", filters_salary=False))


def jobdata(r: Item, p: SearchParams) -> dict[str, Column]:
    stripped = lambda path: tx.strip(r.text(path))
    by_id = F.concat(F.lit("https://jobdataapi.com/api/jobs/"), r.text("id"), F.lit("/"))
    published = r.text("published")
    return {
        "title": stripped("title"), "company": tx.first_nonempty(stripped("company.name"), F.lit("Unknown")),
        "location": stripped("location"), "url": tx.first_nonempty(stripped("application_url"), by_id),
        "description": tx.cap_text(tx.strip(r.first("description_string", "description")), 5000),
        "remote": cl.remote_flag(r.flag("has_remote")),
        "salary_min": r.number("salary_min"), "salary_max": r.number("salary_max"),
        "salary_currency": tx.first_nonempty(stripped("salary_currency"), F.lit("USD")),
        "experience_level": cl.experience_from_code(stripped("experience_level")),
        "date_posted": F.when(F.length(published) >= 10, _day(published)).otherwise(""),
        "company_logo": stripped("company.logo"),
    }


register_feed(FeedSpec("JobData", "json", jobdata, describe=tx.strip, items=("$.results",), needs="title", dedup="url",
                       cap_by="keyword", filters_remote="none", filters_salary=False))


# ---- RSS feeds ------------------------------------------------------------------------------
def weworkremotely(r: Item, p: SearchParams) -> dict[str, Column]:
    company, title = tx.split_company_title(r.text("title"))
    tags = F.array_join(F.coalesce(r.raw("category"), F.array().cast("array<string>")), ", ")
    return {
        "title": title, "company": company, "location": F.lit("Remote"),
        "description": r.text("description"), "url": r.text("link"), "remote": F.lit("Remote"),
        "job_type": F.lit(p.job_type or FULL_TIME), "date_posted": r.text("pubDate"),
        "tags": tx.first_nonempty(tags, r.board),
    }


register_feed(FeedSpec("WeWorkRemotely", "rss", weworkremotely, remote_only=True,
                       searched=lambda r: [r.text("title"), r.text("description"), r.board]))


def lobsters(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": r.text("title"), "description": r.text("description"), "url": r.text("link"),
        "date_posted": r.text("pubDate"), "tags": F.lit("lobsters, job"),
    }


register_feed(FeedSpec("Lobsters", "rss", lobsters, filters_remote="none", filters_salary=False,
                       searched=lambda r: [r.text("title"), r.text("description")]))


def _devit_text(r: Item) -> Column:
    tags = F.array_join(F.coalesce(r.raw("category"), F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", r.text("title"), r.first("author", "dc:creator"), r.text("description"), tags)


def devitjobs(r: Item, p: SearchParams) -> dict[str, Column]:
    pay = money.salary_range_currency(F.concat_ws(" ", r.text("title"), r.text("description")))
    raw = r.first("pubDate", "updated")
    tags = F.filter(F.coalesce(r.raw("category"), F.array().cast("array<string>")), lambda t: t != "")
    return {
        "title": r.text("title"), "company": r.first("author", "dc:creator"),
        "location": tx.first_nonempty(r.raw("location", "string"), F.lit("United Kingdom")),
        "description": r.text("description"), "url": r.text("link"),
        "remote": cl.remote_by_text(_devit_text(r)), **_salary(pay), "salary_currency": pay["currency"],
        "date_posted": F.coalesce(F.date_format(dt.mail_date(raw), "yyyy-MM-dd"), dt.cut_time(raw)),
        "tags": F.array_join(tags, ", "),
    }


register_feed(FeedSpec("DevITjobs", "rss", devitjobs, searched=lambda r: [_devit_text(r)]))


def totaljobs(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": r.text("title"), "company": r.text("author"), "location": F.lit(p.location),
        "description": r.text("description"), "url": r.text("link"), "date_posted": r.text("pubDate"),
    }


register_feed(FeedSpec("Totaljobs", "rss", totaljobs, dedup="url", cap_by="keyword", filters_remote="none",
                       filters_salary=False, searched=lambda r: [r.text("title"), r.text("description")]))


# ---- cards of web pages, landed as rows ---------------------------------------------------------
def remote_co(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": tx.first_nonempty(r.raw("title"), F.lit("Remote job")), "company": r.text("company"),
        "location": F.lit("Remote"), "description": r.text("description"),
        "url": tx.first_nonempty(r.raw("url"), F.lit("https://remote.co")), "remote": F.lit("Remote"),
    }


register_feed(FeedSpec(
    "Remote.co", "table", remote_co, describe=tx.strip, dedup="url", cap_by="keyword", remote_only=True,
    filters_salary=False, keep=lambda r: (r.text("title") != "") | (r.text("url") != ""),
    searched=lambda r: [r.text("title"), r.text("company"), r.text("description")]))


def govuk(r: Item, p: SearchParams) -> dict[str, Column]:
    return {
        "title": tx.first_nonempty(r.raw("title"), F.lit("Job")), "company": r.text("company"),
        "location": r.text("location"), "url": r.text("url"), "tags": F.lit("UK, government"),
    }


register_feed(FeedSpec(
    "GOV.UK Find a Job", "table", govuk, describe=tx.strip, dedup="all", cap_by="keyword", filters_remote="none",
    filters_salary=False, searched=lambda r: [r.text("title"), r.text("company"), r.text("location")]))


def linkedin_direct(r: Item, p: SearchParams) -> dict[str, Column]:
    title, as_of = tx.undouble(r.text("title")), F.to_date(r.landed)
    attr = tx.strip(r.text("posted_attr"))
    posted = F.when(dt.is_iso(attr), _day(attr)).otherwise(dt.relative_date(r.text("posted_text"), as_of))
    title = tx.first_nonempty(title, F.col("keyword"))
    return {
        "title": title, "company": tx.first_nonempty(r.raw("company"), F.lit("Unknown")),
        "location": r.text("location"), "url": r.text("url"),
        "remote": cl.remote_by_pattern(r.text("location"), title), "date_posted": posted,
    }


register_feed(FeedSpec(
    "LinkedIn (Direct)", "table", linkedin_direct, describe=tx.strip, dedup="url", cap_by="keyword",
    filters_remote="remote", filters_salary=False, keep=lambda r: links.is_listing_link(r.text("url"))))


# ---- tables -----------------------------------------------------------------------------------
TABLE_COLUMNS = (
    "job_url string, job_url_direct string, title string, company_name string, company string, location string, "
    "description string, site string, date_posted string, is_remote boolean, min_amount double, max_amount double, "
    "currency string, job_type string, company_logo string, logo_photo_url string"
)


def jobspy(r: Item, p: SearchParams) -> dict[str, Column]:
    site = r.text("site")
    label = F.when(site != "", F.concat(F.lit("JobSpy ("), tx.title_case(site), F.lit(")"))).otherwise("JobSpy")
    return {
        "title": r.text("title"), "company": r.first("company_name", "company"), "location": r.text("location"),
        "description": r.text("description"), "url": r.first("job_url", "job_url_direct"),
        "source": label, "remote": cl.remote_flag(r.flag("is_remote")),
        "salary_min": r.number("min_amount"), "salary_max": r.number("max_amount"),
        "salary_currency": tx.first_nonempty(r.raw("currency"), F.lit("USD")),
        "job_type": tx.label_case(tx.first_nonempty(r.raw("job_type"), F.lit(p.job_type))),
        "date_posted": r.text("date_posted"), "company_logo": r.first("company_logo", "logo_photo_url"),
    }


def _short_html(c: Column) -> Column:
    return tx.cap_text(clean_html(c), 5000)


register_feed(FeedSpec("JobSpy", "table", jobspy, describe=_short_html, dedup="url", cap_by="keyword", place_is_remote=True))
register_feed(FeedSpec("LinkedIn", "table", jobspy, describe=_short_html, dedup="url", cap_by="keyword", relabel="LinkedIn", place_is_remote=True,
                       keep=lambda r: F.lower(r.text("site")) == "linkedin"))
