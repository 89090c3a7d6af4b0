"""The source dimension and feeds that contain other feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: name, website, needs a key, free of charge ---------------------------
SOURCES = [
    ("RemoteOK", "https://remoteok.com/", False, True),
    ("Arbeitnow", "https://arbeitnow.com/", False, True),
    ("The Muse", "https://www.themuse.com/", False, True),
    ("Jobicy", "https://jobicy.com/", False, True),
    ("Remotive", "https://remotive.com/", False, True),
    ("WeWorkRemotely", "https://weworkremotely.com/", False, True),
    ("JobSpy", "https://github.com/Bunsly/JobSpy", False, True),
    ("LinkedIn", "https://www.linkedin.com/jobs/", False, True),
    ("WorkingNomads", "https://www.workingnomads.com/", False, True),
    ("Lobsters", "https://lobste.rs/t/job", False, True),
    ("Greenhouse", "https://boards.greenhouse.io/", False, True),
    ("HN Who is hiring", "https://news.ycombinator.com/", False, True),
    ("Totaljobs", "https://www.totaljobs.com/", False, True),
    ("Remote.co", "https://remote.co/", False, True),
    ("GOV.UK Find a Job", "https://findajob.dwp.gov.uk/", False, True),
    ("Adzuna", "https://developer.adzuna.com/", True, True),
    ("Reed", "https://www.reed.co.uk/developers/", True, True),
    ("USAJobs", "https://developer.usajobs.gov/", True, True),
    ("Jooble", "https://jooble.org/api/about", True, True),
    ("Google Jobs", "https://serpapi.com/", True, True),
    ("Findwork", "https://findwork.dev/developers/", True, True),
    ("CareerJet", "https://www.careerjet.com/partners/api", True, True),
    ("JobData", "https://jobdataapi.com/docs/", False, True),
    ("LinkedIn (Direct)", "https://www.linkedin.com/jobs/", False, True),
    ("Lever", "https://jobs.lever.co/", False, True),
    ("Ashby", "https://jobs.ashbyhq.com/", False, True),
    ("Workable", "https://apply.workable.com/", False, True),
    ("JobsCollider", "https://jobscollider.com/", False, True),
    ("DevITjobs", "https://devitjobs.uk/", False, True),
]
# Sources listed as needing a key in the source picker.
KEY_SOURCES = ["Adzuna", "Reed", "USAJobs", "Jooble", "Google Jobs", "Findwork", "CareerJet", "JobData"]
FREE_SOURCES = [name for name, *_ in SOURCES if name not in KEY_SOURCES]
# A feed that is skipped when another one that contains it runs.
SUPERSEDED = [("LinkedIn", "JobSpy")]
# -----------------------------------------------------------------------------------------


def source_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "name string, website string, requires_api_key boolean, is_free boolean")


def superseded_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUPERSEDED, "feed string, superseded_by string")
