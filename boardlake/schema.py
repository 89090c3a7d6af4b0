"""Canonical tables as Spark schemas. Text columns hold '' where a value is missing."""

LISTING = (
    "job_id string, title string, company string, location string, description string, "
    "url string, source string, remote string, salary_min decimal(12,2), "
    "salary_max decimal(12,2), salary_currency string, job_type string, "
    "experience_level string, date_posted string, date_scraped timestamp_ntz, "
    "tags string, company_logo string"
)

# Column order of the listing record and of its CSV export (fixed values).
LISTING_COLUMNS = [
    "job_id", "title", "company", "location", "description", "url", "source",
    "remote", "salary_min", "salary_max", "salary_currency", "job_type",
    "experience_level", "date_posted", "date_scraped", "tags", "company_logo",
]

MARK_LOG = "job_id string, kind string, action string, ts timestamp_ntz, notes string, seq bigint"
MARK_STATE = "job_id string, kind string, since timestamp_ntz, notes string"
MARK_KINDS = ["favourite", "applied", "not_interested"]

PROMPT = (
    "prompt_id bigint, title string, model string, cv string, about_me string, "
    "preferences string, extra_context string, is_active boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
ANALYSIS = "job_id string, prompt_id bigint, model string, result string, created_at timestamp_ntz"
SAVED = (
    "search_id bigint, query string, source string, remote string, job_type string, "
    "salary_min double, posted_in_last_days int, region string"
)
