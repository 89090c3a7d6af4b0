"""Work arrangement, contract type, level, category, score labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from boardlake.functions.text import let

# ---- fixed values -------------------------------------------------------------------
LEVEL_CODES = {"EN": "Entry", "MI": "Mid", "SE": "Senior", "EX": "Executive"}
LEVEL_LABELS = {
    "entry": "Entry Level", "mid": "Mid Level", "senior": "Senior Level",
    "lead": "Senior Level", "executive": "Senior Level",
}
REMOTIVE_CATEGORIES = {
    "software": "software-dev", "engineer": "software-dev", "developer": "software-dev",
    "data": "data", "analyst": "data", "machine learning": "data", "design": "design",
    "marketing": "marketing", "product": "product", "customer": "customer-support",
    "sales": "sales", "devops": "devops-sysadmin", "finance": "finance-legal", "hr": "hr",
    "writing": "writing", "qa": "qa",
}
JOBSCOLLIDER_CATEGORIES = {
    "software": "software-development", "developer": "software-development",
    "engineer": "software-development", "data": "data", "devops": "devops-sysadmin",
    "sysadmin": "devops-sysadmin", "design": "design", "marketing": "marketing",
    "sales": "sales", "product": "product", "qa": "qa", "security": "cybersecurity",
    "cyber": "cybersecurity", "finance": "finance-legal", "legal": "finance-legal",
    "hr": "human-resources", "writing": "writing", "customer": "customer-service",
    "project": "project-management", "business": "business",
}
FEED_TRIGGERS = {
    "programming": ["developer", "engineer", "software", "python", "java", "react", "backend",
                    "frontend", "full stack", "web dev", "mobile"],
    "design": ["design", "ux", "ui", "graphic", "creative"],
    "devops": ["devops", "sysadmin", "infrastructure", "cloud", "aws", "azure", "kubernetes"],
    "management": ["manager", "management", "finance", "accounting", "project"],
    "customer_support": ["customer", "support", "service"],
    "sales_marketing": ["sales", "marketing", "growth", "seo", "content"],
}
FEED_DEFAULT = ["programming", "all_others"]
WORK_FROM_HOME = r"(?i)(remote|wfh|work from home)"
# -------------------------------------------------------------------------------------


def any_of(text: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(text, F.lit(n))
    return hit


def remote_flag(flag: Column, no: str = "On-site") -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "Remote").otherwise(no)


def remote_by_text(text: Column, needles: tuple[str, ...] = ("remote",), no: str = "On-site") -> Column:
    return remote_flag(let(F.lower(text), lambda low: any_of(low, list(needles))), no)


def remote_by_pattern(*texts: Column) -> Column:
    hit = F.lit(False)
    for t in texts:
        hit = hit | t.rlike(WORK_FROM_HOME)
    return remote_flag(hit)


def remote_by_workplace(workplace: Column, location: Column) -> Column:
    return (
        F.when(workplace == "remote", "Remote")
        .when(workplace == "hybrid", "Hybrid")
        .when(workplace == "on-site", "On-site")
        .otherwise(remote_by_text(location, no="Unknown"))
    )


def job_type_class(c: Column, temporary: bool = False) -> Column:
    contract = ["contract", "freelance"] + (["temporary"] if temporary else [])
    known = let(F.lower(c), lambda low: (
        F.when(any_of(low, ["full"]), "Full-time")
        .when(any_of(low, ["part"]), "Part-time")
        .when(any_of(low, contract), "Contract")
        .when(any_of(low, ["intern"]), "Internship")
    ))
    return F.coalesce(known, c, F.lit(""))


def _lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), default)


def experience_from_code(c: Column) -> Column:
    """EN, MI, SE, EX in any case; unknown codes pass through."""
    return _lookup(F.upper(c), LEVEL_CODES, c)


def experience_label(level: Column) -> Column:
    return _lookup(F.lower(level), LEVEL_LABELS, F.lit(""))


def category_guess(c: Column, table: dict[str, str]) -> Column:
    """Category of the first trigger, in table order, found in the text."""
    def first_hit(low: Column) -> Column:
        branch = F
        for trigger, category in table.items():
            branch = branch.when(F.contains(low, F.lit(trigger)), category)
        return branch.otherwise("")

    return let(F.lower(c), first_hit)


def feed_select(c: Column) -> Column:
    """All feed sections whose triggers occur; two default sections when none does."""
    hits = let(F.lower(c), lambda low: F.array_compact(
        F.array(*[F.when(any_of(low, t), F.lit(k)) for k, t in FEED_TRIGGERS.items()])
    ))
    default = F.array(*[F.lit(x) for x in FEED_DEFAULT])
    return let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(default))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 8, "success").when(score >= 6, "info").when(score >= 4, "warning")
        .otherwise("danger")
    )


def rubric_recommendation(score: Column) -> Column:
    return F.when(score >= 6, "apply").when(score >= 4, "maybe").otherwise("skip")
