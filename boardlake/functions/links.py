"""Listing ids and links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def listing_id(source: Column, url: Column, title: Column, company: Column) -> Column:
    """Stable id: md5 of source and link, or of source, title and company without a link."""
    by_url = F.concat_ws("|", source, url)
    by_name = F.concat_ws("|", source, title, company)
    return F.md5(F.when(F.coalesce(url, F.lit("")) != "", by_url).otherwise(by_name))


def absolute(url: Column, host: str) -> Column:
    """Relative links get the host; '' stays ''."""
    return F.when((url == "") | F.startswith(url, F.lit("http")), url).otherwise(
        F.concat(F.lit(host), url)
    )


def canonical_view(url: Column, host: str) -> Column:
    """Any link holding /jobs/view/<id> becomes host/jobs/view/<id>/."""
    found = F.regexp_extract(url, r"/jobs/view/(\d+)", 1)
    return F.when(found != "", F.concat(F.lit(f"{host}/jobs/view/"), found, F.lit("/"))).otherwise(url)


def is_listing_link(url: Column) -> Column:
    return F.contains(url, F.lit("/jobs/")) & ~F.contains(url, F.lit("premium/products"))
