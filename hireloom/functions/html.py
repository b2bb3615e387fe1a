"""Columns over page markup and page URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom.functions.text import blank_to_null, clean, strip

# Shapes of a job-view URL.
JOB_ID_PATTERN = (
    r"(?i)(?:linkedin\.com/(?:jobs/view|jobs/collections/[^/]+/)/|currentJobId=)(\d{6,})"
)
JOB_URL_PREFIX = "https://www.linkedin.com/jobs/view/"
# What takes the place of markup, in this order; the results depend on the order.
MARKUP = [
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(p|li|h\d|div)>", "\n"),
    (r"<[^>]+>", " "),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]


def strip_html(markup: Column) -> Column:
    text = markup
    for pattern, put in MARKUP:
        text = F.regexp_replace(text, pattern, put)
    return clean(text)


def first_text(html: Column, patterns: list[str]) -> Column:
    """Cleaned first group of the first pattern that gives any text."""
    found = [strip_html(blank_to_null(F.regexp_extract(html, f"(?is){p}", 1))) for p in patterns]
    return F.coalesce(*found)


def job_id(url: Column) -> Column:
    """Job id of a URL or of bare digits; null when there is none."""
    text = strip(url)
    return F.coalesce(
        blank_to_null(F.regexp_extract(text, JOB_ID_PATTERN, 1)),
        blank_to_null(F.regexp_extract(text, r"^\d{6,}$", 0)),
    )


def job_url(url: Column) -> Column:
    return F.concat(F.lit(JOB_URL_PREFIX), job_id(url), F.lit("/"))


def page_url(url: Column) -> Column:
    """Scheme, host and path of any URL, without query and fragment."""
    return F.regexp_replace(clean(url), r"[?#].*$", "")
