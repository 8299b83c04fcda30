"""SRC-16: links to disclosures on fetched pages, by the rules of three kinds of site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TARGET_YEARS, doc_type, links

# Words that tell a relevant document.
REPORT_WORDS = (
    "annual report", "annual-report", "annualreport", "full year results", "full-year", "fy202", "fy 202", "half year results", "half-year", "h1 202", "h2 202", "earnings release", "investor presentation",
    "q1 results", "q2 results", "q3 results", "q4 results", "financial statements", "audited accounts", "directors report", "chairman statement",
)


def absolute(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base``: absolute ones stay, others take its scheme, host or folder."""
    host = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.concat(host, F.regexp_replace(F.regexp_replace(F.substring(base, F.length(host) + 1, F.length(base)), r"[?#].*$", ""), r"[^/]*$", ""))
    folder = F.when(folder == host, F.concat(host, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", 0), href))
        .when(href.startswith("/"), F.concat(host, href))
        .when(href == "", base)
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(?:\./)+", "")))
    )


def disclosure_links(pages: DataFrame, site: str) -> DataFrame:
    """Links of ``pages`` (ticker, url, html) by the rule of ``site``: portal (pdf and year), company_ir (pdf and word or year), news (word and year in the label)."""
    rows = pages.select("ticker", "url", F.inline(links(F.col("html")))).withColumn("low", F.lower("label"))
    has = lambda c, words: F.lit(False) if not words else c.rlike("|".join(w.replace(".", r"\.") for w in words))
    years = tuple(map(str, TARGET_YEARS))
    pdf, label, both = F.col("href").endswith(".pdf"), F.col("low"), F.concat("low", F.lit(" "), "href")
    if site == "portal":
        hit, told = pdf & has(F.concat("href", "low"), years), F.concat("low", F.lower("href"))
    elif site == "company_ir":
        hit, told = pdf & (has(F.lower(both), REPORT_WORDS) | has(both, years)), F.lower(both)
    else:
        hit, told = has(label, REPORT_WORDS) & has(label, years), label
    stem = F.regexp_replace(F.element_at(F.split("href", "/"), -1), r"\.[^.]*$", "")
    title = F.when((F.col("label") == "") & F.lit(site == "company_ir"), stem).otherwise(F.col("label"))
    return rows.filter(hit).select(F.lit(site).alias("source"), "ticker", absolute(F.col("url"), F.col("href")).alias("url"), title.alias("title"), doc_type(told).alias("doc_type"))
