"""Column functions that clean and classify disclosure text. All but the Unicode form stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Lines dropped when they match from their beginning, in any case.
NOISE_LINES = (
    r"\s*\d+\s*$",
    r"\s*page\s+\d+\s+of\s+\d+\s*$",
    r"\s*annual report\s+20\d{2}\s*$",
    r"\s*[A-Z\s]{3,50}\s+plc\s*$",
    r"\s*www\.[a-z\-\.]+\.(com|ng|net)\s*$",
    r"\s*\|\s*\d+\s*\|\s*$",
    r"confidential.*?only\s*$",
    r"\s*for the (year|period) ended.*?$",
    r".*?(?:/|\|)\s*(?:annual report|business review|strategic report|financial statements).*$",
    r"\s*(?:strategic report|business review|annual report)\s*$",
)
# Phrases replaced by a space, one after another.
BOILERPLATE = (
    r"this annual report (is|has been) prepared",
    r"forward.looking statements.*?actual results",
    r"registered (office|address):\s*[^\n]{0,100}",
    r"rc\s*no\.?\s*\d+",
    r"frc/\d{4}/\w+/\d+",
    r"incorporated in nigeria",
    r"securities and exchange commission",
    r"nigerian exchange group",
    r"this report (was|is) printed on",
)
# Words that tell outlook and sentiment.
FORWARD_WORDS = ("outlook", "expect", "anticipate", "forecast", "project", "guidance", "target", "plan", "strategy", "objective", "will", "intend", "believe", "2024", "2025", "going forward", "next year", "upcoming", "future")
SENTIMENT_WORDS = ("growth", "decline", "increase", "decrease", "improved", "challenges", "opportunity", "risk", "strong", "weak", "performance", "revenue", "profit", "loss", "recovery")
# Document classes by substring; the first that fits.
DOC_TYPES = (
    ("annual_report", ("annual report", "annual-report", "fy", "full year")),
    ("interim_report", ("half year", "h1", "h2", "interim")),
    ("quarterly_results", ("q1", "q2", "q3", "q4", "quarterly")),
    ("earnings_release", ("earnings", "press release", "unaudited")),
    ("agm_statement", ("agm", "annual general")),
)
# Section headings that begin and end a narrative section.
SECTIONS = {
    "chairman_statement": (("chairman", "chairman's statement", "chairman's letter"), ("chief executive", "managing director", "board of directors", "corporate governance", "directors' report")),
    "ceo_review": (("chief executive", "ceo's review", "managing director", "chief executive's review", "ceo review"), ("financial review", "operating review", "business review", "corporate governance", "our strategy")),
    "operating_review": (("operating review", "business review", "financial review", "management discussion", "performance review"), ("risk", "governance", "sustainability", "directors' report")),
    "outlook": (("outlook", "prospects", "looking ahead", "future plans", "going forward", "2024 outlook", "2025 outlook"), ("risk", "governance", "directors", "financial statements", "auditor", "notes to")),
}
TARGET_YEARS = (2020, 2021, 2022, 2023, 2024)
MIN_CHARS, MAX_CHARS = 200, 40_000


# White space of any kind, as the pattern class has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def one_space(c: Column) -> Column:
    """Each run of white space as one space; runs that are one already are not touched."""
    return F.regexp_replace(c, r"(?U) \s+|[^\S ]\s*", " ")


@F.pandas_udf(StringType())
def compatible_form(s: pd.Series) -> pd.Series:
    """NFKC, which Spark lacks."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def plain_characters(c: Column) -> Column:
    """TXT-01: compatible form, ASCII quotes and dashes, currency sign as letters."""
    c = F.translate(compatible_form(c), "\u2018\u2019\u201c\u201d\u2013\u00a0", "''\"\"- ")
    return F.replace(F.replace(c, F.lit("—"), F.lit(" - ")), F.lit("₦"), F.lit("NGN"))


def drop_noise_lines(c: Column) -> Column:
    """TXT-02: lines that match one of NOISE_LINES are dropped; the others keep their spaces."""
    pattern = "(?iuUd)^(?:" + "|".join(NOISE_LINES) + ")"
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda l: ~F.rlike(strip(l), F.lit(pattern))), "\n")


def drop_boilerplate(c: Column) -> Column:
    """TXT-03."""
    for p in BOILERPLATE:
        c = F.regexp_replace(c, f"(?isuUd){p}", " ")
    return c


def repair_artifacts(c: Column) -> Column:
    """TXT-04, in this order."""
    for p, r in ((r"(\w)-\n(\w+)", "$1$2"), (" {3,}", "  "), (r"\n{3,}", "\n\n"), (r"\|{2,}", " "), (r"\.{4,}", " "), ("_{3,}", " "), (r"[\x{E000}-\x{F8FF}]", " ")):
        c = F.regexp_replace(c, f"(?uUd){p}", r)
    return c


def currency_words(c: Column) -> Column:
    """TXT-05."""
    for p, r in ((r"[N₦]'000", "(NGN thousands)"), (r"[N₦]'(million|billion)", "(NGN $1)"), (r"n(?<=\bn)aira\b", "NGN")):  # the letter first, then its boundary
        c = F.regexp_replace(c, f"(?iuU){p}", r)
    return c


def paragraphs(c: Column) -> Column:
    """TXT-06: one line per paragraph, blank lines between; one that begins in lower case joins the one before."""
    blocks = F.transform(F.split(c, r"(?U)\n\s*\n"), lambda b: strip(one_space(b)))
    return F.regexp_replace(F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n"), r"\n\n(?=\p{IsLowercase})", " ")


def n_words(c: Column) -> Column:
    """TXT-10."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(c), F.lit("|".join(w.replace(".", r"\.") for w in words)))


def quality(c: Column) -> Column:
    """TXT-09."""
    letters = F.length(F.regexp_replace(c, r"(?U)[^\p{L}\s]+", ""))
    forward, feeling = has_any(c, FORWARD_WORDS), has_any(c, SENTIMENT_WORDS)
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(n_words(c) < 50, "poor")
        .when(letters / F.length(c) < 0.6, "poor")
        .when(F.length(c) - F.length(F.translate(c, ".!?", "")) < 3, "poor")
        .when(forward & feeling, "good")
        .when(forward | feeling, "acceptable")
        .otherwise("poor")
    )


def clean_text(c: Column, unicode_form: bool = True) -> Column:
    """TXT-01..06 in order."""
    base = plain_characters(c) if unicode_form else c
    return strip(paragraphs(currency_words(repair_artifacts(drop_boilerplate(drop_noise_lines(base))))))


def clean_sections(df: DataFrame, column: str = "text", unicode_form: bool = True) -> DataFrame:
    """TXT-07: ``df`` with text, quality, char_count, original_len and compression in place of ``column``.

    The cleaned text comes out of a generator of one row, so that no filter above is pushed into the chain: it runs once per
    row. char_count is the length before a long text is cut.
    """
    rest = [c for c in df.columns if c != column]
    staged = df.select("*", F.explode(F.array(clean_text(F.col(column), unicode_form))).alias("__text")).withColumn("__n", F.length("__text"))
    n, text, empty = F.col("__n"), F.col("__text"), F.col(column).isNull() | (strip(F.col(column)) == "")
    kind = F.when(empty, "empty").when(n < MIN_CHARS, "too_short").when(n > MAX_CHARS, "truncated").otherwise(quality(text))
    cut = F.when(empty, "").when(n > MAX_CHARS, F.concat(F.substring(text, 1, MAX_CHARS), F.lit("\n[TRUNCATED]"))).otherwise(text)
    packed = F.when(~empty, F.round((1 - n / F.length(column)) * 100, 1))
    return staged.select(*rest, cut.alias("text"), kind.alias("quality"), F.when(empty, 0).otherwise(n).alias("char_count"), F.when(~empty, F.length(column)).alias("original_len"), packed.alias("compression"))


def section(c: Column, name: str, cap: int = 25_000) -> Column:
    """TXT-08: the text from the first heading that begins the section to the nearest that ends it, '' if none does."""
    starts, ends = SECTIONS[name]
    low = F.lower(c)
    quoted = lambda m: m.replace(".", r"\.")
    first = None
    for m in starts:
        at = F.regexp_instr(low, F.lit(rf"(?:^|\n)(?U)\s*{quoted(m)}[^\n\.]{{0,60}}(?:\n|$)"))
        here = F.when(at > 0, at - 1 + F.locate(m, F.substr(low, at)))
        first = here if first is None else F.coalesce(first, here)
    rest = F.substr(low, first + F.lit(50))
    stop = F.length(c) + 1
    for m in ends:
        at = F.regexp_instr(rest, F.lit(rf"\n(?U)\s*{quoted(m)}[^\n\.]{{0,60}}(?:\n|$)"))
        stop = F.least(stop, F.when(at > 0, first + 49 + at).otherwise(F.length(c) + 1))
    return F.coalesce(strip(F.substr(c, first, F.least(stop - first, F.lit(cap)))), F.lit(""))


def doc_type(c: Column) -> Column:
    """TXT-11."""
    low, out = F.lower(c), None
    for name, words in DOC_TYPES:
        hit = F.rlike(low, F.lit("|".join(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def report_year(title: Column, url: Column) -> Column:
    """TXT-12: the latest target year named in title or address."""
    both = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))
    return F.coalesce(*[F.when(both.contains(str(y)), str(y)) for y in sorted(TARGET_YEARS, reverse=True)])


def safe_filename(ticker: Column, title: Column, url: Column) -> Column:
    """TXT-13."""
    return F.concat_ws("_", ticker, F.regexp_replace(F.substring(title, 1, 40), r"[^\p{L}\p{N}]", "_"), F.substring(F.md5(url), 1, 8))


def repair_json(c: Column, schema: str) -> Column:
    """TXT-14: fences off, from the first brace to the last, null where that is no JSON."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def fill_prompt(template: Column, passage: Column) -> Column:
    """TXT-16."""
    return F.replace(F.replace(F.replace(template, F.lit("{passage}"), passage), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def links(html: Column) -> Column:
    """SRC-16: (href, label) of each anchor."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*?href=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?is)href=\"([^\"]*)\"", 1).alias("href"), strip(F.regexp_replace(F.regexp_extract(a, r"(?is)^<a[^>]*>(.*)</a>$", 1), "<[^>]+>", "")).alias("label")))
