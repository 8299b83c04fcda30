"""PSG: annotation passages from cleaned sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Which sections give passages, and the limits in words.
SECTION_ORDER = ("outlook", "chairman_statement", "ceo_review", "operating_review")
MIN_PARAGRAPH_CHARS, MIN_WORDS, SHORT_WORDS, LONG_WORDS, PACK_WORDS, MAX_NUMERIC = 100, 30, 80, 400, 150, 0.25


def _words(c):
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def chunks(c):
    """PSG-04: a long paragraph as packs of whole sentences, each closed once it has enough words."""
    packed = F.aggregate(
        F.split(c, r"(?U)(?<=[.!?])\s+"),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")),
        lambda acc, s: F.when(
            T.n_words(F.concat_ws(" ", F.nullif(acc["cur"], F.lit("")), s)) >= PACK_WORDS,
            F.struct(F.array_append(acc["done"], F.concat_ws(" ", F.nullif(acc["cur"], F.lit("")), s)).alias("done"), F.lit("").alias("cur")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat_ws(" ", F.nullif(acc["cur"], F.lit("")), s).alias("cur"))),
        lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])),
    )
    return F.when(T.n_words(c) > LONG_WORDS, packed).otherwise(F.array(c))


# What an annotator fills in, null at first.
LABEL_FIELDS = ("sentiment_label", "sentiment_intensity", "has_guidance", "guidance_type", "guidance_span", "annotator", "annotation_notes")


def extract_passages(sections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``sections`` (doc_id, ticker, year, section, text, quality, and what to ``keep``) to one row per passage, with empty label fields.

    Only good and acceptable sections of SECTION_ORDER; the id formula repeats across documents, doc_id tells them apart. A
    paragraph finds the next one in the array of its section, so nothing is shuffled.
    """
    base = sections.filter(F.col("section").isin(*SECTION_ORDER) & F.col("quality").isin("good", "acceptable"))
    paras = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda p: F.length(p) > MIN_PARAGRAPH_CHARS)
    rows = base.withColumn("__ps", paras)
    both = F.transform("__ps", lambda p, i: F.struct(p.alias("p"), F.get("__ps", i + 1).alias("next")))
    rows = rows.select("doc_id", "ticker", "year", "section", *keep, F.posexplode(both).alias("i", "__b"))
    rows = rows.select("doc_id", "ticker", "year", "section", *keep, "i", "__b.p", "__b.next").withColumn("n", T.n_words(F.col("p"))).filter(F.col("n") >= MIN_WORDS)
    rows = rows.withColumn("p", F.when((F.col("n") < SHORT_WORDS) & F.col("next").isNotNull(), F.concat_ws("\n\n", "p", "next")).otherwise(F.col("p")))
    rows = rows.select("doc_id", "ticker", "year", "section", *keep, "i", F.posexplode(chunks(F.col("p"))).alias("j", "text"))
    numeric = F.size(F.filter(_words(F.col("text")), lambda w: F.rlike(w, F.lit(r"(?U)\d"))))
    rows = rows.withColumn("word_count", T.n_words(F.col("text"))).filter((F.col("word_count") >= MIN_WORDS) & (numeric / F.col("word_count") <= MAX_NUMERIC))
    ident = F.concat_ws("_", "ticker", F.coalesce("year", F.lit("None")), "section", "i", "j")
    return rows.select("doc_id", ident.alias("passage_id"), "ticker", "year", "section", *keep, "i", "j", "text", "word_count", T.quality(F.col("text")).alias("quality"), *[F.lit(None).cast("string").alias(c) for c in LABEL_FIELDS], F.lit("pending").alias("annotation_status"))


def preserve_annotations(new: DataFrame, old: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """PSG-10: labels of earlier rows over the new ones, column by column where the old value is not null.

    Of earlier rows the last that isn't pending counts, of new ones the first.
    """
    kept = old.filter(~F.col("annotation_status").eqNullSafe("pending")).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__o"))
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), order).alias("__n"))
    joined = first.join(kept, key, "left")
    return joined.select(key, *[(F.coalesce(F.col(f"__o.{c}"), F.col(f"__n.{c}")) if c in columns else F.col(f"__n.{c}")).alias(c) for c in new.columns if c != key])


def documents_summary(passages: DataFrame) -> DataFrame:
    """PSG-08: passages and good ones per document."""
    return passages.groupBy("doc_id").agg(F.count("*").alias("passage_count"), F.count_if(F.col("quality") == "good").alias("good_passages"))


def run_corpus(sections: DataFrame, sector: str = "sector") -> tuple[DataFrame, DataFrame, DataFrame]:
    """PSG-09: (passages, summary by document, sums by sector) of raw ``sections`` (doc_id, ticker, year, section, text, ``sector``): cleaned, classed and cut into passages."""
    rest = ["doc_id", "ticker", "year", "section", sector]
    cleaned = T.clean_sections(sections.select(*rest, "text"), "text")
    found = extract_passages(cleaned, (sector,))
    counts = documents_summary(found)
    docs = sections.select("doc_id", "ticker", "year", sector).distinct().join(counts, "doc_id", "left").na.fill(0, ["passage_count", "good_passages"])
    sums = docs.groupBy(sector).agg(F.count("*").alias("documents"), F.sum("passage_count").alias("passages"), F.sum("good_passages").alias("good"))
    return found, docs, sums
