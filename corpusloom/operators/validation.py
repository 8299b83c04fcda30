"""VAL: coverage and quality of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of a sufficient corpus.
MIN_TICKERS, MIN_SECTORS, MIN_YEARS, MIN_PER_SECTOR, MIN_SINGLE = 20, 5, 3, 20, 5
REQUIRED_SECTORS = ("Banking", "Oil & Gas", "Consumer Goods", "Telecoms", "Industrial")
REQUIRED_YEARS = ("2020", "2021", "2022", "2023", "2024")


def coverage(index: DataFrame) -> DataFrame:
    """VAL-01: distinct tickers, sectors and years, and whether they suffice. Exact, two-phase counts."""
    out = index.agg(F.count("*").alias("n_docs"), *[F.count_distinct(c).alias(f"n_{c}") for c in ("ticker", "sector", "year")])
    return out.withColumn("coverage_ok", (F.col("n_ticker") >= MIN_TICKERS) & (F.col("n_sector") >= MIN_SECTORS) & (F.col("n_year") >= MIN_YEARS))


def per_sector(index: DataFrame) -> DataFrame:
    """VAL-02."""
    return index.filter("sector is not null").groupBy("sector").agg(F.count("*").alias("n")).withColumn("sector_ok", F.col("n") >= MIN_PER_SECTOR)


def passage_quality(queue: DataFrame) -> DataFrame:
    """VAL-04."""
    usable = F.count_if(F.col("quality").isin("good", "acceptable"))
    return queue.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == "good").alias("good"), F.count_if(F.col("quality") == "acceptable").alias("acceptable"), F.count_if(F.col("quality") == "poor").alias("poor"), F.count_if(F.col("annotation_status") == "done").alias("annotated"), F.round(usable / F.count("*"), 6).alias("quality_ratio"), F.round(F.count_if(F.col("annotation_status") == "done") / F.count("*") * 100, 6).alias("progress"))


def word_counts(queue: DataFrame) -> DataFrame:
    """VAL-06: mean and exact median."""
    return queue.agg(F.round(F.avg("word_count"), 6).alias("mean_words"), F.round(F.median("word_count"), 6).alias("median_words"))


def gaps(index: DataFrame) -> DataFrame:
    """VAL-07: (kind, value) of what is missing or thin."""
    spark = index.sparkSession
    need = lambda col, values, kind: spark.createDataFrame([(v,) for v in values], "value string").join(index.select(F.col(col).cast("string").alias("value")).distinct(), "value", "left_anti").select(F.lit(kind).alias("kind"), "value")
    thin = per_sector(index).filter(~F.col("sector_ok")).select(F.lit("low_sector").alias("kind"), F.col("sector").alias("value"))
    single = index.filter("ticker is not null").groupBy("ticker").count().filter("count = 1")
    many = single.agg(F.count("*").alias("n")).filter(F.col("n") > MIN_SINGLE).select(F.lit("single_document_companies").alias("kind"), F.col("n").cast("string").alias("value"))
    return need("sector", REQUIRED_SECTORS, "missing_sector").unionByName(need("year", REQUIRED_YEARS, "missing_year")).unionByName(thin).unionByName(many)


def ready(index: DataFrame, queue: DataFrame) -> DataFrame:
    """VAL-08: one row of flags."""
    a = coverage(index).select("coverage_ok")
    b = per_sector(index).agg(F.every("sector_ok").alias("sectors_ok"))
    c = passage_quality(queue).select((F.col("quality_ratio") >= 0.5).alias("quality_ok"))
    return a.crossJoin(b).crossJoin(c).withColumn("ready", F.col("coverage_ok") & F.coalesce("sectors_ok", F.lit(False)) & F.col("quality_ok"))  # one row each
