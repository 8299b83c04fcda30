"""SRC: typed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANY = "ticker string, name string, sector string, tier int, ir_url string, sec_url string"
PRICES = "date date, open double, high double, low double, close double, volume long, ticker string"


SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A Parquet table of a folder; ``spread`` for work on texts, see there."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_out(df) if spread else df


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is a small table in fewer files than cores, and else as it is read.

    A file of one row group is one task, however many cores are idle. Tables over ``SPREAD_BYTES`` a core are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def companies(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """SRC-01: the company list of a JSON file."""
    out = spark.read.schema(f"companies array<struct<{COMPANY.replace(' string', ':string').replace(' int', ':int')}>>").json(path, multiLine=True).select(F.inline("companies"))
    return out.filter(F.col("ticker") == ticker.upper()) if ticker else out


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with embedded line breaks and doubled quotes, under a declared schema."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def wide_prices(spark: SparkSession, path: str, tickers: list[str]) -> DataFrame:
    """SRC-03: a table of dates by tickers as (date, ticker, value)."""
    schema = "date date, " + ", ".join(f"`{t}` double" for t in tickers)
    return csv(spark, path, schema).unpivot("date", tickers, "ticker", "value").filter("value is not null")


def documents_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-14: nested documents of a folder tree, with the folder's name as ticker."""
    out = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    return out.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def binary_files(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """SRC-15, SRC-17: files with their bytes, without those over the limit; an extractor is applied by the caller."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= most_bytes)


def html_prices(rows: DataFrame, html: str = "html") -> DataFrame:
    """SRC-21: table rows of at least four cells: day-first date, thousands commas, close in the last cell."""
    tr = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<tr[^>]*>.*?</tr>)"), F.lit(1)))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    out = rows.select(*[c for c in rows.columns if c != html], tr.alias("tr")).withColumn("cells", cells).filter(F.size("cells") >= 4)
    number = F.expr("try_cast(replace(element_at(cells, -1), ',', '') as double)")
    date = F.coalesce(F.expr("try_to_date(cells[0], 'd/M/yyyy')"), F.expr("try_to_date(cells[0], 'd-M-yyyy')"), F.expr("try_to_date(cells[0], 'yyyy-MM-dd')"))
    return out.withColumn("date", date).withColumn("close", number).filter("date is not null and close is not null").drop("tr", "cells")


def predictions(df: DataFrame, need_label: bool = True) -> DataFrame:
    """SRC-06: without errors and, if asked, without empty labels."""
    out = df.filter(F.nullif(F.col("error"), F.lit("")).isNull())
    return out.filter(F.nullif(F.col("pred_sentiment"), F.lit("")).isNotNull()) if need_label else out
