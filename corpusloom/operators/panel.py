"""PRC: the price panel, kept long (ticker, date, close), and the calendar of disclosure events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Month of the annual and the interim disclosure by sector; anything else: 4 and 9.
ANNUAL_MONTH = {"Banking": 3, "Oil & Gas": 4, "Consumer Goods": 4, "Telecoms": 3, "Industrial": 4}
INTERIM_MONTH = {"Banking": 8, "Oil & Gas": 9, "Consumer Goods": 9, "Telecoms": 8, "Industrial": 9}


def dense(prices: DataFrame) -> DataFrame:
    """PRC-01: mean close of each key on the grid of all dates and tickers, null where a ticker has none.

    The grid is dates times tickers by definition; the smaller side is streamed against the other's distinct values.
    """
    mean = prices.groupBy("ticker", "date").agg(F.avg("close").alias("close"))
    grid = mean.select("date").distinct().crossJoin(mean.select("ticker").distinct())
    return grid.join(mean, ["ticker", "date"], "left")


def _by_date():
    return Window.partitionBy("ticker").orderBy("date")


def log_returns(panel: DataFrame) -> DataFrame:
    """PRC-02: null where either side is."""
    return panel.withColumn("ret", F.log(F.col("close") / F.lag("close").over(_by_date())))


def simple_returns(panel: DataFrame) -> DataFrame:
    """PRC-03: change against the last known close; a gap gives 0 and then catches up."""
    filled = panel.withColumn("close", F.last("close", ignorenulls=True).over(_by_date().rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("ret", F.col("close") / F.lag("close").over(_by_date()) - 1)


def market_proxy(returns: DataFrame) -> DataFrame:
    """PRC-05: mean return of the tickers by date, nulls skipped."""
    return returns.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("market"))


def with_market(returns: DataFrame, market: DataFrame) -> DataFrame:
    """PRC-04."""
    return returns.join(market, "date", "left")


def disclosure_calendar(companies: DataFrame, first: int = 2020, last: int = 2024) -> DataFrame:
    """PRC-06: an annual and an interim event per company and year, on the 15th of the sector's month."""
    month = lambda m, d: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("sector")], F.lit(d))
    kinds = F.array(F.struct(F.lit("annual_report").alias("doc_type"), month(ANNUAL_MONTH, 4).alias("m")), F.struct(F.lit("interim_report").alias("doc_type"), month(INTERIM_MONTH, 9).alias("m")))
    rows = companies.select("ticker", F.col("name").alias("company"), "sector", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("fiscal_year"))
    rows = rows.withColumn("k", F.explode(kinds))
    return rows.select("ticker", "company", "sector", "fiscal_year", F.col("k.doc_type").alias("doc_type"), F.make_date("fiscal_year", F.col("k.m"), F.lit(15)).alias("estimated_date"))


def enrich_dates(events: DataFrame, actual: DataFrame, order: str) -> DataFrame:
    """PRC-07: the actual date by ticker, year and type, the last of repeated ones."""
    known = actual.groupBy("ticker", F.col("year").cast("string").alias("__y"), "doc_type").agg(F.max_by("actual_date", order).alias("actual_date"))
    joined = events.withColumn("__y", F.col("fiscal_year").cast("string")).join(known, ["ticker", "__y", "doc_type"], "left").drop("__y")
    return joined.withColumn("event_date", F.coalesce("actual_date", "estimated_date"))


def price_stats(prices: DataFrame) -> DataFrame:
    """PRC-08."""
    return prices.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def union_prices(frames: list[DataFrame]) -> DataFrame:
    """SRC-20: all frames of prices as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def market_index(primary: DataFrame | None, fallback: DataFrame | None) -> DataFrame | None:
    """SRC-19: (date, market_close) of the first of two sources that has rows; None if neither has."""
    for source in (primary, fallback):
        if source is not None and not source.isEmpty():
            return source.select("date", F.col("close").alias("market_close"))
    return None


def load_prices(prices: DataFrame, ticker: str) -> DataFrame:
    """SRC-23: one ticker's rows by date with their position from 0."""
    rows = prices.filter(F.col("ticker") == ticker)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def event_dates(events: DataFrame) -> DataFrame:
    """SRC-04: the actual date of an event, else the estimated one."""
    return events.withColumn("event_date", F.coalesce("actual_date", "estimated_date"))


def between_dates(prices: DataFrame, first: str, last: str) -> DataFrame:
    """SRC-21: rows of a range of dates, both ends included."""
    return prices.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
