"""EVT: event windows on trading-day positions.

Every range join has the ticker as equality key and a bounded number of positions per event, so it is planned as a hash or
sort-merge join with a residual filter and never as a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EST_START, EST_END, MIN_EST, MIN_ALIGNED, REACH = 250, 30, 100, 110, 10
# The windows of cumulative abnormal returns.
WINDOWS = ((-1, 1), (0, 1), (0, 3), (0, 5), (-1, 3), (-1, 5))


def aligned(returns: DataFrame, market: DataFrame) -> DataFrame:
    """EVT-01: (ticker, date, ret, market, pos) on dates where both are known; tickers with too few dates are left out."""
    both = returns.filter("ret is not null").join(market.filter("market is not null"), "date").select("ticker", "date", "ret", "market")
    w = Window.partitionBy("ticker")
    both = both.withColumn("pos", (F.row_number().over(w.orderBy("date")) - 1).cast("int")).withColumn("n", F.count("*").over(w))
    return both.filter(F.col("n") >= MIN_ALIGNED).drop("n")


def as_of(events: DataFrame, panel: DataFrame) -> DataFrame:
    """EVT-02: ``loc``, the position of the first trading day on or after the event; events past the end are left out.

    One sort per ticker over the union of both sides, instead of a join of every event with every later day.
    """
    days = panel.select("ticker", F.col("date").alias("d"), "pos", F.lit(None).cast("string").alias("event_id"))
    marks = events.select("ticker", F.col("event_date").alias("d"), F.lit(None).cast("int").alias("pos"), "event_id")
    ahead = Window.partitionBy("ticker").orderBy("d", F.col("event_id").isNull()).rowsBetween(0, Window.unboundedFollowing)
    found = days.unionByName(marks).withColumn("loc", F.first("pos", ignorenulls=True).over(ahead)).filter("event_id is not null and loc is not null")
    return events.join(found.select("ticker", "event_id", "loc"), ["ticker", "event_id"])


def window_rows(events: DataFrame, panel: DataFrame, lo: int, hi: int) -> DataFrame:
    """Panel rows at loc+lo..loc+hi of each event, with ``day``: positions are enumerated and joined by equality."""
    wanted = events.select("event_id", "ticker", "loc", F.explode(F.sequence(F.greatest(F.col("loc") + lo, F.lit(0)), F.greatest(F.col("loc") + hi, F.lit(0)))).alias("pos")).filter((F.col("pos") >= F.col("loc") + lo) & (F.col("pos") <= F.col("loc") + hi))
    return wanted.join(panel, ["ticker", "pos"]).withColumn("day", F.col("pos") - F.col("loc"))


def market_model(events: DataFrame, panel: DataFrame) -> DataFrame:
    """EVT-03, EVT-04: alpha, beta, R2, residual deviation (of n) and n per event; events with too few days are left out.

    An event nearer than EST_END to the beginning has no estimate.
    """
    rows = window_rows(events, panel, -EST_START, -EST_END - 1)
    out = rows.groupBy("event_id", "ticker", "loc").agg(F.regr_intercept("ret", "market").alias("alpha"), F.regr_slope("ret", "market").alias("beta"), F.regr_r2("ret", "market").alias("r2"), F.regr_syy("ret", "market").alias("syy"), F.count("*").alias("n_obs"))
    return out.filter(F.col("n_obs") >= MIN_EST).withColumn("sigma", F.sqrt(F.col("syy") * (1 - F.col("r2")) / F.col("n_obs"))).drop("syy")


def abnormal_returns(models: DataFrame, panel: DataFrame, reach: int = REACH) -> DataFrame:
    """EVT-05: (event_id, ticker, day, ret, market, expected, ar)."""
    rows = window_rows(models, panel, -reach, reach).join(models.select("event_id", "alpha", "beta"), "event_id")
    rows = rows.withColumn("expected", F.col("alpha") + F.col("beta") * F.col("market"))
    return rows.select("event_id", "ticker", "day", "ret", "market", "expected", (F.col("ret") - F.col("expected")).alias("ar"))


def name_of(a: int, b: int) -> str:
    return f"car_{'m' if a < 0 else ''}{abs(a)}_{b}"


def cumulative(ar: DataFrame, windows: tuple = WINDOWS) -> DataFrame:
    """EVT-06: one column per window, null where it has no day."""
    return ar.groupBy("event_id", "ticker").agg(*[F.round(F.sum(F.when(F.col("day").between(a, b), F.col("ar"))), 6).alias(name_of(a, b)) for a, b in windows])


def buy_and_hold(ar: DataFrame, last: int = 5) -> DataFrame:
    """EVT-07: null with fewer than two days."""
    rows = ar.filter(F.col("day").between(0, last)).groupBy("event_id", "ticker").agg(F.count("*").alias("n"), F.product(1 + F.col("ret")).alias("r"), F.product(1 + F.col("market")).alias("m"))
    return rows.select("event_id", "ticker", F.round(F.when(F.col("n") >= 2, F.col("r") - F.col("m")), 6).alias("bhar"))


def mean_adjusted(events: DataFrame, panel: DataFrame, spans: tuple = (1, 3, 5), before: int = 121, gap: int = 2, least: int = 10) -> DataFrame:
    """EVT-10: returns over the mean of the days before; that mean is 0 with ``least`` days or fewer."""
    est = window_rows(events, panel, -before, -gap - 1).groupBy("event_id").agg(F.avg("ret").alias("mean"), F.count("ret").alias("n_est"))
    rows = window_rows(events, panel, 0, max(spans) - 1).join(est, "event_id", "left").withColumn("mu", F.when(F.col("n_est") > least, F.col("mean")).otherwise(0.0))
    ar = F.coalesce("ret", F.lit(0.0)) - F.col("mu")
    return rows.groupBy("event_id", "ticker").agg(*[F.round(F.sum(F.when(F.col("day") < s, ar)), 6).alias(f"car_{s}d") for s in spans], F.count("*").alias("n_days"))


def filing_events(index: DataFrame) -> DataFrame:
    """EVT-11: an event 90 days after the end of each document's year."""
    return index.filter(F.col("year").rlike(r"^\d{4}$")).withColumn("event_date", F.date_add(F.make_date(F.col("year").cast("int"), F.lit(12), F.lit(31)), 90))


def average_by_day(ar: DataFrame, reach: int = 5) -> DataFrame:
    """EVT-12: mean abnormal return by day with its standard error."""
    out = ar.filter(F.col("day").between(-reach, reach)).groupBy("day").agg(F.avg("ar").alias("m"), (F.stddev_samp("ar") / F.sqrt(F.count("ar"))).alias("s"), F.count("ar").alias("n"))
    return out.select("day", F.round("m", 6).alias("mean_ar"), F.round("s", 6).alias("sem"), "n", F.round(1.96 * F.col("s"), 6).alias("ci95"))


def results(events: DataFrame, models: DataFrame, ar: DataFrame, sectors: DataFrame) -> DataFrame:
    """EVT-08: a row per event with an estimate: its model, cumulative returns and the sector of the company list (null if not in it)."""
    m = models.select("event_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 4).alias("beta"), F.round("r2", 4).alias("r_squared"), F.round("sigma", 6).alias("std_error"), F.col("n_obs").alias("est_n_obs"))
    dim = sectors.select("ticker", F.col("sector").alias("__s"))
    out = events.join(m, "event_id").join(cumulative(ar).drop("ticker"), "event_id").join(buy_and_hold(ar).drop("ticker"), "event_id", "left").join(dim, "ticker", "left")
    return out.drop("sector").withColumnRenamed("__s", "sector")


def with_sentiment(found: DataFrame, scores: DataFrame) -> DataFrame:
    """EVT-09: scores by ticker and fiscal year (as text); events without keep nulls."""
    return found.withColumn("__y", F.col("fiscal_year").cast("string")).join(scores.withColumnRenamed("year", "__y"), ["ticker", "__y"], "left").drop("__y")


def simple_study(events: DataFrame, panel: DataFrame, spans: tuple = (1, 3, 5)) -> DataFrame:
    """EVT-10, EVT-11: every event with its mean-adjusted returns, or ``error``: no_price_data or event_date_out_of_range."""
    got = mean_adjusted(as_of(events, panel), panel, spans).drop("ticker")
    known = panel.select("ticker").distinct().withColumn("__k", F.lit(True))
    out = events.join(got, "event_id", "left").join(known, "ticker", "left")
    return out.withColumn("error", F.when(F.col("__k").isNull(), "no_price_data").when(F.col("n_days").isNull(), "event_date_out_of_range")).drop("__k")
