"""Queries over prices, events and regressions. Prices: one series per return flag and line status of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eventstudy as E
from ..operators import panel as P
from ..operators import sentiment as SE
from ..operators import stats as ST
from ..sources.readers import table
from . import labels as L

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"))


_BASE = """px AS (SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close FROM lineitem), mean AS (SELECT ticker, date, avg(close) AS close FROM px GROUP BY ALL),
grid AS (SELECT t.ticker, d.date, m.close FROM (SELECT DISTINCT ticker FROM mean) t CROSS JOIN (SELECT DISTINCT date FROM mean) d LEFT JOIN mean m ON m.ticker = t.ticker AND m.date = d.date),
lr AS (SELECT ticker, date, close, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS ret FROM grid),
mk AS (SELECT date, avg(ret) AS market FROM lr WHERE ret IS NOT NULL GROUP BY date)"""
_PANEL = f"""{_BASE}, al AS (SELECT ticker, date, ret, market, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM lr JOIN mk USING (date) WHERE ret IS NOT NULL),
pan AS (SELECT * FROM al WHERE n >= {E.MIN_ALIGNED}),
ev AS (SELECT DISTINCT ticker, ticker || '_' || year(date) AS event_id, make_date(year(date), 3, 15) AS event_date FROM mean),
lo AS (SELECT e.event_id, e.ticker, min(p.pos) AS loc FROM ev e JOIN pan p ON p.ticker = e.ticker AND p.date >= e.event_date GROUP BY ALL)"""
_MODEL = f"""{_PANEL}, mo AS (SELECT lo.event_id, lo.ticker, lo.loc, regr_intercept(ret, market) AS alpha, regr_slope(ret, market) AS beta, regr_r2(ret, market) AS r2, regr_syy(ret, market) AS syy, count(*) AS n_obs FROM lo JOIN pan p ON p.ticker = lo.ticker AND p.pos >= greatest(lo.loc - {E.EST_START}, 0) AND p.pos < lo.loc - {E.EST_END} GROUP BY ALL HAVING count(*) >= {E.MIN_EST})"""
_AR = f"{_MODEL}, ar AS (SELECT m.event_id, m.ticker, p.pos - m.loc AS day, p.ret, p.market, m.alpha + m.beta * p.market AS expected, p.ret - (m.alpha + m.beta * p.market) AS ar FROM mo m JOIN pan p ON p.ticker = m.ticker AND p.pos BETWEEN m.loc - {E.REACH} AND m.loc + {E.REACH})"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    r = P.log_returns(P.dense(_prices(spark, d)))
    return E.aligned(r, P.market_proxy(r))


def _events(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("date")
    return _prices(spark, d).select("ticker", F.concat_ws("_", "ticker", y.cast("string")).alias("event_id"), F.make_date(y, F.lit(3), F.lit(15)).alias("event_date")).distinct()


def _models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    panel = _panel(spark, d)
    return E.market_model(E.as_of(_events(spark, d), panel), panel), panel


def _ar(spark: SparkSession, d: str) -> DataFrame:
    models, panel = _models(spark, d)
    return E.abnormal_returns(models, panel)


@query(f"WITH {_BASE} SELECT ticker, date, round(ret, 6) AS ret FROM lr")
def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return P.log_returns(P.dense(_prices(spark, d))).select("ticker", "date", F.round("ret", 6).alias("ret"))


@query(f"WITH {_BASE}, ff AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM grid) SELECT ticker, date, round(c / lag(c) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS ret FROM ff")
def simple_returns_ffill(spark: SparkSession, d: str) -> DataFrame:
    return P.simple_returns(P.dense(_prices(spark, d))).select("ticker", "date", F.round("ret", 6).alias("ret"))


@query(f"WITH {_BASE} SELECT date, round(market, 6) AS market FROM mk")
def market_proxy(spark: SparkSession, d: str) -> DataFrame:
    return P.market_proxy(P.log_returns(P.dense(_prices(spark, d)))).select("date", F.round("market", 6).alias("market"))


def _month(m: dict, default: int) -> str:
    return "CASE sector " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" ELSE {default} END"


@query(f"SELECT ticker, name AS company, sector, CAST(y AS INTEGER) AS fiscal_year, doc_type, make_date(CAST(y AS INTEGER), m, 15) AS estimated_date FROM (SELECT *, unnest(range(2020, 2025)) AS y FROM companies) c, LATERAL (SELECT 'annual_report' AS doc_type, {_month(P.ANNUAL_MONTH, 4)} AS m UNION ALL SELECT 'interim_report', {_month(P.INTERIM_MONTH, 9)})")
def event_calendar(spark: SparkSession, d: str) -> DataFrame:
    return P.disclosure_calendar(table(spark, d, "companies"))


@query("WITH px AS (SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM px GROUP BY ticker")
def price_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.price_stats(_prices(spark, d))


@query(f"WITH {_PANEL} SELECT event_id, ticker, loc FROM lo")
def asof_event(spark: SparkSession, d: str) -> DataFrame:
    return E.as_of(_events(spark, d), _panel(spark, d)).select("event_id", "ticker", "loc")


@query(f"WITH {_MODEL} SELECT event_id, ticker, loc, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2, n_obs, round(sqrt(syy * (1 - r2) / n_obs), 6) AS sigma FROM mo")
def market_model(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d)[0].select("event_id", "ticker", "loc", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "r2")], "n_obs", F.round("sigma", 6).alias("sigma"))


@query(f"WITH {_AR} SELECT event_id, ticker, day, round(expected, 6) AS expected, round(ar, 6) AS ar FROM ar")
def event_window_ar(spark: SparkSession, d: str) -> DataFrame:
    return _ar(spark, d).select("event_id", "ticker", "day", F.round("expected", 6).alias("expected"), F.round("ar", 6).alias("ar"))


_CAR = ", ".join(f"round(sum(CASE WHEN day BETWEEN {a} AND {b} THEN ar END), 6) AS {E.name_of(a, b)}" for a, b in E.WINDOWS)


@query(f"WITH {_AR} SELECT event_id, ticker, {_CAR} FROM ar GROUP BY event_id, ticker")
def car_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.cumulative(_ar(spark, d))


@query(f"WITH {_AR} SELECT event_id, ticker, round(CASE WHEN count(*) >= 2 THEN product(1 + ret) - product(1 + market) END, 6) AS bhar FROM ar WHERE day BETWEEN 0 AND 5 GROUP BY event_id, ticker")
def bhar(spark: SparkSession, d: str) -> DataFrame:
    return E.buy_and_hold(_ar(spark, d))


@query(f"""WITH {_PANEL}, es AS (SELECT lo.event_id, avg(ret) AS m, count(ret) AS k FROM lo JOIN pan p ON p.ticker = lo.ticker AND p.pos >= greatest(lo.loc - 121, 0) AND p.pos < lo.loc - 2 GROUP BY ALL),
w AS (SELECT lo.event_id, lo.ticker, p.pos - lo.loc AS day, coalesce(ret, 0) - CASE WHEN k > 10 THEN m ELSE 0.0 END AS a FROM lo JOIN pan p ON p.ticker = lo.ticker AND p.pos BETWEEN lo.loc AND lo.loc + 4 LEFT JOIN es USING (event_id))
SELECT event_id, ticker, {", ".join(f"round(sum(CASE WHEN day < {s} THEN a END), 6) AS car_{s}d" for s in (1, 3, 5))}, count(*) AS n_days FROM w GROUP BY ALL""")
def mean_adjusted_car(spark: SparkSession, d: str) -> DataFrame:
    panel = _panel(spark, d)
    return E.mean_adjusted(E.as_of(_events(spark, d), panel), panel)


@query(f"WITH {_AR} SELECT day, round(avg(ar), 6) AS mean_ar, round(stddev_samp(ar) / sqrt(count(ar)), 6) AS sem, count(ar) AS n, round(1.96 * stddev_samp(ar) / sqrt(count(ar)), 6) AS ci95 FROM ar WHERE day BETWEEN -5 AND 5 GROUP BY day")
def avg_ar_by_day(spark: SparkSession, d: str) -> DataFrame:
    return E.average_by_day(_ar(spark, d))


@query("SELECT text_path, make_date(CAST(year AS INTEGER), 12, 31) + 90 AS event_date FROM corpus_index WHERE regexp_full_match(year, '[0-9]{4}')")
def filing_events(spark: SparkSession, d: str) -> DataFrame:
    return E.filing_events(table(spark, d, "corpus_index")).select("text_path", "event_date")


# --- statistics over the sentiment scores ---


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return SE.scores(L.scored_rows(spark, d)).withColumn("grp", ST.sentiment_group(F.col("net_sentiment")))


_GRP = f"{L.SCORES_SQL}, sg AS (SELECT *, CASE WHEN net_sentiment <= -0.2 THEN 'negative' WHEN net_sentiment <= 0.2 THEN 'neutral' WHEN net_sentiment > 0.2 THEN 'positive' END AS grp FROM scores)"


@query(f"WITH {_GRP} SELECT ticker, year, grp FROM sg")
def sentiment_groups(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("ticker", "year", "grp")


@query(f"WITH {_GRP} SELECT grp, count(*) AS n, round(avg(guidance_mean), 6) AS mean, round(stddev_pop(guidance_mean), 6) AS std, round(median(guidance_mean), 6) AS median, round(avg(guidance_mean) / (stddev_samp(guidance_mean) / sqrt(count(*))), 6) AS t, round(avg(CASE WHEN guidance_mean > 0 THEN 1 ELSE 0 END), 6) AS share_positive FROM sg WHERE grp IS NOT NULL GROUP BY grp HAVING count(*) >= 5")
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    return ST.group_stats(_scores(spark, d), "grp", "guidance_mean")


@query(f"WITH {_GRP}, m AS (SELECT avg(weighted) FILTER (grp = 'positive') AS ma, var_samp(weighted) FILTER (grp = 'positive') AS va, count(weighted) FILTER (grp = 'positive') AS na, avg(weighted) FILTER (grp = 'negative') AS mb, var_samp(weighted) FILTER (grp = 'negative') AS vb, count(weighted) FILTER (grp = 'negative') AS nb FROM sg) SELECT na, nb, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)), 6) AS df FROM m")
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    return ST.welch(_scores(spark, d), "grp", "weighted", "positive", "negative")


@query(f"WITH {L.SCORES_SQL}, r AS (SELECT rank() OVER (ORDER BY net_sentiment) + (count(*) OVER (PARTITION BY net_sentiment) - 1) / 2 AS a, rank() OVER (ORDER BY guidance_mean) + (count(*) OVER (PARTITION BY guidance_mean) - 1) / 2 AS b FROM scores) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r HAVING count(*) >= 10")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return ST.spearman(_scores(spark, d), "net_sentiment", "guidance_mean")


@query(f"WITH {L.SCORES_SQL} SELECT CAST(regr_count(weighted, net_sentiment) AS BIGINT) AS n, round(regr_slope(weighted, net_sentiment), 6) AS slope, round(regr_intercept(weighted, net_sentiment), 6) AS intercept, round(regr_r2(weighted, net_sentiment), 6) AS r2 FROM scores")
def univariate_ols(spark: SparkSession, d: str) -> DataFrame:
    return ST.line(_scores(spark, d), "weighted", "net_sentiment")


@query(f"WITH {L.SCORES_SQL} SELECT count(*) AS n, count(DISTINCT ticker) AS n_groups, round(avg(net_sentiment), 6) AS mean, round(median(net_sentiment), 6) AS median, round(stddev_samp(net_sentiment), 6) AS std, round(avg(CASE WHEN net_sentiment > 0.2 THEN 1 ELSE 0 END), 6) AS share_high, round(avg(CASE WHEN net_sentiment < -0.2 THEN 1 ELSE 0 END), 6) AS share_low FROM scores")
def descriptives(spark: SparkSession, d: str) -> DataFrame:
    return ST.descriptives(_scores(spark, d), "net_sentiment", "ticker")


@query(f"WITH {_GRP} SELECT ticker, year, CASE WHEN grp = 'neutral' THEN 1 ELSE 0 END AS g_neutral, CASE WHEN grp = 'positive' THEN 1 ELSE 0 END AS g_positive FROM sg")
def onehot(spark: SparkSession, d: str) -> DataFrame:
    out = ST.one_hot(_scores(spark, d), "grp", "g_")
    for c in ("g_neutral", "g_positive"):
        out = out if c in out.columns else out.withColumn(c, F.lit(0))
    return out.select("ticker", "year", "g_neutral", "g_positive")


@query()
def ols_hac(spark: SparkSession, d: str) -> DataFrame:
    return ST.ols_hac(_scores(spark, d), "weighted", ["net_sentiment", "guidance_rate", "guidance_mean"], ["ticker", "year"])


_ROWS = f"{L.SCORES_SQL}, pr AS (SELECT CAST(weighted AS DOUBLE) AS y, CAST(net_sentiment AS DOUBLE) AS x, row_number() OVER (ORDER BY weighted, net_sentiment) - 1 AS i FROM scores WHERE weighted IS NOT NULL AND net_sentiment IS NOT NULL), nn AS (SELECT count(*) AS n FROM pr)"
_HASH = "CAST('0x' || substring(md5('42_' || r || '_' || pr.i), 1, 15) AS BIGINT)"


@query(f"""WITH {_ROWS}, k AS (SELECT r, y, row_number() OVER (PARTITION BY r ORDER BY {_HASH}, pr.i) - 1 AS k FROM pr, range(1000) t(r)), s AS (SELECT r, regr_slope(k.y, pr.x) AS s FROM k JOIN pr ON pr.i = k.k GROUP BY r), tr AS (SELECT regr_slope(y, x) AS t FROM pr)
SELECT round(any_value(t), 6) AS slope, round(avg(s), 6) AS placebo_mean, round(stddev_pop(s), 6) AS placebo_std, round(avg(CASE WHEN abs(s) >= abs(t) THEN 1 ELSE 0 END), 4) AS p_value, count(*) AS n_permutations FROM s, tr""")
def placebo(spark: SparkSession, d: str) -> DataFrame:
    return ST.placebo(_scores(spark, d), "weighted", "net_sentiment")


@query(f"""WITH {_ROWS}, k AS (SELECT r, {_HASH} % n AS j FROM pr, range(2000) t(r), nn), s AS (SELECT r, regr_slope(y, x) AS s FROM k JOIN pr ON pr.i = k.j GROUP BY r)
SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, count(*) AS n_resamples FROM s WHERE s IS NOT NULL""")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return ST.bootstrap(_scores(spark, d), "weighted", "net_sentiment")
