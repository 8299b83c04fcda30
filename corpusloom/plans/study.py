"""Queries from the event study to the regressions, and over evaluation runs, links and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement as A
from ..operators import annotation as N
from ..operators import eventstudy as E
from ..operators import links as K
from ..operators import metrics as M
from ..operators import panel as P
from ..operators import passages as G
from ..operators import registry as R
from ..operators import scoring as C
from ..operators import sentiment as SE
from ..operators import stats as ST
from ..operators import taxonomy as X
from ..sources.readers import table
from ..sources.shared import stash
from . import corpus as CO
from . import labels as L
from . import market as MK
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
YEARS_ON = 25  # the prices end before the sentiment begins


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the six price series stand for the listed companies that come first; their years for later ones ---


def _listed(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "companies").select("ticker", "sector").orderBy("ticker").limit(6)
    names = F.array(*[F.lit(x) for x in ("AF", "AO", "NF", "NO", "RF", "RO")])
    rank = first.withColumn("k", F.row_number().over(ST.Window.partitionBy(F.lit(1)).orderBy("ticker")))  # six rows
    return rank.select(F.element_at(names, F.col("k")).alias("ticker"), F.col("ticker").alias("listed"), F.when(F.col("k") < 6, F.col("sector")).alias("sector"))


_LISTED = "li AS (SELECT ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][k] AS ticker, ticker AS listed, CASE WHEN k < 6 THEN sector END AS sector FROM (SELECT *, row_number() OVER (ORDER BY ticker) AS k FROM companies) WHERE k <= 6)"
_CARS = ", ".join(E.name_of(a, b) for a, b in E.WINDOWS)
_RESULTS = f"""{MK._AR}, {_LISTED}, ca AS (SELECT event_id, {MK._CAR} FROM ar GROUP BY event_id),
bh AS (SELECT event_id, round(CASE WHEN count(*) >= 2 THEN product(1 + ret) - product(1 + market) END, 6) AS bhar FROM ar WHERE day BETWEEN 0 AND 5 GROUP BY event_id),
rs AS (SELECT m.event_id, m.ticker, ev.event_date, CAST(year(ev.event_date) + {YEARS_ON} AS INTEGER) AS fiscal_year, round(m.alpha, 6) AS alpha, round(m.beta, 4) AS beta, round(m.r2, 4) AS r_squared, round(sqrt(m.syy * (1 - m.r2) / m.n_obs), 6) AS std_error, m.n_obs AS est_n_obs, {_CARS}, bhar, li.sector FROM mo m JOIN ev USING (event_id) JOIN ca USING (event_id) LEFT JOIN bh USING (event_id) LEFT JOIN li ON li.ticker = m.ticker)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    models, panel = MK._models(spark, d)
    events = MK._events(spark, d).withColumn("fiscal_year", F.year("event_date") + YEARS_ON)
    return E.results(events, models, E.abnormal_returns(models, panel), _listed(spark, d))


@query(f"WITH {_RESULTS} SELECT * FROM rs")
def event_results(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    scores = SE.scores(L.scored_rows(spark, d)).withColumnRenamed("ticker", "listed")
    scores = scores.join(_listed(spark, d).select("ticker", "listed"), "listed").drop("listed")
    return E.with_sentiment(_results(spark, d), scores)


_STUDY = f"{_RESULTS}, {L.SCORES_SQL}, st AS (SELECT rs.*, s.* EXCLUDE (ticker, year) FROM rs LEFT JOIN li ON li.ticker = rs.ticker LEFT JOIN scores s ON s.ticker = li.listed AND s.year = CAST(rs.fiscal_year AS VARCHAR))"


@query(f"WITH {_STUDY} SELECT event_id, ticker, fiscal_year, car_0_3, n_passages, sentiment_mean, net_sentiment, guidance_adj FROM st")
def event_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("event_id", "ticker", "fiscal_year", "car_0_3", "n_passages", "sentiment_mean", "net_sentiment", "guidance_adj")


def _frame(spark: SparkSession, d: str) -> DataFrame:
    names = {"sentiment_mean": "sentiment_score_mean", "guidance_mean": "guidance_score_mean", "weighted": "weighted_score_mean", "guidance_adj": "guidance_adj_sentiment"}
    df = _scored(spark, d).filter("car_0_3 is not null")
    for a, b in names.items():
        df = df.withColumnRenamed(a, b)
    return df.withColumn("post_fx_unif", (F.col("fiscal_year") >= 2023).cast("int"))


@query(f"WITH {_STUDY} SELECT event_id, pct_pos - pct_neg AS net_sentiment, CAST(guidance_rate > 0.3 AS INTEGER) AS has_guidance_int, beta * beta AS beta_sq, fiscal_year AS year_int, CAST(fiscal_year >= 2023 AS INTEGER) AS post_2023 FROM st WHERE car_0_3 IS NOT NULL")
def analysis_frame(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d).withColumn("year", F.col("fiscal_year").cast("string"))
    return ST.analysis_frame(df, "car_0_3").select("event_id", "net_sentiment", "has_guidance_int", "beta_sq", "year_int", "post_2023")


@query()
def regression_models(spark: SparkSession, d: str) -> DataFrame:
    """The six models on the event study; sectors and years as columns of their own in the fifth."""
    df = stash(_frame(spark, d), "study-frame").select("event_id", "car_0_3", "sector", F.col("fiscal_year").cast("string").alias("fy"), *ST.COMBINED, *ST.CONTROLS, "net_sentiment", "guidance_adj_sentiment")
    return ST.all_models(ST.one_hot(ST.one_hot(df, "sector", "sec_"), "fy", "yr_"), "car_0_3", ["event_id"])


def _hac_sql(source: str, y: str, x: str, order: str, lags: int = 4) -> str:
    """Least squares on one column with Newey-West errors."""
    pairs = [(i, j) for i in range(2) for j in range(2)]
    lag = ", ".join(f"lag(s{j}, {l}) OVER o AS s{j}_{l}" for l in range(1, lags + 1) for j in range(2))
    cell = {(l, i, j): f"coalesce(sum(s{i} * s{j}{f'_{l}' if l else ''}), 0)" for l in range(lags + 1) for i, j in pairs}
    total = {(i, j): " + ".join([cell[0, i, j]] + [f"{1 - l / (lags + 1)} * ({cell[l, i, j]} + {cell[l, j, i]})" for l in range(1, lags + 1)]) for i, j in pairs}
    return f"""d AS (SELECT {order} AS o, CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x FROM {source} WHERE {y} IS NOT NULL AND {x} IS NOT NULL), b AS (SELECT count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_r2(y, x) AS r2, sum(x) AS sx, sum(x * x) AS sxx FROM d),
s AS (SELECT o, y - b0 - b1 * x AS s0, x * (y - b0 - b1 * x) AS s1 FROM d, b), g AS (SELECT s0, s1, {lag} FROM s WINDOW o AS (ORDER BY o)),
m AS (SELECT {", ".join(f"{v} AS m{i}{j}" for (i, j), v in total.items())} FROM g), a AS (SELECT *, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11 FROM b, m),
v AS (SELECT n, r2, b0, b1, sqrt(i00 * (m00 * i00 + m01 * i01) + i01 * (m10 * i00 + m11 * i01)) AS e0, sqrt(i01 * (m00 * i01 + m01 * i11) + i11 * (m10 * i01 + m11 * i11)) AS e1 FROM a),
hac AS (SELECT n AS n_obs, r2 AS r_squared, 'const' AS variable, b0 AS coef, e0 AS std_err, b0 / e0 AS t_stat FROM v UNION ALL SELECT n, r2, {S.q(x)}, b1, e1, b1 / e1 FROM v)"""


def _t_p(t: str, df: str, n: int = 2000) -> str:
    """Two-sided p-value of t by Simpson's rule."""
    return f"(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * list_sum(list_transform(range(0, {n + 1}), lambda k: (CASE WHEN k IN (0, {n}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(1 + power(k * abs({t}) / {n}, 2) / {df}, -({df} + 1) / 2))) * abs({t}) / {n} / 3)"


_STARS = "CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.10 THEN '*' ELSE '' END"


@query(f"WITH {L.SCORES_SQL}, {_hac_sql('scores', 'weighted', 'net_sentiment', 'ticker || chr(0) || year')}, p AS (SELECT *, round({_t_p('t_stat', '(n_obs - 2)')}, 6) AS p_value FROM hac) SELECT n_obs, round(r_squared, 6) AS r_squared, variable, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(t_stat, 4) AS t_stat, p_value, {_STARS} AS sig FROM p")
def ols_hac_line(spark: SparkSession, d: str) -> DataFrame:
    """One model on the scores, in full against SQL."""
    out = ST.ols_hac(MK._scores(spark, d), "weighted", ["net_sentiment"], ["ticker", "year"])
    r = lambda c, n=6: F.round(c, n).alias(c)
    return out.select("n_obs", r("r_squared"), "variable", r("coef"), r("std_err"), r("t_stat", 4), F.round("p_value", 6).alias("p_value"), "sig")


_GROUPS = f"""{MK._GRP}, g1 AS (SELECT grp, count(*) AS n, avg(weighted) AS m, stddev_pop(weighted) AS s, median(weighted) AS md, avg(weighted) / (stddev_samp(weighted) / sqrt(count(*))) AS t, avg(CASE WHEN weighted > 0 THEN 1 ELSE 0 END) AS sp FROM sg WHERE grp IS NOT NULL GROUP BY grp HAVING count(*) >= 5),
w AS (SELECT avg(weighted) FILTER (grp = 'positive') AS ma, var_samp(weighted) FILTER (grp = 'positive') AS va, count(weighted) FILTER (grp = 'positive') AS na, avg(weighted) FILTER (grp = 'negative') AS mb, var_samp(weighted) FILTER (grp = 'negative') AS vb, count(weighted) FILTER (grp = 'negative') AS nb, median(weighted) FILTER (grp = 'positive') AS da, median(weighted) FILTER (grp = 'negative') AS db FROM sg),
w2 AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)) AS df FROM w WHERE na >= 5 AND nb >= 5),
r AS (SELECT rank() OVER (ORDER BY weighted) + (count(*) OVER (PARTITION BY weighted) - 1) / 2 AS a, rank() OVER (ORDER BY net_sentiment) + (count(*) OVER (PARTITION BY net_sentiment) - 1) / 2 AS b FROM scores), rh AS (SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r HAVING count(*) >= 10),
tests AS (SELECT grp AS "group", CAST(n AS VARCHAR) AS n, round(m, 6) AS mean_car, round(s, 6) AS std_car, round(md, 6) AS median_car, round(t, 6) AS t_stat, round({_t_p('round(t, 6)', '(n - 1)')}, 6) AS p_value, round(sp, 6) AS pct_positive_car FROM g1
UNION ALL SELECT 'positive vs negative (diff)', na || ' vs ' || nb, round(ma - mb, 6), NULL, round(da - db, 6), round(t, 6), round({_t_p('round(t, 6)', 'round(df, 6)')}, 6), NULL FROM w2
UNION ALL SELECT 'rank correlation', CAST(n AS VARCHAR), rho, NULL, NULL, NULL, round({_t_p('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')}, 6), NULL FROM rh)"""


@query(f"WITH {_GROUPS} SELECT *, {_STARS} AS sig FROM tests")
def group_tests(spark: SparkSession, d: str) -> DataFrame:
    return ST.group_tests(MK._scores(spark, d), "grp", "weighted", "net_sentiment")


@query(f"""WITH {MK._PANEL}, ev2 AS (SELECT ticker, event_id, event_date FROM ev UNION ALL SELECT 'ZZ', 'ZZ_1', DATE '1995-03-15' UNION ALL SELECT 'RF', 'RF_late', DATE '2030-01-01'),
lo2 AS (SELECT e.event_id, e.ticker, min(p.pos) AS loc FROM ev2 e JOIN pan p ON p.ticker = e.ticker AND p.date >= e.event_date GROUP BY ALL),
es AS (SELECT lo2.event_id, avg(ret) AS m, count(ret) AS k FROM lo2 JOIN pan p ON p.ticker = lo2.ticker AND p.pos >= greatest(lo2.loc - 121, 0) AND p.pos < lo2.loc - 2 GROUP BY ALL),
w AS (SELECT lo2.event_id, p.pos - lo2.loc AS day, coalesce(ret, 0) - CASE WHEN k > 10 THEN m ELSE 0.0 END AS a FROM lo2 JOIN pan p ON p.ticker = lo2.ticker AND p.pos BETWEEN lo2.loc AND lo2.loc + 4 LEFT JOIN es USING (event_id)),
c AS (SELECT event_id, {", ".join(f"round(sum(CASE WHEN day < {s} THEN a END), 6) AS car_{s}d" for s in (1, 3, 5))}, count(*) AS n_days FROM w GROUP BY ALL)
SELECT e.event_id, e.ticker, e.event_date, car_1d, car_3d, car_5d, n_days, CASE WHEN e.ticker NOT IN (SELECT ticker FROM pan) THEN 'no_price_data' WHEN n_days IS NULL THEN 'event_date_out_of_range' END AS error FROM ev2 e LEFT JOIN c USING (event_id)""")
def simple_event_study(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([("ZZ", "ZZ_1", "1995-03-15"), ("RF", "RF_late", "2030-01-01")], "ticker string, event_id string, event_date string").withColumn("event_date", F.to_date("event_date"))
    return E.simple_study(MK._events(spark, d).unionByName(extra), MK._panel(spark, d)).select("event_id", "ticker", "event_date", "car_1d", "car_3d", "car_5d", "n_days", "error")


# --- prices ---


@query(f"WITH {MK._BASE} SELECT date, round(avg(close), 6) AS market_close FROM px WHERE ticker = 'AF' GROUP BY date")
def market_fallback(spark: SparkSession, d: str) -> DataFrame:
    prices = MK._prices(spark, d)
    primary, fallback = (prices.filter(F.col("ticker") == t).groupBy("date").agg(F.round(F.avg("close"), 6).alias("close")) for t in ("INDEX", "AF"))
    return P.market_index(primary, fallback)


@query(f"WITH {MK._BASE} SELECT ticker, date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos FROM mean WHERE ticker = 'RF' AND date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'")
def price_load(spark: SparkSession, d: str) -> DataFrame:
    prices = MK._prices(spark, d)
    both = P.union_prices([prices.filter("ticker in ('AF', 'RF')"), prices.filter("ticker not in ('AF', 'RF')")])
    daily = both.groupBy("ticker", "date").agg(F.avg("close").alias("close"))
    return P.load_prices(P.between_dates(daily, "1993-01-01", "1996-12-31"), "RF").select("ticker", "date", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {MK._BASE} SELECT ticker, date, round(ret, 6) AS ret, round(market, 6) AS market FROM lr LEFT JOIN mk USING (date)")
def returns_with_market(spark: SparkSession, d: str) -> DataFrame:
    r = P.log_returns(P.dense(MK._prices(spark, d)))
    return P.with_market(r, P.market_proxy(r)).select("ticker", "date", F.round("ret", 6).alias("ret"), F.round("market", 6).alias("market"))


_ACTUAL = "act AS (SELECT ticker, year, doc_type, CAST(max_by(discovered, registry_id) AS DATE) AS actual_date FROM (SELECT registry_id, ticker, year, doc_type, make_date(CAST(year AS INTEGER) + 1, 1 + CAST(registry_id % 12 AS INTEGER), 1) AS discovered FROM collection_registry WHERE ticker IS NOT NULL AND year IS NOT NULL AND doc_type IS NOT NULL AND regexp_full_match(year, '[0-9]{4}')) GROUP BY ALL)"


@query(f"WITH ev AS ({MK.SQL['event_calendar']}), {_ACTUAL} SELECT e.ticker, e.fiscal_year, e.doc_type, e.estimated_date, actual_date, coalesce(actual_date, estimated_date) AS event_date FROM ev e LEFT JOIN act a ON a.ticker = e.ticker AND a.year = CAST(e.fiscal_year AS VARCHAR) AND a.doc_type = e.doc_type")
def event_dates(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "collection_registry").filter(F.col("year").rlike(r"^\d{4}$") & F.col("ticker").isNotNull() & F.col("doc_type").isNotNull())
    actual = reg.select("registry_id", "ticker", "year", "doc_type", F.make_date(F.col("year").cast("int") + 1, (F.col("registry_id") % 12 + 1).cast("int"), F.lit(1)).alias("actual_date"))
    out = P.enrich_dates(P.disclosure_calendar(table(spark, d, "companies")), actual, "registry_id")
    return P.event_dates(out).select("ticker", "fiscal_year", "doc_type", "estimated_date", "actual_date", "event_date")


# --- evaluation runs and errors ---


def _run_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = L._pairs(spark, d).filter("task = 'sentiment'")
    return p.withColumn("run_id", F.when(F.length("item") % 2 == 0, "run_a").otherwise("run_b")).withColumn("shots", (F.length("model") % 3).cast("int"))


_RUNS = f"""{L._GOLD}, x AS (SELECT CASE WHEN length(item) % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS run_id, model, CAST(length(model) % 3 AS INTEGER) AS shots, gold, pred FROM pairs WHERE task = 'sentiment'),
k AS (SELECT run_id, model, shots, l AS label, count(*) FILTER (gold = l) AS su, count(*) FILTER (pred = l) AS pr, count(*) FILTER (gold = l AND pred = l) AS tp FROM x, (SELECT unnest({list(N.SENTIMENTS)}) AS l) GROUP BY ALL),
f AS (SELECT run_id, model, shots, round(avg(CASE WHEN su + pr > 0 THEN 2 * tp / (su + pr) ELSE 0.0 END), 6) AS macro_f1, sum(su * pr) AS chance FROM k GROUP BY ALL), t AS (SELECT run_id, model, shots, count(*) AS n, count(*) FILTER (gold = pred) AS ok FROM x GROUP BY ALL)"""


@query(f"WITH {_RUNS} SELECT run_id, model, shots, n, round(ok / n, 6) AS accuracy, macro_f1, round(CASE WHEN chance = n * n THEN 1.0 ELSE (ok / n - chance / (n * n)) / (1 - chance / (n * n)) END, 6) AS kappa FROM t JOIN f USING (run_id, model, shots)")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    return M.compare_runs(_run_pairs(spark, d), N.SENTIMENTS)


@query(f"WITH {L._GOLD}, k AS (SELECT model, l AS label, count(*) FILTER (gold = l) AS support, count(*) FILTER (pred = l) AS predicted, count(*) FILTER (gold = l AND pred = l) AS tp FROM pairs, (SELECT unnest({list(N.SENTIMENTS)}) AS l) WHERE task = 'sentiment' GROUP BY ALL), p AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS re FROM k) SELECT model, label, CAST(support AS BIGINT) AS support, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM p")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    t = M.contingency(L._pairs(spark, d).filter("task = 'sentiment'"), ["model"], N.SENTIMENTS)
    return M.per_class(t, ["model"], N.SENTIMENTS).select("model", "label", F.col("support").cast("long").alias("support"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {L._GOLD}, c AS (SELECT model, gold, {', '.join(f'''count(*) FILTER (pred = '{l}') AS c_{l}''' for l in N.SENTIMENTS)}, count(*) FILTER (pred IN {S.listed(N.SENTIMENTS)}) AS n FROM pairs WHERE task = 'sentiment' GROUP BY ALL) SELECT model, gold, {', '.join(f'round(c_{l} / n, 6) AS share_{l}' for l in N.SENTIMENTS)} FROM c")
def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    t = M.contingency(L._pairs(spark, d).filter("task = 'sentiment'"), ["model"], N.SENTIMENTS)
    return M.shares_of_gold(t, ["model"], N.SENTIMENTS)


@query(f"""WITH {L._GOLD}, x AS (SELECT model, gold, pred FROM pairs WHERE task = 'guidance' AND gold <> 'none'), sp AS (SELECT model, gold AS label FROM x UNION SELECT model, pred FROM x),
k AS (SELECT sp.model, sp.label, count(*) FILTER (gold = label) AS su, count(*) FILTER (pred = label) AS pr, count(*) FILTER (gold = label AND pred = label) AS tp FROM sp JOIN x USING (model) GROUP BY ALL), f AS (SELECT model, round(avg(CASE WHEN su + pr > 0 THEN 2 * tp / (su + pr) ELSE 0.0 END), 6) AS macro_f1 FROM k GROUP BY model)
SELECT model, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1 ELSE 0 END), 6) AS accuracy, any_value(macro_f1) AS macro_f1 FROM x JOIN f USING (model) GROUP BY model""")
def guidance_types(spark: SparkSession, d: str) -> DataFrame:
    rows = L._pairs(spark, d).filter("task = 'guidance'").withColumn("gold_guidance", F.col("gold") != "none")
    return M.guidance_types(rows, ["model"], N.GUIDANCE)


@query(f"WITH {L._TAGS} SELECT count(*) AS n, count(*) FILTER (NOT gold_guidance AND pred_guidance) AS false_positive, count(*) FILTER (gold_guidance AND NOT pred_guidance) AS false_negative, round(count(*) FILTER (NOT gold_guidance AND pred_guidance) / count(*), 4) AS fp_rate, round(count(*) FILTER (gold_guidance AND NOT pred_guidance) / count(*), 4) AS fn_rate FROM tagged WHERE gold_guidance IS NOT NULL AND pred_guidance IS NOT NULL")
def guidance_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return X.guidance_error_rates(L._rows(spark, d))


_MODELS = ("ann_01", "ann_08", "ann_15")


@query(f"WITH {L._TAGS} SELECT sector, {', '.join(f'''round(avg(CASE WHEN model = '{m}' THEN CASE WHEN is_sentiment_error THEN 1 ELSE 0 END END), 6) AS {m}''' for m in _MODELS)} FROM tagged WHERE sector IS NOT NULL GROUP BY sector")
def sector_by_model(spark: SparkSession, d: str) -> DataFrame:
    return X.sector_by_model(L._tagged(spark, d), list(_MODELS))


@query(f"WITH {L._GOLD}, {L._ITEM}, k AS (SELECT item, CASE WHEN count(DISTINCT pred) > 1 THEN 1 ELSE 0 END AS d FROM pairs WHERE task = 'sentiment' GROUP BY item) SELECT sector, round(avg(d), 6) AS rate, count(*) AS n FROM k JOIN it USING (item) WHERE sector IS NOT NULL GROUP BY sector")
def disagreement_by_sector(spark: SparkSession, d: str) -> DataFrame:
    return X.disagreement_by_sector(L._pairs(spark, d).filter("task = 'sentiment'"), L._items(spark, d))


@query(f"WITH {L._GOLD}, {L._ITEM}, w AS (SELECT item, {', '.join(f'''min(pred) FILTER (model = '{m}') AS {m}''' for m in _MODELS)}, count(DISTINCT p1) AS n_labels FROM (SELECT item, model, min(pred) AS pred, min(pred) AS p1 FROM pairs WHERE task = 'sentiment' GROUP BY ALL) GROUP BY item HAVING count(DISTINCT p1) > 1) SELECT w.*, it.sector, it.section, it.word_count FROM w LEFT JOIN it USING (item)")
def disagreement_table(spark: SparkSession, d: str) -> DataFrame:
    items = L._items(spark, d).select("item", "sector", "section", "word_count")
    return X.disagreement_table(L._pairs(spark, d).filter("task = 'sentiment'"), items, list(_MODELS))


@query(f"WITH {L._GOLD} SELECT item, model, pred, gold AS gold_sentiment FROM pairs WHERE task = 'sentiment'")
def gold_join(spark: SparkSession, d: str) -> DataFrame:
    p = L._pairs(spark, d).filter("task = 'sentiment'")
    return X.join_gold(p.select("item", "model", "pred"), p.select("item", "gold").distinct(), {"gold": "gold_sentiment"})


@query(L.SQL["qualitative_topn"].replace("SELECT code, CAST(rank AS INTEGER) AS rank, item, model, gold, pred FROM r WHERE rank <= 3", "SELECT code, CAST(rank AS INTEGER) AS rank, item, model, gold, pred, substring(it.text, 1, 400) AS excerpt FROM r LEFT JOIN it USING (item) WHERE rank <= 3"))
def qualitative_sheet(spark: SparkSession, d: str) -> DataFrame:
    return X.example_sheet(L._tagged(spark, d), L._items(spark, d))


# --- agreement of annotators with items in common ---

_FEW = ("ann_01", "ann_08")
_FEW_VOTES = f"{S.VOTES.replace('votes AS (', 'every AS (')}, votes AS (SELECT * FROM every WHERE annotator IN {S.listed(_FEW)})"


def _few(spark: SparkSession, d: str) -> DataFrame:
    return L._votes(spark, d).filter(F.col("annotator").isin(*_FEW))


@query(L.SQL["common_items"].replace(f"WITH {S.VOTES}", f"WITH {_FEW_VOTES}"))
def common_items_of_two(spark: SparkSession, d: str) -> DataFrame:
    return A.common_items(_few(spark, d))


_COMMON = f"{_FEW_VOTES.replace('votes AS (', 'few AS (')}, ct AS (SELECT task, count(DISTINCT annotator) AS k FROM few GROUP BY task), cf AS (SELECT task, item FROM few JOIN ct USING (task) GROUP BY task, item, k HAVING count(DISTINCT annotator) = k), votes AS (SELECT few.* FROM few JOIN cf USING (task, item))"


@query(L.SQL["fleiss"].replace(f"WITH {S.VOTES}", f"WITH {_COMMON}") + " WHERE n_items >= 5")
def fleiss_common(spark: SparkSession, d: str) -> DataFrame:
    return A.fleiss_common(_few(spark, d))


@query(f"SELECT * FROM (WITH c AS ({L.SQL['fleiss'].replace(f'WITH {S.VOTES}', f'WITH {_COMMON}')}), a AS ({L.SQL['krippendorff_nominal'].replace(f'WITH {S.VOTES}', f'WITH {_COMMON}')}), p AS ({L.SQL['agreement_summary'].replace(f'WITH {S.VOTES}', f'WITH {_COMMON}')}) SELECT c.task, c.n_items, CAST(2 AS BIGINT) AS n_annotators, c.kappa AS fleiss_kappa, a.alpha, p.mean_kappa AS mean_pairwise_kappa, p.mean_agreement AS mean_pairwise_agreement, CASE " + " ".join(f"WHEN c.kappa >= {a} THEN '{b}'" for a, b in A.BANDS) + " ELSE 'Poor' END AS band FROM c LEFT JOIN a USING (task) LEFT JOIN p USING (task) WHERE c.n_items >= 5)")
def agreement_table(spark: SparkSession, d: str) -> DataFrame:
    return A.agreement_table(_few(spark, d), L._RANKS)


@query(f"WITH {_FEW_VOTES}, fl AS (SELECT item FROM votes WHERE task = 'sentiment' GROUP BY item HAVING count(*) >= 2 AND count(DISTINCT label) > 1), {L._ITEM} SELECT v.item, {', '.join(f'''max(label) FILTER (annotator = '{a}') AS ann_{a}''' for a in _FEW)}, any_value(substring(it.text, 1, 200)) AS excerpt FROM votes v JOIN fl USING (item) LEFT JOIN it USING (item) WHERE task = 'sentiment' GROUP BY v.item")
def adjudication_sheet(spark: SparkSession, d: str) -> DataFrame:
    return A.adjudication_sheet(_few(spark, d), L._items(spark, d))


@query(f"WITH {S.VOTES} SELECT task, item, annotator, label FROM votes")
def simulated_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes simulated without noise give the labels back."""
    v = L._votes(spark, d)
    who = F.collect_list("annotator")
    sim = A.simulate(v.select("task", "item", "label", F.col("annotator").alias("voter")), ["x"], list(N.GUIDANCE), noise=0.0)
    back = v.groupBy("task", "item", "label").agg(who.alias("names"))
    return sim.groupBy("task", "item", "label").agg(F.count("*").alias("n")).join(back, ["task", "item", "label"]).filter(F.col("n") == F.size("names")).select("task", "item", F.explode("names").alias("annotator"), "label")


# --- the queue: change log, pre-annotation, views ---

_FIRST = "(SELECT * FROM annotation_queue QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY row_id) = 1)"


def _first_rows(spark: SparkSession, d: str) -> DataFrame:
    cols = ["row_id", "passage_id", "sentiment_label", "guidance_type", "annotator", "annotation_status"]
    return R.first_by_key(table(spark, d, "annotation_queue").select(*cols), "passage_id", "row_id")


@query(f"WITH f AS {_FIRST}, l AS (SELECT * FROM annotation_queue WHERE annotated_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY annotated_at DESC, row_id DESC) = 1) SELECT f.passage_id, CASE WHEN l.passage_id IS NULL THEN f.sentiment_label ELSE l.sentiment_label END AS sentiment_label, CASE WHEN l.passage_id IS NULL THEN f.annotation_status ELSE l.annotation_status END AS annotation_status FROM f LEFT JOIN l ON l.passage_id = f.passage_id")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "annotation_queue").filter("annotated_at is not null")
    return N.apply_changes(_first_rows(spark, d), log, "passage_id", ["sentiment_label", "annotation_status"], ["annotated_at", "row_id"]).select("passage_id", "sentiment_label", "annotation_status")


@query("SELECT count(*) AS total, count(*) FILTER (annotation_status = 'done') AS done, count(*) FILTER (annotation_status = 'skipped') AS skipped, count(*) FILTER (annotation_status = 'pending') AS pending, round(count(*) FILTER (annotation_status = 'done') / count(*) * 100, 6) AS percent_done FROM annotation_queue")
def progress_totals(spark: SparkSession, d: str) -> DataFrame:
    return N.progress_totals(table(spark, d, "annotation_queue"))


@query(f"{L.SQL['web_pending'].replace('SELECT row_id', 'SELECT row_id, quality, section')} ORDER BY {L._RANK} LIMIT 1")
def web_next(spark: SparkSession, d: str) -> DataFrame:
    return N.web_next(table(spark, d, "annotation_queue")).select("row_id", "quality", "section")


_COUNTS = lambda words: "(" + " + ".join(f"CAST((length(t) - length(replace(t, {S.q(w)}, ''))) / {len(w)} AS INTEGER)" for w in words) + ")"
_LEXICON = f"CASE WHEN {_COUNTS(C.UP)} > {_COUNTS(C.DOWN)} THEN 'positive' WHEN {_COUNTS(C.DOWN)} > {_COUNTS(C.UP)} THEN 'negative' ELSE 'neutral' END"


@query(f"WITH b AS (SELECT * FROM (SELECT row_id, text FROM annotation_queue WHERE quality IN ('good', 'acceptable') AND (annotation_status = 'pending' OR coalesce(annotation_status, '') = '') ORDER BY row_id LIMIT 50) WHERE length({S.strip('text')}) >= 50), s AS (SELECT row_id, {_LEXICON} AS label FROM (SELECT row_id, lower(text) AS t FROM b)) SELECT q.row_id, CASE WHEN s.row_id IS NULL THEN q.sentiment_label ELSE s.label END AS sentiment_label, CASE WHEN s.row_id IS NULL THEN q.annotator ELSE 'lexicon' END AS annotator, CASE WHEN s.row_id IS NULL THEN q.annotation_status ELSE 'ai_annotated' END AS annotation_status FROM annotation_queue q LEFT JOIN s USING (row_id)")
def pre_annotated(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "annotation_queue")
    batch = N.pre_annotation_batch(queue).select("row_id", F.col("text").alias("prompt"))
    scored = C.flatten(C.score(batch, "prompt", {"lexicon": C.lexicon_scorer})).select("row_id", F.col("pred_sentiment").alias("sentiment_label"))
    return N.merge_machine_labels(queue, scored, "row_id", "lexicon").select("row_id", "sentiment_label", "annotator", "annotation_status")


@query("SELECT 'empty gold' AS case_name, count(*) AS n FROM annotation_queue WHERE annotation_status = 'done' UNION ALL SELECT 'gold', count(*) FROM annotation_queue WHERE annotation_status = 'done' AND quality = 'good' UNION ALL SELECT 'no gold', count(*) FROM annotation_queue WHERE annotation_status = 'done'")
def gold_fallback(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "annotation_queue")
    gold = N.gold_rows(queue.filter("quality = 'good'"))
    cases = {"empty gold": gold.limit(0), "gold": gold, "no gold": None}
    return P.union_prices([N.gold_or_done(g, queue).agg(F.count("*").alias("n")).select(F.lit(k).alias("case_name"), "n") for k, g in cases.items()])


@query(f"""SELECT 'sentiment_label' AS "column", count(*) FILTER ({S.full_label('sentiment_label')} IS DISTINCT FROM sentiment_label) AS n_changed FROM annotation_queue UNION ALL SELECT 'guidance_type', count(*) FILTER ({S.full_label('guidance_type')} IS DISTINCT FROM guidance_type) FROM annotation_queue""")
def label_changes(spark: SparkSession, d: str) -> DataFrame:
    cols = ["sentiment_label", "guidance_type"]
    queue = table(spark, d, "annotation_queue").select("row_id", *cols)
    return N.changed_columns(queue, N.repair_labels(queue, cols), "row_id", cols)


@query(f"SELECT row_id, {', '.join(f'''coalesce({S.full_label(c)}, '') AS {c}''' for c in ('sentiment_label', 'guidance_type', 'sentiment_intensity'))}, coalesce(annotator, '') AS annotator FROM annotation_queue")
def web_queue(spark: SparkSession, d: str) -> DataFrame:
    return N.web_queue(table(spark, d, "annotation_queue")).select("row_id", "sentiment_label", "guidance_type", "sentiment_intensity", "annotator")


@query("SELECT sector, guidance_type, count(*) AS n FROM annotation_queue WHERE annotation_status = 'done' AND sector IS NOT NULL AND guidance_type IS NOT NULL GROUP BY ALL")
def sector_by_guidance(spark: SparkSession, d: str) -> DataFrame:
    return N.crosstab(table(spark, d, "annotation_queue"), "sector", "guidance_type")


@query("SELECT row_id, CASE ticker WHEN 'ZANDOPET' THEN 'ZPET' WHEN 'RIMADUK' THEN 'RMDK' ELSE ticker END AS ticker FROM annotation_queue")
def rekeyed(spark: SparkSession, d: str) -> DataFrame:
    return N.rekey_tickers(table(spark, d, "annotation_queue").select("row_id", "ticker"), {"ZANDOPET": "ZPET", "RIMADUK": "RMDK"})


# --- scoring ---


@query(f"SELECT item, 'lexicon' AS model, CAST(NULL AS VARCHAR) AS error, 1 AS attempts, {_LEXICON} AS pred_sentiment, CASE WHEN abs({_COUNTS(C.UP)} - {_COUNTS(C.DOWN)}) > 3 THEN 'strong' WHEN {_COUNTS(C.UP)} <> {_COUNTS(C.DOWN)} THEN 'moderate' ELSE 'mild' END AS pred_intensity, CASE WHEN regexp_matches(t, {S.q('|'.join(C.FORWARD_WORDS))}) THEN 'True' ELSE 'False' END AS pred_guidance FROM (WITH {L._ITEM} SELECT item, lower(coalesce(text, '')) AS t FROM it)")
def lexicon_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = L._items(spark, d).select("item", F.coalesce("text", F.lit("")).alias("prompt"))
    return C.flatten(C.score(rows, "prompt", {"lexicon": C.lexicon_scorer})).select("item", "model", "error", "attempts", "pred_sentiment", "pred_intensity", "pred_guidance")


@query(f"WITH {S.VOTES}, i AS (SELECT DISTINCT item FROM votes), m AS (SELECT unnest(['ann_01', 'ann_08']) AS model) SELECT item, model FROM i, m WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.item = i.item AND v.annotator = m.model)")
def unanswered(spark: SparkSession, d: str) -> DataFrame:
    v = L._votes(spark, d)
    return C.unanswered(v.select("item").distinct(), v.select("item", F.col("annotator").alias("model")), ["ann_01", "ann_08"])


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', CAST({n} AS INTEGER))" for k, t, n in C.PROMPTS) + ") AS p(prompt_key, task, shots)")
def prompt_list(spark: SparkSession, d: str) -> DataFrame:
    return C.prompt_table(spark).select("prompt_key", "task", "shots")


@query(f"WITH {L._ITEM} SELECT item, k AS prompt_key, contains(coalesce(text, ''), '{{') AS braces FROM it, (SELECT unnest(['sentiment_0shot', 'combined_5shot']) AS k) WHERE text IS NOT NULL")
def prompts_filled(spark: SparkSession, d: str) -> DataFrame:
    rows = L._items(spark, d).filter("text is not null").select("item", "text")
    out = C.get_prompts(rows, ["sentiment_0shot", "combined_5shot"])
    return out.filter(F.col("prompt").endswith(F.col("text")) & ~F.col("prompt").contains("{passage}")).select("item", "prompt_key", F.col("text").contains("{").alias("braces"))


# --- corpus: links, registry, driver ---

_HOST = r"regexp_extract(url, '^[a-z]+://[^/]*', 0)"
_PAGES = f"pg AS (SELECT ticker, {_HOST} || '/list/' AS base, CASE registry_id % 3 WHEN 0 THEN regexp_replace(url, '^[a-z]+://[^/]*', '') WHEN 1 THEN url ELSE regexp_extract(url, '[^/]*$', 0) END AS href, regexp_replace(coalesce(title, ''), '^ +| +$', '', 'g') AS label, url FROM collection_registry WHERE url LIKE 'http%')"
_ABS = f"CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN {_HOST} || href ELSE base || href END"
_TYPE = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, {S.q('|'.join(w))}) THEN {S.q(n)}" for n, w in T.DOC_TYPES) + " ELSE 'other' END"
_YEAR, _WORDS = S.q("|".join(map(str, T.TARGET_YEARS))), S.q("|".join(K.REPORT_WORDS))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collection_registry").filter("url like 'http%'")
    host = F.regexp_extract("url", "^[a-z]+://[^/]*", 0)
    href = F.when(F.col("registry_id") % 3 == 0, F.regexp_replace("url", "^[a-z]+://[^/]*", "")).when(F.col("registry_id") % 3 == 1, F.col("url")).otherwise(F.regexp_extract("url", "[^/]*$", 0))
    return rows.select("ticker", F.concat(host, F.lit("/list/")).alias("url"), F.concat(F.lit('<p><a class="x" href="'), href, F.lit('"><b>'), F.coalesce("title", F.lit("")), F.lit("</b></a></p>")).alias("html"))


@query(f"WITH {_PAGES} SELECT 'portal' AS source, ticker, {_ABS} AS url, label AS title, {_TYPE('lower(label) || lower(href)')} AS doc_type FROM pg WHERE href LIKE '%.pdf' AND regexp_matches(href || lower(label), {_YEAR})")
def portal_links(spark: SparkSession, d: str) -> DataFrame:
    return K.disclosure_links(_pages(spark, d), "portal")


@query(f"WITH {_PAGES} SELECT 'company_ir' AS source, ticker, {_ABS} AS url, CASE WHEN label = '' THEN regexp_replace(regexp_extract(href, '[^/]*$', 0), '\\.[^.]*$', '') ELSE label END AS title, {_TYPE(chr(39).join(['lower(label || ', ' ', ' || href)']))} AS doc_type FROM pg WHERE href LIKE '%.pdf' AND (regexp_matches(lower(label || ' ' || href), {_WORDS}) OR regexp_matches(lower(label) || ' ' || href, {_YEAR}))")
def company_links(spark: SparkSession, d: str) -> DataFrame:
    return K.disclosure_links(_pages(spark, d), "company_ir")


@query(f"WITH {_PAGES} SELECT 'news' AS source, ticker, {_ABS} AS url, label AS title, {_TYPE('lower(label)')} AS doc_type FROM pg WHERE regexp_matches(lower(label), {_WORDS}) AND regexp_matches(lower(label), {_YEAR})")
def news_links(spark: SparkSession, d: str) -> DataFrame:
    return K.disclosure_links(_pages(spark, d), "news")


@query("SELECT url, 'failed' AS reason FROM collection_registry WHERE extraction_stats.extraction_status = 'failed' UNION ALL SELECT url, 'late' FROM collection_registry WHERE downloaded_at IS NULL")
def failed_log(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "collection_registry")
    known = reg.filter("extraction_stats.extraction_status = 'failed'").select("url", F.lit("failed").alias("reason"))
    return R.mark_failed(known, reg.filter("downloaded_at is null").select("url", F.lit("late").alias("reason")))


@query("SELECT registry_id, CASE WHEN url IN (SELECT url FROM collection_registry WHERE registry_id % 5 = 0) THEN 'new/' || url ELSE local_path END AS local_path FROM collection_registry")
def marked_downloads(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "collection_registry").select("registry_id", "url", "local_path")
    events = reg.filter("registry_id % 5 = 0").select("url", F.concat(F.lit("new/"), "url").alias("local_path"))
    return R.mark(reg, events, "url", ["local_path"]).select("registry_id", "local_path")


@query("SELECT DISTINCT url FROM collection_registry WHERE downloaded_at IS NOT NULL OR registry_id % 5 = 0")
def downloaded_urls(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "collection_registry")
    return R.add_urls(reg.filter("downloaded_at is not null").select("url"), reg.filter("registry_id % 5 = 0"))


_MANUAL = f"""m AS (SELECT DISTINCT local_path AS path, split_part(company_name, ' ', 1) AS folder, regexp_replace(regexp_extract(local_path, '[^/]*$', 0), '\\.[^.]*$', '') AS stem FROM collection_registry WHERE local_path IS NOT NULL AND source = 'manual' AND company_name IS NOT NULL),
f AS (SELECT m.*, (SELECT c.ticker FROM companies c WHERE c.ticker = upper(folder) OR contains(upper(c.ticker), upper(folder)) OR contains(replace(upper(c.name), ' ', ''), upper(folder)) ORDER BY c.ticker <> upper(folder), c.ticker LIMIT 1) AS found, lower(replace(stem, '_', ' ')) AS low FROM m WHERE path NOT IN (SELECT local_path FROM collection_registry WHERE local_path IS NOT NULL AND source = 'company_ir')),
u AS (SELECT *, coalesce(found, upper(folder)) AS t, 'manual://' || coalesce(found, upper(folder)) || '/' || regexp_extract(path, '[^/]*$', 0) AS url FROM f)"""


@query(f"WITH {_MANUAL} SELECT t AS ticker, url, stem AS title, {_TYPE('low')} AS doc_type, coalesce(c.name, t) AS company_name, coalesce(c.sector, 'Unknown') AS sector, coalesce(CASE " + " ".join(f"WHEN contains(low || ' ' || lower(url), '{y}') THEN '{y}'" for y in sorted(T.TARGET_YEARS, reverse=True)) + " END, '2023') AS year, path AS local_path FROM u LEFT JOIN companies c ON c.ticker = u.t")
def manual_files(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "collection_registry")
    files = reg.filter("local_path is not null and source = 'manual' and company_name is not null").select(F.col("local_path").alias("path"), F.split_part("company_name", F.lit(" "), F.lit(1)).alias("folder"), F.regexp_replace(F.regexp_extract("local_path", "[^/]*$", 0), r"\.[^.]*$", "").alias("stem")).distinct()
    return R.register_manual(reg.filter("source = 'company_ir'"), files, table(spark, d, "companies")).drop("source")


@query(f"WITH {CO._PASSAGES}, ok AS (SELECT doc_id, {S.quality('text')} AS quality FROM passages WHERE wc >= {G.MIN_WORDS} AND num / wc <= {G.MAX_NUMERIC}), n AS (SELECT doc_id, count(*) AS passage_count, count(*) FILTER (quality = 'good') AS good_passages FROM ok GROUP BY doc_id) SELECT * FROM n")
def passage_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.documents_summary(CO._passages(spark, d))


@query()
def corpus_run(spark: SparkSession, d: str) -> DataFrame:
    """Sums by sector of a whole run: cleaning, classes, passages. Its steps have queries with SQL of their own."""
    docs = table(spark, d, "documents", spread=True).select("doc_id", F.coalesce("ticker", F.lit("NONE")).alias("ticker"), "year", F.lit("outlook").alias("section"), "sector", "text")
    return G.run_corpus(docs)[2]


@query("WITH r AS (SELECT DISTINCT year AS run_id FROM collection_registry WHERE year IS NOT NULL) SELECT c.registry_id, c.year FROM collection_registry c WHERE c.year = (SELECT coalesce(max(run_id) FILTER (contains(run_id, '2023')), max(run_id)) FROM r)")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "collection_registry").filter("year is not null").select("registry_id", F.col("year").alias("run_id"))
    return R.latest_run(runs, "2023").select("registry_id", F.col("run_id").alias("year"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def clean_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions without an error and with a label; other kinds of event stand for errors."""
    from ..sources.readers import predictions

    rows = table(spark, d, "events").select("event_id", "event_type", F.when(~F.col("event_type").isin("click", "view"), "failed").otherwise("").alias("error"), F.col("event_type").alias("pred_sentiment"))
    return predictions(rows).select("event_id", "event_type")
