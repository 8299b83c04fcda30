"""Panel, event windows, statistics and the other operators on small data, against numpy."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import agreement as A
from corpusloom.operators import eventstudy as E
from corpusloom.operators import panel as P
from corpusloom.operators import registry as R
from corpusloom.operators import scoring as C
from corpusloom.operators import stats as S
from corpusloom.plans.pipeline import Pipeline
from corpusloom.sources import readers, writers
from corpusloom.streaming import registry as SR

DAY = dt.date(2024, 1, 1)


def test_returns_over_a_gap(spark):
    rows = [("A", DAY, 1.0), ("A", DAY + dt.timedelta(2), 2.0), ("A", DAY + dt.timedelta(3), 3.0), ("B", DAY + dt.timedelta(1), 5.0)]
    panel = P.dense(spark.createDataFrame(rows, "ticker string, date date, close double"))
    simple = [r["ret"] for r in P.simple_returns(panel).filter("ticker = 'A'").orderBy("date").collect()]
    assert simple == [None, 0.0, 1.0, 0.5]
    log = [r["ret"] for r in P.log_returns(panel).filter("ticker = 'A'").orderBy("date").collect()]
    assert log[:3] == [None, None, None] and log[3] == pytest.approx(math.log(1.5))


def _panel(spark, n=400, seed=1):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(0, 0.01, n)
    r = 0.001 + 1.3 * m + rnd.normal(0, 0.005, n)
    rows = [("A", DAY + dt.timedelta(i), float(r[i]), float(m[i]), i) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, ret double, market double, pos int"), r, m


def test_event_study_as_by_numpy(spark):
    panel, r, m = _panel(spark)
    events = spark.createDataFrame([("A", "late", DAY + dt.timedelta(300)), ("A", "early", DAY + dt.timedelta(20)), ("A", "after", DAY + dt.timedelta(999)), ("A", "before", DAY - dt.timedelta(9))], "ticker string, event_id string, event_date date")
    located = E.as_of(events, panel)
    assert {x["event_id"]: x["loc"] for x in located.collect()} == {"late": 300, "early": 20, "before": 0}
    models = E.market_model(located, panel)
    row = models.collect()
    assert [x["event_id"] for x in row] == ["late"]  # no estimate near the beginning
    x, y = m[50:270], r[50:270]
    b = np.cov(x, y, bias=True)[0, 1] / x.var()
    a = y.mean() - b * x.mean()
    assert row[0]["n_obs"] == 220 and row[0]["beta"] == pytest.approx(b) and row[0]["alpha"] == pytest.approx(a)
    assert row[0]["sigma"] == pytest.approx(np.sqrt(((y - a - b * x) ** 2).mean()))
    ar = E.abnormal_returns(models, panel)
    assert ar.count() == 21
    car = E.cumulative(ar).first()
    assert car["car_0_3"] == pytest.approx((r[300:304] - a - b * m[300:304]).sum(), abs=1e-6)
    assert E.buy_and_hold(ar).first()["bhar"] == pytest.approx(np.prod(1 + r[300:306]) - np.prod(1 + m[300:306]), abs=1e-6)


def test_tails():
    assert S.t_p_value(2.2258, 115) == pytest.approx(0.0280, abs=1e-4)
    assert S.t_p_value(0, 10) == pytest.approx(1.0)
    assert S.f_p_value(4.0, 1, 50) == pytest.approx(S.t_p_value(2.0, 50))


def test_least_squares_with_collinear_columns(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=60)
    y = 1 + 2 * x + rnd.normal(size=60)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i]), float(2 * x[i])) for i in range(60)], "i int, y double, a double, b double")
    one = {r["variable"]: r for r in S.ols_hac(df, "y", ["a"], ["i"]).collect()}
    two = S.ols_hac(df, "y", ["a", "b"], ["i"]).first()
    d = np.column_stack([np.ones(60), x])
    coef, *_ = np.linalg.lstsq(d, y, rcond=None)
    e = (y - d @ coef)[:, None] * d
    s = e.T @ e + sum((1 - l / 5) * (e[l:].T @ e[:-l] + e[:-l].T @ e[l:]) for l in range(1, 5))
    inv = np.linalg.inv(d.T @ d)
    assert one["a"]["coef"] == pytest.approx(coef[1]) and one["a"]["std_err"] == pytest.approx(np.sqrt((inv @ s @ inv)[1, 1]))
    assert two["r_squared"] == pytest.approx(one["a"]["r_squared"]) and two["aic"] == pytest.approx(one["a"]["aic"])
    assert one["a"]["bic"] - one["a"]["aic"] == pytest.approx(2 * (math.log(60) - 2))
    assert S.ols_hac(df.limit(9), "y", ["a"], ["i"]) is None


def test_resampling_is_repeatable(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "y double, x double")
    a, b = S.bootstrap(df, "y", "x", n=200).first(), S.bootstrap(df, "y", "x", n=200).first()
    assert a == b and a["low"] <= a["mean"] <= a["high"]
    assert 0 <= S.placebo(df, "y", "x", n=200).first()["p_value"] <= 1


def test_agreement_by_hand(spark):
    rows = [("t", str(i), a, l) for i, ls in enumerate(["pp", "pn", "nn", "pp", "uu", "un"]) for a, l in zip("ab", ls)]
    long = spark.createDataFrame(rows, "task string, item string, annotator string, label string")
    n, po = 6, 4 / 6
    pe = sum((ca / n) * (cb / n) for ca, cb in ((3, 2), (1, 3), (2, 1)))
    assert A.pairwise_kappa(long).first()["kappa"] == pytest.approx((po - pe) / (1 - pe), abs=1e-6)
    assert A.common_items(long).count() == 12
    swapped = long.withColumn("annotator", F.translate("annotator", "ab", "ba"))
    assert A.fleiss(long).collect() == A.fleiss(swapped).collect()
    ranks = {"n": 0, "u": 1, "p": 2}
    assert A.krippendorff(long, "nominal", ranks).first()["alpha"] < 1
    assert A.krippendorff(long.filter("label = 'p' and item in ('0', '3')"), "nominal", ranks).first()["alpha"] == 1


def test_registry(spark):
    found = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "registry_id int, url string")
    known = spark.createDataFrame([(0, "v")], "registry_id int, url string")
    assert sorted(r["registry_id"] for r in R.add_discovered(known, found).collect()) == [0, 1]
    runs = spark.createDataFrame([("2024_a",), ("2023_combined",)], "run_id string")
    assert R.latest_run(runs).first()[0] == "2024_a" and R.latest_run(runs, "combined").first()[0] == "2023_combined"


def test_scorer_and_retries(spark):
    df = spark.createDataFrame([("a", "growth and record profit"), ("b", None)], "item string, prompt string")

    def broken(_):
        raise RuntimeError("down")

    out = C.score(df, "prompt", {"lexicon": C.lexicon_scorer, "broken": broken})
    got = {(r["item"], r["model"]): r for r in C.flatten(out).collect()}
    assert got["a", "lexicon"]["pred_sentiment"] == "positive" and got["a", "lexicon"]["error"] is None
    assert got["b", "broken"]["error"] == "down" and got["b", "broken"]["attempts"] == 3
    assert C.resolve_prompt({"combined_3shot": 3, "combined_0shot": 0}, "combined", 5) == "combined_0shot"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz', 1)], "k string, text string, n int")
    writers.csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "k string, text string, n int").collect() == df.collect()
    (tmp_path / "co.json").write_text('{"metadata": {}, "companies": [{"ticker": "AA", "name": "A Plc", "sector": "S", "tier": 1}]}')
    assert readers.companies(spark, str(tmp_path / "co.json"), "aa").first()["name"] == "A Plc"
    html = spark.createDataFrame([("<table><tr><td>Date</td><td>a</td><td>b</td><td>c</td></tr><tr><td>03/02/2024</td><td>1</td><td>2</td><td>1,234.5</td></tr></table>",)], "html string")
    assert readers.html_prices(html).first()["close"] == 1234.5
    assert r"\hline" in writers.latex(df, "A & B", "t")


def test_pipeline_goes_on(spark, tmp_path):
    def bad(spark, read):
        raise ValueError

    p = Pipeline(spark, str(tmp_path)).stage("one", lambda s, read: s.range(3)).stage("bad", bad).stage("two", lambda s, read: read("one").selectExpr("id * 2 as id"))
    assert p.status()["one"] == "pending"
    out = p.run()
    assert out["two"] == "complete" and out["bad"].startswith("failed") and p.read("two").count() == 3
    assert p.run(resume=True)["one"] == "skipped"


def test_stream_of_finds(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select 'u' as url, timestamp'2024-01-01' as discovered union all select 'u', timestamp'2024-01-02' union all select 'v', timestamp'2024-01-02'").write.parquet(src)
    stream = spark.readStream.schema("url string, discovered timestamp").parquet(src)
    q = SR.distinct_finds(stream).writeStream.format("memory").queryName("finds").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from finds").count() == 2
