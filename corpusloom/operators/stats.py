"""STA: regressions and tests. Moments are gathered on the cluster; only k x k matrices reach the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.shared import stash
from .ranking import ranked


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return float("nan") if df <= 0 or math.isnan(t) else beta_tail(df / 2, 0.5, df / (df + t * t))


def f_p_value(f: float, d1: float, d2: float) -> float:
    return float("nan") if d1 <= 0 or d2 <= 0 or math.isnan(f) else beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def stars(p: Column) -> Column:
    """STA-04."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def analysis_frame(df: DataFrame, car: str) -> DataFrame:
    """STA-01."""
    y = F.expr("try_cast(year as int)")
    return df.filter(F.col(car).isNotNull()).withColumns({"net_sentiment": F.col("pct_pos") - F.col("pct_neg"), "has_guidance_int": (F.col("guidance_rate") > 0.3).cast("int"), "beta_sq": F.pow("beta", F.lit(2)), "year_int": y, "post_2023": F.coalesce((y >= 2023).cast("int"), F.lit(0))})


def one_hot(df: DataFrame, column: str, prefix: str, most: int = 1_000) -> DataFrame:
    """STA-02: a 0/1 column for each value but the first in order; null gives zeros."""
    values = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values[1:]})


def _lagged_products(rows: DataFrame, coef: np.ndarray, order: list[str], lags: int, k: int) -> tuple[float, list[np.ndarray]]:
    """(sum of squared residuals, sums of products of each row's score with that of the row ``l`` before it).

    Rows are sorted by ranges. Each partition sums its own products and hands on its first and last ``lags`` scores, from which the
    driver adds the products across partitions.
    """

    def run(batches):
        pid, n, ssr = TaskContext.get().partitionId(), 0, 0.0
        sums, head, carry = np.zeros((lags + 1, k, k)), np.zeros((0, k)), np.zeros((0, k))
        for batch in batches:
            x = np.column_stack([batch.column(f"__x{i}").to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
            e = batch.column("__y").to_numpy(zero_copy_only=False) - x @ coef
            score = x * e[:, None]
            ssr, n = ssr + float(e @ e), n + len(e)
            full = np.vstack([carry, score])
            for l in range(lags + 1):
                at = np.arange(max(len(carry), l), len(full))
                sums[l] += full[at].T @ full[at - l]
            head, carry = np.vstack([head, score])[:lags] if len(head) < lags else head, full[-lags:] if lags else full[:0]
        cols = [[pid], [n], [ssr], [sums.ravel().tolist()], [head.ravel().tolist()], [carry.ravel().tolist()]]
        kinds = [pa.int32(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["pid", "n", "ssr", "sums", "head", "tail"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = rows.select(*order, "__y", *[f"__x{i}" for i in range(k)]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    got = wanted.mapInArrow(run, "pid int, n long, ssr double, sums array<double>, head array<double>, tail array<double>").orderBy("pid").collect()  # a row per partition
    sums, scores, at = np.zeros((lags + 1, k, k)), {}, 0
    for r in got:
        sums += np.array(r["sums"]).reshape(lags + 1, k, k)
        head, tail = np.array(r["head"]).reshape(-1, k), np.array(r["tail"]).reshape(-1, k)
        scores |= {at + i: (r["pid"], v) for i, v in enumerate(head)} | {at + r["n"] - len(tail) + i: (r["pid"], v) for i, v in enumerate(tail)}
        at += r["n"]
    for t, (pid, v) in scores.items():
        for l in range(1, lags + 1):
            if t - l in scores and scores[t - l][0] != pid:
                sums[l] += np.outer(v, scores[t - l][1])
    return sum(r["ssr"] for r in got), list(sums)


def ols_hac(df: DataFrame, y: str, xs: list[str], order: list[str], lags: int = 4, label: str = "model", least: int = 10) -> DataFrame | None:
    """STA-03: least squares with Newey-West errors (Bartlett weights); null rows dropped; None with too few rows.

    Two passes over the data: cross products, then lagged products of the scores in the order of ``order``, which is a
    sort by ranges: no task sees all rows.
    Collinear columns are handled by the pseudo-inverse and the numeric rank.
    """
    spark = df.sparkSession
    names = ["const", *xs]
    rows = df.select(*order, F.col(y).cast("double").alias("__y"), *[F.col(f"`{x}`").cast("double").alias(f"__x{i}") for i, x in enumerate(xs, 1)]).dropna(subset=["__y", *[f"__x{i}" for i in range(1, len(xs) + 1)]]).withColumn("__x0", F.lit(1.0))
    rows = stash(rows, "model-rows")  # read for the cross products, the ranges and the lags
    k = len(names)
    x = lambda i: F.col(f"__x{i}")
    first = rows.agg(F.count("*").alias("n"), F.sum(F.col("__y")).alias("sy"), F.sum(F.col("__y") * F.col("__y")).alias("yy"), *[F.sum(x(i) * F.col("__y")).alias(f"b{i}") for i in range(k)], *[F.sum(x(i) * x(j)).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    n = first["n"]
    if n < least:
        return None
    a = np.array([[first[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([first[f"b{i}"] for i in range(k)])
    inv, rank = np.linalg.pinv(a), int(np.linalg.matrix_rank(a))
    coef = inv @ b
    ssr, lagged = _lagged_products(rows, coef, order, lags, k)
    s = np.zeros((k, k))
    for l in range(lags + 1):
        g = lagged[l]
        s += g if l == 0 else (1 - l / (lags + 1)) * (g + g.T)
    cov = inv @ s @ inv
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    sst = first["yy"] - first["sy"] ** 2 / n
    r2 = 1 - ssr / sst if sst > 0 else float("nan")
    df_res = n - rank
    ll = -n / 2 * (math.log(2 * math.pi * max(ssr, 1e-300) / n) + 1)
    slope = coef[1:]
    f = float(slope @ np.linalg.pinv(cov[1:, 1:]) @ slope / max(1, rank - 1)) if k > 1 else float("nan")
    shared = (label, n, r2, 1 - (1 - r2) * (n - 1) / df_res if df_res > 0 else float("nan"), f, f_p_value(f, rank - 1, df_res), -2 * ll + 2 * rank, -2 * ll + rank * math.log(n))
    out = [(*map(lambda v: v if isinstance(v, (str, int)) else float(v), shared), v, float(c), float(e), float(c / e) if e else float("nan"), t_p_value(float(c / e), df_res) if e else float("nan")) for v, c, e in zip(names, coef, se)]
    frame = spark.createDataFrame(out, "label string, n_obs long, r_squared double, adj_r2 double, f_stat double, f_pvalue double, aic double, bic double, variable string, coef double, std_err double, t_stat double, p_value double")
    return frame.withColumn("sig", stars(F.col("p_value")))


def sentiment_group(c: Column) -> Column:
    """STA-06."""
    return F.when(c <= -0.2, "negative").when(c <= 0.2, "neutral").when(c > 0.2, "positive")


def group_stats(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """STA-07: mean, deviation (of n), median, t against 0 and share above 0 of each group with enough rows."""
    v = F.col(value)
    out = df.filter(F.col(group).isNotNull() & v.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), (F.avg(v) / (F.stddev_samp(v) / F.sqrt(F.count("*")))).alias("t"), F.avg((v > 0).cast("int")).alias("share_positive"))
    return out.filter(F.col("n") >= least).select(group, "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "t", "share_positive")])


def welch(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """STA-08: t and degrees of freedom of group ``a`` against ``b``."""
    part = lambda g: (F.avg(F.when(F.col(group) == g, F.col(value))), F.var_samp(F.when(F.col(group) == g, F.col(value))), F.count(F.when(F.col(group) == g, F.col(value))))
    (ma, va, na), (mb, vb, nb) = part(a), part(b)
    m = df.agg(ma.alias("ma"), va.alias("va"), na.alias("na"), mb.alias("mb"), vb.alias("vb"), nb.alias("nb"))
    x, y = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return m.select("na", "nb", F.round((F.col("ma") - F.col("mb")) / F.sqrt(x + y), 6).alias("t"), F.round((x + y) * (x + y) / (x * x / (F.col("na") - 1) + y * y / (F.col("nb") - 1)), 6).alias("df"))


def average_ranks(df: DataFrame, column: str, out: str, buckets: int = 32) -> DataFrame:
    """Mean rank of equal values. Ranks come from counts of distinct values, summed within ranges of values and shifted by the ranges before."""
    c = stash(df.groupBy(column).agg(F.count("*").alias("__c")), "rank-values")
    cuts = sorted(set(c.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.01)))
    c = c.withColumn("__b", F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), lambda x: x < F.col(column))))
    sizes, before = {r[0]: r[1] for r in c.groupBy("__b").agg(F.sum("__c")).collect()}, []  # a row per range
    for b in sorted(sizes):
        before += [F.lit(b), F.lit(sum(n for x, n in sizes.items() if x < b))]
    shift = F.create_map(*before)[F.col("__b")] if before else F.lit(0)
    r = c.withColumn("__u", shift + F.sum("__c").over(Window.partitionBy("__b").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn(out, F.col("__u") - (F.col("__c") - 1) / 2.0).select(column, out)
    return df.join(r, column)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of t; for results of a few rows."""
    return pd.Series([t_p_value(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")


def with_p(df: DataFrame, t: Column, freedom: Column) -> DataFrame:
    """``df`` with p_value and sig."""
    out = df.withColumn("p_value", F.round(t_p(t.cast("double"), freedom.cast("double")), 6))
    return out.withColumn("sig", stars(F.col("p_value")))


def group_tests(df: DataFrame, group: str, value: str, score: str, a: str = "positive", b: str = "negative", least: int = 5) -> DataFrame:
    """STA-07, STA-08, STA-09 as one table: each group against 0, group ``a`` against ``b``, and the rank correlation of value and score."""
    v = F.col(value)
    base = df.filter(F.col(group).isNotNull() & v.isNotNull())
    cols = ["group", "n", "mean_car", "std_car", "median_car", "t_stat", "p_value", "sig", "pct_positive_car"]
    null = F.lit(None).cast("double")
    one = group_stats(df, group, value, least)
    one = with_p(one, F.col("t"), F.col("n") - 1).select(F.col(group).alias("group"), F.col("n").cast("string").alias("n"), F.col("mean").alias("mean_car"), F.col("std").alias("std_car"), F.col("median").alias("median_car"), F.col("t").alias("t_stat"), "p_value", "sig", F.col("share_positive").alias("pct_positive_car"))
    mid = base.agg(*[F.avg(F.when(F.col(group) == g, v)).alias(f"m{g}") for g in (a, b)], *[F.median(F.when(F.col(group) == g, v)).alias(f"d{g}") for g in (a, b)])
    two = with_p(welch(df, group, value, a, b).filter(f"na >= {least} and nb >= {least}"), F.col("t"), F.col("df")).crossJoin(F.broadcast(mid))  # one row
    two = two.select(F.lit(f"{a} vs {b} (diff)").alias("group"), F.concat_ws(" vs ", "na", "nb").alias("n"), F.round(F.col(f"m{a}") - F.col(f"m{b}"), 6).alias("mean_car"), null.alias("std_car"), F.round(F.col(f"d{a}") - F.col(f"d{b}"), 6).alias("median_car"), F.col("t").alias("t_stat"), "p_value", "sig", null.alias("pct_positive_car"))
    rho = spearman(df, value, score)
    three = with_p(rho, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))), F.col("n") - 2)
    three = three.select(F.lit("rank correlation").alias("group"), F.col("n").cast("string").alias("n"), F.col("rho").alias("mean_car"), null.alias("std_car"), null.alias("median_car"), null.alias("t_stat"), "p_value", "sig", null.alias("pct_positive_car"))
    return one.select(cols).unionByName(two.select(cols)).unionByName(three.select(cols))


# The models by label, with the columns of each; those the data lack are left out.
SENTIMENT, GUIDANCE, CONTROLS = ["sentiment_score_mean"], ["guidance_rate", "guidance_score_mean"], ["beta", "post_fx_unif"]
COMBINED = ["sentiment_score_mean", "guidance_score_mean", "guidance_rate", "weighted_score_mean"]
EFFECTS = ("sec_", "yr_", "dt_")


def model_specs(columns: list[str]) -> list[tuple[str, list[str]]]:
    """STA-05: (label, columns) of the models that the columns at hand allow."""
    have = lambda names: [c for c in names if c in columns]
    effects = [c for p in EFFECTS for c in columns if c.startswith(p)]
    base, full = have(COMBINED), have(COMBINED + CONTROLS)
    specs = [
        ("M1: Univariate Sentiment", have(SENTIMENT), 1), ("M2: Guidance Signals", have(GUIDANCE), 1), ("M3: Sentiment + Guidance", base, 2), ("M4: Sentiment + Controls", full, 3),
        ("M5: Full Model (Sector + Year FE)", full + effects, 3), ("M6: Net Sentiment Index", have(["net_sentiment", "guidance_adj_sentiment", "beta"]) if "net_sentiment" in columns else [], 1),
    ]
    return [(label, xs) for label, xs, least in specs if len(xs) >= least]


def all_models(df: DataFrame, y: str, order: list[str]) -> DataFrame | None:
    """STA-05: every model of ``model_specs``, one after another, each by its own rows without nulls; the frame is computed once."""
    df = stash(df, "model-frame")
    done = [m for label, xs in model_specs(df.columns) if (m := ols_hac(df, y, xs, order, label=label)) is not None]
    out = None
    for m in done:
        out = m if out is None else out.unionByName(m)
    return out


def spearman(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """STA-09."""
    rows = stash(df.select(a, b).dropna(), "rank-pairs")  # read several times
    met = average_ranks(average_ranks(rows, a, "__ra"), b, "__rb")
    return met.agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho")).filter(F.col("n") >= least).select("n", F.round("rho", 6).alias("rho"))


def line(df: DataFrame, y: str, x: str) -> DataFrame:
    """STA-14."""
    return df.agg(F.regr_count(y, x).alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def descriptives(df: DataFrame, value: str, group: str) -> DataFrame:
    """STA-12."""
    v = F.col(value)
    return df.agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.avg((v > 0.2).cast("int")), 6).alias("share_high"), F.round(F.avg((v < -0.2).cast("int")), 6).alias("share_low"))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with its position from 0 in ``order``: sorted by ranges, positions of a range shifted by the sizes of those before."""
    s = stash(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, shift, at = F.shiftright("__m", 33), [], 0
    for p, n in sorted(s.groupBy(part).count().collect()):  # a row per partition
        shift += [F.lit(p), F.lit(at)]
        at += n
    offset = F.create_map(*shift)[part] if shift else F.lit(0)
    return s.withColumn(out, offset + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m")


def _draw(*parts: Column) -> Column:
    """A number below 2^60 by hash of the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _replicates(df: DataFrame, y: str, x: str, reps: int, seed: int, permute: bool) -> DataFrame:
    """(id, slope) of each replicate: every row meets a drawn one, or the one of its place in a permutation.

    The grid of replicates and rows is a range that is split like any table, so the number of rows has no bound.
    """
    pairs = numbered(df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).dropna(), ["y", "x"], "i")
    n = pairs.count()
    grid = df.sparkSession.range(reps * n).select(F.expr(f"id div {max(n, 1)}").alias("id"), F.expr(f"id % {max(n, 1)}").alias("i"))
    if not permute:
        drawn = grid.select("id", (_draw(F.lit(seed), F.col("id"), F.col("i")) % max(n, 1)).alias("i")).join(pairs, "i")
        return drawn.groupBy("id").agg(F.regr_slope("y", "x").alias("slope"))
    ranks = ranked(grid.withColumn("h", _draw(F.lit(seed), F.col("id"), F.col("i"))), ["id"], F.shiftleft("h", 4), ["h", "i"], "k")
    met = ranks.join(pairs.select("i", "y"), "i").join(pairs.select(F.col("i").alias("k"), "x"), "k")
    return met.groupBy("id").agg(F.regr_slope("y", "x").alias("slope"))


def placebo(df: DataFrame, y: str, x: str, n: int = 1_000, seed: int = 42) -> DataFrame:
    """STA-10: share of permuted slopes at least as large as the true one."""
    true = df.select(y, x).dropna().agg(F.regr_slope(y, x).alias("slope"))
    reps = _replicates(df, y, x, n, seed, True).withColumnRenamed("slope", "r")
    out = reps.crossJoin(F.broadcast(true)).agg(F.first("slope").alias("slope"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.avg((F.abs("r") >= F.abs("slope")).cast("int")).alias("p"), F.count("*").alias("n_permutations"))  # one row
    return out.select(F.round("slope", 6).alias("slope"), F.round("m", 6).alias("placebo_mean"), F.round("s", 6).alias("placebo_std"), F.round("p", 4).alias("p_value"), "n_permutations")


def bootstrap(df: DataFrame, y: str, x: str, n: int = 2_000, seed: int = 42) -> DataFrame:
    """STA-11: percentile interval of the slope over resampled rows."""
    reps = _replicates(df, y, x, n, seed, False).filter("slope is not null")
    out = reps.agg(F.avg("slope").alias("mean"), F.stddev_pop("slope").alias("std"), F.percentile("slope", F.lit(0.025)).alias("low"), F.percentile("slope", F.lit(0.975)).alias("high"), F.count("*").alias("n_resamples"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")], "n_resamples")
