"""SEN: sentiment scores by company and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scores of the labels, and the order in which prompts and models are preferred.
SENTIMENT = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}
INTENSITY = {"mild": 0.5, "moderate": 1.0, "strong": 1.5}
GUIDANCE = {"positive": 1.0, "negative": -1.0, "neutral": 0.0, "conditional": 0.5, "none": 0.0}
PROMPTS = ("combined_5shot", "combined_3shot", "combined_0shot", "sentiment_5shot", "sentiment_3shot")
MODELS = ("gpt4o", "claude", "gemini")


def _score(m: dict, c: str, default: float):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)], F.lit(default))


def cascade(rows: DataFrame, column: str, preference: tuple[str, ...], least: int = 10) -> DataFrame:
    """SEN-01, SEN-02: the rows of the first preferred value with more than ``least`` rows; all rows if there is none."""
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(preference) for x in (p, i)])[F.col(column)]
    top = rows.groupBy(column).agg(F.count("*").alias("n")).withColumn("r", rank).agg(F.min(F.when(F.col("n") > least, F.col("r"))).alias("__best"))
    return rows.crossJoin(F.broadcast(top)).filter(F.col("__best").isNull() | (rank == F.col("__best"))).drop("__best")  # one row


def scores(rows: DataFrame) -> DataFrame:
    """SEN-03..05: per (ticker, year), from sentiment, intensity, guidance (boolean), guidance_type and item."""
    s, i, g = _score(SENTIMENT, "sentiment", 0.0), _score(INTENSITY, "intensity", 1.0), _score(GUIDANCE, "guidance_type", 0.0)
    share = lambda l: F.avg(F.coalesce(F.col("sentiment") == l, F.lit(False)).cast("int"))
    out = rows.filter("ticker is not null and year is not null").groupBy("ticker", "year").agg(
        F.avg(s).alias("sentiment_mean"), F.avg(s * i).alias("weighted"), F.sum(s).alias("sentiment_sum"), F.avg(g).alias("guidance_mean"), F.avg(F.coalesce("guidance", F.lit(False)).cast("int")).alias("guidance_rate"), F.count("item").alias("n_passages"), share("positive").alias("pct_pos"), share("negative").alias("pct_neg"), share("neutral").alias("pct_neu"),
    )
    out = out.withColumn("net_sentiment", F.col("pct_pos") - F.col("pct_neg")).withColumn("guidance_adj", 0.6 * F.col("weighted") + 0.4 * F.col("guidance_mean"))
    return out.select("ticker", "year", "n_passages", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns if c not in ("ticker", "year", "n_passages")])
