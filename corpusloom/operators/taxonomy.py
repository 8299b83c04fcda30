"""ERR: rule-based tags of wrong predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The signals of each rule, matched as substrings of the text in lower case.
LOCAL = ("naira", "kobo", "ngn", "₦", "subsidy", "forex", "fx", "parallel market", "cbn", "sec nigeria", "ngx", "nse", "rc no", "frc/", "cac", "inec", "nnpc", "dpr", "nuprc")
FX = ("foreign exchange", "fx loss", "translation loss", "exchange rate", "devaluation", "naira depreciation", "monetary policy rate", "mpr", "cbn policy")
REGULATORY = ("in accordance with", "as required by", "the companies and allied matters act", "cama", "sec rules", "ifrs", "independent auditor", "going concern", "dividend policy", "articles of association")
FORMAL = ("we are pleased", "the board is satisfied", "we remain committed", "the group continues to", "in line with our strategy", "we are confident", "we remain optimistic")
JARGON = {
    "Banking": ("npl", "car", "ldr", "nim", "cost of funds", "tier 1", "tier 2", "loan loss", "impairment charge", "risk assets", "letters of credit"),
    "Oil & Gas": ("boepd", "2p reserves", "opex per barrel", "lifting costs", "upstream", "downstream", "midstream", "ppe abandonment", "unitization", "gas flaring"),
    "Consumer Goods": ("offtake", "trade spend", "distributor", "rtm", "gt channel", "sachet", "sku", "pouch", "pack size", "volume decline"),
    "Telecoms": ("arpu", "mou", "data revenue", "spectrum", "qos", "churn rate", "active subscribers", "mtn", "airtel"),
    "Industrial": ("clinker", "cement volume", "crushing strength", "capacity utilisation", "brt", "blended cement"),
}
MACRO = ("2023 fx unification", "naira redesign", "fuel subsidy removal", "inflation", "purchasing power", "food inflation", "poverty rate", "insecurity", "flooding", "power outage")
FORWARD = ("expect", "anticipate", "forecast", "target", "plan", "intend", "project", "will", "aim", "hope", "believe", "estimate", "going forward", "in the coming", "next year", "2024", "2025")
CONDITIONAL = ("subject to", "contingent on", "depending on", "if", "provided that", "assuming", "barring", "unless", "conditional on", "fx stabilisation", "policy environment")
CODES = ("A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4", "C2", "C3", "C4", "UNK")
LENGTH_EDGES = (0, 50, 100, 150, 200, 300, 500)


def count_signals(text: Column, signals: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(s).cast("int") for s in signals])


def signal_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the text in lower case and the counts of each signal list, once per row."""
    low = rows.withColumn("__t", F.lower(F.coalesce(F.col(text), F.lit(""))))
    t = F.col("__t")
    jargon = None
    for sector, words in JARGON.items():
        n = count_signals(t, words)
        jargon = F.when(F.col("sector") == sector, n) if jargon is None else jargon.when(F.col("sector") == sector, n)
    lists = {"__fx": FX, "__regulatory": REGULATORY, "__formal": FORMAL, "__local": LOCAL, "__macro": MACRO, "__forward": FORWARD, "__conditional": CONDITIONAL}
    return low.withColumns({n: count_signals(t, w) for n, w in lists.items()} | {"__jargon": jargon.otherwise(0)}).drop("__t")


def tags() -> Column:
    """ERR-01: codes of a row with gold, pred, gold_guidance, pred_guidance (boolean), gold_type, pred_type and signal counts.

    Empty where the sentiment is right or missing; UNK where no rule fits.
    """
    c, gold, pred = F.col, F.col("gold"), F.col("pred")
    gg, pg = F.coalesce(c("gold_guidance"), F.lit(False)), F.coalesce(c("pred_guidance"), F.lit(False))
    a3 = (c("__fx") >= 2) & (gold == "positive") & pred.isin("negative", "neutral")
    a4 = (c("__regulatory") >= 2) & (gold == "neutral") & (pred != "neutral")
    a2 = (c("__formal") >= 1) & (gold == "positive") & (pred == "neutral")
    rules = (
        ("A3", a3), ("A4", a4), ("A2", a2), ("A1", (c("__local") >= 3) & ~(a3 | a4 | a2)), ("B1", c("__jargon") >= 2), ("B2", c("__macro") >= 1), ("B3", (c("__forward") >= 1) & gg & ~pg),
        ("B4", (c("__conditional") >= 1) & (c("gold_type") == "conditional") & c("pred_type").isin("positive", "negative")),
        ("C2", (pred == "neutral") & gold.isin("positive", "negative")), ("C3", (pred == "positive") & gold.isin("negative", "neutral")), ("C4", pg & ~gg & (c("__forward") >= 1)),
    )
    found = F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules])))
    wrong = gold.isNotNull() & pred.isNotNull() & (gold != pred)
    return F.when(~wrong, F.array().cast("array<string>")).when(F.size(found) == 0, F.array(F.lit("UNK"))).otherwise(found)


def tag_errors(rows: DataFrame, text: str = "text") -> DataFrame:
    """ERR-03: flags, tags joined by '|', and their number."""
    wrong = F.coalesce(F.col("gold") != F.col("pred"), F.lit(False))
    guide = F.coalesce(F.col("gold_guidance") != F.col("pred_guidance"), F.lit(False))
    out = signal_counts(rows, text).withColumn("tag_list", tags()).withColumn("is_sentiment_error", wrong).withColumn("is_guidance_error", guide)
    out = out.withColumn("is_any_error", F.col("is_sentiment_error") | F.col("is_guidance_error")).withColumn("tags", F.array_join("tag_list", "|")).withColumn("n_tags", F.size("tag_list"))
    return out.select(*rows.columns, "tag_list", "is_sentiment_error", "is_guidance_error", "is_any_error", "tags", "n_tags")


def tag_counts(tagged: DataFrame) -> DataFrame:
    """ERR-06: occurrences of each code and their share of all wrong rows."""
    total = tagged.agg(F.count_if("is_sentiment_error").alias("wrong"))
    n = tagged.select(F.explode("tag_list").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("code", "n", F.round(F.col("n") / F.col("wrong"), 6).alias("rate"))  # one row


def error_rates(tagged: DataFrame, dimensions: list[str]) -> DataFrame:
    """ERR-07: (dimension, value, n, errors, rate); one scan."""
    kinds = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])
    rows = tagged.select(F.col("is_sentiment_error").cast("int").alias("e"), F.explode(kinds).alias("k")).filter("k.value is not null")
    return rows.groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"), F.sum("e").alias("errors"), F.round(F.avg("e"), 6).alias("rate"))


def disagreement(rows: DataFrame) -> DataFrame:
    """ERR-04: items on which the models differ, with the number of models and labels."""
    return rows.filter("pred is not null").groupBy("item").agg(F.count_distinct("model").alias("n_models"), F.count_distinct("pred").alias("n_labels")).filter("n_labels > 1")


def disagreement_rate(rows: DataFrame) -> DataFrame:
    """Share of disagreement over all items, not only those that differ."""
    per = rows.filter("pred is not null").groupBy("item").agg(F.count_distinct("pred").alias("k"))
    return per.agg(F.count("*").alias("n_items"), F.round(F.avg((F.col("k") > 1).cast("int")), 6).alias("rate"))


def examples(tagged: DataFrame, k: int = 3, least_words: int = 60, order: tuple[str, ...] = ("item", "model")) -> DataFrame:
    """ERR-05: up to k examples per code; rows with that code alone if there are k of them, else all."""
    rows = tagged.filter(F.col("word_count") >= least_words).select(*order, "n_tags", "gold", "pred", F.explode("tag_list").alias("code"))
    single = rows.groupBy("code").agg(F.count_if(F.col("n_tags") == 1).alias("singles"))
    rows = rows.join(single, "code").filter((F.col("singles") < k) | (F.col("n_tags") == 1))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(*order))).filter(F.col("rank") <= k).select("code", "rank", *order, "gold", "pred")


def guidance_errors(rows: DataFrame) -> DataFrame:
    """ERR-09."""
    ok = rows.filter("gold_guidance is not null and pred_guidance is not null")
    return ok.agg(F.count("*").alias("n"), F.count_if(~F.col("gold_guidance") & F.col("pred_guidance")).alias("false_positive"), F.count_if(F.col("gold_guidance") & ~F.col("pred_guidance")).alias("false_negative"))


def guidance_error_rates(rows: DataFrame) -> DataFrame:
    """ERR-09: with the shares of all valid rows."""
    g = guidance_errors(rows)
    return g.select("*", F.round(F.col("false_positive") / F.col("n"), 4).alias("fp_rate"), F.round(F.col("false_negative") / F.col("n"), 4).alias("fn_rate"))


def join_gold(predictions: DataFrame, gold: DataFrame, columns: dict[str, str], key: str = "item") -> DataFrame:
    """ERR-02: gold labels (``columns``: name in gold to name here) of predictions that don't carry them; others stay as they are."""
    missing = {a: b for a, b in columns.items() if b not in predictions.columns}
    if not missing:
        return predictions
    return predictions.join(gold.groupBy(key).agg(*[F.first(a).alias(b) for a, b in missing.items()]), key, "left")


def disagreement_table(rows: DataFrame, items: DataFrame, models: list[str]) -> DataFrame:
    """ERR-04: items on which the models differ, a column per model with its first prediction (the smallest), beside the item's data."""
    first = rows.filter("pred is not null").groupBy("item", "model").agg(F.min("pred").alias("pred"))
    wide = first.groupBy("item").agg(*[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models], F.count_distinct("pred").alias("n_labels"))
    return wide.filter("n_labels > 1").join(items, "item", "left")


def sector_by_model(tagged: DataFrame, models: list[str]) -> DataFrame:
    """ERR-10: error rate by sector, a column per model."""
    wrong = F.col("is_sentiment_error").cast("int")
    return tagged.filter("sector is not null").groupBy("sector").agg(*[F.round(F.avg(F.when(F.col("model") == m, wrong)), 6).alias(m) for m in models])


def disagreement_by_sector(rows: DataFrame, items: DataFrame) -> DataFrame:
    """ERR-12: share of items on which the models differ, and items, by sector."""
    per = rows.filter("pred is not null").groupBy("item").agg((F.count_distinct("pred") > 1).cast("int").alias("d"))
    return per.join(items.select("item", "sector"), "item").filter("sector is not null").groupBy("sector").agg(F.round(F.avg("d"), 6).alias("rate"), F.count("*").alias("n"))


def example_sheet(tagged: DataFrame, texts: DataFrame, chars: int = 400, k: int = 3) -> DataFrame:
    """ERR-05: the examples with the beginning of their text."""
    return examples(tagged, k).join(texts.select("item", F.substring("text", 1, chars).alias("excerpt")), "item", "left")


def length_bins(tagged: DataFrame) -> DataFrame:
    """ERR-11: error rate by word count, bins open on the left; longer and empty rows are left out."""
    c, bin_ = F.col("word_count"), None
    for a, b in zip(LENGTH_EDGES, LENGTH_EDGES[1:]):
        cond = (c > a) & (c <= b)
        bin_ = F.when(cond, f"({a},{b}]") if bin_ is None else bin_.when(cond, f"({a},{b}]")
    return tagged.withColumn("bin", bin_).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_sentiment_error").cast("int")), 6).alias("rate"))
