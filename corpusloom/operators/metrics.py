"""MET: classification metrics, all from one contingency table (keys, gold, pred, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(pairs: DataFrame, keys: list[str], labels: tuple[str, ...] | None = None) -> DataFrame:
    """MET-01: counts of (gold, pred), both in ``labels``; the only pass over the rows."""
    rows = pairs.filter("gold is not null and pred is not null")
    if labels:
        rows = rows.filter(F.col("gold").isin(*labels) & F.col("pred").isin(*labels))
    return rows.groupBy(*keys, "gold", "pred").agg(F.count("*").alias("n"))


def per_class(table: DataFrame, keys: list[str], labels: tuple[str, ...] | None = None) -> DataFrame:
    """MET-04: precision, recall and F1 of each label; 0 where undefined. ``labels`` fixes the set, else it is what occurs."""
    roles = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"))))
    flat = table.select(*keys, "gold", "pred", "n", roles.alias("r"))
    cls = flat.groupBy(*keys, F.col("r.label").alias("label")).agg(F.sum(F.col("n") * F.col("r.g")).alias("support"), F.sum(F.col("n") * F.col("r.p")).alias("predicted"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n") * F.col("r.g")).otherwise(0)).alias("tp"))
    if labels:
        spine = table.select(*keys).distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
        cls = spine.join(cls, [*keys, "label"], "left").na.fill(0, ["support", "predicted", "tp"])
    p, r = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    cls = cls.withColumn("precision", p).withColumn("recall", r)
    return cls.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def report(table: DataFrame, keys: list[str], labels: tuple[str, ...] | None) -> DataFrame:
    """MET-02, MET-07, MET-11: accuracy, macro and weighted scores by ``keys``."""
    total = table.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    m = per_class(table, keys, labels).groupBy(*keys).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))
    return total.join(m, keys).select(*keys, "n", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), "macro_f1", "weighted_f1", "macro_precision", "macro_recall")


def cohen(table: DataFrame, keys: list[str]) -> DataFrame:
    """MET-03: Cohen's kappa over the labels that occur."""
    total = table.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    g = table.groupBy(*keys, F.col("gold").alias("l")).agg(F.sum("n").alias("g"))
    p = table.groupBy(*keys, F.col("pred").alias("l")).agg(F.sum("n").alias("p"))
    chance = g.join(p, [*keys, "l"]).groupBy(*keys).agg(F.sum(F.col("g") * F.col("p")).alias("s"))
    po, pe = F.col("right") / F.col("n"), F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.join(chance, keys, "left").select(*keys, "n", F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def confusion(table: DataFrame, keys: list[str], labels: tuple[str, ...]) -> DataFrame:
    """MET-05: a row per gold label, a column per predicted one."""
    return table.groupBy(*keys, "gold").agg(*[F.sum(F.when(F.col("pred") == l, F.col("n")).otherwise(0)).alias(f"pred_{l}") for l in labels])


def binary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MET-06: scores of the positive class; ``gold`` and ``pred`` are boolean."""
    c = pairs.filter("gold is not null and pred is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("gold") & F.col("pred")).alias("tp"), F.count_if(~F.col("gold") & F.col("pred")).alias("fp"), F.count_if(F.col("gold") & ~F.col("pred")).alias("fn"))
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return c.select(*keys, "n", F.round((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round((F.col("tp") + F.col("fn")) / F.col("n"), 6).alias("prevalence"))


def accuracy_by(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """MET-08: (dimension, value, n, accuracy), null values left out; one scan."""
    kinds = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])
    rows = pairs.filter("gold is not null and pred is not null").select((F.col("gold") == F.col("pred")).cast("int").alias("ok"), F.explode(kinds).alias("k")).filter("k.value is not null")
    return rows.groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


def accuracy_by_quartile(pairs: DataFrame, column: str) -> DataFrame:
    """MET-09: accuracy by quartile of ``column``, bins closed on the right; equal edges merge their bins."""
    rows = pairs.filter(f"gold is not null and pred is not null and {column} is not null")
    q = rows.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    b = F.broadcast(q)  # one row
    bin_ = F.when(F.col(column) <= F.col("q")[0], 1).when(F.col(column) <= F.col("q")[1], 2).when(F.col(column) <= F.col("q")[2], 3).otherwise(4)
    return rows.crossJoin(b).withColumn("bin", bin_).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"))


def top_confusions(table: DataFrame, k: int = 10) -> DataFrame:
    """MET-10: the k most frequent wrong pairs."""
    return table.filter("gold <> pred").groupBy("gold", "pred").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(k)


def compare_runs(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """MET-12: accuracy, macro F1 and kappa by (run_id, model, shots), in order of model and shots."""
    keys = ["run_id", "model", "shots"]
    t = contingency(pairs, keys, labels)
    return report(t, keys, labels).select(*keys, "n", "accuracy", "macro_f1").join(cohen(t, keys).drop("n"), keys).orderBy("model", "shots", "run_id")


def guidance_types(pairs: DataFrame, keys: list[str], labels: tuple[str, ...]) -> DataFrame:
    """MET-07: types of guidance over rows whose gold has guidance and whose labels are in the scheme; macro over what occurs."""
    rows = pairs.filter(F.col("gold_guidance") & F.col("gold").isin(*labels) & F.col("pred").isin(*labels))
    return report(contingency(rows, keys), keys, None).select(*keys, "n", "accuracy", "macro_f1")


def shares_of_gold(table: DataFrame, keys: list[str], labels: tuple[str, ...]) -> DataFrame:
    """The confusion matrix with each row divided by its sum, as a plot takes it."""
    c = confusion(table, keys, labels)
    total = sum((F.col(f"pred_{l}") for l in labels), F.lit(0))
    return c.select(*keys, "gold", *[F.round(F.col(f"pred_{l}") / total, 6).alias(f"share_{l}") for l in labels])
