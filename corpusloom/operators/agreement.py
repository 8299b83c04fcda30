"""IAA: agreement between annotators. Inputs are long: (task, item, annotator, label), one row per vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotation import GUIDANCE, SENTIMENTS, full_label
from .registry import last_by_key

# Bands of agreement.
BANDS = ((0.80, "Almost perfect"), (0.61, "Substantial"), (0.41, "Moderate"), (0.21, "Fair"), (0.0, "Slight"))
TASKS = {"sentiment": ("sentiment_label", SENTIMENTS), "guidance": ("guidance_type", GUIDANCE)}


def votes(queue: DataFrame) -> DataFrame:
    """IAA-01: the latest done vote of each annotator on each item and task, nulls and unknown labels left out."""
    done = queue.filter("annotation_status = 'done'").withColumn("annotator", F.lower(F.trim("annotator"))).filter("annotator <> '' and passage_id is not null")
    last = last_by_key(done.select("passage_id", "annotator", "annotated_at", "row_id", *[c for c, _ in TASKS.values()]), ["passage_id", "annotator"], ["annotated_at", "row_id"])
    kinds = F.array(*[F.struct(F.lit(t).alias("task"), full_label(F.col(c)).alias("label")) for t, (c, _) in TASKS.items()])
    long = last.select("passage_id", "annotator", F.explode(kinds).alias("k")).select(F.col("k.task").alias("task"), F.col("passage_id").alias("item"), "annotator", F.col("k.label").alias("label"))
    known = F.lit(False)
    for t, (_, labels) in TASKS.items():
        known = known | ((F.col("task") == t) & F.col("label").isin(*labels))
    return long.filter(known)


def common_items(long: DataFrame) -> DataFrame:
    """IAA-02: votes on items that every annotator of the task rated."""
    k = long.groupBy("task").agg(F.count_distinct("annotator").alias("k"))
    full = long.groupBy("task", "item").agg(F.count_distinct("annotator").alias("n")).join(k, "task").filter("n = k").select("task", "item")
    return long.join(full, ["task", "item"], "left_semi")


def fleiss(long: DataFrame) -> DataFrame:
    """IAA-03: (task, n_items, kappa) over items with two votes or more; 1 if chance agreement is 1."""
    cell = long.groupBy("task", "item", "label").agg(F.count("*").alias("n"))
    item = cell.groupBy("task", "item").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2")).filter("n > 1")
    p = item.withColumn("p", (F.col("n2") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))
    mean = p.groupBy("task").agg(F.count("*").alias("n_items"), F.avg("p").alias("po"), F.sum("n").alias("total"))
    share = cell.join(item.select("task", "item"), ["task", "item"], "left_semi").groupBy("task", "label").agg(F.sum("n").alias("m"))
    pe = share.join(mean.select("task", "total"), "task").groupBy("task").agg(F.sum(F.pow(F.col("m") / F.col("total"), 2)).alias("pe"))
    return mean.join(pe, "task").select("task", "n_items", F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def fleiss_common(long: DataFrame, least: int = 5) -> DataFrame:
    """IAA-03 as the reference has it: only items that every annotator of the task rated, and no task with fewer than ``least`` of them."""
    return fleiss(common_items(long)).filter(F.col("n_items") >= least)


def krippendorff(long: DataFrame, level: str, ranks: dict[str, int], textbook: bool = False) -> DataFrame:
    """IAA-04: (task, alpha). Pairs within an item are counted from the item's label counts, not by pairing its votes.

    The default counts every ordered pair once and takes plain rank differences for ordinal data; ``textbook`` weights
    pairs by 1 / (votes of the item - 1) and squares ordinal differences.
    """
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    cell = long.groupBy("task", "item", "label").agg(F.count("*").alias("n"))
    total = cell.groupBy("task", "item").agg(F.sum("n").alias("m")).filter("m > 1")
    cell = cell.join(total, ["task", "item"])
    a, b = cell.select("task", "item", F.col("label").alias("v"), F.col("n").alias("nv"), "m"), cell.select("task", "item", F.col("label").alias("w"), F.col("n").alias("nw"))
    weight = F.when(F.col("v") == F.col("w"), F.col("nv") * (F.col("nv") - 1)).otherwise(F.col("nv") * F.col("nw"))
    both = a.join(b, ["task", "item"]).groupBy("task", "v", "w").agg(F.sum(weight / (F.col("m") - 1) if textbook else weight.cast("double")).alias("o"))
    gap = F.abs(rank[F.col("v")] - rank[F.col("w")]).cast("double")
    d = F.when(F.col("v") == F.col("w"), 0.0).otherwise(1.0) if level == "nominal" else gap * gap if level == "interval" or textbook else gap
    margin = both.groupBy("task", "v").agg(F.sum("o").alias("c"))
    n = margin.groupBy("task").agg(F.sum("c").alias("n"))
    observed = both.withColumn("d", d).groupBy("task").agg((F.sum(F.col("o") * F.col("d"))).alias("x"))
    pairs = margin.join(margin.select("task", F.col("v").alias("w"), F.col("c").alias("c2")), "task").withColumn("d", d)
    expected = pairs.groupBy("task").agg(F.sum(F.col("c") * F.col("c2") * F.col("d")).alias("e"))
    out = observed.join(expected, "task").join(n, "task")
    do, de = F.col("x") / F.col("n"), F.col("e") / (F.col("n") * (F.col("n") - 1))
    return out.select("task", F.round(F.when(F.col("e") == 0, 1.0).otherwise(1 - do / de), 6).alias("alpha"))


def pairwise_kappa(long: DataFrame, least: int = 5) -> DataFrame:
    """IAA-05: (task, a, b, n, agreement, kappa) of each pair of annotators with enough common items."""
    x, y = long.toDF("task", "item", "a", "la"), long.toDF("task", "item", "b", "lb")
    cell = x.join(y, ["task", "item"]).filter("a < b").groupBy("task", "a", "b", "la", "lb").agg(F.count("*").alias("n"))
    keys = ["task", "a", "b"]
    total = cell.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("same")).filter(F.col("n") >= least)
    ma = cell.groupBy(*keys, F.col("la").alias("l")).agg(F.sum("n").alias("ma"))
    mb = cell.groupBy(*keys, F.col("lb").alias("l")).agg(F.sum("n").alias("mb"))
    chance = ma.join(mb, [*keys, "l"]).groupBy(*keys).agg(F.sum(F.col("ma") * F.col("mb")).alias("s"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.join(chance, keys, "left").select(*keys, "n", F.round(po, 6).alias("agreement"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def band(k: Column) -> Column:
    """IAA-06."""
    out = None
    for low, name in BANDS:
        out = F.when(k >= low, name) if out is None else out.when(k >= low, name)
    return out.otherwise("Poor")


def pairwise_summary(long: DataFrame, least: int = 5) -> DataFrame:
    """IAA-06, IAA-09: mean of the pairs by task."""
    return pairwise_kappa(long, least).groupBy("task").agg(F.count("*").alias("n_pairs"), F.round(F.avg("kappa"), 5).alias("mean_kappa"), F.round(F.avg("agreement"), 5).alias("mean_agreement")).withColumn("band", band(F.col("mean_kappa")))


def adjudication(long: DataFrame, task: str = "sentiment") -> DataFrame:
    """IAA-07: items with two votes or more and more than one label, with the votes as 'annotator=label' in order."""
    return long.filter(F.col("task") == task).groupBy("item").agg(F.count("*").alias("n_votes"), F.count_distinct("label").alias("n_labels"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "annotator", "label"))), "|").alias("votes")).filter("n_votes >= 2 and n_labels > 1")


def simulate(items: DataFrame, annotators: list[str], labels: list[str], noise: float = 0.12, seed: int = 7) -> DataFrame:
    """IAA-08: votes of simulated annotators who resample a label with probability ``noise``."""
    who = F.explode(F.array(*[F.lit(a) for a in annotators]))
    base = items.select("task", "item", "label", who.alias("annotator"))
    u = lambda k: F.pmod(F.xxhash64("item", "annotator", F.lit(seed + k)), F.lit(1_000_003)) / 1_000_003.0
    other = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.floor(u(1) * len(labels)) + 1).cast("int"))
    return base.select("task", "item", "annotator", F.when(u(0) < noise, other).otherwise(F.col("label")).alias("label"))


def adjudication_sheet(long: DataFrame, texts: DataFrame, task: str = "sentiment", chars: int = 200) -> DataFrame:
    """IAA-07: items to be adjudicated with the beginning of their text and ``ann_<name>``, the label of each annotator; a pivot over the annotators' names."""
    rows = long.filter(F.col("task") == task)
    names = [r[0] for r in rows.select("annotator").distinct().orderBy("annotator").collect()]  # columns of the result
    flagged = adjudication(long, task).select("item")
    wide = rows.join(flagged, "item", "left_semi").groupBy("item").pivot("annotator", names).agg(F.first("label"))
    wide = wide.select("item", *[F.col(f"`{n}`").alias(f"ann_{n}") for n in names])
    return wide.join(texts.select("item", F.substring("text", 1, chars).alias("excerpt")), "item", "left")


def agreement_table(long: DataFrame, ranks: dict[str, int], least: int = 5) -> DataFrame:
    """IAA-09: a row per task: items and annotators in common, Fleiss, Krippendorff, mean pairwise kappa and agreement, band."""
    common = common_items(long)
    n = common.groupBy("task").agg(F.count_distinct("item").alias("n_items"), F.count_distinct("annotator").alias("n_annotators")).filter(F.col("n_items") >= least)
    f = fleiss(common).select("task", F.col("kappa").alias("fleiss_kappa"))
    a = krippendorff(common, "nominal", ranks)
    p = pairwise_summary(common, least).select("task", F.col("mean_kappa").alias("mean_pairwise_kappa"), F.col("mean_agreement").alias("mean_pairwise_agreement"))
    return n.join(f, "task", "left").join(a, "task", "left").join(p, "task", "left").withColumn("band", band(F.col("fleiss_kappa")))
