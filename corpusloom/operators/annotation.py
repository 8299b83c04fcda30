"""ANN and FIX: the annotation queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Short codes, label sets, the order in which passages are shown, and the columns of the gold standard.
SHORT_LABELS = {"p": "positive", "n": "negative", "u": "neutral", "c": "conditional", "1": "mild", "2": "moderate", "3": "strong"}
SENTIMENTS = ("positive", "negative", "neutral")
GUIDANCE = ("positive", "negative", "neutral", "conditional", "none")
QUALITY_RANK = {"good": 0, "acceptable": 1, "poor": 2}
SECTION_RANK = {"outlook": 0, "chairman_statement": 1, "ceo_review": 2, "operating_review": 3}
GOLD_COLUMNS = ("passage_id", "ticker", "company", "sector", "year", "doc_type", "section", "text", "word_count", "sentiment_label", "sentiment_intensity", "has_guidance", "guidance_type", "guidance_span", "annotator", "annotation_notes")


def _map(pairs: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def full_label(c: Column) -> Column:
    """FIX-02: short codes as words, in lower case without spaces around."""
    low = F.lower(strip(c))
    return F.coalesce(_map(SHORT_LABELS, low), low)


def repair_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: full_label(F.col(c)) for c in columns})


def pending(queue: DataFrame, sector: str | None = None) -> DataFrame:
    """ANN-01."""
    out = queue.filter((F.col("annotation_status") == "pending") | F.col("annotator").isNull() | (F.col("annotator") == ""))
    return out.filter(F.lower("sector") == sector.lower()) if sector else out


def next_batch(queue: DataFrame, k: int = 20, sector: str | None = None, order: str = "row_id") -> DataFrame:
    """ANN-02: the k pending passages to show first; a distributed top-k."""
    rank = lambda m, c: F.coalesce(_map(m, F.col(c)), F.lit(9))
    return pending(queue, sector).orderBy(rank(QUALITY_RANK, "quality"), rank(SECTION_RANK, "section"), order).limit(k)


def progress(queue: DataFrame, columns: list[str]) -> DataFrame:
    """ANN-04: (dimension, value, n) over done rows."""
    kinds = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns])
    return queue.filter("annotation_status = 'done'").select(F.explode(kinds).alias("k")).filter("k.value is not null").groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))


def gold_rows(queue: DataFrame) -> DataFrame:
    """ANN-05."""
    return queue.filter("annotation_status = 'done'").select(*GOLD_COLUMNS)


def web_pending(queue: DataFrame) -> DataFrame:
    """ANN-07."""
    return queue.filter(F.col("quality").isin("good", "acceptable") & (F.col("annotation_status").isin("pending", "ai_annotated") | F.col("annotator").isNull() | (F.col("annotator") == "")))


def sector_progress(queue: DataFrame) -> DataFrame:
    """ANN-08: done rows (of any quality) against annotatable ones, in whole per cent."""
    usable = F.col("quality").isin("good", "acceptable")
    out = queue.filter("sector is not null").groupBy("sector").agg(F.count_if(F.col("annotation_status") == "done").alias("done"), F.count_if(usable).alias("annotatable"))
    return out.withColumn("percent", F.when(F.col("annotatable") > 0, F.floor(F.col("done") * 100 / F.col("annotatable"))).otherwise(0).cast("long"))


def dashboard_rates(queue: DataFrame) -> DataFrame:
    """ANN-09: shares of positive labels and of guidance among done rows."""
    done = queue.filter("annotation_status = 'done'")
    return done.agg(F.round(F.avg((F.coalesce(full_label(F.col("sentiment_label")), F.lit("")) == "positive").cast("int")) * 100, 6).alias("positivity"), F.round(F.avg((F.lower("has_guidance") == "true").cast("int")) * 100, 6).alias("guidance"))


def crosstab(queue: DataFrame, a: str, b: str) -> DataFrame:
    """ANN-10: counts of label pairs among done rows, null values left out."""
    return queue.filter("annotation_status = 'done'").filter(f"{a} is not null and {b} is not null").groupBy(a, b).agg(F.count("*").alias("n"))


def first_guidance(queue: DataFrame, k: int = 10, order: str = "row_id") -> DataFrame:
    """ANN-11."""
    return queue.filter("annotation_status = 'done' and guidance_span is not null and lower(has_guidance) = 'true'").orderBy(order).limit(k)


def set_sector(df: DataFrame, companies: DataFrame) -> DataFrame:
    """FIX-03: sector from the company list where the ticker is in it."""
    dim = companies.select("ticker", F.col("sector").alias("__s"))
    return df.join(dim, "ticker", "left").withColumn("sector", F.coalesce("__s", "sector")).drop("__s")


def unmapped_tickers(df: DataFrame, companies: DataFrame) -> DataFrame:
    return df.filter("ticker is not null").select("ticker").distinct().join(companies.select("ticker"), "ticker", "left_anti")


def rekey_tickers(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """FIX-01."""
    return df.withColumn("ticker", F.coalesce(_map(mapping, F.col("ticker")), F.col("ticker")))


def changed_columns(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """FIX-02: (column, n_changed) of a repair."""
    old = before.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = after.select(key, *columns).join(old, key)
    n = both.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in columns])
    return n.unpivot([], columns, "column", "n_changed")


def apply_changes(queue: DataFrame, log: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """ANN-03: the queue with the label fields of the latest change of each passage; the log itself is only added to."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("__l"))
    joined = queue.join(last, key, "left")
    return joined.select(*[F.when(F.col("__l").isNotNull(), F.col(f"__l.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in queue.columns])


def progress_totals(queue: DataFrame) -> DataFrame:
    """ANN-04: totals by status with their share of all rows in per cent."""
    n = queue.agg(F.count("*").alias("total"), *[F.count_if(F.col("annotation_status") == s).alias(s) for s in ("done", "skipped", "pending")])
    return n.withColumn("percent_done", F.round(F.col("done") / F.col("total") * 100, 6))


def web_next(queue: DataFrame, k: int = 1, sector: str | None = None, order: str = "row_id") -> DataFrame:
    """ANN-07: the first rows of the web view, in the order of ANN-02."""
    rank = lambda m, c: F.coalesce(_map(m, F.col(c)), F.lit(9))
    rows = web_pending(queue)
    rows = rows.filter(F.lower("sector") == sector.lower()) if sector else rows
    return rows.orderBy(rank(QUALITY_RANK, "quality"), rank(SECTION_RANK, "section"), order).limit(k)


def pre_annotation_batch(queue: DataFrame, k: int = 50, least_chars: int = 50, order: str = "row_id") -> DataFrame:
    """ANN-12: the next k annotatable pending rows, without those too short to judge."""
    ready = F.col("quality").isin("good", "acceptable") & ((F.col("annotation_status") == "pending") | (F.coalesce("annotation_status", F.lit("")) == ""))
    return queue.filter(ready).orderBy(order).limit(k).filter(F.length(strip(F.col("text"))) >= least_chars)


def merge_machine_labels(queue: DataFrame, labels: DataFrame, key: str, who: str) -> DataFrame:
    """ANN-12: the queue with the labels of a scored batch, status ai_annotated."""
    fields = [c for c in labels.columns if c != key]
    tagged = labels.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in fields])
    hit = F.col("__k").isNotNull()
    values = {c: F.col(f"__{c}") for c in fields} | {"annotator": F.lit(who), "annotation_status": F.lit("ai_annotated")}
    joined = queue.join(tagged, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in queue.columns])


def gold_or_done(gold: DataFrame | None, queue: DataFrame) -> DataFrame:
    """SRC-08, SRC-09: the gold standard where there is one with rows, else the queue's done rows."""
    if gold is not None and not gold.isEmpty():
        return gold.select(*GOLD_COLUMNS)
    return gold_rows(queue)


def web_queue(queue: DataFrame) -> DataFrame:
    """SRC-13: the queue as the web view loads it: nulls of text columns as empty text, short codes expanded."""
    texts = [c for c, t in queue.dtypes if t == "string"]
    return repair_labels(queue.na.fill("", texts), ["sentiment_label", "guidance_type", "sentiment_intensity"])
