"""Problem 5: lines repeated across the documents of one source.

Two lines are the same if they agree in their letters. Documents of a source with the same letters in the same
lines are collapsed into one cluster with a weight before lines are counted, so each line
is counted over distinct clusters and publication dates as well as over documents; copies of a republished
article raise only the last. Which count decides is a parameter; lines are removed if two clusters and two dates have them.

Everything is hashed inside the JVM: a document becomes an array of 64-bit line keys (null for a line without
letters), and only those arrays are grouped and shuffled. Counts are partial sums before the shuffle, so a
source with a third of all documents is no hot spot.

Defined results: a null source has no site lines; null text stays null; empty text stays empty; a line
repeated within one document counts once for that document and is removed wherever it stands; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

MIN_DOCS, MIN_SHARE = 3, 0.2
# Lists of repeated lines are broadcast up to this number of lines; beyond it they are joined, a source's documents in parts.
MAX_BROADCAST, PARTS = 500_000, 64


def _keys(text: F.Column) -> F.Column:
    letters = lambda l: F.regexp_replace(l, r"[^\p{L}]+", "")
    return F.transform(F.split(F.lower(text), "\n", -1), lambda l: F.when(l.rlike(r"\p{L}"), F.xxhash64(letters(l))))


def line_keys(df: DataFrame, id_col: str, source: str, date: str | None, text: str = "text") -> DataFrame:
    """(id, source, day, keys): one key per line, in line order."""
    day = F.to_date(F.col(date)) if date else F.lit(None).cast("date")
    rows = df.filter(F.col(source).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.col(source).alias("source"), day.alias("day"), _keys(F.col(text)).alias("keys"))


def repeated_lines(keys: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_clusters: int = 1, min_dates: int = 0) -> DataFrame:
    """(source, key, n_docs, n_clusters, n_dates, source_docs) of each repeated line.

    n_dates leaves out clusters without a date; for ``min_dates`` each of them may be of a date of its own.
    """
    body = keys.withColumn("body", F.xxhash64("keys")).withColumn("set", F.array_distinct(F.array_compact("keys")))
    clusters = stash(body.groupBy("source", "body").agg(F.count("*").alias("w"), F.first("set").alias("set"), F.min("day").alias("day")), "line-clusters")
    totals = clusters.groupBy("source").agg(F.sum("w").alias("source_docs"))
    alone = F.when(F.col("day").isNull(), F.col("body")).alias("alone")
    lines = clusters.select("source", "w", "day", F.explode("set").alias("key"))
    counts = lines.groupBy("source", "key").agg(F.sum("w").alias("n_docs"), F.count("*").alias("n_clusters"))
    counts = counts.filter((F.col("n_docs") >= min_docs) & (F.col("n_clusters") >= min_clusters))
    often = stash(counts.join(totals, "source").filter(F.col("n_docs") + 1e-9 >= min_share * F.col("source_docs")), "line-counts")
    dated = with_lists(clusters, often).filter("drop is not null").select("source", "day", alone, F.explode(F.array_intersect("set", "drop")).alias("key")).distinct()
    dates = dated.groupBy("source", "key").agg(F.count("day").alias("n_dates"), F.count("alone").alias("n_alone"))
    return often.join(dates, ["source", "key"]).filter(F.col("n_dates") + F.col("n_alone") >= min_dates).drop("n_alone")


def with_lists(rows: DataFrame, repeated: DataFrame, source: str = "source", max_broadcast: int | None = None) -> DataFrame:
    """``rows`` with ``drop``, the repeated lines of their source (null for none).

    A source has at most 1 / min_share times its mean number of lines per document, so a list is small. Where all lists together are
    too large to broadcast, each is copied to ``PARTS`` parts among which the documents of its source are spread.
    """
    lists = repeated.groupBy(F.col("source").alias("__source")).agg(F.collect_set("key").alias("drop"))
    if repeated.count() <= (MAX_BROADCAST if max_broadcast is None else max_broadcast):
        return rows.join(F.broadcast(lists), F.col(source) == F.col("__source"), "left").drop("__source")
    lists = lists.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    spread = rows.withColumn("__spread", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if t in ("bigint", "string", "int")]), F.lit(PARTS)).cast("int"))
    return spread.join(lists, (F.col(source) == F.col("__source")) & (F.col("__spread") == F.col("__part")), "left").drop("__source", "__part", "__spread")


def repeated_occurrences(df: DataFrame, id_col: str, source: str, date: str | None, text: str = "text", **rule) -> DataFrame:
    """(id, line_no) of every line that is repeated within its source."""
    keys = stash(line_keys(df, id_col, source, date, text), "line-keys")
    found = stash(repeated_lines(keys, **rule).select("source", "key"), "line-repeated")
    hits = with_lists(keys.select("id", "source", "keys"), found).filter("drop is not null").withColumn("hit", F.expr("transform(keys, k -> k is not null and array_contains(drop, k))"))
    out = hits.select("id", F.posexplode("hit").alias("line_no", "hit")).filter("hit").select(F.col("id").alias(id_col), "line_no")
    return out.distinct()


def remove_site_lines(df: DataFrame, id_col: str, source: str, date: str | None, text: str = "text", **rule) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text``; every other line stays as it was.

    Lines of one cluster or of one date are a republished article, not repeated lines.
    """
    rule = {"min_clusters": 2, "min_dates": 2} | rule
    keys = stash(line_keys(df, id_col, source, date, text), "line-keys")
    found = stash(repeated_lines(keys, **rule).select("source", "key"), "line-repeated")
    taken = [F.col(c).alias(f"__c{i}") for i, c in enumerate(df.columns)]  # a column of the table may be named like one of ours
    t, by = f"__c{df.columns.index(text)}", f"__c{df.columns.index(source)}"
    rows = with_lists(df.select(*taken), found, by).withColumn("__lines", F.split(t, "\n", -1)).withColumn("__keys", _keys(F.col(t)))
    kept = F.expr("array_join(filter(__lines, (l, i) -> not (__keys[i] is not null and array_contains(drop, __keys[i]))), '\n')")
    clean = F.when(F.col("drop").isNull(), F.col(t)).otherwise(kept)
    return rows.withColumn(t, clean).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(df.columns)])
