"""REG and SRC: the collection registry as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_type, report_year


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """REG-02: the first row of each key. Aggregates before the shuffle, so a key with many rows is no hot spot."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def add_discovered(known: DataFrame, found: DataFrame, key: str = "url", order: str = "registry_id") -> DataFrame:
    """REG-02: newly found rows whose key isn't known, the first of each."""
    return known.unionByName(first_by_key(found, key, order).join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def mark(registry: DataFrame, events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """REG-03: ``columns`` of every row whose key has an event, set to the event's values."""
    e = events.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in columns])
    joined = registry.join(e, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in registry.columns])


def download_queue(registry: DataFrame, ticker: str | None = None) -> DataFrame:
    """REG-07: neither downloaded nor failed under any row of the address, and not of type other."""
    done = registry.filter("downloaded_at is not null").select("url")
    failed = registry.filter("extraction_stats.extraction_status = 'failed'").select("url")
    out = registry.filter("doc_type <> 'other'").join(done.unionByName(failed).distinct(), "url", "left_anti")
    return out.filter(F.col("ticker") == ticker.upper()) if ticker else out


def extraction_queue(registry: DataFrame) -> DataFrame:
    """REG-08: downloaded, with a file, not yet extracted."""
    extracted = registry.filter("text_path is not null").select("url").distinct()
    return registry.filter("downloaded_at is not null and local_path is not null").join(extracted, "url", "left_anti")


def build_index(registry: DataFrame) -> DataFrame:
    """REG-09: rows with statistics and a text path, statistics as columns."""
    return registry.filter("extraction_stats is not null and text_path is not null").select("registry_id", "ticker", F.col("company_name").alias("company"), "sector", "year", "doc_type", "source", F.col("local_path").alias("pdf_path"), "text_path", "extraction_stats.*")


def grouped_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """REG-10, VAL-03: (dimension, value, n) of each column by itself, null values left out; one scan by grouping sets."""
    kinds = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(kinds).alias("k")).filter("k.value is not null").groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))


def summary(registry: DataFrame) -> DataFrame:
    """REG-05."""
    return registry.agg(F.count("*").alias("discovered"), F.count("downloaded_at").alias("downloaded"), F.count("text_path").alias("extracted"), F.count_if(F.col("extraction_stats.extraction_status") == "failed").alias("failed"))


def discover(sources: list[DataFrame], companies: DataFrame) -> DataFrame:
    """REG-06: all finds with the company's name and sector; companies is a fixed list, broadcast by its size."""
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return found.join(companies.select("ticker", F.col("name").alias("company_name"), "sector"), "ticker", "left")


def by_priority(df: DataFrame, key: str, source: str, priority: list[str]) -> DataFrame:
    """SRC-22: of each key only the rows of its best source; unknown sources come last."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, s in enumerate(priority) for x in (s, i)])[F.col(source)], F.lit(len(priority)))
    ranked = df.withColumn("__p", rank)
    best = ranked.groupBy(key).agg(F.min("__p").alias("__p"))
    return ranked.join(best, [key, "__p"], "left_semi").drop("__p")


def fuzzy_company(df: DataFrame, companies: DataFrame, folder: str, order: str = "ticker") -> DataFrame:
    """SRC-24: ``df`` with ``found``: the ticker equal to ``folder``, else the first company in order whose ticker, or name without spaces, contains it.

    Containment is looked up by equality: a folder's first three letters meet the pieces of that length of tickers and names, and
    what meets is checked. A folder without letters finds nothing.
    """
    names = df.select(F.upper(folder).alias("__f")).distinct().filter("__f is not null and replace(__f, ' ', '') <> ''")
    listed = companies.select(F.col("ticker").alias("found"), F.col(order).alias("__o"), F.upper("ticker").alias("__t"), F.upper(F.replace("name", F.lit(" "), F.lit(""))).alias("__n"))
    exact = names.join(listed, F.col("__f") == F.col("__t")).select("__f", "found", F.lit(0).alias("__r"), "__o")
    bare = F.replace("__f", F.lit(" "), F.lit(""))
    looks = names.select("__f", F.explode(F.array(F.struct(F.lit("t").alias("k"), F.col("__f").alias("w")), F.struct(F.lit("n").alias("k"), bare.alias("w")))).alias("l")).select("__f", "l.k", "l.w", F.substring("l.w", 1, 3).alias("g"))
    pieces = listed.select("found", "__o", F.explode(F.array(F.struct(F.lit("t").alias("k"), F.col("__t").alias("v")), F.struct(F.lit("n").alias("k"), F.col("__n").alias("v")))).alias("l")).select("found", "__o", "l.k", "l.v")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("v"), i, n))))
    pieces = pieces.filter("length(v) > 0").withColumn("g", F.explode(F.array_distinct(grams)))
    inside = looks.join(pieces, ["k", "g"]).filter(F.col("v").contains(F.col("w"))).select("__f", "found", F.lit(1).alias("__r"), "__o")
    best = exact.union(inside).groupBy("__f").agg(F.min_by("found", F.struct("__r", "__o")).alias("found"))
    return df.withColumn("__f", F.upper(folder)).join(best, "__f", "left").drop("__f")


def mark_failed(failed: DataFrame, events: DataFrame) -> DataFrame:
    """REG-04: (url, reason, failed_at) appended; an address may fail several times."""
    return failed.unionByName(events.select(*failed.columns))


def add_urls(known: DataFrame, events: DataFrame) -> DataFrame:
    """REG-03: the list of addresses with those of the events, each once."""
    return known.select("url").union(events.select("url")).distinct()


def register_manual(known: DataFrame, files: DataFrame, companies: DataFrame) -> DataFrame:
    """SRC-24: files (path, folder, stem) not yet known by local_path, as registry rows with the company of their folder."""
    fresh = files.join(known.select(F.col("local_path").alias("path")).filter("path is not null").distinct(), "path", "left_anti")
    found = fuzzy_company(fresh, companies, "folder").withColumn("ticker", F.coalesce("found", F.upper("folder")))
    dim = companies.select("ticker", F.col("name").alias("company_name"), "sector")
    rows = found.join(dim, "ticker", "left")
    low = F.lower(F.replace("stem", F.lit("_"), F.lit(" ")))
    url = F.concat(F.lit("manual://"), "ticker", F.lit("/"), F.element_at(F.split("path", "/"), -1))
    year = F.coalesce(report_year(low, url), F.lit("2023"))
    return rows.select(F.lit("manual").alias("source"), "ticker", url.alias("url"), F.col("stem").alias("title"), doc_type(low).alias("doc_type"), F.coalesce("company_name", "ticker").alias("company_name"), F.coalesce("sector", F.lit("Unknown")).alias("sector"), year.alias("year"), F.col("path").alias("local_path"))


def latest_run(runs: DataFrame, prefer: str | None = None) -> DataFrame:
    """SRC-05, SRC-07: the newest run, one whose name has ``prefer`` before all others."""
    rank = F.struct(F.col("run_id").contains(prefer) if prefer else F.lit(True), "run_id")
    top = runs.agg(F.max(rank).alias("r")).select(F.col("r.run_id").alias("run_id"))
    return runs.join(F.broadcast(top), "run_id", "left_semi")  # one row


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """ANN-06: the latest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def sequence_of(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Position from 0 within a key, for operators that depend on row order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
