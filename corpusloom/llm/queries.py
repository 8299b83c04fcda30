"""The pN_ queries over the tables of the disclosure corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consensus, leakage, packing, personal, sampling, scans, site_lines, splits, splitting, text_form
from ..plans import sqltext as S
from .common import read, run_dir


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(read(spark, d, "annotation_queue", True))[0].select("passage_id", "task", "label")


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(read(spark, d, "annotation_queue", True))[0]


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(read(spark, d, "annotation_queue", True))[1]


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, scans.Repairer]:
    registry = read(spark, d, "collection_registry", True).select(F.lit("collection_registry").alias("src"), F.col("registry_id").alias("rec_id"), "text")
    texts = registry.unionByName(read(spark, d, "documents", True).select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text"))
    names = read(spark, d, "companies").select("name")
    return texts, scans.fit_repairer(texts, names)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.spoilt_lines(*_scanned(spark, d))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_texts(*_scanned(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return text_form.look_alike_pairs(read(spark, d, "documents", True), "doc_id")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose text has several spellings, each with its class and spelling."""
    out = text_form.look_alike_classes(read(spark, d, "documents", True), "doc_id")
    return out.select("doc_id", F.hex("form").alias("class"), F.hex("raw").alias("spelling"))


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return text_form.to_consistent(read(spark, d, "documents", True).select("doc_id", "text"))


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the queue in the consistent form, with the number of stored spellings of each."""
    keys = text_form.form_keys(read(spark, d, "annotation_queue", True), "row_id")
    return keys.groupBy(F.hex("form").alias("form")).agg(F.count("*").alias("n_rows"), F.count_distinct("raw").alias("n_spellings"), F.min("id").alias("first_row"))


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.sample(read(spark, d, "corpus_index"), read(spark, d, "target_shares"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].filter("short").select("sector", "year", "doc_type")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_occurrences(read(spark, d, "documents", True), "doc_id", "ticker", "published_at")


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.remove_site_lines(read(spark, d, "documents", True).select("doc_id", "ticker", "published_at", "text"), "doc_id", "ticker", "published_at").select("doc_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(read(spark, d, "annotation_queue", True), "row_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read(spark, d, "annotation_queue", True), "row_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.misspelt_tickers(_splits(spark, d)[0], "row_id")


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = f"{run_dir(spark)}/splits-{uuid.uuid4().hex}"
    return splits.rows_with_splits(read(spark, d, "annotation_queue"), read(spark, d, "companies"), read(spark, d, "split_shares"), "row_id", path)


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)[0].select("row_id", "passage_id", "listed", "split")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)[2]


def p7_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The queue in two deliveries, the second of which finds the tables the first one left: (row_id, passage_id, delivery, split)."""
    queue, companies, shares = (read(spark, d, t) for t in ("annotation_queue", "companies", "split_shares"))
    path, out = f"{run_dir(spark)}/splits-{uuid.uuid4().hex}", None
    middle = queue.agg(F.avg("row_id")).first()[0] or 0.0
    for k, part in enumerate((F.col("row_id") <= middle, F.col("row_id") > middle)):
        rows = splits.rows_with_splits(queue.filter(part), companies, shares, "row_id", path)[0]
        rows = rows.select("row_id", "passage_id", F.lit(k).alias("delivery"), "split")
        out = rows if out is None else out.union(rows)
    return out


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents", True), "doc_id").filter("n_pieces > 1").select("doc_id").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents", True), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read(spark, d, "documents", True), read(spark, d, "eval_passages"), "doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p9_found(spark, d), read(spark, d, "eval_passages"), "doc_id", "item_id")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaking(read(spark, d, "documents").select("doc_id", "ticker"), p9_found(spark, d), "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(read(spark, d, "documents", True), "doc_id")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(read(spark, d, "documents", True).select("doc_id", "text"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("p") and n[1].isdigit()}

_KEY = lambda x: f"regexp_replace(regexp_replace(lower({S.strip(x)}), '[{S.WS}]*&[{S.WS}]*', ' and ', 'g'), '[{S.WS}_-]+', ' ', 'g')"
_NAME = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\b(?:plc|ltd|limited|incorporated|inc|company|co|nigeria|nig)\\b', ' ', 'g'), ' +', ' ', 'g'))"
SQL: dict[str, str] = {
    "p4_found": f"""WITH k AS (SELECT text_path, nullif({_KEY("sector")}, '') AS s, nullif(regexp_extract(lower({S.strip("year")}), '^(?:fy|f\\.y\\.)?[{S.WS}/_-]*((?:19|20)[0-9][0-9])(?:\\.0+)?$', 1), '') AS y, nullif(regexp_replace(lower({S.strip("doc_type")}), '[{S.WS}_-]+', '_', 'g'), '') AS t FROM corpus_index WHERE text_path IS NOT NULL),
d AS (SELECT text_path, min(s) AS s, min(y) AS y, min(t) AS t FROM k GROUP BY text_path), c AS (SELECT s, y, t, count(*) AS n FROM d GROUP BY ALL), total AS (SELECT 0.3 * count(*) AS n FROM d)
SELECT sector, year, doc_type FROM target_shares x CROSS JOIN total LEFT JOIN c ON c.s = {_KEY("x.sector")} AND c.y = x.year AND c.t = x.doc_type WHERE coalesce(c.n, 0) + 1e-9 < greatest(x.min_count, x.share * total.n)""",
    "p5_found": """WITH l AS (SELECT doc_id, ticker, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE ticker IS NOT NULL),
k AS (SELECT doc_id, ticker, line_no, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS key FROM l), n AS (SELECT ticker, count(*) AS nd FROM documents WHERE ticker IS NOT NULL AND text IS NOT NULL GROUP BY ticker),
r AS (SELECT ticker, key FROM k JOIN n USING (ticker) WHERE key <> '' GROUP BY ticker, key, nd HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) + 1e-9 >= 0.2 * nd) SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN r USING (ticker, key)""",
    "p6_found": f"SELECT DISTINCT row_id FROM annotation_queue WHERE {S.words('text')} > 400",
    "p7_found": f"SELECT a.row_id, c.ticker FROM annotation_queue a JOIN companies c ON {_NAME('a.company')} = {_NAME('c.name')} WHERE a.ticker IS DISTINCT FROM c.ticker",
}
