"""Queries over texts, the registry and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import passages as P
from ..operators import registry as R
from ..operators import validation as V
from ..sources.readers import table
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH c AS (SELECT doc_id, text, {S.clean_chain('text')} AS t FROM documents)
SELECT doc_id, CASE WHEN {S.strip('text')} = '' THEN 'empty' WHEN length(t) < {T.MIN_CHARS} THEN 'too_short' WHEN length(t) > {T.MAX_CHARS} THEN 'truncated' ELSE {S.quality('t')} END AS quality,
  CAST(length(t) AS BIGINT) AS char_count, md5(CASE WHEN length(t) > {T.MAX_CHARS} THEN substring(t, 1, {T.MAX_CHARS}) || chr(10) || '[TRUNCATED]' ELSE t END) AS text_md5 FROM c""")
def section_clean(spark: SparkSession, d: str) -> DataFrame:
    out = T.clean_sections(table(spark, d, "documents", spread=True).select("doc_id", "text"), unicode_form=False)
    return out.select("doc_id", "quality", F.col("char_count").cast("long").alias("char_count"), F.md5("text").alias("text_md5"))


@query()
def section_clean_unicode(spark: SparkSession, d: str) -> DataFrame:
    return T.clean_sections(table(spark, d, "documents", spread=True).select("doc_id", "text"))


@query(f"SELECT doc_id, CAST({S.words('text')} AS BIGINT) AS words, {S.quality('text')} AS quality FROM documents")
def quality_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", spread=True).select("doc_id", T.n_words(F.col("text")).cast("long").alias("words"), T.quality(F.col("text")).alias("quality"))


@query("SELECT registry_id, CASE " + " ".join(f"WHEN regexp_matches(t, {S.q('|'.join(w))}) THEN {S.q(n)}" for n, w in T.DOC_TYPES) + " ELSE 'other' END AS doc_type FROM (SELECT registry_id, lower(concat_ws(' ', title, url)) AS t FROM collection_registry)")
def doc_type_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collection_registry").select("registry_id", T.doc_type(F.concat_ws(" ", "title", "url")).alias("doc_type"))


@query("SELECT registry_id, CASE " + " ".join(f"WHEN contains(t, '{y}') THEN '{y}'" for y in sorted(T.TARGET_YEARS, reverse=True)) + " END AS year FROM (SELECT registry_id, lower(coalesce(title, '') || ' ' || coalesce(url, '')) AS t FROM collection_registry)")
def year_infer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collection_registry").select("registry_id", T.report_year(F.col("title"), F.col("url")).alias("year"))


@query(r"SELECT registry_id, concat_ws('_', ticker, regexp_replace(substring(title, 1, 40), '[^\p{L}\p{N}]', '_', 'g'), substring(md5(url), 1, 8)) AS filename FROM collection_registry")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collection_registry").select("registry_id", T.safe_filename(F.col("ticker"), F.col("title"), F.col("url")).alias("filename"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", T.repair_json(raw, "k int")["k"].alias("k"))


@query()
def narrative_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collection_registry", spread=True).filter("text is not null")
    return rows.select("registry_id", *[T.section(F.col("text"), n).alias(n) for n in T.SECTIONS])


def _passages(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    docs = table(spark, d, "documents", spread=True).select("doc_id", *keep, F.coalesce("ticker", F.lit("NONE")).alias("ticker"), "year", F.lit("outlook").alias("section"), "text", T.quality(F.col("text")).alias("quality"))
    return P.extract_passages(docs, keep)


_SENT = f"string_split(regexp_replace(p, '([.!?])[{S.WS}]+', '\\1' || chr(1), 'g'), chr(1))"
_PASSAGES = f"""RECURSIVE base AS (SELECT doc_id, coalesce(ticker, 'NONE') AS ticker, year, text FROM documents WHERE {S.quality('text')} IN ('good', 'acceptable')),
lines AS (SELECT doc_id, ticker, year, list_filter(list_transform(string_split(text, chr(10)), lambda l: {S.strip('l')}), lambda l: length(l) > {P.MIN_PARAGRAPH_CHARS}) AS ls FROM base),
paras AS (SELECT doc_id, ticker, year, unnest(ls) AS p0, unnest(range(len(ls))) AS i FROM lines),
nexts AS (SELECT *, lead(p0) OVER (PARTITION BY doc_id ORDER BY i) AS nx, {S.words('p0')} AS n FROM paras),
kept AS (SELECT doc_id, ticker, year, i, CASE WHEN n < {P.SHORT_WORDS} AND nx IS NOT NULL THEN p0 || chr(10) || chr(10) || nx ELSE p0 END AS p FROM nexts WHERE n >= {P.MIN_WORDS}),
sents AS (SELECT doc_id, i, unnest({_SENT}) AS s, unnest(range(len({_SENT}))) AS k FROM kept WHERE {S.words('p')} > {P.LONG_WORDS}),
walk AS (SELECT doc_id, i, k, s, 0 AS j, {S.words('s')} AS cum FROM sents WHERE k = 0 UNION ALL
  SELECT s.doc_id, s.i, s.k, s.s, CASE WHEN w.cum >= {P.PACK_WORDS} THEN w.j + 1 ELSE w.j END, CASE WHEN w.cum >= {P.PACK_WORDS} THEN {S.words('s.s')} ELSE w.cum + {S.words('s.s')} END FROM walk w JOIN sents s ON s.doc_id = w.doc_id AND s.i = w.i AND s.k = w.k + 1),
chunks AS (SELECT doc_id, i, j, string_agg(s, ' ' ORDER BY k) AS text FROM walk WHERE s <> '' GROUP BY doc_id, i, j UNION ALL SELECT doc_id, i, 0, p FROM kept WHERE {S.words('p')} <= {P.LONG_WORDS}),
passages AS (SELECT c.doc_id, k.ticker, k.year, c.i, c.j, c.text, {S.words('c.text')} AS wc, len(list_filter(regexp_extract_all(c.text, '[^{S.WS}]+'), lambda w: regexp_matches(w, '\\p{{Nd}}'))) AS num FROM chunks c JOIN kept k ON k.doc_id = c.doc_id AND k.i = c.i)"""


@query(f"WITH {_PASSAGES} SELECT doc_id, ticker || '_' || coalesce(year, 'None') || '_outlook_' || i || '_' || j AS passage_id, CAST(wc AS BIGINT) AS word_count, {S.quality('text')} AS quality, md5(text) AS text_md5 FROM passages WHERE wc >= {P.MIN_WORDS} AND num / wc <= {P.MAX_NUMERIC}")
def passage_explode(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select("doc_id", "passage_id", F.col("word_count").cast("long").alias("word_count"), "quality", F.md5("text").alias("text_md5"))


@query(f"WITH {_PASSAGES}, ok AS (SELECT doc_id, {S.quality('text')} AS quality FROM passages WHERE wc >= {P.MIN_WORDS} AND num / wc <= {P.MAX_NUMERIC}) SELECT d.source, count(*) AS n, count(*) FILTER (quality = 'good') AS good, count(*) FILTER (quality = 'acceptable') AS acceptable, count(*) FILTER (quality = 'poor') AS poor FROM ok JOIN documents d USING (doc_id) GROUP BY d.source")
def passage_quality(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d, ("source",)).groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col("quality") == k).alias(k) for k in ("good", "acceptable", "poor")])


@query("""SELECT registry_id, url AS href, regexp_replace(coalesce(title, ''), '^ +| +$', '', 'g') AS label FROM collection_registry""")
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<div><a class="x" href="'), F.col("url"), F.lit('"><b>'), F.coalesce("title", F.lit("")), F.lit("</b></a></div>"))
    return table(spark, d, "collection_registry").select("registry_id", F.inline(T.links(html)))


@query("SELECT registry_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY registry_id) AS rn FROM collection_registry) WHERE rn = 1")
def registry_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.first_by_key(table(spark, d, "collection_registry").select("registry_id", "url", "title"), "url", "registry_id").select("registry_id", "url")


@query("SELECT registry_id, url FROM collection_registry r WHERE doc_type <> 'other' AND NOT EXISTS (SELECT 1 FROM collection_registry x WHERE x.url = r.url AND (x.downloaded_at IS NOT NULL OR x.extraction_stats.extraction_status = 'failed'))")
def download_queue(spark: SparkSession, d: str) -> DataFrame:
    return R.download_queue(table(spark, d, "collection_registry")).select("registry_id", "url")


@query("SELECT registry_id, url FROM collection_registry r WHERE downloaded_at IS NOT NULL AND local_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM collection_registry x WHERE x.url = r.url AND x.text_path IS NOT NULL)")
def extraction_queue(spark: SparkSession, d: str) -> DataFrame:
    return R.extraction_queue(table(spark, d, "collection_registry")).select("registry_id", "url")


@query("SELECT registry_id, ticker, company_name AS company, sector, year, doc_type, source, local_path AS pdf_path, text_path, extraction_stats.page_count AS page_count, extraction_stats.full_text_chars AS full_text_chars, extraction_stats.chairman_chars AS chairman_chars, extraction_stats.ceo_chars AS ceo_chars, extraction_stats.operating_chars AS operating_chars, extraction_stats.outlook_chars AS outlook_chars, extraction_stats.extraction_status AS extraction_status FROM collection_registry WHERE extraction_stats IS NOT NULL AND text_path IS NOT NULL")
def corpus_index_build(spark: SparkSession, d: str) -> DataFrame:
    return R.build_index(table(spark, d, "collection_registry"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM collection_registry WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("sector", "doc_type", "year")))
def registry_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.grouped_counts(table(spark, d, "collection_registry"), ["sector", "doc_type", "year"])


@query("SELECT count(*) AS discovered, count(downloaded_at) AS downloaded, count(text_path) AS extracted, count(*) FILTER (extraction_stats.extraction_status = 'failed') AS failed FROM collection_registry")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(table(spark, d, "collection_registry"))


@query("""WITH f AS (SELECT registry_id, upper(CASE WHEN registry_id % 3 = 0 THEN ticker ELSE split_part(company_name, ' ', 1) || CASE WHEN registry_id % 3 = 1 THEN ' ' || split_part(company_name, ' ', 2) ELSE '' END END) AS folder FROM collection_registry)
SELECT registry_id, (SELECT c.ticker FROM companies c WHERE c.ticker = f.folder OR ((contains(upper(c.ticker), f.folder) OR contains(replace(upper(c.name), ' ', ''), replace(f.folder, ' ', ''))) AND replace(f.folder, ' ', '') <> '') ORDER BY c.ticker <> f.folder, c.ticker LIMIT 1) AS found FROM f""")
def fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    word = lambda k: F.split_part("company_name", F.lit(" "), F.lit(k))
    folder = F.when(F.col("registry_id") % 3 == 0, F.col("ticker")).otherwise(F.concat(word(1), F.when(F.col("registry_id") % 3 == 1, F.concat(F.lit(" "), word(2))).otherwise("")))
    return R.fuzzy_company(table(spark, d, "collection_registry").select("registry_id", folder.alias("folder")), table(spark, d, "companies"), "folder").select("registry_id", "found")


@query("WITH p AS (SELECT registry_id, ticker, source, CASE source WHEN 'exchange_portal' THEN 0 WHEN 'company_ir' THEN 1 WHEN 'news_wire' THEN 2 ELSE 3 END AS r FROM collection_registry WHERE ticker IS NOT NULL) SELECT registry_id, ticker, source FROM p WHERE r = (SELECT min(r) FROM p x WHERE x.ticker = p.ticker)")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collection_registry").filter("ticker is not null").select("registry_id", "ticker", "source")
    return R.by_priority(rows, "ticker", "source", ["exchange_portal", "company_ir", "news_wire"]).select("registry_id", "ticker", "source")


@query("SELECT registry_id, r.ticker, coalesce(c.name, '') AS name, c.sector AS dim_sector FROM collection_registry r LEFT JOIN companies c ON r.ticker = c.ticker")
def discovery_enrich(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "collection_registry").select("registry_id", "ticker", "source")
    parts = [reg.filter(F.col("source") == s) for s in ("company_ir", "exchange_portal", "news_wire", "manual")] + [reg.filter("source is null or source not in ('company_ir', 'exchange_portal', 'news_wire', 'manual')")]
    return R.discover(parts, table(spark, d, "companies")).select("registry_id", "ticker", F.coalesce("company_name", F.lit("")).alias("name"), F.col("sector").alias("dim_sector"))


@query(f"SELECT count(*) AS n_docs, count(DISTINCT ticker) AS n_ticker, count(DISTINCT sector) AS n_sector, count(DISTINCT year) AS n_year, count(DISTINCT ticker) >= {V.MIN_TICKERS} AND count(DISTINCT sector) >= {V.MIN_SECTORS} AND count(DISTINCT year) >= {V.MIN_YEARS} AS coverage_ok FROM corpus_index")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return V.coverage(table(spark, d, "corpus_index"))


@query(f"SELECT sector, count(*) AS n, count(*) >= {V.MIN_PER_SECTOR} AS sector_ok FROM corpus_index WHERE sector IS NOT NULL GROUP BY sector")
def docs_per_sector(spark: SparkSession, d: str) -> DataFrame:
    return V.per_sector(table(spark, d, "corpus_index"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM corpus_index WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("year", "doc_type", "source")))
def docs_per_group(spark: SparkSession, d: str) -> DataFrame:
    return R.grouped_counts(table(spark, d, "corpus_index"), ["year", "doc_type", "source"])


@query("SELECT count(*) AS n, count(*) FILTER (quality = 'good') AS good, count(*) FILTER (quality = 'acceptable') AS acceptable, count(*) FILTER (quality = 'poor') AS poor, count(*) FILTER (annotation_status = 'done') AS annotated, round(count(*) FILTER (quality IN ('good', 'acceptable')) / count(*), 6) AS quality_ratio, round(count(*) FILTER (annotation_status = 'done') / count(*) * 100, 6) AS progress FROM annotation_queue")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.passage_quality(table(spark, d, "annotation_queue"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM annotation_queue WHERE {c} IS NOT NULL AND passage_id IS NOT NULL GROUP BY {c}" for c in ("section", "sector")))
def passages_per_group(spark: SparkSession, d: str) -> DataFrame:
    return R.grouped_counts(table(spark, d, "annotation_queue").filter("passage_id is not null"), ["section", "sector"])


@query("SELECT round(avg(word_count), 6) AS mean_words, round(median(word_count), 6) AS median_words FROM annotation_queue")
def word_count_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.word_counts(table(spark, d, "annotation_queue"))


@query(
    f"SELECT 'missing_sector' AS kind, v AS value FROM (SELECT unnest({list(V.REQUIRED_SECTORS)}) AS v) WHERE v NOT IN (SELECT sector FROM corpus_index WHERE sector IS NOT NULL)"
    f" UNION ALL SELECT 'missing_year', v FROM (SELECT unnest({list(V.REQUIRED_YEARS)}) AS v) WHERE v NOT IN (SELECT year FROM corpus_index WHERE year IS NOT NULL)"
    f" UNION ALL SELECT 'low_sector', sector FROM corpus_index WHERE sector IS NOT NULL GROUP BY sector HAVING count(*) < {V.MIN_PER_SECTOR}"
    f" UNION ALL SELECT 'single_document_companies', CAST(count(*) AS VARCHAR) FROM (SELECT ticker FROM corpus_index WHERE ticker IS NOT NULL GROUP BY ticker HAVING count(*) = 1) HAVING count(*) > {V.MIN_SINGLE}"
)
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return V.gaps(table(spark, d, "corpus_index"))
