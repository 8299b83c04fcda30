"""Queries over the annotation queue: progress, agreement, scores and error tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import annotation as N
from ..operators import metrics as M
from ..operators import registry as R
from ..operators import scoring as C
from ..operators import sentiment as E
from ..operators import taxonomy as X
from ..operators.passages import preserve_annotations as preserve
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


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotation_queue")


_RANK = "CASE quality WHEN 'good' THEN 0 WHEN 'acceptable' THEN 1 WHEN 'poor' THEN 2 ELSE 9 END, CASE section WHEN 'outlook' THEN 0 WHEN 'chairman_statement' THEN 1 WHEN 'ceo_review' THEN 2 WHEN 'operating_review' THEN 3 ELSE 9 END, row_id"
_PENDING = "(annotation_status = 'pending' OR annotator IS NULL OR annotator = '')"


@query(f"SELECT row_id, passage_id, quality, section FROM annotation_queue WHERE {_PENDING} ORDER BY {_RANK} LIMIT 20")
def priority_topk(spark: SparkSession, d: str) -> DataFrame:
    return N.next_batch(_queue(spark, d)).select("row_id", "passage_id", "quality", "section")


@query("SELECT passage_id, annotator, row_id FROM (SELECT *, row_number() OVER (PARTITION BY passage_id, annotator ORDER BY annotated_at DESC, row_id DESC) AS rn FROM annotation_queue WHERE annotated_at IS NOT NULL AND annotator IS NOT NULL) WHERE rn = 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = _queue(spark, d).filter("annotated_at is not null and annotator is not null").select("passage_id", "annotator", "annotated_at", "row_id")
    return R.last_by_key(rows, ["passage_id", "annotator"], ["annotated_at", "row_id"]).select("passage_id", "annotator", "row_id")


@query("SELECT row_id, " + ", ".join(f"{S.full_label(c)} AS {c}" for c in ("sentiment_label", "guidance_type", "sentiment_intensity")) + " FROM annotation_queue")
def label_repair(spark: SparkSession, d: str) -> DataFrame:
    return N.repair_labels(_queue(spark, d).select("row_id", "sentiment_label", "guidance_type", "sentiment_intensity"), ["sentiment_label", "guidance_type", "sentiment_intensity"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM annotation_queue WHERE annotation_status = 'done' AND {c} IS NOT NULL GROUP BY {c}" for c in ("sentiment_label", "has_guidance", "annotator", "sector")))
def annotation_progress(spark: SparkSession, d: str) -> DataFrame:
    return N.progress(_queue(spark, d), ["sentiment_label", "has_guidance", "annotator", "sector"])


@query("SELECT " + ", ".join(c if c != "text" else "md5(text) AS text" for c in N.GOLD_COLUMNS) + " FROM annotation_queue WHERE annotation_status = 'done'")
def gold_export(spark: SparkSession, d: str) -> DataFrame:
    return N.gold_rows(_queue(spark, d)).withColumn("text", F.md5("text"))


@query(f"SELECT row_id FROM annotation_queue WHERE quality IN ('good', 'acceptable') AND (annotation_status IN ('pending', 'ai_annotated') OR annotator IS NULL OR annotator = '')")
def web_pending(spark: SparkSession, d: str) -> DataFrame:
    return N.web_pending(_queue(spark, d)).select("row_id")


@query("SELECT sector, count(*) FILTER (annotation_status = 'done') AS done, count(*) FILTER (quality IN ('good', 'acceptable')) AS annotatable, CAST(CASE WHEN count(*) FILTER (quality IN ('good', 'acceptable')) > 0 THEN floor(count(*) FILTER (annotation_status = 'done') * 100 / count(*) FILTER (quality IN ('good', 'acceptable'))) ELSE 0 END AS BIGINT) AS percent FROM annotation_queue WHERE sector IS NOT NULL GROUP BY sector")
def sector_progress(spark: SparkSession, d: str) -> DataFrame:
    return N.sector_progress(_queue(spark, d))


@query(f"SELECT round(avg(CASE WHEN coalesce({S.full_label('sentiment_label')}, '') = 'positive' THEN 1 ELSE 0 END) * 100, 6) AS positivity, round(avg(CASE WHEN lower(has_guidance) = 'true' THEN 1 WHEN has_guidance IS NULL THEN NULL ELSE 0 END) * 100, 6) AS guidance FROM annotation_queue WHERE annotation_status = 'done'")
def dashboard_rates(spark: SparkSession, d: str) -> DataFrame:
    return N.dashboard_rates(_queue(spark, d))


@query("SELECT sector, sentiment_label, count(*) AS n FROM annotation_queue WHERE annotation_status = 'done' AND sector IS NOT NULL AND sentiment_label IS NOT NULL GROUP BY ALL")
def sector_by_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return N.crosstab(_queue(spark, d), "sector", "sentiment_label")


@query("SELECT row_id, guidance_span FROM annotation_queue WHERE annotation_status = 'done' AND guidance_span IS NOT NULL AND lower(has_guidance) = 'true' ORDER BY row_id LIMIT 10")
def first_guidance(spark: SparkSession, d: str) -> DataFrame:
    return N.first_guidance(_queue(spark, d)).select("row_id", "guidance_span")


@query("SELECT row_id, coalesce(c.sector, a.sector) AS sector FROM annotation_queue a LEFT JOIN companies c USING (ticker)")
def sector_fix(spark: SparkSession, d: str) -> DataFrame:
    return N.set_sector(_queue(spark, d).select("row_id", "ticker", "sector"), table(spark, d, "companies")).select("row_id", "sector")


@query("SELECT DISTINCT ticker FROM annotation_queue WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker FROM companies)")
def unmapped_tickers(spark: SparkSession, d: str) -> DataFrame:
    return N.unmapped_tickers(_queue(spark, d), table(spark, d, "companies"))


@query("""WITH n AS (SELECT passage_id, ticker, sentiment_label, annotation_status FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY row_id) rn FROM annotation_queue) WHERE rn = 1),
o AS (SELECT passage_id, sentiment_label, annotation_status FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY row_id DESC) rn FROM annotation_queue WHERE annotation_status IS DISTINCT FROM 'pending') WHERE rn = 1)
SELECT n.passage_id, n.ticker, coalesce(o.sentiment_label, n.sentiment_label) AS sentiment_label, coalesce(o.annotation_status, n.annotation_status) AS annotation_status FROM n LEFT JOIN o USING (passage_id)""")
def preserve_annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = _queue(spark, d).select("row_id", "passage_id", "ticker", "sentiment_label", "annotation_status")
    return preserve(rows, rows, "passage_id", ["sentiment_label", "annotation_status"], "row_id").select("passage_id", "ticker", "sentiment_label", "annotation_status")


# --- agreement ---


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return A.votes(_queue(spark, d))


@query(f"WITH {S.VOTES} SELECT task, annotator, count(*) AS n FROM votes GROUP BY task, annotator")
def agreement_views(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d).groupBy("task", "annotator").agg(F.count("*").alias("n"))


@query(f"WITH {S.VOTES}, k AS (SELECT task, count(DISTINCT annotator) AS k FROM votes GROUP BY task), f AS (SELECT task, item FROM votes JOIN k USING (task) GROUP BY task, item, k HAVING count(DISTINCT annotator) = k) SELECT v.task, v.item, v.annotator, v.label FROM votes v JOIN f USING (task, item)")
def common_items(spark: SparkSession, d: str) -> DataFrame:
    return A.common_items(_votes(spark, d))


@query(f"""WITH {S.VOTES}, cell AS (SELECT task, item, label, count(*) AS n FROM votes GROUP BY ALL), it AS (SELECT task, item, sum(n) AS n, sum(n * n) AS n2 FROM cell GROUP BY ALL HAVING sum(n) > 1),
m AS (SELECT task, count(*) AS n_items, avg((n2 - n) / (n * (n - 1))) AS po, sum(n) AS total FROM it GROUP BY task),
s AS (SELECT task, label, sum(c.n) AS m FROM cell c SEMI JOIN it USING (task, item) GROUP BY ALL), pe AS (SELECT s.task, sum((s.m / m.total) * (s.m / m.total)) AS pe FROM s JOIN m USING (task) GROUP BY s.task)
SELECT task, n_items, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM m JOIN pe USING (task)""")
def fleiss(spark: SparkSession, d: str) -> DataFrame:
    return A.fleiss(_votes(spark, d))


_RANKS = {"negative": 0, "neutral": 1, "positive": 2, "conditional": 3, "none": 4}


def _kripp(dist: str) -> str:
    rank = lambda c: f"CASE {c} " + " ".join(f"WHEN '{l}' THEN {r}" for l, r in _RANKS.items()) + " END"
    gap = f"abs(({rank('v')}) - ({rank('w')}))"
    dd = {"nominal": "CASE WHEN v = w THEN 0.0 ELSE 1.0 END", "ordinal": gap, "interval": f"{gap} * {gap}"}[dist]
    return f"""WITH {S.VOTES}, c0 AS (SELECT task, item, label, count(*) AS n FROM votes GROUP BY ALL), cell AS (SELECT c0.*, sum(n) OVER (PARTITION BY task, item) AS m FROM c0),
ok AS (SELECT * FROM cell WHERE m > 1), o AS (SELECT a.task, a.label AS v, b.label AS w, sum(CASE WHEN a.label = b.label THEN a.n * (a.n - 1) ELSE a.n * b.n END) AS o FROM ok a JOIN ok b ON a.task = b.task AND a.item = b.item GROUP BY ALL),
mg AS (SELECT task, v, sum(o) AS c FROM o GROUP BY ALL), n AS (SELECT task, sum(c) AS n FROM mg GROUP BY task), x AS (SELECT task, sum(o * ({dd})) AS x FROM o GROUP BY task),
e AS (SELECT task, sum(c * c2 * ({dd})) AS e FROM (SELECT a.task, a.v, b.v AS w, CAST(a.c AS DOUBLE) AS c, CAST(b.c AS DOUBLE) AS c2 FROM mg a JOIN mg b USING (task)) GROUP BY task)
SELECT task, round(CASE WHEN e = 0 THEN 1.0 ELSE 1 - (x / n) / (e / (CAST(n AS DOUBLE) * (n - 1))) END, 6) AS alpha FROM x JOIN e USING (task) JOIN n USING (task)"""


@query(_kripp("nominal"))
def krippendorff_nominal(spark: SparkSession, d: str) -> DataFrame:
    return A.krippendorff(_votes(spark, d), "nominal", _RANKS)


@query(_kripp("ordinal"))
def krippendorff_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return A.krippendorff(_votes(spark, d), "ordinal", _RANKS)


@query(_kripp("interval"))
def krippendorff_interval(spark: SparkSession, d: str) -> DataFrame:
    return A.krippendorff(_votes(spark, d), "interval", _RANKS)


_PAIRS = f"""WITH {S.VOTES}, cell AS (SELECT x.task, x.annotator AS a, y.annotator AS b, x.label AS la, y.label AS lb, count(*) AS n FROM votes x JOIN votes y ON x.task = y.task AND x.item = y.item AND x.annotator < y.annotator GROUP BY ALL),
t AS (SELECT task, a, b, sum(n) AS n, sum(CASE WHEN la = lb THEN n ELSE 0 END) AS same FROM cell GROUP BY ALL HAVING sum(n) >= 5),
ma AS (SELECT task, a, b, la AS l, sum(n) AS ma FROM cell GROUP BY ALL), mb AS (SELECT task, a, b, lb AS l, sum(n) AS mb FROM cell GROUP BY ALL),
ch AS (SELECT task, a, b, sum(ma * mb) AS s FROM ma JOIN mb USING (task, a, b, l) GROUP BY ALL),
k AS (SELECT task, a, b, CAST(n AS BIGINT) AS n, same / n AS po, coalesce(s, 0) / (n * n) AS pe FROM t LEFT JOIN ch USING (task, a, b)),
p AS (SELECT task, a, b, n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k)"""


@query(f"{_PAIRS} SELECT * FROM p")
def pairwise_kappa(spark: SparkSession, d: str) -> DataFrame:
    return A.pairwise_kappa(_votes(spark, d))


@query(f"{_PAIRS}, m AS (SELECT task, count(*) AS n_pairs, round(avg(kappa), 5) AS mean_kappa, round(avg(agreement), 5) AS mean_agreement FROM p GROUP BY task) SELECT *, CASE " + " ".join(f"WHEN mean_kappa >= {a} THEN '{b}'" for a, b in A.BANDS) + " ELSE 'Poor' END AS band FROM m")
def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.pairwise_summary(_votes(spark, d))


@query(f"WITH {S.VOTES} SELECT item, count(*) AS n_votes, count(DISTINCT label) AS n_labels, string_agg(annotator || '=' || label, '|' ORDER BY annotator || '=' || label) AS votes FROM votes WHERE task = 'sentiment' GROUP BY item HAVING count(*) >= 2 AND count(DISTINCT label) > 1")
def adjudication(spark: SparkSession, d: str) -> DataFrame:
    return A.adjudication(_votes(spark, d))


# --- scores: gold is the majority of an item's votes, each annotator is a model ---


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d)
    cell = v.groupBy("task", "item", "label").agg(F.count("*").alias("n"))
    gold = cell.groupBy("task", "item").agg(F.max_by("label", F.struct("n", "label")).alias("gold"))
    return v.join(gold, ["task", "item"]).select("task", "item", F.col("annotator").alias("model"), "gold", F.col("label").alias("pred"))


_GOLD = f"""{S.VOTES}, cell AS (SELECT task, item, label, count(*) AS n FROM votes GROUP BY ALL), g AS (SELECT task, item, label AS gold FROM (SELECT *, row_number() OVER (PARTITION BY task, item ORDER BY n DESC, label DESC) AS rn FROM cell) WHERE rn = 1),
pairs AS (SELECT v.task, v.item, v.annotator AS model, g.gold, v.label AS pred FROM votes v JOIN g USING (task, item))"""
_ITEM = "it AS (SELECT passage_id AS item, ticker, sector, year, section, doc_type, word_count, text FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY row_id) AS rn FROM annotation_queue) WHERE rn = 1)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    cols = ["row_id", "ticker", "sector", "year", "section", "doc_type", "word_count", "text"]
    return R.first_by_key(table(spark, d, "annotation_queue", spread=True).select("passage_id", *cols), "passage_id", "row_id").withColumnRenamed("passage_id", "item").drop("row_id")


@query(f"WITH {_GOLD} SELECT model, gold, " + ", ".join(f"CAST(count(*) FILTER (pred = '{l}') AS BIGINT) AS pred_{l}" for l in N.SENTIMENTS) + " FROM pairs WHERE task = 'sentiment' GROUP BY model, gold")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    t = M.contingency(_pairs(spark, d).filter("task = 'sentiment'"), ["model"], N.SENTIMENTS)
    return M.confusion(t, ["model"], N.SENTIMENTS)


def _report_sql(task: str, labels: tuple[str, ...] | None) -> str:
    spine = f"sp AS (SELECT DISTINCT model, l AS label FROM pairs, (SELECT unnest({list(labels)}) AS l) WHERE task = '{task}')" if labels else f"sp AS (SELECT DISTINCT model, gold AS label FROM pairs WHERE task = '{task}' UNION SELECT DISTINCT model, pred FROM pairs WHERE task = '{task}')"
    return f"""WITH {_GOLD}, {spine}, c AS (SELECT sp.model, sp.label, count(*) FILTER (p.gold = sp.label) AS support, count(*) FILTER (p.pred = sp.label) AS predicted, count(*) FILTER (p.pred = sp.label AND p.gold = sp.label) AS tp FROM sp JOIN pairs p ON p.model = sp.model AND p.task = '{task}' GROUP BY ALL),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr),
m AS (SELECT model, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall FROM f GROUP BY model),
t AS (SELECT model, count(*) AS n, round(count(*) FILTER (gold = pred) / count(*), 6) AS accuracy FROM pairs WHERE task = '{task}' GROUP BY model)
SELECT model, n, accuracy, macro_f1, weighted_f1, macro_precision, macro_recall FROM t JOIN m USING (model)"""


@query(_report_sql("sentiment", N.SENTIMENTS))
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return M.report(M.contingency(_pairs(spark, d).filter("task = 'sentiment'"), ["model"], N.SENTIMENTS), ["model"], N.SENTIMENTS)


@query(_report_sql("guidance", None))
def guidance_type_report(spark: SparkSession, d: str) -> DataFrame:
    return M.report(M.contingency(_pairs(spark, d).filter("task = 'guidance'"), ["model"]), ["model"], None)


@query(f"""WITH {_GOLD}, c AS (SELECT model, gold, pred, count(*) AS n FROM pairs WHERE task = 'sentiment' GROUP BY ALL), t AS (SELECT model, sum(n) AS n, sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS k FROM c GROUP BY model),
a AS (SELECT model, gold AS l, sum(n) AS g FROM c GROUP BY ALL), b AS (SELECT model, pred AS l, sum(n) AS p FROM c GROUP BY ALL), ch AS (SELECT model, sum(g * p) AS s FROM a JOIN b USING (model, l) GROUP BY model)
SELECT model, CAST(n AS BIGINT) AS n, round(CASE WHEN coalesce(s, 0) / (n * n) = 1 THEN 1.0 ELSE (k / n - coalesce(s, 0) / (n * n)) / (1 - coalesce(s, 0) / (n * n)) END, 6) AS kappa FROM t LEFT JOIN ch USING (model)""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return M.cohen(M.contingency(_pairs(spark, d).filter("task = 'sentiment'"), ["model"], N.SENTIMENTS), ["model"])


@query(f"""WITH {_GOLD}, b AS (SELECT model, gold <> 'none' AS g, pred <> 'none' AS p FROM pairs WHERE task = 'guidance'), c AS (SELECT model, count(*) AS n, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM b GROUP BY model)
SELECT model, n, round((n - fp - fn) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1, round((tp + fn) / n, 6) AS prevalence FROM c""")
def guidance_binary(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).filter("task = 'guidance'").select("model", (F.col("gold") != "none").alias("gold"), (F.col("pred") != "none").alias("pred"))
    return M.binary(rows, ["model"])


@query(f"WITH {_GOLD}, {_ITEM}, j AS (SELECT p.gold = p.pred AS ok, it.* FROM pairs p JOIN it USING (item) WHERE task = 'sentiment') " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy FROM j WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("sector", "year", "section")))
def accuracy_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).filter("task = 'sentiment'").join(_items(spark, d), "item")
    return M.accuracy_by(rows, ["sector", "year", "section"])


@query(f"WITH {_GOLD}, {_ITEM}, j AS (SELECT p.gold = p.pred AS ok, it.word_count AS x FROM pairs p JOIN it USING (item) WHERE task = 'sentiment' AND it.word_count IS NOT NULL), e AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM j) SELECT CASE WHEN x <= q[1] THEN 1 WHEN x <= q[2] THEN 2 WHEN x <= q[3] THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy FROM j, e GROUP BY bin")
def accuracy_by_quartile(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).filter("task = 'sentiment'").join(_items(spark, d), "item")
    return M.accuracy_by_quartile(rows, "word_count")


@query(f"WITH {_GOLD} SELECT gold, pred, count(*) AS n FROM pairs WHERE task = 'guidance' AND gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10")
def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    return M.top_confusions(M.contingency(_pairs(spark, d).filter("task = 'guidance'"), ["model"]))


# --- error tags ---


def _rows(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    g = p.filter("task = 'guidance'").select("item", "model", F.col("gold").alias("gold_type"), F.col("pred").alias("pred_type"), (F.col("gold") != "none").alias("gold_guidance"), (F.col("pred") != "none").alias("pred_guidance"))
    return p.filter("task = 'sentiment'").select("item", "model", "gold", "pred").join(g, ["item", "model"], "left").join(_items(spark, d), "item")


def _sum(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(t, {S.q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


_FWD = f"{_sum(X.FORWARD)} >= 1"
_JARGON = " OR ".join(f"(sector = {S.q(s)} AND {_sum(w)} >= 2)" for s, w in X.JARGON.items())
_TAGS = f"""{_GOLD}, {_ITEM}, gd AS (SELECT item, model, gold AS gold_type, pred AS pred_type, gold <> 'none' AS gold_guidance, pred <> 'none' AS pred_guidance FROM pairs WHERE task = 'guidance'),
r0 AS (SELECT p.item, p.model, p.gold, p.pred, gd.gold_type, gd.pred_type, gd.gold_guidance, gd.pred_guidance, it.sector, it.doc_type, it.word_count, lower(coalesce(it.text, '')) AS t FROM pairs p LEFT JOIN gd USING (item, model) JOIN it USING (item) WHERE p.task = 'sentiment'),
r1 AS (SELECT *, coalesce(gold_guidance, false) AS gg, coalesce(pred_guidance, false) AS pg, {_sum(X.FX)} >= 2 AND gold = 'positive' AND pred IN ('negative', 'neutral') AS a3, {_sum(X.REGULATORY)} >= 2 AND gold = 'neutral' AND pred <> 'neutral' AS a4, {_sum(X.FORMAL)} >= 1 AND gold = 'positive' AND pred = 'neutral' AS a2 FROM r0),
r2 AS (SELECT *, list_sort(list_filter([CASE WHEN a3 THEN 'A3' END, CASE WHEN a4 THEN 'A4' END, CASE WHEN a2 THEN 'A2' END, CASE WHEN {_sum(X.LOCAL)} >= 3 AND NOT (a3 OR a4 OR a2) THEN 'A1' END, CASE WHEN {_JARGON} THEN 'B1' END, CASE WHEN {_sum(X.MACRO)} >= 1 THEN 'B2' END,
  CASE WHEN {_FWD} AND gg AND NOT pg THEN 'B3' END, CASE WHEN {_sum(X.CONDITIONAL)} >= 1 AND gold_type = 'conditional' AND pred_type IN ('positive', 'negative') THEN 'B4' END, CASE WHEN pred = 'neutral' AND gold IN ('positive', 'negative') THEN 'C2' END,
  CASE WHEN pred = 'positive' AND gold IN ('negative', 'neutral') THEN 'C3' END, CASE WHEN pg AND NOT gg AND {_FWD} THEN 'C4' END], lambda x: x IS NOT NULL)) AS found FROM r1),
tagged AS (SELECT item, model, gold, pred, sector, doc_type, word_count, gold_guidance, pred_guidance, gold <> pred AS is_sentiment_error, coalesce(gold_guidance <> pred_guidance, false) AS is_guidance_error, CASE WHEN gold = pred THEN [] WHEN len(found) = 0 THEN ['UNK'] ELSE found END AS tag_list FROM r2)"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return X.tag_errors(_rows(spark, d))


@query(f"WITH {_TAGS} SELECT item, model, is_sentiment_error, is_guidance_error, is_sentiment_error OR is_guidance_error AS is_any_error, array_to_string(tag_list, '|') AS tags, CAST(len(tag_list) AS INTEGER) AS n_tags FROM tagged")
def error_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("item", "model", "is_sentiment_error", "is_guidance_error", "is_any_error", "tags", "n_tags")


@query(f"WITH {_TAGS}, w AS (SELECT count(*) FILTER (is_sentiment_error) AS w FROM tagged) SELECT code, count(*) AS n, round(count(*) / any_value(w), 6) AS rate FROM (SELECT unnest(tag_list) AS code FROM tagged), w GROUP BY code")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.tag_counts(_tagged(spark, d))


@query(f"WITH {_TAGS} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, CAST(count(*) FILTER (is_sentiment_error) AS BIGINT) AS errors, round(avg(CASE WHEN is_sentiment_error THEN 1 ELSE 0 END), 6) AS rate FROM tagged WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("model", "sector", "doc_type")))
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    return X.error_rates(_tagged(spark, d), ["model", "sector", "doc_type"])


@query(f"WITH {_GOLD} SELECT item, count(DISTINCT model) AS n_models, count(DISTINCT pred) AS n_labels FROM pairs WHERE task = 'sentiment' GROUP BY item HAVING count(DISTINCT pred) > 1")
def disagreement(spark: SparkSession, d: str) -> DataFrame:
    return X.disagreement(_pairs(spark, d).filter("task = 'sentiment'"))


@query(f"WITH {_GOLD}, k AS (SELECT item, count(DISTINCT pred) AS k FROM pairs WHERE task = 'sentiment' GROUP BY item) SELECT count(*) AS n_items, round(avg(CASE WHEN k > 1 THEN 1 ELSE 0 END), 6) AS rate FROM k")
def disagreement_rate(spark: SparkSession, d: str) -> DataFrame:
    return X.disagreement_rate(_pairs(spark, d).filter("task = 'sentiment'"))


@query(f"WITH {_TAGS}, e AS (SELECT item, model, gold, pred, len(tag_list) AS nt, unnest(tag_list) AS code FROM tagged WHERE word_count >= 60), s AS (SELECT *, count(*) FILTER (nt = 1) OVER (PARTITION BY code) AS singles FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY item, model) AS rank FROM s WHERE singles < 3 OR nt = 1) SELECT code, CAST(rank AS INTEGER) AS rank, item, model, gold, pred FROM r WHERE rank <= 3")
def qualitative_topn(spark: SparkSession, d: str) -> DataFrame:
    return X.examples(_tagged(spark, d))


@query(f"WITH {_TAGS} SELECT count(*) AS n, count(*) FILTER (NOT gold_guidance AND pred_guidance) AS false_positive, count(*) FILTER (gold_guidance AND NOT pred_guidance) AS false_negative FROM tagged WHERE gold_guidance IS NOT NULL AND pred_guidance IS NOT NULL")
def guidance_errors(spark: SparkSession, d: str) -> DataFrame:
    return X.guidance_errors(_rows(spark, d))


@query(f"WITH {_TAGS}, b AS (SELECT CASE " + " ".join(f"WHEN word_count > {a} AND word_count <= {b} THEN '({a},{b}]'" for a, b in zip(X.LENGTH_EDGES, X.LENGTH_EDGES[1:])) + " END AS bin, is_sentiment_error AS e FROM tagged) SELECT bin, count(*) AS n, round(avg(CASE WHEN e THEN 1 ELSE 0 END), 6) AS rate FROM b WHERE bin IS NOT NULL GROUP BY bin")
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    return X.length_bins(_tagged(spark, d))


# --- sentiment scores ---


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    done = _queue(spark, d).filter("annotation_status = 'done'")
    return done.select("row_id", "ticker", F.when(F.col("year") != "Unknown", F.col("year")).alias("year"), F.col("passage_id").alias("item"), "section", N.full_label(F.col("sentiment_label")).alias("sentiment"), N.full_label(F.col("sentiment_intensity")).alias("intensity"), (F.lower("has_guidance") == "true").alias("guidance"), N.full_label(F.col("guidance_type")).alias("guidance_type"))


def _case(m: dict, c: str, default: float) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" ELSE {default} END"


ROWS_SQL = f"rows AS (SELECT row_id, ticker, CASE WHEN year <> 'Unknown' THEN year END AS year, passage_id AS item, section, {S.full_label('sentiment_label')} AS sentiment, {S.full_label('sentiment_intensity')} AS intensity, lower(has_guidance) = 'true' AS guidance, {S.full_label('guidance_type')} AS guidance_type FROM annotation_queue WHERE annotation_status = 'done')"
_s, _i, _g = _case(E.SENTIMENT, "sentiment", 0.0), _case(E.INTENSITY, "intensity", 1.0), _case(E.GUIDANCE, "guidance_type", 0.0)
SCORES_SQL = f"""{ROWS_SQL}, sc AS (SELECT ticker, year, CAST({_s} AS DOUBLE) AS s, CAST({_i} AS DOUBLE) AS i, CAST({_g} AS DOUBLE) AS g, coalesce(guidance, false) AS gu, item, sentiment FROM rows WHERE ticker IS NOT NULL AND year IS NOT NULL),
ag AS (SELECT ticker, year, count(item) AS n_passages, avg(s) AS sentiment_mean, avg(s * i) AS weighted, sum(s) AS sentiment_sum, avg(g) AS guidance_mean, avg(CASE WHEN gu THEN 1 ELSE 0 END) AS guidance_rate, avg(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END) AS pct_pos, avg(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) AS pct_neg, avg(CASE WHEN sentiment = 'neutral' THEN 1 ELSE 0 END) AS pct_neu FROM sc GROUP BY ticker, year),
scores AS (SELECT ticker, year, n_passages, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("sentiment_mean", "weighted", "sentiment_sum", "guidance_mean", "guidance_rate", "pct_pos", "pct_neg", "pct_neu"))}, round(pct_pos - pct_neg, 6) + 0.0 AS net_sentiment, round(0.6 * weighted + 0.4 * guidance_mean, 6) + 0.0 AS guidance_adj FROM ag)"""


@query(f"WITH {SCORES_SQL} SELECT * FROM scores")
def sentiment_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.scores(scored_rows(spark, d))


@query(f"WITH {ROWS_SQL} SELECT row_id, section FROM rows WHERE section = 'ceo_review'")
def prompt_cascade(spark: SparkSession, d: str) -> DataFrame:
    return E.cascade(scored_rows(spark, d).select("row_id", "section"), "section", ("combined_review", "ceo_review", "outlook")).select("row_id", "section")


@query()
def offline_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every passage scored by the lexicon; no network."""
    rows = C.prompts(_items(spark, d).select("item", "text"), "Judge this passage: {passage}").select("item", "prompt")
    return C.flatten(C.score(rows, "prompt", {"lexicon": C.lexicon_scorer})).drop("raw")
