"""Queries over revisions and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityjobs.catalog.registry import query
from equityjobs.functions import numbers
from equityjobs.operators import compare
from equityjobs.plans import jobs

_KEYS = "metric, fiscal_period, unit, currency, accounting_basis, value_type, scenario"
_ONCE = f"once AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY id, {_KEYS}) AS times FROM metrics WHERE coalesce(fiscal_period, '') <> '' AND accounting_basis IN ('연결','별도') AND scenario IN ('기본','낙관','비관')) x WHERE times = 1 AND value IS NOT NULL)"
_HELD = "held AS (SELECT DISTINCT id, publisher, published_at, unnest(stock_codes) AS stock_code FROM reports)"
_PREV = f"{_HELD}, prev AS (SELECT *, lag(id) OVER (PARTITION BY stock_code ORDER BY published_at NULLS FIRST, id) AS a, CASE WHEN coalesce(publisher, '') <> '' THEN lag(id) OVER (PARTITION BY stock_code, publisher ORDER BY published_at NULLS FIRST, id) END AS s FROM held)"
_MATCH = " AND ".join(f"o.{k.strip()} IS NOT DISTINCT FROM n.{k.strip()}" for k in _KEYS.split(","))


@query("w13_previous_reports", f"WITH {_PREV} SELECT id, stock_code, coalesce(s, a) AS prev_report_id, CASE WHEN s IS NOT NULL THEN 'same_publisher' WHEN a IS NOT NULL THEN 'cross_publisher' END AS prev_match_type FROM prev")
def _(t):
    return compare.previous_reports(t.reports)


@query("q8_compare_reports", f"""
    WITH {_PREV}, {_ONCE}, pr AS (SELECT DISTINCT coalesce(s, a) AS p, id AS c FROM prev WHERE a IS NOT NULL)
    SELECT p AS previous_id, c AS current_id, n.metric, n.fiscal_period, n.unit, o.value AS previous, n.value AS current, round(n.value - o.value, 6) AS delta,
           CASE WHEN n.unit = '%' OR o.value <= 0 OR n.value <= 0 THEN NULL ELSE round((n.value - o.value) / o.value * 100, 6) END AS change_pct
    FROM pr JOIN once n ON n.id = c AND n.value_type <> '실적' JOIN once o ON o.id = p AND {_MATCH}""")
def _(t):
    return jobs.compare_reports(t.reports, t.metrics).select("previous_id", "current_id", "metric", "fiscal_period", "unit", "previous", "current", "delta", "change_pct")


@query("j12_comparable_metrics", f"WITH {_ONCE} SELECT id, count(*) AS n FROM once GROUP BY id")
def _(t):
    return compare.comparable_metrics(t.metrics).filter("value is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("j13_report_pairs", """
    WITH held AS (SELECT DISTINCT id, publisher, published_at, unnest(stock_codes) AS code FROM reports WHERE (report_type IS NULL OR report_type = '단일종목') AND published_at IS NOT NULL)
    SELECT DISTINCT a.id AS left_id, b.id AS right_id, coalesce(a.publisher, '') <> '' AND a.publisher IS NOT DISTINCT FROM b.publisher AS same_publisher
    FROM held a JOIN held b ON a.code = b.code AND (a.published_at < b.published_at OR (a.published_at = b.published_at AND a.id < b.id)) AND b.published_at - a.published_at <= 30""")
def _(t):
    return compare.report_pairs(t.reports, most_days=30)


@query("j13_rejected_pairs", """
    SELECT a.id AS left_id, b.id AS right_id, CASE WHEN coalesce(a.report_type, '단일종목') <> '단일종목' OR coalesce(b.report_type, '단일종목') <> '단일종목' THEN 'report_type' WHEN a.id = b.id THEN 'same_report' WHEN NOT list_has_any(a.stock_codes, b.stock_codes) THEN 'other_company' END AS reason
    FROM reports a JOIN reports b ON b.id = a.id - a.id % 7""")
def _(t):
    pairs = t.reports.select(F.col("id").alias("left_id"), (F.col("id") - F.col("id") % 7).alias("right_id"))
    return compare.rejected_pairs(pairs, t.reports)


@query("f20_change_labels", """
    SELECT id, line, CASE WHEN value IS NULL THEN '비교값 없음' WHEN unit = '%' THEN (CASE WHEN d >= 0 THEN '+' ELSE '-' END) || CAST(abs(d) AS VARCHAR) || '.00%p' WHEN value < 0 THEN '적자 전환' WHEN c < 0 THEN '적자 전환' ELSE '+100.00%' END AS label
    FROM (SELECT id, line, unit, value, value AS c, CAST(id % 50 - 20 AS BIGINT) AS d FROM metrics) x""")
def _(t):
    base = F.when(F.col("value").isNull(), None).when(F.col("unit") == "%", 1000.0).otherwise(F.when(F.col("value") < 0, 5.0).otherwise(F.col("value")))
    new = F.when(F.col("value").isNull(), None).when(F.col("unit") == "%", 1000.0 + F.col("id") % 50 - 20).otherwise(F.when(F.col("value") < 0, F.col("value")).otherwise(2 * F.col("value")))
    return t.metrics.select("id", "line", numbers.numeric_change(base, new, F.col("unit"), F.lit("영업이익"))[2].alias("label"))


@query("f21_target_directions", "SELECT id, CASE WHEN target_price_new IS NOT NULL AND target_price_old IS NOT NULL THEN CASE WHEN target_price_new > target_price_old THEN '상향' WHEN target_price_new < target_price_old THEN '하향' ELSE '불변' END WHEN target_price_new IS NULL AND target_price_old IS NULL THEN 'N/A' ELSE target_price_dir END AS direction FROM summaries")
def _(t):
    return t.summaries.select("id", numbers.target_direction(F.col("target_price_old"), F.col("target_price_new"), F.col("target_price_dir")).alias("direction"))


def pages(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "body"))
    return rows.withColumn("page_no", F.col("page_no") + 1)


_PAGES = "pg AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) + 1 AS page_no, unnest(string_split(text, chr(10))) AS body FROM documents)"


@query("w8_pages_text", f"""
    WITH {_PAGES}, ch AS (SELECT *, '--- Page ' || page_no || ' ---' || chr(10) || body || chr(10) AS c FROM pg), ru AS (SELECT *, sum(greatest(1, length(c) // 3)) OVER (PARTITION BY doc_id ORDER BY page_no) AS used FROM ch)
    SELECT doc_id, coalesce(string_agg(c, '' ORDER BY page_no) FILTER (WHERE used <= 200), '') AS text, count(*) FILTER (WHERE used <= 200) AS pages_used, count(*) AS total_pages, count(*) FILTER (WHERE used > 200) > 0 AS truncated, CAST(coalesce(max(used) FILTER (WHERE used <= 200), 0) AS BIGINT) AS tokens FROM ru GROUP BY doc_id""")
def _(t):
    return compare.pages_text(pages(t), 200)


@query("w9_lead_pages", f"WITH {_PAGES}, h AS (SELECT doc_id, min(page_no) FILTER (WHERE contains(body, 'the')) AS hit FROM pg GROUP BY doc_id) SELECT pg.doc_id, page_no FROM pg JOIN h ON h.doc_id = pg.doc_id WHERE page_no <= least(3, coalesce(hit, 3))")
def _(t):
    return compare.lead_pages(pages(t), "the").select("doc_id", "page_no")


def cited(t):
    """Metrics with quotes and pages: the value is on page 1 or 2 as the line says, some quotes are wrong."""
    v = F.format_number(F.abs("value"), 2)
    said = F.when(F.col("value") < 0, F.concat(F.lit("("), v, F.lit(")"))).otherwise(v)
    page = F.when(F.col("line") % 3 == 0, 2).otherwise(1)
    quote = F.when(F.col("line") % 5 == 0, F.lit("no number")).when(F.col("line") % 7 == 0, F.concat(F.lit("12M Fwd "), said)).otherwise(F.concat(F.lit("value "), said))
    metrics = t.metrics.filter("value is not null").select("id", "line", "fiscal_period", "value", page.alias("page"), quote.alias("quote"), F.lit(None).cast("double").alias("previous_value"), F.lit(None).cast("int").alias("previous_page"), F.lit(None).cast("string").alias("previous_quote"))
    odd = t.metrics.filter("value is not null").select("id", F.when(F.col("line") % 2 == 0, 2).otherwise(1).alias("page"), said.alias("said"))
    return metrics, odd.groupBy("id", "page").agg(F.concat_ws(" ", F.collect_list("said")).alias("body"))


@query("f23_grounded_metrics", """
    WITH m AS (SELECT *, CASE WHEN line % 3 = 0 THEN 2 ELSE 1 END AS page FROM metrics WHERE value IS NOT NULL), b AS (SELECT id, CASE WHEN line % 2 = 0 THEN 2 ELSE 1 END AS page, value FROM metrics WHERE value IS NOT NULL)
    SELECT id, line, value, line % 5 <> 0 AND NOT (line % 7 = 0 AND coalesce(fiscal_period, '') <> '') AND EXISTS (SELECT 1 FROM b WHERE b.id = m.id AND b.page = m.page AND b.value = m.value) AS kept FROM m""")
def _(t):
    return compare.ground_metrics(*cited(t)).select("id", "line", "value", "kept")


@query("q9_ground_summaries", """
    WITH m AS (SELECT *, CASE WHEN line % 3 = 0 THEN 2 ELSE 1 END AS page FROM metrics WHERE value IS NOT NULL), b AS (SELECT id, CASE WHEN line % 2 = 0 THEN 2 ELSE 1 END AS page, value FROM metrics WHERE value IS NOT NULL),
    k AS (SELECT id, count(*) FILTER (WHERE line % 5 <> 0 AND NOT (line % 7 = 0 AND coalesce(fiscal_period, '') <> '') AND EXISTS (SELECT 1 FROM b WHERE b.id = m.id AND b.page = m.page AND b.value = m.value)) AS kept, count(*) AS given FROM m GROUP BY id)
    SELECT s.id, kept, given - kept AS omitted, target_price_new IS NULL OR coalesce(target_price_raw, '') <> '' OR len(source_pages) > 0 AS valid FROM summaries s JOIN k ON k.id = s.id""")
def _(t):
    grounded, summaries = jobs.ground_summaries(*cited(t), t.summaries)
    counts = grounded.groupBy("id").agg(F.count_if("kept").alias("kept"), F.sum("omitted").alias("omitted"))
    return summaries.join(counts, "id").select("id", "kept", "omitted", "valid")
