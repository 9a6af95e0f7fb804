"""Queries over report rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from equityjobs.catalog.registry import query
from equityjobs.functions import dates, texts
from equityjobs.operators import reports as R
from equityjobs.sources import layout
from equityjobs.sources.scratch import scratch_path
from equityjobs.sources.adapters import NOW, TODAY

DAY, MOMENT = date.fromisoformat(TODAY), datetime.fromisoformat(NOW)
ED = "coalesce(published_at, CAST(sent_at + INTERVAL 9 HOUR AS DATE))"
IN_SCOPE = "tagging_status IN ('auto','verified') AND out_of_scope_reason IS NULL"


@query("p1_in_scope", f"SELECT id, tagging_status FROM reports WHERE {IN_SCOPE}")
def _(t):
    return t.reports.filter(R.in_scope()).select("id", "tagging_status")


@query("p2_effective_date", f"SELECT id, CAST({ED} AS VARCHAR) AS effective_date FROM reports")
def _(t):
    return t.reports.select("id", dates.effective_date().alias("effective_date"))


@query("p3_period_rows", f"SELECT id, false AS with_oos FROM reports WHERE {IN_SCOPE} AND published_at >= DATE '2000-06-01' UNION ALL SELECT id, true FROM reports WHERE tagging_status IN ('auto','verified') AND {ED} >= DATE '2000-06-01'")
def _(t):
    start = date(2000, 6, 1)
    return R.period_rows(t.reports, start).select("id", F.lit(False).alias("with_oos")).unionByName(R.period_rows(t.reports, start, True).select("id", F.lit(True).alias("with_oos")))


@query("p3_month_layout", f"SELECT id, false AS with_oos FROM reports WHERE {IN_SCOPE} AND published_at >= DATE '2000-06-01' UNION ALL SELECT id, true FROM reports WHERE tagging_status IN ('auto','verified') AND {ED} >= DATE '2000-06-01'")
def _(t):
    """The same period out of reports that are stored by month."""
    path, start = scratch_path(t.spark, "reports_by_month"), date(2000, 6, 1)
    rows = t.reports.select("id", "published_at", "sent_at", "tagging_status", "out_of_scope_reason")
    layout.write_by_month(rows, path)
    found = [layout.read_period(t.spark, path, rows.schema, start, oos).select("id", F.lit(oos).alias("with_oos")) for oos in (False, True)]
    return found[0].unionByName(found[1])


@query("p4_period_start", f"SELECT count(*) AS n, '2000-08-01' AS start FROM reports WHERE {ED} >= DATE '2000-08-01'")
def _(t):
    start = dates.period_start(365, MOMENT)
    return t.reports.filter(dates.effective_date() >= start).agg(F.count(F.lit(1)).alias("n"), F.first(start).alias("start"))


@query("p5_rows_of_stock", "SELECT id FROM reports WHERE list_contains(stock_codes, '000042')")
def _(t):
    return R.rows_of_stock(t.reports, "000042").select("id")


@query("p6_rows_of_stocks", "SELECT id, 'list' AS way FROM reports WHERE list_has_any(stock_codes, ['000007','000042']) UNION ALL SELECT id, 'table' FROM reports WHERE list_has_any(stock_codes, (SELECT list(code) FROM stocks WHERE market = 'KOSDAQ GLOBAL'))")
def _(t):
    a = R.rows_of_stocks(t.reports, ["000007", "000042", "000007", "x-y"]).select("id", F.lit("list").alias("way"))
    b = R.rows_of_code_table(t.reports, t.stocks.filter("market = 'KOSDAQ GLOBAL'")).select("id", F.lit("table").alias("way"))
    return a.unionByName(b)


@query("p8_public_reports", f"""
    SELECT r.id, c.code AS stock_code, CAST(r.published_at AS VARCHAR) AS published_at, r.title, r.publisher, s.one_line_summary,
           CAST(row_number() OVER (PARTITION BY c.code ORDER BY r.published_at DESC NULLS LAST, r.id DESC) AS BIGINT) AS newest
    FROM reports r, (SELECT DISTINCT id, unnest(stock_codes) AS code FROM reports) c
    LEFT JOIN summaries s ON s.id = r.id AND s.summary_version = 'v2' WHERE c.id = r.id AND {IN_SCOPE}""")
def _(t):
    rows = R.public_reports(t.reports.filter(R.in_scope()), t.summaries, "v2")
    return rows.select("id", "stock_code", "published_at", "title", "publisher", "one_line_summary", "newest")


@query("p9_library", """
    SELECT r.id FROM reports r LEFT JOIN summaries s ON s.id = r.id AND s.summary_version = 'v2'
    WHERE r.publisher = 'P3' AND (contains(lower(concat_ws(' ', r.title, s.one_line_summary)), 'report on 1')) AND s.summary_version IS NOT NULL
      AND r.published_at >= DATE '1998-08-01'""")
def _(t):
    rows = t.reports.join(t.summaries.filter("summary_version = 'v2'"), "id", "left")
    return R.library(rows, DAY, publisher="P3", words="Report on 1", analysed=True, months=36).select("id")


@query("p10_stock_search", "SELECT code, name FROM stocks WHERE starts_with(code, 'RING') OR contains(upper(name), 'RING')")
def _(t):
    return t.stocks.filter(F.col("code").startswith("RING") | F.upper("name").contains("RING")).select("code", "name")


@query("p11_valid_codes", "SELECT code, code IN (SELECT code FROM stocks) AS valid FROM (SELECT DISTINCT lpad(CAST(l_partkey AS VARCHAR), CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE 6 END, '0') AS code FROM lineitem) x")
def _(t):
    width = F.when(F.col("l_partkey") % 3 == 0, 5).otherwise(6)
    codes = t.lineitem.select(F.when(width == 5, F.lpad(F.col("l_partkey").cast("string"), 5, "0")).otherwise(F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("code")).distinct()
    listed = codes.filter(texts.valid_code(F.col("code"))).join(t.stocks.select("code"), "code", "left_semi").withColumn("valid", F.lit(True))  # a bounded stock list
    return codes.join(listed, "code", "left").select("code", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("p14_value_sets", """
    SELECT 'report_type' AS column_name, count(*) FILTER (WHERE report_type NOT IN ('단일종목','산업','섹터','IR자료','전략·시황','기타')) AS n FROM reports
    UNION ALL SELECT 'out_of_scope_reason', count(*) FILTER (WHERE out_of_scope_reason NOT IN ('foreign','fund','digital','private','ir_self')) FROM reports
    UNION ALL SELECT 'publisher_type', count(*) FILTER (WHERE publisher_type NOT IN ('broker','data_provider','ir_agency','other')) FROM reports
    UNION ALL SELECT 'tagging_status', count(*) FILTER (WHERE tagging_status NOT IN ('pending','processing','auto','review_needed','verified')) FROM reports
    UNION ALL SELECT 'source_pages', count(*) FILTER (WHERE list_min(source_pages) < 1) FROM summaries""")
def _(t):
    return R.value_set_violations(t.reports, t.summaries)


@query("p15_fold_versions", "SELECT taxonomy_version, count(*) AS n FROM (SELECT CASE WHEN taxonomy_version IN ('old','older') THEN 'v3' ELSE taxonomy_version END AS taxonomy_version FROM reports) x GROUP BY 1")
def _(t):
    return R.fold_versions(t.reports, ["old", "older"], "v3").groupBy("taxonomy_version").agg(F.count(F.lit(1)).alias("n"))


@query("j1_company_reports", """
    SELECT c.code AS stock_code, count(*) AS reports, count(s.id) AS summaries, max(CASE WHEN newest = 1 THEN id END) AS latest_id FROM (
        SELECT r.id, c.code, row_number() OVER (PARTITION BY c.code ORDER BY r.published_at DESC NULLS LAST, r.id DESC) AS newest
        FROM reports r, (SELECT DISTINCT id, unnest(stock_codes) AS code FROM reports) c WHERE c.id = r.id) c
    LEFT JOIN (SELECT id AS sid, id FROM summaries WHERE summary_version = 'v2') s ON s.sid = c.id GROUP BY c.code""".replace("max(CASE WHEN newest = 1 THEN id END)", "max(CASE WHEN newest = 1 THEN c.id END)"))
def _(t):
    rows = R.public_reports(t.reports, t.summaries, "v2")
    return rows.groupBy("stock_code").agg(F.count(F.lit(1)).alias("reports"), F.count("summary_version").alias("summaries"), F.max(F.when(F.col("newest") == 1, F.col("id"))).alias("latest_id"))


@query("a18_queue_distribution", """
    SELECT count(*) FILTER (WHERE tagging_status='pending') AS pending, count(*) FILTER (WHERE tagging_status='processing') AS processing,
           count(*) FILTER (WHERE tagging_status='auto') AS auto, count(*) FILTER (WHERE tagging_status='review_needed') AS review_needed,
           count(*) FILTER (WHERE tagging_status='verified') AS verified, count(out_of_scope_reason) AS oos_total,
           count(*) FILTER (WHERE tagged_at >= TIMESTAMP '2001-07-31 03:00:00') AS last_24h FROM reports""")
def _(t):
    return R.queue_distribution(t.reports, MOMENT)


@query("a24_company_statistics", f"""
    WITH c AS (SELECT DISTINCT id, unnest(stock_codes) AS stock_code FROM reports WHERE {IN_SCOPE}),
    x AS (SELECT c.stock_code, r.publisher, r.published_at, r.id, s.summary_version, s.has_details, s.target_price_new
          FROM c JOIN reports r ON r.id = c.id LEFT JOIN summaries s ON s.id = r.id AND s.summary_version = 'v2')
    SELECT stock_code, count(*) AS reports, count(DISTINCT publisher) AS publishers, count(summary_version) AS analysed,
           count(*) FILTER (WHERE has_details) AS with_details,
           (list(target_price_new ORDER BY coalesce(published_at, DATE '0001-01-01') DESC, id DESC) FILTER (WHERE target_price_new IS NOT NULL))[1] AS latest_target
    FROM x GROUP BY stock_code""")
def _(t):
    return R.company_statistics(t.reports, t.summaries, "v2")


@query("a26_in_progress", "SELECT count(*) AS n FROM reports WHERE tagging_status = 'processing' AND tagging_locked_at >= TIMESTAMP '1999-01-01 00:00:00'")
def _(t):
    return R.in_progress(t.reports, datetime(1999, 1, 1))


@query("k5_review_queue", "SELECT id, (SELECT count(*) FROM reports WHERE tagging_status = 'review_needed' AND id NOT IN (3, 5, 8)) AS waiting FROM reports WHERE tagging_status = 'review_needed' AND id NOT IN (3, 5, 8) ORDER BY tagged_at NULLS LAST, id LIMIT 1")
def _(t):
    queue = t.reports.filter((F.col("tagging_status") == "review_needed") & ~F.col("id").isin(3, 5, 8)).agg(F.count(F.lit(1)).alias("waiting"))
    return R.review_queue(t.reports, [3, 5, 8]).select("id").join(F.broadcast(queue))  # one row each


@query("k6_work_batch", "SELECT id FROM reports WHERE tagging_status = 'pending' ORDER BY downloaded_at, id LIMIT 25")
def _(t):
    return R.work_batch(t.reports, 25).select("id")


@query("k7_newest_in_scope", f"SELECT strftime(max(sent_at), '%Y-%m-%d %H:%M:%S') AS latest_at FROM reports WHERE {IN_SCOPE}")
def _(t):
    return R.newest_in_scope(t.reports)


@query("f38_summary_invariants", """
    SELECT id, array_to_string(list_sort(list_distinct(source_pages)), '|') AS source_pages,
           target_price_new IS NULL OR coalesce(target_price_raw, '') <> '' OR len(source_pages) > 0 AS valid FROM summaries""")
def _(t):
    return R.summary_invariants(t.summaries).select("id", "source_pages", "valid")
