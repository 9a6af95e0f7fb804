"""Queries over coverage counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityjobs.catalog.registry import query
from equityjobs.catalog.reports import DAY, ED, IN_SCOPE
from equityjobs.functions import dates
from equityjobs.operators import coverage as C
from equityjobs.operators import reports as R
from equityjobs.schemas import OTHER_RESEARCH_PUBLISHERS


def trunc(unit: str, day: str = ED) -> str:
    return f"CAST(CAST(date_trunc('{unit}', {day}) AS DATE) AS VARCHAR)"


@query("a1_sector_timeseries", f"""
    WITH x AS (SELECT {trunc('month')} AS bucket, unnest(sectors_major) AS sector FROM reports WHERE {IN_SCOPE}),
    top AS (SELECT sector FROM x GROUP BY 1 ORDER BY count(*) DESC, sector LIMIT 5)
    SELECT 'top' AS way, bucket, sector, count(*) AS count FROM x WHERE sector IN (SELECT sector FROM top) GROUP BY 1, 2, 3
    UNION ALL SELECT 'chosen', bucket, sector, count(*) FROM (SELECT {trunc('week')} AS bucket, unnest(sectors_major) AS sector FROM reports WHERE {IN_SCOPE}) y
    WHERE sector IN ('S1','S6') GROUP BY 1, 2, 3""")
def _(t):
    rows = t.reports.filter(R.in_scope())
    top = C.sector_timeseries(rows, "sectors_major", [], "M", 5).withColumn("way", F.lit("top"))
    return top.unionByName(C.sector_timeseries(rows, "sectors_major", ["S1", "S6"], "W").withColumn("way", F.lit("chosen")))


@query("a2_sector_ranking", f"""
    SELECT code, count(*) AS count FROM (SELECT unnest(stock_codes) AS code FROM reports WHERE {IN_SCOPE} AND list_has_any(sectors_major, ['S2','S3'])) x
    GROUP BY code ORDER BY count(*) DESC, code LIMIT 20""")
def _(t):
    return C.sector_ranking(t.reports.filter(R.in_scope()), "sectors_major", ["S2", "S3"])


@query("j2_ranking_names", f"""
    SELECT r.code, r.count, coalesce(s.name, '') AS name FROM (SELECT code, count(*) AS count FROM (SELECT unnest(stock_codes) AS code FROM reports WHERE {IN_SCOPE}) x
    GROUP BY code ORDER BY count(*) DESC, code LIMIT 20) r LEFT JOIN stocks s ON s.code = r.code AND s.line_no % 3 <> 0""")
def _(t):
    return C.with_names(C.sector_ranking(t.reports.filter(R.in_scope()), "sectors_major", []), t.stocks.filter("line_no % 3 <> 0"))


@query("a3_report_types", f"SELECT {trunc('month')} AS bucket, report_type, count(*) AS count FROM reports WHERE report_type IS NOT NULL GROUP BY 1, 2")
def _(t):
    return C.report_type_timeseries(t.reports, "M", include_oos=True)


@query("a4_stock_timeseries", f"SELECT code, bucket, count(*) AS count FROM (SELECT DISTINCT id, unnest(stock_codes) AS code, {trunc('week')} AS bucket FROM reports) x GROUP BY 1, 2")
def _(t):
    return C.stock_timeseries(t.reports, "W")


@query("f1_buckets", f"SELECT {trunc('day')} AS d, {trunc('week')} AS w, {trunc('month')} AS m, count(*) AS n FROM reports GROUP BY 1, 2, 3")
def _(t):
    day = dates.effective_date()
    return t.reports.groupBy(*[dates.bucket(day, u).alias(u.lower()) for u in "DWM"]).agg(F.count(F.lit(1)).alias("n"))


@query("f2_dense_series", f"""
    WITH s AS (SELECT code, CAST(date_trunc('month', d) AS DATE) AS bucket, count(*) AS c FROM (SELECT DISTINCT id, unnest(stock_codes) AS code, {ED} AS d FROM reports) x GROUP BY 1, 2),
    e AS (SELECT code, min(bucket) AS a, max(bucket) AS b FROM s GROUP BY code),
    g AS (SELECT code, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS bucket FROM e)
    SELECT g.code, CAST(g.bucket AS VARCHAR) AS bucket, coalesce(s.c, 0) AS count FROM g LEFT JOIN s ON s.code = g.code AND s.bucket = g.bucket""")
def _(t):
    return C.dense(C.stock_timeseries(t.reports, "M"), ["code"], "M")


@query("a5_publishers", f"""
    WITH p AS (SELECT code, publisher, count(*) AS c FROM (SELECT id, publisher, unnest(list_distinct(stock_codes)) AS code FROM reports WHERE publisher IS NOT NULL) x GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY c DESC, publisher) AS k FROM p)
    SELECT code, CASE WHEN k <= 5 THEN publisher ELSE '기타' END AS publisher, CAST(sum(c) AS BIGINT) AS count FROM r GROUP BY 1, 2""")
def _(t):
    held = t.reports.withColumn("code", F.explode(F.array_distinct("stock_codes")))
    return C.publisher_distribution(held, ["code"])


@query("a6_market_totals", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE out_of_scope_reason IS NULL) AS inscope, count(out_of_scope_reason) AS oos, count(DISTINCT publisher) AS publishers,
           CAST(min({ED}) AS VARCHAR) AS earliest, CAST(max({ED}) AS VARCHAR) AS latest FROM reports""")
def _(t):
    return C.market_totals(t.reports)


@query("a7_available_items", "SELECT DISTINCT item FROM (SELECT unnest(sectors_minor) AS item FROM reports WHERE out_of_scope_reason IS NULL) x WHERE item <> ''")
def _(t):
    return C.available_items(t.reports, "sectors_minor")


_COUNTS = f"""
    r AS (SELECT id, {ED} AS d, publisher, coalesce(publisher_type, '') AS pt, coalesce(report_type, '') AS rt, len(stock_codes) AS held, unnest(list_distinct(stock_codes)) AS code
          FROM reports WHERE {IN_SCOPE}),
    k AS (SELECT *, CASE WHEN pt IN ('','broker') AND rt IN ('','단일종목','기타') AND held = 1 THEN 's' WHEN pt IN ('','broker') AND rt = '섹터' THEN 'm'
                         WHEN pt IN {OTHER_RESEARCH_PUBLISHERS} THEN 'o' END AS kind FROM r WHERE d >= DATE '2001-08-01' - 365),
    a AS (SELECT code, count(*) FILTER (WHERE kind='s') AS s, count(*) FILTER (WHERE kind='m') AS m, count(*) FILTER (WHERE kind='o') AS o,
                 max(d) FILTER (WHERE kind='s') AS last, count(DISTINCT publisher) FILTER (WHERE kind='s' AND publisher <> '') AS b FROM k GROUP BY code),
    report_counts_of AS (SELECT c.code, coalesce(s,0) AS stock_reports, coalesce(m,0) AS sector_mentions, coalesce(o,0) AS other_research, CAST(last AS VARCHAR) AS last_stock_report_date,
           coalesce(b,0) AS brokers, CASE WHEN coalesce(s,0) = 0 THEN 'none' WHEN s >= 3 AND last >= DATE '2001-08-01' - 180 THEN 'covered' ELSE 'few' END AS label
    FROM stocks c LEFT JOIN a ON a.code = c.code)"""


@query("a8_report_counts", f"WITH {_COUNTS} SELECT * FROM report_counts_of")
def _(t):
    return C.report_counts(t.reports.filter(R.in_scope()), t.stocks, DAY)
