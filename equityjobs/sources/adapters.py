"""Domain tables derived from the generic test tables.

Each table is one SQL text in a small common dialect; ``ARR(`` and ``HOURS(`` stand for the engine's array
constructor and hour interval, so the same text serves Spark and the SQL that checks it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TODAY, NOW = "2001-08-01", "2001-08-01 03:00:00"


def _code(x: str) -> str:
    return f"lpad(cast({x} as string), 6, '0')"


TABLES: dict[str, str] = {
    "stocks": f"""
        select p_partkey as line_no, {_code('p_partkey')} as code, p_name as name,
               case p_size % 5 when 0 then 'KOSPI' when 1 then 'KOSPI' when 4 then 'KOSDAQ GLOBAL' else 'KOSDAQ' end as market,
               p_type as sector_major, p_brand as sector_minor, replace(p_name, ' ', ', ') as products_text
        from part""",
    "quotes": f"""
        select {_code('p_partkey')} as stock_code, p_partkey % 13 = 0 as halted, p_partkey % 17 = 0 as admin_issue,
               cast(round(p_retailprice * 1000000) as bigint) as market_cap
        from part""",
    "daily_prices": f"""
        select {_code('l_partkey')} as stock_code, cast(l_shipdate as date) as day,
               case when l_orderkey % 50 = 0 then 0 else cast(round(l_extendedprice) as bigint) end as close,
               case when l_linenumber = 7 then null else cast(round(l_quantity * l_extendedprice) as bigint) end as trading_value,
               l_orderkey as s1, l_linenumber as s2, l_partkey as s3, l_suppkey as s4, l_extendedprice as s5, l_quantity as s6
        from lineitem""",
    "reports": f"""
        select o_orderkey as id, o_orderkey % 4 as chat, o_orderkey as message_id,
               case when o_orderkey % 6 = 0 then null else cast(o_orderdate as date) end as published_at,
               cast(o_orderdate as timestamp) + HOURS(cast((o_orderkey * 7) % 24 as int)) as sent_at,
               cast(o_orderdate as timestamp) + HOURS(cast((o_orderkey * 7) % 24 + 1 as int)) as downloaded_at,
               case when o_orderstatus = 'O' or o_orderstatus = 'F' then cast(o_orderdate as timestamp) + HOURS(cast((o_orderkey * 7) % 24 + 5 as int))
                    when o_orderkey % 2 = 0 then cast(o_orderdate as timestamp) + HOURS(30) end as tagged_at,
               case substr(o_orderpriority, 1, 1) when '1' then '단일종목' when '2' then '섹터' when '3' then '산업' when '4' then '기타' else null end as report_type,
               case when o_custkey % 10 = 0 then null when o_custkey % 37 = 0 then '' else concat('P', cast(o_custkey % 113 as string)) end as publisher,
               case o_custkey % 6 when 0 then 'broker' when 1 then 'data_provider' when 2 then 'ir_agency' when 3 then 'other' when 4 then null else '' end as publisher_type,
               case when o_orderkey % 11 = 0 then ARR() when o_orderkey % 3 = 0 then ARR({_code('o_custkey')}, {_code('o_custkey * 3')})
                    else ARR({_code('o_custkey')}) end as stock_codes,
               ARR(concat('C', cast(o_custkey as string))) as company_names,
               case when o_orderkey % 4 = 0 then ARR(concat('S', cast(o_custkey % 8 as string)), concat('S', cast(o_custkey % 5 as string)))
                    else ARR(concat('S', cast(o_custkey % 8 as string))) end as sectors_major,
               ARR(concat('M', cast(o_custkey % 13 as string))) as sectors_minor,
               ARR(concat('R', cast(o_custkey % 11 as string))) as products,
               ARR(concat('A', cast(o_custkey % 9 as string))) as analysts,
               case when o_orderkey % 29 = 0 then 'pending' when o_orderkey % 31 = 0 then 'processing'
                    when o_orderstatus = 'O' then 'auto' when o_orderstatus = 'F' then 'verified' else 'review_needed' end as tagging_status,
               case when o_orderkey % 9 = 0 then 'foreign' when o_orderkey % 23 = 0 then 'fund' else null end as out_of_scope_reason,
               case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as tagging_confidence,
               case o_orderkey % 7 when 0 then 'first_page_unreadable' when 1 then 'krx_unmatched_in_scope:ipo_pending_or_unknown'
                    when 2 then 'type_indeterminate;page_image' when 3 then 'publisher_suspect:unknown' when 4 then 'llm_refusal:length;page_image' else null end as tagging_notes,
               cast(o_orderdate as timestamp) + HOURS(cast(o_orderkey % 11 as int)) as tagging_locked_at,
               concat('w', cast(o_orderkey % 3 as string)) as tagging_worker_id,
               case when o_orderkey % 13 = 0 then 'plain.pdf' else concat('R_20260511_',
                    case o_orderkey % 5 when 0 then 'pubd' when 1 then 'pube' when 2 then 'Zeta+X' when 3 then '31780' else 'No One' end,
                    '_', cast(o_orderkey as string), '.pdf') end as file_name,
               concat('Report on ', cast(o_custkey as string)) as title,
               case when o_orderkey % 8 = 0 then 'old' else 'v3' end as taxonomy_version, 'v9' as tagger_version
        from orders""",
    "summaries": """
        select o_orderkey as id, case when o_orderkey % 5 = 0 then 'v1' else 'v2' end as summary_version,
               case when o_orderkey % 3 = 0 then null else cast(floor(o_totalprice) as bigint) % 1000 end as target_price_new,
               case when o_orderkey % 4 = 0 then null else cast(floor(o_totalprice) as bigint) % 900 end as target_price_old,
               case when o_orderkey % 2 = 0 then '신규' else 'N/A' end as target_price_dir,
               case when o_orderkey % 7 = 0 then null else concat(cast(o_orderkey as string), '원') end as target_price_raw,
               case when o_orderkey % 6 = 0 then ARR() else ARR(cast(o_orderkey % 5 as int), cast(o_custkey % 3 + 1 as int), cast(o_orderkey % 5 as int)) end as source_pages,
               o_orderkey % 3 = 1 as has_details, concat('Summary ', cast(o_custkey % 50 as string)) as one_line_summary
        from orders""",
    "metrics": """
        select l_orderkey as id, l_returnflag as metric, case when l_suppkey % 41 = 0 then null else cast(extract(year from l_shipdate) as string) end as fiscal_period,
               case when l_linenumber % 2 = 0 then '%' else '원' end as unit, case when l_linenumber % 2 = 0 then null else 'KRW' end as currency,
               case l_suppkey % 5 when 0 then '별도' when 1 then '미기재' else '연결' end as accounting_basis,
               case when l_suppkey % 7 = 0 then '실적' else '추정' end as value_type,
               case l_suppkey % 3 when 0 then '기본' when 1 then '기본' else '낙관' end as scenario,
               case when l_suppkey % 11 = 0 then -round(l_extendedprice, 2) when l_suppkey % 13 = 0 then null else round(l_extendedprice, 2) end as value,
               l_linenumber as line
        from lineitem""",
    "messages": """
        select conv_id % 4 as chat, conv_id * 100 + turn as message_id,
               cast('2024-01-01 00:00:00' as timestamp) + HOURS(cast(conv_id % 960 as int)) as sent_at,
               case turn % 4 when 0 then 'application/pdf' else 'text/plain' end as mime,
               case when turn % 2 = 0 then concat('R_20260511_TAG', cast(conv_id % 5 as string), '.PDF') else concat('note: ', cast(conv_id as string), '?.txt') end as file_name
        from conversations""",
    "attempts": """
        select user_id % 4 as chat, event_id % 500 as message_id, ts as failed_at, concat('e', cast(event_id % 7 as string)) as error, event_id
        from events where event_type = 'error'""",
    "runs": """
        select event_id as run_id, case event_type when 'click' then 'ok' when 'view' then 'partial' when 'error' then 'failed' else 'running' end as status,
               ts as started_at, cast(ts as date) as as_of, event_type
        from events""",
    "builds": """
        select n_nationkey as build_id, case n_nationkey % 5 when 0 then 'done' when 1 then 'pilot' when 2 then 'failed' when 3 then 'done' else 'incomplete' end as status,
               2020 + n_nationkey % 4 as fiscal_year, concat('p', cast(n_nationkey % 3 as string)) as profile_version,
               concat('m', cast(n_nationkey % 2 as string)) as embed_model, (n_nationkey * 7) % 25 as finished_no
        from nation""",
    "publishers": """
        select concat('P', cast(s_suppkey as string)) as canonical, case when s_suppkey < 15 then concat('pub', substr('abcdefghijklmno', cast(s_suppkey + 1 as int), 1)) else concat('pub', cast(s_suppkey as string)) end as alias,
               case s_suppkey % 4 when 0 then 'broker' when 1 then 'data_provider' when 2 then 'ir_agency' else 'other' end as publisher_type
        from supplier""",
    "vectors": f"""
        select {_code('vec_id')} as code, label as grp, embedding as vector from embeddings""",
    "segment_vectors": f"""
        select {_code('cast((vec_id - vec_id % 2) / 2 as bigint)')} as code, cast(vec_id % 2 as int) as seg_no,
               case when vec_id % 7 = 0 then -1 else (vec_id * 13) % 100 end as share, embedding as vector
        from embeddings""",
    "sections": f"""
        select {_code('cast((doc_id - doc_id % 10) / 10 as bigint)')} as stock_code, cast((doc_id - doc_id % 5) / 5 as bigint) as rcept_no,
               case doc_id % 5 when 0 then '020100' when 1 then '020200' when 2 then '020400' when 3 then '020700' else '020800' end as section_code,
               case doc_id % 4 when 0 then '0.1.9' when 1 then '0.2.0' when 2 then '0.10.0' else 'v0.3.0' end as parser_version,
               case doc_id % 9 when 0 then 'N' when 1 then 'K' else 'Y' end as corp_cls, concat('Corp ', source) as corp_name,
               doc_id % 17 <> 0 as is_final, 2024 as fiscal_year, concat('2024-', lpad(cast(doc_id % 12 + 1 as string), 2, '0')) as fiscal_end,
               text as prose_text, doc_id
        from documents""",
    "profiles": f"""
        select {_code('cast((doc_id - doc_id % 2) / 2 as bigint)')} as stock_code, doc_id, 2020 + cast(doc_id % 4 as int) as fiscal_year, concat('p', cast(doc_id % 3 as string)) as profile_version,
               case when doc_id % 19 = 0 then 'failed' else 'ok' end as status, doc_id % 6 = 0 as is_holding, n_chars as tokens,
               text, cast(doc_id as bigint) as rcept_no,
               case doc_id % 4 when 0 then '0.1.9' when 1 then '0.2.0' when 2 then '0.10.0' else 'v0.3.0' end as parser_version
        from documents""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def check_sql(query: str) -> str:
    """The checking SQL with the domain tables that it names in front."""
    named = [n for n in TABLES if re.search(rf"\b{n}\b", query)]
    heads = [f"{n} AS ({TABLES[n].replace('ARR(', 'list_value(').replace('HOURS(', 'to_hours(')})" for n in named]
    if not heads:
        return query
    body = query.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {', '.join(heads)}, {body[4:]}"
    return f"WITH {', '.join(heads)} {body}"


class Tables:
    """Base and domain tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in TABLES:
            raise AttributeError(name)
        text = TABLES[name].replace("ARR(", "array(").replace("HOURS(", "make_interval(0, 0, 0, 0, ")
        source = re.search(r"\bfrom (\w+)(?: where|\s*$)", text.strip())[1]
        return self.spark.sql(re.sub(rf"\bfrom {source}\b", f"from {{{source}}}", text), **{source: getattr(self, source)})
