"""Queries over terms, texts and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityjobs.catalog.registry import query
from equityjobs.functions import texts
from equityjobs.operators import filings, terms

SYNONYMS = {"the": ["and", "of"], "une": ["le", "la"]}
DISPLAYS = {"the": "The!", "une": "Une"}
KEY = "CASE WHEN lower(raw) IN ('and','of') THEN 'the' WHEN lower(raw) IN ('le','la') THEN 'une' ELSE lower(raw) END"
RAW = "raws AS (SELECT doc_id, stock_code, status, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS raw, unnest(range(len(regexp_extract_all(text, '[A-Za-z]+')))) AS pos FROM profiles)"
KEYED = f"{RAW}, keyed AS (SELECT *, {KEY} AS key FROM raws)"
TABLE = f"{KEYED}, tt AS (SELECT key, CASE key WHEN 'the' THEN 'The!' WHEN 'une' THEN 'Une' ELSE arg_min(raw, (doc_id, pos)) END AS display, count(DISTINCT doc_id) AS companies FROM keyed WHERE status = 'ok' GROUP BY key)"


def displays():
    return F.create_map(*[F.lit(x) for p in DISPLAYS.items() for x in p])


def spellings():
    return texts.spelling_map(SYNONYMS)


def with_terms(t):
    """Profiles with the words of their whole texts; dealt anew before these are cut, since a file may be read by one task."""
    return t.profiles.repartition("doc_id").withColumn("terms", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))


def term_table(t):
    return terms.term_table(with_terms(t).filter("status = 'ok'"), spellings(), displays(), ["doc_id"])


@query("a13_term_table", f"WITH {TABLE} SELECT key, display, companies FROM tt")
def _(t):
    return term_table(t)


@query("f3_squash", "SELECT doc_id, regexp_replace(lower(text), '[\\s·ㆍ・‧∙⋅\\-‐‑‒–−﹣－]+', '', 'g') AS squashed FROM profiles")
def _(t):
    return t.profiles.select("doc_id", texts.squash(F.col("text")).alias("squashed"))


@query("f4_term_keys", f"WITH {KEYED} SELECT doc_id, pos, key FROM keyed")
def _(t):
    rows = with_terms(t).select("doc_id", F.posexplode("terms").alias("pos", "raw"))
    return rows.select("doc_id", "pos", texts.term_key(F.col("raw"), spellings()).alias("key"))


@query("f7_profile_terms", f"WITH {KEYED} SELECT doc_id, string_agg(key, '|' ORDER BY first) AS terms FROM (SELECT doc_id, key, min(pos) AS first FROM keyed GROUP BY 1, 2) x GROUP BY doc_id")
def _(t):
    return with_terms(t).filter(F.size("terms") > 0).select("doc_id", texts.term_keys(F.col("terms"), spellings()).alias("terms"))


@query("f5_spellings", f"WITH {RAW} SELECT DISTINCT raw AS term, CASE WHEN lower(raw) IN ('the','and','of') THEN 3 WHEN lower(raw) IN ('une','le','la') THEN 3 ELSE 1 END AS spellings FROM raws")
def _(t):
    found = terms.term_spellings(with_terms(t).select(F.explode("terms").alias("term")), SYNONYMS)
    return found.select("term", F.size("spellings").alias("spellings"))


@query("f6_spelling_violations", "SELECT k AS key, count(DISTINCT s) AS standards FROM (SELECT lower(replace(name, ' ', '')) AS k, lower(sector_major) AS s FROM stocks) x GROUP BY k HAVING count(DISTINCT s) > 1")
def _(t):
    return terms.spelling_violations(t.stocks.select(F.col("name").alias("spelling"), F.col("sector_major").alias("standard")))


#: What a document is said to contain: the words of the next document, looked for in its own whole text.
_SAID = "said AS (SELECT p.doc_id, r.pos, r.raw FROM raws r JOIN profiles p ON p.doc_id = r.doc_id - 1)"
_HAY = "regexp_replace(lower(text), '[\\s·ㆍ・‧∙⋅\\-‐‑‒–−﹣－]+', '', 'g')"


def with_said_terms(t):
    """Both texts of a document are dealt by its number, and words are cut where they are looked for."""
    said = t.profiles.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("_said")).repartition("doc_id")
    none = F.expr("cast(array() as array<string>)")
    both = t.profiles.select("doc_id", "text").repartition("doc_id").join(said, "doc_id", "left")
    return both.select("doc_id", "text", F.coalesce(F.regexp_extract_all("_said", F.lit("([A-Za-z]+)"), F.lit(1)), none).alias("terms"))


@query("f8_grounding", f"""
    WITH {RAW}, {_SAID}, hay AS (SELECT doc_id, {_HAY} AS hay FROM profiles),
    hit AS (SELECT r.doc_id, r.pos, r.raw, CASE WHEN lower(raw) IN ('the','and','of') THEN contains(hay, 'the') OR contains(hay, 'and') OR contains(hay, 'of')
        WHEN lower(raw) IN ('une','le','la') THEN contains(hay, 'une') OR contains(hay, 'le') OR contains(hay, 'la') ELSE contains(hay, lower(raw)) END AS ok FROM said r JOIN hay h ON h.doc_id = r.doc_id)
    SELECT p.doc_id, coalesce(string_agg(raw, '|' ORDER BY pos) FILTER (WHERE ok), '') AS kept_terms, count(raw) AS given,
           round(CASE WHEN count(raw) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE ok) / count(raw) END, 6) AS grounding_ratio,
           CASE WHEN count(raw) = 0 THEN false ELSE count(*) FILTER (WHERE ok) / count(raw) < 0.8 END AS ask_again
    FROM profiles p LEFT JOIN hit ON hit.doc_id = p.doc_id GROUP BY p.doc_id""")
def _(t):
    return terms.grounded_terms(with_said_terms(t), SYNONYMS)


@query("a25_grounding_ratio", f"WITH {RAW}, {_SAID}, h AS (SELECT doc_id, {_HAY} AS hay FROM profiles) SELECT round(sum(CASE WHEN contains(hay, lower(raw)) THEN 1 ELSE 0 END) / count(*), 6) AS ratio, count(*) AS given FROM said JOIN h ON h.doc_id = said.doc_id")
def _(t):
    found = terms.grounded_terms(with_said_terms(t), {})
    return found.agg((F.sum(F.size("kept_terms")) / F.sum("given")).alias("ratio"), F.sum("given").cast("long").alias("given"))


@query("f9_caps", f"""
    WITH {KEYED}, firsts AS (SELECT doc_id, key, min(pos) AS pos, arg_min(raw, pos) AS raw FROM keyed GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM firsts)
    SELECT doc_id, string_agg(raw, '|' ORDER BY pos) AS products, CASE WHEN doc_id % 150 <= 100 THEN CAST(doc_id % 150 AS DOUBLE) ELSE -1.0 END AS share FROM r WHERE n <= 12 GROUP BY doc_id""")
def _(t):
    rows = with_terms(t).filter(F.size("terms") > 0)
    return rows.select("doc_id", terms.tidy(F.col("terms"), 12, spellings()).alias("products"), terms.capped_share(F.col("doc_id") % 150).alias("share"))


@query("w7_segment_order", """
    SELECT code, seg_no, CAST(row_number() OVER (PARTITION BY code ORDER BY share < 0, CASE WHEN share >= 0 THEN -share END, seg_no) AS BIGINT) AS place FROM segment_vectors""")
def _(t):
    return terms.ordered_segments(t.segment_vectors.select("code", "seg_no", "share"), ["code"]).select("code", "seg_no", "place")


@query("f12_embedding_texts", f"""
    WITH {RAW} SELECT p.doc_id, '업종: N' || (p.doc_id % 7) || chr(10) || '요약: S' || chr(10) || '제품: a, b' || chr(10) || '키워드: ' || chr(10) || '사업부문: seg' ||
        CASE WHEN p.doc_id % 5 = 0 THEN '' ELSE '(' || CASE p.doc_id % 4 WHEN 0 THEN '50' WHEN 1 THEN '98.1' WHEN 2 THEN '0.25' ELSE '0' END || '%)' END || ': a, b' || chr(10) || '적용처: c' AS text FROM profiles p""")
def _(t):
    share = F.when(F.col("doc_id") % 5 == 0, -1.0).when(F.col("doc_id") % 4 == 0, 50.0).when(F.col("doc_id") % 4 == 1, 98.1).when(F.col("doc_id") % 4 == 2, 0.25).otherwise(0.0)
    ab, c, none = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.expr("cast(array() as array<string>)")
    segment = F.array(F.struct(F.lit("seg").alias("name"), share.alias("revenue_share_pct"), ab.alias("products")))
    profile = F.struct(F.concat(F.lit("N"), F.col("doc_id") % 7).alias("niche_industry"), F.lit("S").alias("summary"), ab.alias("products"), none.alias("keywords"), segment.alias("segments"), c.alias("applications"))
    return t.profiles.withColumn("profile", profile).select("doc_id", terms.company_text().alias("text"))


@query("f19_query_terms", "SELECT code, CASE WHEN contains(name, ' ') THEN replace(name, ' ', '') || '|' || replace(name, ' ', '|') ELSE name END AS keys FROM stocks")
def _(t):
    return t.stocks.select("code", texts.query_terms(F.col("name"), spellings()).alias("keys"))


@query("f24_filename_tags", "SELECT id, CASE WHEN id % 13 = 0 OR id % 5 = 3 THEN NULL WHEN id % 5 = 0 THEN 'pubd' WHEN id % 5 = 1 THEN 'pube' WHEN id % 5 = 2 THEN 'Zeta+X' ELSE 'No One' END AS tag FROM reports")
def _(t):
    return t.reports.select("id", texts.filename_tag(F.col("file_name")).alias("tag"))


@query("f22_numbers", "SELECT id, line, 2 AS n, value AS largest FROM (SELECT id, line, CASE WHEN abs(value) > 7 THEN abs(value) ELSE 7 END AS value FROM metrics WHERE value IS NOT NULL AND abs(value) <> 7) x")
def _(t):
    said = F.concat(F.lit("from ("), F.lit("7"), F.lit(") to "), F.format_number(F.abs("value"), 2), F.lit(" won"))
    rows = t.metrics.filter("value is not null and abs(value) <> 7").select("id", "line", texts.numbers_in(said).alias("x"))
    return rows.select("id", "line", F.size("x").alias("n"), F.array_max(F.transform("x", F.abs)).alias("largest"))


@query("f30_split_products", "SELECT code, replace(name, ' ', '|') AS products FROM stocks")
def _(t):
    return t.stocks.select("code", texts.split_products(F.concat("products_text", F.lit(" 등, "))).alias("products"))


@query("f32_safe_file_names", "SELECT chat, message_id, CASE WHEN lower(file_name) LIKE '%.pdf' THEN file_name ELSE replace(replace(file_name, ':', '_'), '?', '_') || '.pdf' END AS file_name FROM messages")
def _(t):
    return t.messages.select("chat", "message_id", texts.safe_file_name(F.col("file_name")).alias("file_name"))


@query("f36_parser_versions", "SELECT parser_version, parser_version <> '0.1.9' AS supported, count(*) AS n FROM sections GROUP BY 1, 2")
def _(t):
    return t.sections.groupBy("parser_version", texts.supported_parser(F.col("parser_version")).alias("supported")).agg(F.count(F.lit(1)).alias("n"))


@query("f39_lookup_codes", "SELECT p_partkey, CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END AS code FROM part")
def _(t):
    return t.part.select("p_partkey", texts.lookup_code(F.col("p_partkey").cast("string")).alias("code"))


_YEAR = "y AS (SELECT * FROM sections WHERE is_final AND fiscal_year = 2024 AND parser_version <> '0.1.9')"


@query("s3_sections_of_year", f"WITH {_YEAR} SELECT doc_id, stock_code, section_code FROM y")
def _(t):
    return filings.sections_of_year(t.sections, 2024).select("doc_id", "stock_code", "section_code")


_FILED = f"{_YEAR}, f AS (SELECT stock_code, arg_max(rcept_no, (fiscal_end, rcept_no)) AS rcept_no, arg_max(corp_cls, (fiscal_end, rcept_no, section_code)) AS corp_cls, arg_max(corp_name, (fiscal_end, rcept_no, section_code)) AS corp_name, max(fiscal_end) AS fiscal_end FROM y GROUP BY stock_code)"


@query("w4_latest_filings", f"WITH {_FILED} SELECT stock_code, rcept_no, corp_cls, fiscal_end FROM f")
def _(t):
    return filings.latest_filings(filings.sections_of_year(t.sections, 2024)).select("stock_code", "rcept_no", "corp_cls", "fiscal_end")


@query("w5_newest_sections", """
    WITH s AS (SELECT stock_code, rcept_no - rcept_no % 2 AS rcept_no, section_code, parser_version, doc_id FROM sections)
    SELECT stock_code, rcept_no, section_code, parser_version FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, rcept_no, section_code
        ORDER BY CASE parser_version WHEN '0.1.9' THEN 1 WHEN '0.2.0' THEN 2 WHEN 'v0.3.0' THEN 3 ELSE 4 END DESC, doc_id DESC) AS n FROM s) x WHERE n = 1""")
def _(t):
    rows = t.sections.withColumn("rcept_no", F.col("rcept_no") - F.col("rcept_no") % 2)
    return filings.newest_sections(rows).select("stock_code", "rcept_no", "section_code", "parser_version")


_TARGETS = f"{_FILED}, targets_of AS (SELECT f.stock_code, f.rcept_no FROM f JOIN stocks s ON s.code = f.stock_code WHERE corp_cls IN ('Y','K') AND trim(s.sector_minor) <> 'Brand#3' AND NOT contains(corp_name, 'src7') AND NOT contains(s.name, 'ring'))"


def target_filings(t):
    return filings.targets(filings.latest_filings(filings.sections_of_year(t.sections, 2024)), t.stocks, "src7|ring", "Brand#3")


@query("j6_targets", f"WITH {_TARGETS} SELECT * FROM targets_of")
def _(t):
    return target_filings(t).select("stock_code", "rcept_no")


@query("u4_not_targets", f"WITH {_TARGETS} SELECT code FROM stocks WHERE code NOT IN (SELECT stock_code FROM targets_of)")
def _(t):
    return t.stocks.select("code").exceptAll(target_filings(t).select(F.col("stock_code").alias("code")))


@query("f10_assembled_inputs", """
    WITH w AS (SELECT stock_code, rcept_no, max(CASE section_code WHEN '020100' THEN t END) AS o, max(CASE section_code WHEN '020200' THEN t END) AS p, max(CASE section_code WHEN '020700' THEN t END) AS n,
                      max(CASE section_code WHEN '020400' THEN t END) AS s, max(CASE section_code WHEN '020800' THEN t END) AS f
               FROM (SELECT stock_code, rcept_no, section_code, trim(prose_text) AS t FROM sections) x GROUP BY 1, 2),
    b AS (SELECT stock_code, rcept_no, concat_ws(chr(10) || chr(10), CASE WHEN o <> '' THEN '[사업의 개요]' || chr(10) || substr(o, 1, 6000) END, CASE WHEN p <> '' THEN '[주요 제품 및 서비스]' || chr(10) || substr(p, 1, 2500) END,
                 CASE WHEN n <> '' AND length(coalesce(o, '')) < 800 THEN '[기타 참고사항]' || chr(10) || substr(n, 1, 3000) END, CASE WHEN s <> '' AND length(coalesce(o, '')) < 800 THEN '[매출 및 수주]' || chr(10) || substr(s, 1, 1500) END,
                 CASE WHEN f <> '' THEN '[영업의 현황]' || chr(10) || substr(f, 1, 6000) END) AS text,
                 coalesce(length(o) > 6000, false) OR coalesce(length(p) > 2500, false) OR (length(coalesce(o, '')) < 800 AND (coalesce(length(n) > 3000, false) OR coalesce(length(s) > 1500, false))) OR coalesce(length(f) > 6000, false) AS cut FROM w)
    SELECT stock_code, rcept_no, substr(text, 1, 12000) AS text, cut OR length(text) > 12000 AS truncated FROM b""")
def _(t):
    rows = t.sections.withColumn("table_text", F.lit(""))
    return filings.assembled_inputs(rows).select("stock_code", "rcept_no", "text", "truncated")


@query("f11_product_tables", """
    SELECT code, line_no % 4 = 0 AS is_table FROM stocks""")
def _(t):
    k = F.col("line_no") % 4
    good = F.concat(F.lit("품목 | 비중\n"), F.col("name"), F.lit(" | 12%\n기타 | -"))
    table = F.when(k == 0, good).when(k == 1, F.lit("품목 | 단가\na | 1")).when(k == 2, F.lit("구분 | 비중\na | b")).otherwise(F.lit("제품 | 1\n2 | 3\n4 | 5,000"))
    return t.stocks.select("code", filings.is_product_table(table).alias("is_table"))


@query("j7_profile_work", """
    WITH w AS (SELECT stock_code, rcept_no, parser_version FROM sections WHERE section_code = '020100'), d AS (SELECT stock_code, rcept_no, parser_version FROM profiles WHERE status = 'ok')
    SELECT w.*, EXISTS (SELECT 1 FROM d WHERE d.stock_code = w.stock_code AND d.rcept_no = w.rcept_no AND d.parser_version = w.parser_version) AS reused FROM w""")
def _(t):
    wanted = t.sections.filter("section_code = '020100'").select("stock_code", "rcept_no", "parser_version")
    todo, reused = filings.profile_work(wanted, t.profiles)
    return todo.withColumn("reused", F.lit(False)).unionByName(reused.withColumn("reused", F.lit(True)))


@query("j8_missing_embeddings", "SELECT doc_id FROM profiles WHERE status = 'ok' AND stock_code NOT IN (SELECT code FROM vectors WHERE grp < 5)")
def _(t):
    return filings.missing_embeddings(t.profiles, t.vectors.filter("grp < 5").select(F.col("code").alias("stock_code")), ["stock_code"]).select("doc_id")


@query("a17_inspection", """
    SELECT fiscal_year, profile_version, status, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, grouping(status) AS is_total
    FROM profiles GROUP BY GROUPING SETS ((fiscal_year, profile_version, status), ())""")
def _(t):
    from equityjobs.operators import lifecycle

    return lifecycle.inspection(t.profiles)
