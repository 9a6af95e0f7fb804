"""Queries over classification, collection and status changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from equityjobs.catalog.registry import query
from equityjobs.catalog.reports import MOMENT
from equityjobs.functions import dates, numbers
from equityjobs.operators import classify, collect, lifecycle
from equityjobs.plans import jobs
from equityjobs.schemas import SNAPSHOT_COLUMNS
from equityjobs.sources import sinks

#: Extraction answers built from reports: both engines derive the same fields.
_X = """
    x AS (SELECT id, file_name, sent_at, published_at, CASE WHEN id % 17 = 0 THEN 'IR자료' WHEN id % 19 = 0 THEN NULL WHEN id % 5 = 0 THEN '전략·시황' ELSE coalesce(report_type, '기타') END AS rt, stock_codes, id % 23 = 0 AS fo, id % 29 = 0 AS fu, id % 31 = 0 AS di, id % 7 = 0 AS pr,
                 CASE id % 3 WHEN 0 THEN 'low' ELSE 'high' END AS sc, publisher, id % 41 = 0 AS unread, CASE WHEN id % 43 = 0 THEN 'length' END AS refusal, id % 11 = 0 AS img, title FROM reports)"""


def extractions(t):
    i = F.col("id")
    kind = F.when(i % 17 == 0, "IR자료").when(i % 19 == 0, F.lit(None)).when(i % 5 == 0, "전략·시황").otherwise(F.coalesce("report_type", F.lit("기타")))
    signals = F.struct((i % 23 == 0).alias("foreign_primary_coverage"), (i % 29 == 0).alias("etf_or_fund"), (i % 31 == 0).alias("digital_asset"), (i % 7 == 0).alias("private_company_likely"))
    codes = F.concat(F.array(F.lit("12345")), F.transform("stock_codes", lambda c: F.when(c % 4 == 0, F.concat(F.lit("9"), F.substring(c, 2, 5))).otherwise(c)))
    names = F.array(F.lit("Nobody"), F.concat(F.lit(" Small"), F.lit(" RING ")))
    body = F.struct(
        kind.alias("report_type"), F.col("title"), F.date_format("published_at", "yyyy-MM-dd").alias("published_at"), codes.alias("stock_codes_raw"), names.alias("company_names_raw"),
        F.col("publisher").alias("publisher_canon"), F.col("analysts"), signals.alias("oos_signals"), F.when(i % 3 == 0, "low").otherwise("high").alias("self_confidence"),
    )
    return t.reports.select("id", "file_name", "sent_at", F.to_json(body).alias("answer"), (i % 41 == 0).alias("unreadable"), F.when(i % 43 == 0, "length").alias("refusal"), (i % 11 == 0).alias("page_image"))


_CLASSIFIED = f"""{_X},
    cr AS (SELECT id, pos, CASE WHEN CAST(c AS BIGINT) % 4 = 0 THEN '9' || substr(c, 2, 5) ELSE c END AS code FROM (SELECT id, unnest(stock_codes) AS c, unnest(range(len(stock_codes))) AS pos FROM x) y),
    hit AS (SELECT id, min(pos) AS pos, s.code, any_value(s.name) AS name, any_value(s.sector_major) AS sma, any_value(s.sector_minor) AS smi, 0 AS way FROM cr JOIN stocks s ON s.code = cr.code GROUP BY id, s.code),
    byname AS (SELECT code, name, sector_major, sector_minor FROM stocks WHERE name = 'small ring' ORDER BY line_no LIMIT 1),
    nm AS (SELECT x.id, 1 AS pos, b.code, b.name, b.sector_major, b.sector_minor, 1 AS way FROM x, byname b WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.id = x.id AND h.code = b.code)),
    every_hit AS (SELECT * FROM hit UNION ALL SELECT * FROM nm),
    e AS (SELECT h.*, row_number() OVER (PARTITION BY h.id ORDER BY way, pos) AS k FROM every_hit h JOIN x ON x.id = h.id WHERE rt IS NOT NULL AND rt NOT IN ('산업','전략·시황')),
    e1 AS (SELECT e.* FROM e JOIN x ON x.id = e.id WHERE rt NOT IN ('단일종목','기타') OR k = 1),
    g AS (SELECT id, string_agg(code, '|' ORDER BY k) AS codes, string_agg(name, '|' ORDER BY k) AS names, min(CASE WHEN k = 1 THEN way END) AS way1, min(CASE WHEN k = 1 THEN name END) AS name1 FROM e1 GROUP BY id),
    lst AS (SELECT DISTINCT id FROM hit),
    p AS (SELECT x.*, g.codes, g.names, g.id IS NOT NULL AS matched, coalesce(rt = '단일종목' AND way1 = 0 AND lower(replace(name1, ' ', '')) <> 'smallring', false) AS mis, lst.id IS NOT NULL AS any_listed, pu.canonical AS pub, pu.publisher_type AS ptype,
                 CASE WHEN tp.canonical IS NOT NULL THEN CASE WHEN pu.canonical IS DISTINCT FROM tp.canonical THEN 'filename_mismatch' END WHEN pu.canonical IS NULL THEN 'unknown' END AS suspect
          FROM x LEFT JOIN g ON g.id = x.id LEFT JOIN lst ON lst.id = x.id LEFT JOIN publishers pu ON pu.canonical = x.publisher
          LEFT JOIN publishers tp ON tp.alias = CASE WHEN x.id % 13 = 0 THEN NULL WHEN x.id % 5 = 0 THEN 'pubd' WHEN x.id % 5 = 1 THEN 'pube' END),
    q AS (SELECT *, unread OR refusal IS NOT NULL OR rt IS NULL AS ur FROM p),
    q2 AS (SELECT *, CASE WHEN ur THEN NULL WHEN rt = 'IR자료' THEN 'ir_self' WHEN fo THEN 'foreign' WHEN fu THEN 'fund' WHEN di THEN 'digital' WHEN pr AND NOT any_listed THEN 'private' END AS oos FROM q),
    q3 AS (SELECT *, rt = '단일종목' AND NOT matched AS um, rt = '기타' AND sc = 'low' AS vague FROM q2),
    q4 AS (SELECT *, ur OR (oos IS NULL AND (um OR vague)) AS review,
                  CASE WHEN ur AND unread THEN 'first_page_unreadable' WHEN ur THEN 'llm_refusal:' || coalesce(refusal, '') WHEN oos IS NOT NULL THEN NULL WHEN um THEN 'krx_unmatched_in_scope:ipo_pending_or_unknown' WHEN vague THEN 'type_indeterminate' WHEN mis THEN 'krx_name_code_mismatch' END AS base FROM q3),
    cls AS (SELECT id, rt AS report_type, pub AS publisher, ptype AS publisher_type, CASE WHEN ur OR oos IS NOT NULL THEN NULL ELSE coalesce(published_at, CAST(sent_at + INTERVAL 9 HOUR AS DATE)) END AS published_at,
                   CASE WHEN ur OR oos IS NOT NULL THEN '' ELSE coalesce(codes, '') END AS stock_codes, CASE WHEN ur OR oos IS NOT NULL THEN '' WHEN matched THEN names WHEN rt IN ('산업','전략·시황') THEN '' ELSE 'Nobody| Small RING ' END AS company_names, oos AS out_of_scope_reason,
                   CASE WHEN review THEN 'review_needed' ELSE 'auto' END AS tagging_status,
                   CASE WHEN review THEN 'low' WHEN oos = 'private' OR (oos IS NULL AND (published_at IS NULL OR mis)) OR img OR suspect IS NOT NULL THEN 'medium' ELSE 'high' END AS tagging_confidence,
                   nullif(concat_ws(';', base, CASE WHEN img THEN 'page_image' END, 'publisher_suspect:' || suspect), '') AS tagging_notes FROM q4)"""


def classified(t):
    return jobs.classify_reports(extractions(t), t.publishers, t.stocks)[0]


@query("q4_classify_reports", f"WITH {_CLASSIFIED} SELECT id, report_type, publisher, publisher_type, CAST(published_at AS VARCHAR) AS published_at, stock_codes, company_names, out_of_scope_reason, tagging_status, tagging_confidence, tagging_notes FROM cls")
def _(t):
    return classified(t).select("id", "report_type", "publisher", "publisher_type", "published_at", "stock_codes", "company_names", "out_of_scope_reason", "tagging_status", "tagging_confidence", "tagging_notes")


@query("f26_oos_reasons", f"WITH {_CLASSIFIED} SELECT out_of_scope_reason, count(*) AS n FROM cls GROUP BY 1")
def _(t):
    return classified(t).groupBy("out_of_scope_reason").agg(F.count(F.lit(1)).alias("n"))


@query("f27_status_notes", f"WITH {_CLASSIFIED} SELECT tagging_status, tagging_confidence, tagging_notes, count(*) AS n FROM cls GROUP BY 1, 2, 3")
def _(t):
    return classified(t).groupBy("tagging_status", "tagging_confidence", "tagging_notes").agg(F.count(F.lit(1)).alias("n"))


@query("f29_published_fallback", f"WITH {_CLASSIFIED} SELECT id, CAST(published_at AS VARCHAR) AS published_at FROM cls WHERE published_at IS NOT NULL")
def _(t):
    return classified(t).filter("published_at is not null").select("id", "published_at")


@query("f37_parsed_answers", f"WITH {_X} SELECT id, rt AS report_type, sc AS self_confidence, fo AS foreign_primary_coverage, pr AS private_company_likely FROM x")
def _(t):
    return classify.parsed(extractions(t)).select("id", "report_type", "self_confidence", "foreign_primary_coverage", "private_company_likely")


@query("f25_publisher_checks", f"WITH {_CLASSIFIED} SELECT id, pub AS publisher, ptype AS publisher_type, suspect AS publisher_suspect FROM p")
def _(t):
    return classify.with_publisher(classify.parsed(extractions(t)), t.publishers).select("id", "publisher", "publisher_type", "publisher_suspect")


@query("j5_canonical_names", "SELECT r.id, coalesce(p.canonical, a.canonical) AS canonical FROM (SELECT id, CASE WHEN id % 2 = 0 THEN publisher ELSE 'pub' || substr('abcdefghijklmnopq', CAST(id % 17 AS INT) + 1, 1) END AS name FROM reports) r LEFT JOIN publishers p ON p.canonical = r.name LEFT JOIN publishers a ON a.alias = r.name")
def _(t):
    name = F.when(F.col("id") % 2 == 0, F.col("publisher")).otherwise(F.concat(F.lit("pub"), F.substring(F.lit("abcdefghijklmnopq"), (F.col("id") % 17 + 1).cast("int"), F.lit(1))))
    return t.reports.select("id", name.alias("name")).join(classify.names_to_canonical(t.publishers), "name", "left").select("id", "canonical")


@query("j3_resolved_codes", f"WITH {_CLASSIFIED} SELECT id, matched, mis AS name_code_mismatch, coalesce(codes, '') AS stock_codes FROM p")
def _(t):
    return classify.resolved(classify.parsed(extractions(t)), t.stocks).select("id", "matched", "name_code_mismatch", "stock_codes")


@query("j4_enriched", f"WITH {_CLASSIFIED}, d AS (SELECT id, sma, min(k) AS k FROM e1 GROUP BY id, sma) SELECT x.id, coalesce((SELECT string_agg(sma, '|' ORDER BY k) FROM d WHERE d.id = x.id), '') AS sectors_major FROM x")
def _(t):
    return classify.resolved(classify.parsed(extractions(t)), t.stocks).select("id", "sectors_major")


@query("s2_stock_keys", "SELECT code, name, 'code' AS way FROM (SELECT *, row_number() OVER (PARTITION BY c2 ORDER BY line_no DESC) AS n FROM (SELECT *, CAST(line_no % 40 AS VARCHAR) AS c2 FROM stocks) y) x WHERE n = 1 UNION ALL SELECT code, name, 'name' FROM (SELECT *, row_number() OVER (PARTITION BY lower(replace(name, ' ', '')) ORDER BY line_no) AS n FROM stocks) x WHERE n = 1")
def _(t):
    by_code, _ = classify.keyed_stocks(t.stocks.withColumn("own", F.col("code")).withColumn("code", (F.col("line_no") % 40).cast("string")))
    _, by_name = classify.keyed_stocks(t.stocks)
    return by_code.select(F.col("own").alias("code"), "name", F.lit("code").alias("way")).unionByName(by_name.select("code", "name", F.lit("name").alias("way")))


@query("a19_batch_report", """
    WITH tok AS (SELECT split_part(n, ':', 1) AS t FROM (SELECT unnest(string_split(coalesce(tagging_notes, ''), ';')) AS n FROM reports) x)
    SELECT 'status' AS kind, tagging_status AS value, count(*) AS n FROM reports GROUP BY 2 UNION ALL SELECT 'confidence', tagging_confidence, count(*) FROM reports GROUP BY 2
    UNION ALL SELECT 'oos', out_of_scope_reason, count(*) FROM reports WHERE out_of_scope_reason IS NOT NULL GROUP BY 2
    UNION ALL SELECT CASE WHEN t IN ('page_image','publisher_suspect') THEN 'mark' ELSE 'review_reason' END, t, count(*) FROM tok WHERE t IN ('first_page_unreadable','llm_refusal','type_indeterminate','krx_unmatched_in_scope','page_image','publisher_suspect') GROUP BY 1, 2""")
def _(t):
    return classify.batch_report(t.reports)


_MET = """
    met_rows AS (SELECT r.id, tagging_status IN ('auto','review_needed') AS able, tagging_status = 'review_needed' AS rv, coalesce(tagging_notes, '') AS nt, r.publisher, r.publisher_type, k.canonical, k.publisher_type AS kt, tp.canonical AS tag_pub, r.id % 2 = 0 AS renders
        FROM reports r LEFT JOIN publishers k ON k.canonical = r.publisher LEFT JOIN publishers tp ON tp.alias = CASE WHEN r.id % 13 = 0 THEN NULL WHEN r.id % 5 = 0 THEN 'pubd' WHEN r.id % 5 = 1 THEN 'pube' END),
    met_of AS (SELECT id, CASE WHEN able THEN concat_ws('|', CASE WHEN rv AND starts_with(nt, 'first_page_unreadable') AND renders THEN 'unreadable' END, CASE WHEN publisher IS NOT NULL AND canonical IS NULL THEN 'publisher_not_in_dictionary' END,
        CASE WHEN NOT (contains(nt, 'publisher_suspect') OR starts_with(nt, 'first_page_unreadable') OR starts_with(nt, 'llm_refusal')) AND tag_pub IS NOT NULL AND publisher IS DISTINCT FROM tag_pub THEN 'publisher_filename_mismatch' END,
        CASE WHEN canonical IS NOT NULL AND publisher_type IS DISTINCT FROM kt THEN 'publisher_type_mismatch' END, CASE WHEN rv AND starts_with(nt, 'krx_unmatched_in_scope') THEN 'krx_unmatched' END) ELSE '' END AS met FROM met_rows)"""


def met(t):
    return lifecycle.met_criteria(t.reports.withColumn("renders", F.col("id") % 2 == 0), t.publishers)


@query("f31_requeue_criteria", f"WITH {_MET} SELECT id, met FROM met_of")
def _(t):
    return met(t).select("id", "met")


@query("a20_requeue_preview", f"WITH {_MET} SELECT criterion, count(*) AS n FROM (SELECT unnest(string_split(met, '|')) AS criterion FROM met_of WHERE met <> '') x GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM met_of WHERE met <> ''")
def _(t):
    return lifecycle.requeue_preview(met(t))


@query("a21_publisher_values", "SELECT coalesce(publisher, '(null)') AS publisher, count(*) AS n FROM reports GROUP BY 1")
def _(t):
    return lifecycle.publisher_values(t.reports)


@query("a21_unknown_tags", "SELECT tag, count(*) AS n FROM (SELECT CASE WHEN id % 5 = 2 THEN 'Zeta+X' ELSE 'No One' END AS tag FROM reports WHERE id % 13 <> 0 AND id % 5 IN (2, 4) AND tagging_status IN ('auto','review_needed','verified')) x GROUP BY tag")
def _(t):
    return lifecycle.unknown_filename_tags(t.reports, t.publishers)


@query("s5_upsert", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE title END AS title, publisher FROM reports WHERE id % 5 <> 0 OR id % 3 = 0".replace("title, publisher", "title, CASE WHEN id % 5 = 0 THEN NULL ELSE publisher END AS publisher"))
def _(t):
    stored = t.reports.filter("id % 5 <> 0").select("id", "title", "publisher")
    received = t.reports.filter("id % 3 = 0").select("id", F.lit("new").alias("title"))
    return lifecycle.upsert(stored, received, ["id"])


@query("s5_repeated_keys", """
    WITH sent AS (SELECT chat, message_id, arg_max(error, (failed_at, event_id)) AS error, max(failed_at) AS seen_at FROM attempts GROUP BY 1, 2)
    SELECT chat, message_id, error, CAST(seen_at AS VARCHAR) AS seen_at FROM sent UNION ALL
    SELECT r.chat, r.message_id, NULL, NULL FROM reports r WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.chat = r.chat AND s.message_id = r.message_id)""")
def _(t):
    """Every failure of a message is received; the last one is what is stored."""
    stored = t.reports.select("chat", "message_id", F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("seen_at"))
    order = F.struct(F.col("failed_at"), F.col("event_id"))
    received = t.attempts.select("chat", "message_id", "error", F.col("failed_at").cast("timestamp").alias("seen_at"), order.alias("no"))
    return lifecycle.upsert(stored.withColumn("no", F.lit(None).cast(received.schema["no"].dataType)), received, ["chat", "message_id"], "no").drop("no")


@query("f28_row_shapes", "SELECT id, 'oos' AS shape, NULL AS publisher_type, publisher, '' AS stock_codes, 'fund' AS out_of_scope_reason, tagging_status FROM reports WHERE false UNION ALL SELECT id, 'oos', publisher_type, publisher, '', 'fund', tagging_status FROM reports WHERE id % 3 = 0 UNION ALL SELECT id, 'reset', NULL, NULL, '', NULL, 'pending' FROM reports WHERE id % 3 = 1")
def _(t):
    columns = ("id", "shape", "publisher_type", "publisher", "stock_codes", "out_of_scope_reason", "tagging_status")
    a = lifecycle.oos_shape(t.reports.filter("id % 3 = 0"), F.lit("fund")).withColumn("shape", F.lit("oos"))
    return a.select(*columns).unionByName(lifecycle.reset_shape(t.reports.filter("id % 3 = 1")).withColumn("shape", F.lit("reset")).select(*columns))


def decisions(t):
    action = F.when(F.col("id") % 4 == 0, "verify").when(F.col("id") % 4 == 1, "oos").when(F.col("id") % 4 == 2, "retag").otherwise("delete")
    return t.reports.filter("id % 7 < 4").select(F.col("id").alias("decision"), "id", action.alias("action"), F.when(F.col("id") % 3 == 0, "digital").when(F.col("id") % 3 == 1, "moon").alias("reason"))


_ABLE = "able AS (SELECT id FROM reports WHERE id % 7 < 4 AND tagging_status = 'review_needed' AND (id % 4 IN (0, 2) OR (id % 4 = 1 AND id % 3 = 0)))"


@query("m5_review_apply", f"""
    WITH {_ABLE} SELECT r.id, CASE WHEN a.id IS NULL THEN tagging_status WHEN r.id % 4 = 2 THEN 'pending' ELSE 'verified' END AS tagging_status,
        CASE WHEN a.id IS NULL OR r.id % 4 = 0 THEN out_of_scope_reason WHEN r.id % 4 = 1 THEN 'digital' END AS out_of_scope_reason, CASE WHEN a.id IS NULL OR r.id % 4 = 0 THEN array_to_string(stock_codes, '|') ELSE '' END AS stock_codes
    FROM reports r LEFT JOIN able a ON a.id = r.id""")
def _(t):
    after, _ = lifecycle.reviewed(t.reports, decisions(t))
    return after.select("id", "tagging_status", "out_of_scope_reason", "stock_codes")


@query("m5_refused_decisions", f"WITH {_ABLE} SELECT id FROM reports WHERE id % 7 < 4 AND id NOT IN (SELECT id FROM able)")
def _(t):
    return lifecycle.reviewed(t.reports, decisions(t))[1].select("id")


_REPEATED = """
    made AS (SELECT id * 3 + n AS decision, id, n, CASE (id + n) % 4 WHEN 0 THEN 'verify' WHEN 1 THEN 'oos' WHEN 2 THEN 'retag' ELSE 'delete' END AS action,
        CASE (id + n) % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'moon' END AS reason FROM reports, (SELECT unnest([0, 1, 2]) AS n) x WHERE id % 7 < 4),
    firsts AS (SELECT m.id, min(decision) AS decision, arg_min(action, decision) AS action FROM made m JOIN reports r ON r.id = m.id
        WHERE tagging_status = 'review_needed' AND (action IN ('verify', 'retag') OR (action = 'oos' AND reason = 'digital')) GROUP BY 1)"""


def repeated_decisions(t):
    """Three decisions on each report, in the order of their numbers."""
    rows = t.reports.filter("id % 7 < 4").select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("n"))
    kind, reason = (F.col("id") + F.col("n")) % 4, (F.col("id") + F.col("n")) % 3
    action = F.when(kind == 0, "verify").when(kind == 1, "oos").when(kind == 2, "retag").otherwise("delete")
    return rows.select((F.col("id") * 3 + F.col("n")).alias("decision"), "id", action.alias("action"), F.when(reason == 0, "digital").when(reason == 1, "moon").alias("reason"))


@query("m5_repeated_decisions", f"""
    WITH {_REPEATED} SELECT 'row' AS part, r.id, CASE WHEN f.action IS NULL THEN tagging_status WHEN f.action = 'retag' THEN 'pending' ELSE 'verified' END AS detail
    FROM reports r LEFT JOIN firsts f ON f.id = r.id UNION ALL SELECT 'refused', decision, action FROM made WHERE decision NOT IN (SELECT decision FROM firsts)""")
def _(t):
    after, refused = lifecycle.reviewed(t.reports, repeated_decisions(t))
    rows = after.select(F.lit("row").alias("part"), "id", F.col("tagging_status").alias("detail"))
    return rows.union(refused.select(F.lit("refused"), "decision", "action"))


@query("m6_undo", f"WITH {_ABLE} SELECT id, CASE WHEN id IN (SELECT id FROM able) AND id % 5 = 0 THEN 'edited' ELSE title END AS title, tagging_status FROM reports".replace("tagging_status FROM reports", "CASE WHEN id IN (SELECT id FROM able) AND id % 5 = 0 THEN CASE WHEN id % 4 = 2 THEN 'pending' ELSE 'verified' END ELSE tagging_status END AS tagging_status FROM reports"))
def _(t):
    after, _ = lifecycle.reviewed(t.reports, decisions(t))
    touched = t.reports.filter("id % 7 < 4 and tagging_status = 'review_needed' and (id % 4 in (0, 2) or (id % 4 = 1 and id % 3 = 0))").select("id")
    current = after.join(touched.withColumn("_t", F.lit(True)), "id", "left").withColumn("title", F.when(F.col("_t") & (F.col("id") % 5 == 0), "edited").otherwise(F.col("title"))).drop("_t")
    columns = [c for c in SNAPSHOT_COLUMNS if c in t.reports.columns]
    back = lifecycle.undone(current, t.reports.join(touched, "id", "left_semi"), after.join(touched, "id", "left_semi"), columns)
    return back.select("id", "title", "tagging_status")


@query("m7_requeue", f"WITH {_MET} SELECT r.id, 'pending' AS tagging_status FROM reports r JOIN met_of m ON m.id = r.id WHERE m.met <> '' AND r.id % 6 <> 1")
def _(t):
    picked = met(t).filter(F.size("met") > 0).drop("met", "renders")
    current = t.reports.withColumn("title", F.when(F.col("id") % 6 == 1, "changed since").otherwise(F.col("title")))
    return lifecycle.guarded_reset(current, picked, ["title", "tagging_status", "publisher", "tagging_notes"]).select("id", "tagging_status")


@query("j18_unchanged_rows", "SELECT id FROM reports WHERE id % 6 <> 1")
def _(t):
    current = t.reports.withColumn("title", F.when(F.col("id") % 6 == 1, "changed since").otherwise(F.col("title")))
    return lifecycle.guarded_reset(current, t.reports, ["title", "publisher"]).select("id")


@query("m4_stale_locks", "SELECT id, CASE WHEN tagging_status = 'processing' AND tagging_locked_at < TIMESTAMP '2000-01-01 00:00:00' THEN 'pending' ELSE tagging_status END AS tagging_status FROM reports")
def _(t):
    return lifecycle.recovered(t.reports, datetime(2000, 1, 1, 6), 6).select("id", "tagging_status")


@query("m4_silent_builds", "SELECT run_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-10 00:00:00' THEN 'failed' ELSE status END AS status FROM runs")
def _(t):
    return lifecycle.closed_builds(t.runs.withColumn("heartbeat_at", F.col("started_at").cast("timestamp")), datetime(2024, 1, 10, 6)).select("run_id", "status")


@query("m8_worker_reset", "SELECT id, CASE WHEN tagging_status = 'processing' AND tagging_worker_id = 'w1' THEN 'pending' ELSE tagging_status END AS tagging_status, CASE WHEN tagging_status = 'processing' AND tagging_worker_id = 'w1' THEN NULL ELSE tagging_worker_id END AS tagging_worker_id FROM reports")
def _(t):
    return lifecycle.worker_reset(t.reports, "w1").select("id", "tagging_status", "tagging_worker_id")


@query("m8_escalation", "SELECT id FROM reports WHERE tagging_status = 'review_needed' AND tagged_at >= TIMESTAMP '1999-06-01 00:00:00'")
def _(t):
    return lifecycle.escalation(t.reports, datetime(1999, 6, 1)).select("id")


@query("m9_profile_replacement", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND (doc_id % 2 = 0 OR status <> 'ok') THEN 'new' ELSE 'old' END AS version, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'ok' WHEN doc_id % 3 = 0 AND status <> 'ok' THEN 'failed' ELSE status END AS status FROM profiles""")
def _(t):
    stored = t.profiles.select("doc_id", "status", F.lit("old").alias("version"))
    received = t.profiles.filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("failed").alias("status"), F.lit("new").alias("version"))
    return lifecycle.replaced_profiles(stored, received, ["doc_id"], ["version"])[0]


@query("m9_repeated_profiles", """
    WITH sent AS (SELECT doc_id - doc_id % 4 AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, doc_id AS version FROM profiles WHERE doc_id % 8 < 4),
    best AS (SELECT doc_id, coalesce(max(version) FILTER (status = 'ok'), max(version)) AS version, max(status) AS status FROM sent GROUP BY 1)
    SELECT p.doc_id, CASE WHEN b.doc_id IS NULL OR (b.status <> 'ok' AND p.status = 'ok') THEN -1 ELSE b.version END AS version,
           CASE WHEN b.doc_id IS NULL OR (b.status <> 'ok' AND p.status = 'ok') THEN p.status ELSE b.status END AS status
    FROM profiles p LEFT JOIN best b ON b.doc_id = p.doc_id""")
def _(t):
    """Up to four rows of a key in one run."""
    stored = t.profiles.select("doc_id", "status", F.lit(-1).cast("long").alias("version"))
    status = F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("ok")
    received = t.profiles.filter("doc_id % 8 < 4").select((F.col("doc_id") - F.col("doc_id") % 4).alias("doc_id"), status.alias("status"), F.col("doc_id").alias("version"))
    return lifecycle.replaced_profiles(stored, received, ["doc_id"], ["version"])[0]


_DONE = "done AS (SELECT *, row_number() OVER (ORDER BY finished_no DESC, build_id DESC) AS n FROM builds WHERE status = 'done'), gone AS (SELECT build_id FROM done WHERE n > 3 UNION ALL SELECT build_id FROM builds WHERE status IN ('pilot','failed','incomplete') AND build_id < (SELECT min(build_id) FROM done WHERE n <= 3))"


@query("w14_retention", f"WITH {_DONE} SELECT build_id FROM gone")
def _(t):
    return lifecycle.dropped_builds(t.builds)


@query("w14_unused_keys", f"WITH {_DONE} SELECT DISTINCT p.fiscal_year, p.profile_version FROM profiles p WHERE p.profile_version <> 'p1' AND NOT EXISTS (SELECT 1 FROM builds b WHERE b.build_id NOT IN (SELECT build_id FROM gone) AND b.fiscal_year = p.fiscal_year AND b.profile_version = p.profile_version)")
def _(t):
    return lifecycle.unused_keys(t.profiles, t.builds, lifecycle.dropped_builds(t.builds), ["fiscal_year", "profile_version"], "p1")


@query("k8_recent_builds", "SELECT build_id, status FROM builds ORDER BY build_id DESC LIMIT 10")
def _(t):
    return t.builds.orderBy(F.desc("build_id")).limit(10).select("build_id", "status")


@query("a16_build_status", "SELECT fiscal_year, count(*) AS eligible, count(*) FILTER (WHERE status = 'ok') AS profiled, CASE WHEN fiscal_year = 2021 THEN 'pilot' WHEN count(*) FILTER (WHERE status = 'ok') * 100 >= count(*) * 95 THEN 'done' ELSE 'incomplete' END AS build_status FROM profiles GROUP BY fiscal_year")
def _(t):
    counts = t.profiles.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("status") == "ok").alias("profiled"))
    return counts.withColumn("build_status", numbers.build_status(F.col("eligible"), F.col("profiled"), F.col("fiscal_year") == 2021))


@query("f35_tree_fingerprint", """
    WITH h AS (SELECT sha256(code || chr(31) || name || chr(31) || coalesce(market, '')) AS hash FROM stocks), c AS (SELECT hash, count(*) AS n FROM h GROUP BY 1),
    b AS (SELECT substr(hash, 1, 3) AS bucket, sha256(string_agg(hash || '*' || n, chr(10) ORDER BY hash)) AS part FROM c GROUP BY 1)
    SELECT sha256(string_agg(bucket || '=' || part, chr(10) ORDER BY bucket)) AS fingerprint FROM b""")
def _(t):
    return lifecycle.tree_fingerprint(t.stocks.select("code", "name", "market"))


@query("f35_fingerprint", "SELECT sha256(string_agg(code || chr(31) || name || chr(31) || coalesce(market, ''), chr(10) ORDER BY code)) AS fingerprint FROM stocks")
def _(t):
    return lifecycle.fingerprint(t.stocks.select("code", "name", "market"), ["code"])


@query("s6_backup_lines", "SELECT id, CAST(id AS VARCHAR) AS first, concat_ws(',', '\"' || id || '\"', coalesce('\"' || publisher || '\"', ''), '\"' || replace(title, 'Report', '\"\"Report') || '\"') AS line FROM reports".replace("CAST(id AS VARCHAR) AS first, ", ""))
def _(t):
    rows = t.reports.withColumn("title", F.regexp_replace("title", "Report", '"Report'))
    return rows.select("id", sinks.backup_line(["id", "publisher", "title"]).alias("line"))


@query("s7_json_records", "SELECT id, '{\"id\":' || id || ',\"stock_codes\":[' || array_to_string(list_transform(stock_codes, lambda c: '\"' || c || '\"'), ',') || ']}' AS record FROM reports")
def _(t):
    return t.reports.select("id", sinks.json_record(["id", "stock_codes"]).alias("record"))


_M = "ms AS (SELECT * FROM messages), ch AS (SELECT DISTINCT chat FROM messages), seen AS (SELECT chat, message_id FROM reports UNION SELECT chat, message_id FROM attempts), hw AS (SELECT ch.chat, coalesce(max(seen.message_id), 0) AS high FROM ch LEFT JOIN seen ON seen.chat = ch.chat GROUP BY ch.chat)"


@query("p12_pdf_messages", "SELECT chat, message_id FROM messages WHERE mime = 'application/pdf' OR lower(file_name) LIKE '%.pdf'")
def _(t):
    return t.messages.filter(collect.has_pdf(F.col("mime"), F.array("file_name"))).select("chat", "message_id")


@query("a22_attempts", "SELECT chat, message_id, count(*) AS attempt_count, arg_max(error, (failed_at, event_id)) AS error, count(*) >= 10 AS warn FROM attempts GROUP BY 1, 2")
def _(t):
    return collect.attempt_log(t.attempts).select("chat", "message_id", "attempt_count", "error", "warn")


@query("a23_high_water", f"WITH {_M} SELECT * FROM hw")
def _(t):
    return collect.high_water(t.reports, t.attempts, t.messages)


@query("u2_seen_ids", "SELECT chat, message_id FROM reports UNION SELECT chat, message_id FROM attempts")
def _(t):
    return collect.seen_ids(t.reports, t.attempts)


@query("j9_backfill", "SELECT chat, message_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.chat = m.chat AND r.message_id = m.message_id) AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.chat = m.chat AND a.message_id = m.message_id)")
def _(t):
    return collect.backfill(t.messages, t.reports, t.attempts).select("chat", "message_id")


@query("q11_collect_increment", f"""
    WITH {_M}, pdf AS (SELECT * FROM ms WHERE mime = 'application/pdf' OR lower(file_name) LIKE '%.pdf')
    SELECT pdf.chat, pdf.message_id, 'new' AS turn FROM pdf JOIN hw ON hw.chat = pdf.chat WHERE pdf.message_id > hw.high
    UNION ALL SELECT chat, message_id, 'retry' FROM pdf WHERE (chat, message_id) IN (SELECT (chat, message_id) FROM attempts) AND (chat, message_id) NOT IN (SELECT (chat, message_id) FROM reports)""")
def _(t):
    return jobs.collect_increment(t.messages, t.reports, t.attempts).select("chat", "message_id", "turn")


_FIRST_RUN = """
    asked AS (SELECT (message_id - message_id % 100) // 100 % 6 AS chat, message_id, mime, file_name, sent_at FROM messages),
    pdf AS (SELECT * FROM asked WHERE mime = 'application/pdf' OR lower(file_name) LIKE '%.pdf'),
    seen AS (SELECT chat, message_id FROM reports UNION SELECT chat, message_id FROM attempts),
    hw AS (SELECT a.chat, coalesce(max(s.message_id), 0) AS high FROM (SELECT DISTINCT chat FROM asked) a LEFT JOIN seen s ON s.chat = a.chat GROUP BY 1),
    fetched AS (SELECT CAST(pdf.chat AS BIGINT) AS chat, pdf.message_id, 'new' AS turn FROM pdf JOIN hw ON hw.chat = pdf.chat WHERE pdf.message_id > hw.high AND (hw.high > 0 OR sent_at >= TIMESTAMP '2024-01-03 00:00:00')
        UNION ALL SELECT CAST(chat AS BIGINT), message_id, 'retry' FROM pdf WHERE (chat, message_id) IN (SELECT (chat, message_id) FROM attempts) AND (chat, message_id) NOT IN (SELECT (chat, message_id) FROM reports))"""


def messages_of_more_chats(t):
    """Two of the six chats have no history."""
    return t.messages.withColumn("chat", F.expr("(message_id - message_id % 100) div 100 % 6"))


@query("q11_first_run", f"WITH {_FIRST_RUN} SELECT * FROM fetched")
def _(t):
    found = jobs.collect_increment(messages_of_more_chats(t), t.reports, t.attempts, datetime(2024, 2, 2), 30)
    return found.select("chat", "message_id", "turn")


@query("m1_increment_counts", f"WITH {_M} SELECT count(*) FILTER (WHERE message_id % 3 = 0) AS processed, count(*) FILTER (WHERE message_id % 3 = 1) AS skipped, count(*) FILTER (WHERE message_id % 3 = 2) AS failed, 0 AS retried FROM ms JOIN hw USING (chat) WHERE message_id > high AND (mime = 'application/pdf' OR lower(file_name) LIKE '%.pdf')".replace("0 AS retried", "CAST(0 AS BIGINT) AS retried"))
def _(t):
    fetched = collect.increment(t.messages, t.reports, t.attempts).filter("turn = 'new'")
    outcome = F.element_at(F.array(F.lit("processed"), F.lit("skipped"), F.lit("failed")), (F.col("message_id") % 3 + 1).cast("int"))
    return collect.run_counts(fetched.withColumn("outcome", outcome))


@query("f34_expected_days", "SELECT event_id, CAST(CASE WHEN isodow(k) <= 5 AND hour(k) >= 20 THEN CAST(k AS DATE) WHEN isodow(k) = 1 THEN CAST(k AS DATE) - 3 WHEN isodow(k) = 7 THEN CAST(k AS DATE) - 2 ELSE CAST(k AS DATE) - 1 END AS VARCHAR) AS day FROM (SELECT event_id, ts + INTERVAL 9 HOUR AS k FROM events) x".replace("isodow(k)", "date_part('isodow', k)"))
def _(t):
    return t.events.select("event_id", dates.expected_trading_day(F.col("ts").cast("timestamp")).alias("day"))


@query("q10_freshness", """
    SELECT CAST(r.as_of AS VARCHAR) AS as_of, r.status, r.as_of < DATE '2001-07-31' OR r.status = 'failed' AS prices_stale,
           CASE WHEN r.status = 'failed' THEN '마지막 주가 갱신이 실패했습니다' WHEN r.as_of < DATE '2001-07-31' THEN '주가가 ' || month(r.as_of) || '월 ' || day(r.as_of) || '일 기준으로 밀려 있습니다. 휴장일이면 정상입니다' END AS note,
           (SELECT max(sent_at) FROM reports WHERE tagging_status IN ('auto','verified') AND out_of_scope_reason IS NULL) < TIMESTAMP '2001-07-29 03:00:00' AS reports_stale
    FROM (SELECT arg_max(status, (started_at, run_id)) AS status, arg_max(as_of, (started_at, run_id)) FILTER (WHERE status IN ('ok','partial')) AS as_of FROM runs) r""")
def _(t):
    return jobs.freshness(t.runs, t.reports, MOMENT).select("as_of", "status", "prices_stale", "note", "reports_stale")
