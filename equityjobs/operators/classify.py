"""Extraction results to classified report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions.dates import korean_date
from equityjobs.functions.texts import filename_tag, split_products, valid_code
from equityjobs.schemas import CONFIDENCES, OOS_CLEARED_ARRAYS, REPORT_TYPES

EXTRACTION = (
    "report_type string, title string, published_at string, stock_codes_raw array<string>, company_names_raw array<string>, publisher_canon string, "
    "analysts array<string>, oos_signals struct<foreign_primary_coverage: boolean, etf_or_fund: boolean, digital_asset: boolean, private_company_likely: boolean>, "
    "self_confidence string, notes string"
)
NO_TEXTS = "cast(array() as array<string>)"


def parsed(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """the JSON answer as typed columns; values outside the value sets make the answer unreadable (null report type)."""
    raw = rows.withColumn("_x", F.from_json(answer, EXTRACTION)).select(*rows.columns, "_x.*")
    signals = [F.coalesce(F.col(f"oos_signals.{s}"), F.lit(False)).alias(s) for s in ("foreign_primary_coverage", "etf_or_fund", "digital_asset", "private_company_likely")]
    lists = [F.coalesce(F.col(c), F.expr(NO_TEXTS)).alias(c) for c in ("stock_codes_raw", "company_names_raw", "analysts")]
    kept = [F.when(F.col("report_type").isin(*REPORT_TYPES), F.col("report_type")).alias("report_type"), F.when(F.col("self_confidence").isin(*CONFIDENCES), F.col("self_confidence")).alias("self_confidence")]
    return raw.select(*rows.columns, *kept, "title", F.col("published_at").alias("published_raw"), *lists, "publisher_canon", *signals)


def with_publisher(rows: DataFrame, publishers: DataFrame) -> DataFrame:
    """The exact canonical publisher with its type, and what the file name's tag says against it.

    The dictionary is joined without a hint: Spark broadcasts it as long as it is small.
    """
    types = publishers.select(F.col("canonical").alias("publisher_canon"), F.col("canonical").alias("publisher"), "publisher_type").distinct()
    tags = names_to_canonical(publishers).select(F.col("name").alias("_tag"), F.col("canonical").alias("_pointed"))
    joined = rows.withColumn("_tag", filename_tag(F.col("file_name"))).join(types, "publisher_canon", "left").join(tags, "_tag", "left")
    suspect = F.when(F.col("_pointed").isNotNull(), F.when(~F.col("publisher").eqNullSafe(F.col("_pointed")), "filename_mismatch")).when(F.col("publisher").isNull(), "unknown")
    return joined.withColumn("publisher_suspect", suspect).drop("_tag", "_pointed")


def names_to_canonical(publishers: DataFrame) -> DataFrame:
    """Canonical names and aliases to the canonical name."""
    own = publishers.select(F.col("canonical").alias("name"), "canonical")
    return own.unionByName(publishers.select(F.col("alias").alias("name"), "canonical")).filter("name is not null").distinct()


def name_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?U)\s+", ""))


def keyed_stocks(stocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list by code (a repeated code keeps its last row) and by name (a repeated name keeps its first)."""
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("line_no")))
    by_code = stocks.withColumn("_n", last).filter("_n = 1").drop("_n")
    first = F.row_number().over(Window.partitionBy("name_key").orderBy("line_no"))
    by_name = stocks.withColumn("name_key", name_key(F.col("name"))).withColumn("_n", first).filter("_n = 1").drop("_n")
    return by_code, by_name


def resolved(rows: DataFrame, stocks: DataFrame) -> DataFrame:
    """Listed entries of each row, by type, and the final arrays built from them in order of appearance.

    ``any_listed`` says whether any given code is listed, whatever the type. The stock list is joined without a hint:
    Spark broadcasts it as long as it is small.
    """
    by_code, by_name = keyed_stocks(stocks)
    facts = ["code", "name", "sector_major", "sector_minor", "products_text"]
    looks = F.coalesce(F.col("report_type").isNotNull() & ~F.col("report_type").isin("산업", "전략·시황"), F.lit(False))
    codes = rows.select("id", F.posexplode("stock_codes_raw").alias("_pos", "code")).filter(valid_code(F.col("code")))
    found = codes.join(by_code.select(*facts), "code").withColumn("_way", F.lit(0))
    names = rows.filter(looks).select("id", F.posexplode("company_names_raw").alias("_pos", "_name")).withColumn("name_key", name_key(F.col("_name")))
    named = names.join(by_name.select("name_key", *facts), "name_key").withColumn("_way", F.lit(1))
    entry = F.struct("_way", "_pos", *facts)
    both = found.select("id", entry.alias("_e")).unionByName(named.select("id", entry.alias("_e")))
    listed = both.groupBy("id").agg(F.array_sort(F.collect_list("_e")).alias("_hits"), F.max(F.col("_e._way") == 0).alias("_any"))
    # A code counts where it comes first.
    firsts = F.filter("_hits", lambda e, i: F.array_position(F.transform("_hits", lambda x: x["code"]), e["code"]) == i + 1)
    single = F.col("report_type").isin("단일종목", "기타")
    joined = rows.join(listed, "id", "left").withColumn("_hits", F.when(looks & F.col("_hits").isNotNull(), firsts).otherwise(F.slice(F.coalesce("_hits", F.array(F.struct(
        F.lit(0).alias("_way"), F.lit(0).alias("_pos"), *[F.lit("").alias(c) for c in facts]))), 1, 0)))
    joined = joined.withColumn("_entries", F.when(single, F.slice("_hits", 1, 1)).otherwise(F.col("_hits")))
    skipped = F.coalesce(F.col("report_type").isin("산업", "전략·시황"), F.lit(False))
    matched = F.size("_entries") > 0

    def distinct(part: str) -> Column:
        return F.array_distinct(F.filter(F.transform("_entries", lambda e: e[part]), lambda x: F.coalesce(x, F.lit("")) != ""))

    own = F.transform("company_names_raw", name_key)
    mismatch = matched & (F.col("report_type") == "단일종목") & (F.get("_entries", F.lit(0))["_way"] == 0) & (F.size("company_names_raw") > 0) & ~F.array_contains(own, name_key(F.get("_entries", F.lit(0))["name"]))
    return joined.select(
        *rows.columns, skipped.alias("lookup_skipped"), matched.alias("matched"), F.coalesce("_any", F.lit(False)).alias("any_listed"), F.coalesce(mismatch, F.lit(False)).alias("name_code_mismatch"),
        F.transform("_entries", lambda e: e["code"]).alias("stock_codes"),
        F.when(matched, F.transform("_entries", lambda e: e["name"])).when(skipped, F.expr(NO_TEXTS)).otherwise(F.col("company_names_raw")).alias("company_names"),
        distinct("sector_major").alias("sectors_major"), distinct("sector_minor").alias("sectors_minor"),
        F.array_distinct(F.flatten(F.transform("_entries", lambda e: split_products(e["products_text"])))).alias("products"),
    )


def oos_reason(has_listed_code: Column) -> Column:
    """ir_self, foreign, fund, digital, then private unless a code is listed."""
    return (
        F.when(F.col("report_type") == "IR자료", "ir_self").when(F.col("foreign_primary_coverage"), "foreign").when(F.col("etf_or_fund"), "fund").when(F.col("digital_asset"), "digital")
        .when(F.col("private_company_likely") & ~has_listed_code, "private")
    )


def classified(extractions: DataFrame, publishers: DataFrame, stocks: DataFrame) -> DataFrame:
    """Q4: one classified row per extraction: routing, lookup, dates (F29), status, confidence and notes (F27), row shape.

    ``extractions``: id, file_name, sent_at, answer (JSON), unreadable, refusal, page_image.
    """
    rows = resolved(with_publisher(parsed(extractions), publishers), stocks)
    unread = F.coalesce("unreadable", F.lit(False)) | F.col("refusal").isNotNull() | F.col("report_type").isNull()
    reason = F.when(~unread, oos_reason(F.col("any_listed")))
    rows = rows.withColumn("_unread", unread).withColumn("out_of_scope_reason", reason)
    outside = F.col("out_of_scope_reason").isNotNull()
    given = F.to_date(F.when(F.col("published_raw").rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp("published_raw", F.lit("yyyy-MM-dd"))))
    unmatched = (F.col("report_type") == "단일종목") & ~F.col("matched")
    vague = (F.col("report_type") == "기타") & (F.coalesce("self_confidence", F.lit("")) == "low")
    review = F.col("_unread") | (~outside & (unmatched | vague))
    base = (
        F.when(F.col("_unread"), F.when(F.coalesce("unreadable", F.lit(False)), "first_page_unreadable").otherwise(F.concat(F.lit("llm_refusal:"), F.coalesce("refusal", F.lit("")))))
        .when(outside, None).when(unmatched, "krx_unmatched_in_scope:ipo_pending_or_unknown").when(vague, "type_indeterminate").when(F.col("name_code_mismatch"), "krx_name_code_mismatch")
    )
    weak = given.isNull() | F.col("name_code_mismatch")
    confidence = F.when(review, "low").when(outside, F.when(F.col("out_of_scope_reason") == "private", "medium").otherwise("high")).when(weak, "medium").otherwise("high")
    marked = F.coalesce("page_image", F.lit(False)) | F.col("publisher_suspect").isNotNull()
    notes = F.concat_ws(";", base, F.when(F.coalesce("page_image", F.lit(False)), "page_image"), F.when(F.col("publisher_suspect").isNotNull(), F.concat(F.lit("publisher_suspect:"), F.col("publisher_suspect"))))
    cleared = outside | F.col("_unread")
    return rows.select(
        "id", F.when(~cleared, F.coalesce(given, korean_date("sent_at"))).alias("published_at"), "report_type", "publisher", "publisher_type", "analysts", "title",
        "stock_codes_raw", "company_names_raw", *[F.when(cleared, F.expr(NO_TEXTS)).otherwise(F.col(c)).alias(c) for c in OOS_CLEARED_ARRAYS], "out_of_scope_reason",
        F.when(review, "review_needed").otherwise("auto").alias("tagging_status"), F.when(marked & (confidence == "high"), "medium").otherwise(confidence).alias("tagging_confidence"),
        F.nullif(notes, F.lit("")).alias("tagging_notes"),
    )


def batch_report(rows: DataFrame) -> DataFrame:
    """Counts by (kind, value): statuses, confidences, out-of-scope reasons, the four review reasons and marks."""
    reasons = ("first_page_unreadable", "llm_refusal", "type_indeterminate", "krx_unmatched_in_scope")
    tokens = F.transform(F.split(F.coalesce("tagging_notes", F.lit("")), ";"), lambda n: F.substring_index(n, ":", 1))
    kinds = F.array(
        F.struct(F.lit("status").alias("kind"), F.col("tagging_status").alias("value")), F.struct(F.lit("confidence").alias("kind"), F.col("tagging_confidence").alias("value")),
        F.struct(F.lit("oos").alias("kind"), F.col("out_of_scope_reason").alias("value")),
    )
    counted = F.filter(tokens, lambda n: n.isin(*reasons, "page_image", "publisher_suspect"))
    notes = F.transform(counted, lambda n: F.struct(F.when(n.isin(*reasons), "review_reason").otherwise("mark").alias("kind"), n.alias("value")))
    return rows.select(F.inline(F.concat(kinds, notes))).filter("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
