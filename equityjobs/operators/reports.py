"""Reading, filtering and checking report rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions.dates import effective_date
from equityjobs.schemas import IN_SCOPE_STATUSES, OOS_REASONS, PUBLISHER_TYPES, REPORT_TYPES, TAGGING_STATUSES


def in_scope() -> Column:
    """P1."""
    return F.col("tagging_status").isin(*IN_SCOPE_STATUSES) & F.col("out_of_scope_reason").isNull()


def period_rows(reports: DataFrame, start: date, include_oos: bool = False) -> DataFrame:
    """In-scope rows by published date; with out-of-scope rows, all final rows by effective date."""
    if include_oos:
        return reports.filter(F.col("tagging_status").isin(*IN_SCOPE_STATUSES) & (effective_date() >= F.lit(start)))
    return reports.filter(in_scope() & (F.col("published_at") >= F.lit(start)))


def rows_of_stock(reports: DataFrame, code: str) -> DataFrame:
    """P5."""
    return reports.filter(F.array_contains("stock_codes", code))


def rows_of_stocks(reports: DataFrame, codes: list[str]) -> DataFrame:
    """Rows that hold any of the codes; codes that are not letters and digits are left out."""
    asked = [c for c in dict.fromkeys(codes) if c.isalnum()]
    if not asked:
        return reports.limit(0)
    return reports.filter(F.arrays_overlap("stock_codes", F.array(*[F.lit(c) for c in asked])))


def rows_of_code_table(reports: DataFrame, codes: DataFrame, key: str = "id") -> DataFrame:
    """P6 for a code table of any size: exploded codes, semi-joined, then the rows by key."""
    hit = reports.select(key, F.explode("stock_codes").alias("code")).join(codes.select("code").distinct(), "code", "left_semi")
    return reports.join(hit.select(key).distinct(), key, "left_semi")


def public_reports(reports: DataFrame, summaries: DataFrame, version: str) -> DataFrame:
    """One row for each company and report with the summary of the active version, newest first."""
    current = summaries.filter(F.col("summary_version") == version)
    held = reports.select("*", F.explode(F.array_distinct("stock_codes")).alias("stock_code"))
    rank = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc_nulls_last("published_at"), F.desc("id")))
    return held.join(current, "id", "left").withColumn("newest", rank)


def library(rows: DataFrame, today: date, publisher: str | None = None, report_type: str | None = None, words: str | None = None, analysed: bool | None = None, months: int | None = None) -> DataFrame:
    """The report library's filters, each optional, over reports joined with summaries."""
    keep = F.lit(True)
    if publisher is not None:
        keep &= F.col("publisher") == publisher
    if report_type is not None:
        keep &= F.col("report_type") == report_type
    if words:
        text = F.lower(F.concat_ws(" ", "title", "one_line_summary"))
        keep &= F.contains(text, F.lit(words.lower()))
    if analysed is not None:
        keep &= F.col("summary_version").isNotNull() == F.lit(analysed)
    if months is not None:
        keep &= F.col("published_at") >= F.add_months(F.lit(today), -months)
    return rows.filter(keep)


def review_queue(reports: DataFrame, skipped: list[int], size: int = 1) -> DataFrame:
    """K5: the oldest rows in review that are not skipped."""
    waiting = reports.filter((F.col("tagging_status") == "review_needed") & ~F.col("id").isin(*skipped or [-1]))
    return waiting.orderBy(F.asc_nulls_last("tagged_at"), "id").limit(size)


def work_batch(reports: DataFrame, size: int) -> DataFrame:
    """K6: the oldest pending rows."""
    return reports.filter(F.col("tagging_status") == "pending").orderBy("downloaded_at", "id").limit(size)


def queue_distribution(reports: DataFrame, now: datetime) -> DataFrame:
    """Rows by status, out-of-scope rows, rows tagged within a day."""
    by_status = [F.count_if(F.col("tagging_status") == s).alias(s) for s in TAGGING_STATUSES]
    return reports.agg(
        *by_status, F.count_if(F.col("out_of_scope_reason").isNotNull()).alias("oos_total"),
        F.count_if(F.col("tagged_at") >= F.lit(now).cast("timestamp") - F.expr("interval 24 hours")).alias("last_24h"),
    )


def in_progress(reports: DataFrame, since: datetime) -> DataFrame:
    """A26."""
    return reports.filter((F.col("tagging_status") == "processing") & (F.col("tagging_locked_at") >= F.lit(since).cast("timestamp"))).agg(F.count(F.lit(1)).alias("n"))


def newest_in_scope(reports: DataFrame) -> DataFrame:
    """K7."""
    return reports.filter(in_scope()).agg(F.max("sent_at").alias("latest_at"))


def company_statistics(reports: DataFrame, summaries: DataFrame, version: str) -> DataFrame:
    """Reports, publishers, analysed, with details, latest target price of every company."""
    rows = public_reports(reports.filter(in_scope()), summaries, version)
    at = F.struct("published_at", "id")  # null is the smallest
    return rows.groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("reports"), F.count_distinct("publisher").alias("publishers"),
        F.count_if(F.col("summary_version").isNotNull()).alias("analysed"), F.count_if(F.coalesce("has_details", F.lit(False))).alias("with_details"),
        F.max_by("target_price_new", F.when(F.col("target_price_new").isNotNull(), at)).alias("latest_target"),
    )


def value_set_violations(reports: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows outside the value sets, by column."""
    sets = {"report_type": REPORT_TYPES, "out_of_scope_reason": OOS_REASONS, "publisher_type": PUBLISHER_TYPES, "tagging_status": TAGGING_STATUSES}
    bad = reports.agg(*[F.count_if(~F.col(c).isin(*values)).alias(c) for c, values in sets.items()])
    pages = summaries.agg(F.count_if(~F.forall("source_pages", lambda p: p >= 1)).alias("n")).select(F.lit("source_pages").alias("column_name"), "n")
    stacked = bad.unpivot([], list(sets), "column_name", "n")
    return stacked.unionByName(pages)


def fold_versions(reports: DataFrame, stray: list[str], target: str) -> DataFrame:
    """Stray version labels become one."""
    return reports.withColumn("taxonomy_version", F.when(F.col("taxonomy_version").isin(*stray), target).otherwise(F.col("taxonomy_version")))


def summary_invariants(summaries: DataFrame) -> DataFrame:
    """pages distinct and sorted; ``valid`` is false for a new target price without a raw text or a page."""
    pages = F.array_sort(F.array_distinct("source_pages"))
    proof = (F.coalesce("target_price_raw", F.lit("")) != "") | (F.size("source_pages") > 0)
    return summaries.withColumn("source_pages", pages).withColumn("valid", F.col("target_price_new").isNull() | proof)
