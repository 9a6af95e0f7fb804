"""Whole jobs: tables in, result tables out; clocks and dictionaries are parameters."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equityjobs.functions.dates import expected_trading_day
from equityjobs.operators import classify, collect, compare, coverage, lifecycle, prices
from equityjobs.operators.reports import in_scope, newest_in_scope, summary_invariants
from equityjobs.sources import sinks
from equityjobs.sources.scratch import scratch_path, stored


def price_snapshot(daily: DataFrame, quotes: DataFrame, stocks: DataFrame, arrival: list[str], since: date | None = None) -> DataFrame:
    """Q1: the latest priced row of every stock with period and excess returns.

    ``since`` (the look-back) reaches the scan as a pushed filter.
    """
    rows = daily if since is None else daily.filter(F.col("day") >= F.lit(since))
    snapshot = prices.snapshots(prices.usable_rows(rows, arrival), quotes, stocks)
    return prices.with_excess(snapshot, prices.market_medians(snapshot))


def market_coverage(rows: DataFrame, stocks: DataFrame, level: str, items: list[str], unit: str, include_oos: bool) -> dict[str, DataFrame]:
    """Q2: the market screen's tables."""
    inside = rows.filter(F.col("out_of_scope_reason").isNull())
    return {
        "totals": coverage.market_totals(rows),
        "available": coverage.available_items(rows, level),
        "coverage": coverage.sector_timeseries(inside, level, items, unit),
        "ranking": coverage.with_names(coverage.sector_ranking(inside, level, items), stocks),
        "types": coverage.report_type_timeseries(rows, unit, include_oos),
    }


def company_activity(rows: DataFrame, unit: str) -> dict[str, DataFrame]:
    """Q2: every company's timeline, publishers and totals."""
    held = rows.withColumn("code", F.explode(F.array_distinct("stock_codes")))
    return {
        "timeline": coverage.dense(coverage.stock_timeseries(rows, unit), ["code"], unit),
        "publishers": coverage.publisher_distribution(held, ["code"]),
        "totals": held.groupBy("code").agg(F.count(F.lit(1)).alias("total")),
    }


def freshness(runs: DataFrame, reports: DataFrame, now: datetime, stale_days: int = 3) -> DataFrame:
    """Q10: one row: last prices and newest report, whether they are stale, and why the prices are."""
    latest = prices.latest_runs(runs).select(F.col("ok_as_of").alias("as_of"), "status")
    newest = newest_in_scope(reports)
    moment = F.lit(now).cast("timestamp")
    behind = F.concat(F.lit("주가가 "), F.month("as_of"), F.lit("월 "), F.day("as_of"), F.lit("일 기준으로 밀려 있습니다. 휴장일이면 정상입니다"))
    note = (
        F.when(F.col("as_of").isNull(), "주가를 갱신한 적이 없습니다").when(F.col("status") == "failed", "마지막 주가 갱신이 실패했습니다")
        .when(F.col("as_of") < expected_trading_day(moment), behind)
    )
    late = F.col("latest_at").isNull() | (F.col("latest_at") < moment - F.expr(f"interval {stale_days} days"))
    both = latest.join(F.broadcast(newest))  # one row each
    return both.select("as_of", "status", note.isNotNull().alias("prices_stale"), note.alias("note"), "latest_at", late.alias("reports_stale"))


def ground_summaries(metrics: DataFrame, pages: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q9: grounded metrics, and summaries with tidy pages and the invariant's verdict."""
    return compare.ground_metrics(metrics, pages), summary_invariants(summaries)


def compare_reports(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    """Q8: revisions between every report and the previous one of its stock."""
    linked = compare.previous_reports(reports).filter("prev_report_id is not null")
    pairs = linked.select(F.col("prev_report_id").alias("previous_id"), F.col("id").alias("current_id")).distinct()
    return compare.revisions(pairs, metrics)


def price_run(targets: DataFrame, daily: DataFrame, quotes: DataFrame, before: DataFrame, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row about the run, the snapshot table after it).

    ``daily`` holds what the run received; ``before`` is the snapshot table up to now. Stocks that were not received keep their
    stored row, flagged; a failed run changes nothing. The one row decides, so it is computed here.
    """
    received = stored(price_snapshot(daily, quotes, targets, arrival), "received")
    summary = stored(prices.run_summary(targets, received), "run")
    failed = summary.first()["status"] == "failed"  # one row
    return summary, before if failed else prices.merge_run(received, before.select(*received.columns))


def classify_reports(extractions: DataFrame, publishers: DataFrame, stocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classified rows of a batch, and their counts by status, confidence, reason and mark."""
    rows = stored(classify.classified(extractions, publishers, stocks), "classified")
    return rows, classify.batch_report(rows)


def report_counts(rows: DataFrame, stocks: DataFrame, day: str) -> DataFrame:
    """The report label of every listed company."""
    return coverage.report_counts(rows.filter(in_scope()), stocks, day)


def collect_increment(messages: DataFrame, reports: DataFrame, attempts: DataFrame, now: datetime | None = None, initial_days: int = 30) -> DataFrame:
    """Q11: what to fetch: failed messages first, then new ones above each chat's high-water mark.

    With ``now``, a chat without history gives the messages of its last ``initial_days`` days.
    """
    return collect.increment(messages, reports, attempts, None if now is None else now - timedelta(days=initial_days))


def requeue(selected_from: DataFrame, current: DataFrame, publishers: DataFrame, columns: list[str], backup: str, criteria: tuple[str, ...] = lifecycle.CRITERIA, table: str | None = None) -> DataFrame:
    """Q12: rows that meet a criterion go back to pending, after a backup; returns them (with met) out of the table after the run.

    ``selected_from`` is the table (with ``renders``) that rows meeting a criterion are picked from, ``current`` the table now. The
    picked rows are backed up under the path ``backup`` (S6 lines) and the backup is read back and counted before anything is
    reset. Of them, those that are unchanged in ``columns`` and still meet a criterion are reset, and just these: the table is
    written (under the path ``table``, else to the scratch folder), read as it was written and compared with what was to change, and a
    difference is an error.
    """
    both = selected_from.withColumn("_now", F.lit(False)).unionByName(current.withColumn("_now", F.lit(True)))
    judged = stored(lifecycle.met_criteria(both, publishers, criteria).filter(F.size("met") > 0), "judged")
    picked, still = (judged.filter(side).drop("_now") for side in (~F.col("_now"), F.col("_now")))
    cells = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in picked.schema if f.name in ("id", *columns)]
    sinks.write_backup(picked.select(*cells), backup)
    wanted, written = picked.count(), sinks.read_backup(picked.sparkSession, backup, len(cells)).count()
    if written != wanted:
        raise RuntimeError(f"the backup has {written} of {wanted} rows; nothing was reset")
    same = (F.col("c.id") == F.col("b.id")) & lifecycle.same_row("c", "b", columns)
    kept = stored(still.alias("c").join(picked.alias("b"), same, "left_semi"), "kept")
    rest = current.join(kept.select("id"), "id", "left_anti").select(*current.columns)
    whole, path = rest.unionByName(lifecycle.reset_shape(kept.drop("met")).select(*current.columns)), table or scratch_path(current.sparkSession, "requeued")
    whole.write.parquet(path)
    after = current.sparkSession.read.schema(whole.schema).parquet(path)
    changed = lifecycle.changed_rows(current, after, "tagging_status")
    counts = {"rows": (current.count(), after.count()), "reset rows": (kept.filter("tagging_status <> 'pending'").count(), changed.count())}
    for what, (expected, found) in counts.items():
        if expected != found:
            raise RuntimeError(f"the table has {found} {what} after the run instead of {expected}")
    return after.join(kept.select("id", "met"), "id")
