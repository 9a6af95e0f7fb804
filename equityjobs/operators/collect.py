"""Incremental collection from messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityjobs.functions.texts import safe_file_name


def has_pdf(mime: Column, names: Column) -> Column:
    """The MIME type, else any attribute's file name."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.exists(names, lambda n: F.coalesce(F.lower(n).endswith(".pdf"), F.lit(False)))


def seen_ids(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """U2."""
    return reports.select("chat", "message_id").unionByName(attempts.select("chat", "message_id")).distinct()


def high_water(reports: DataFrame, attempts: DataFrame, chats: DataFrame) -> DataFrame:
    """The largest seen message id of every chat, 0 when none."""
    marks = seen_ids(reports, attempts).groupBy("chat").agg(F.max("message_id").alias("high"))
    return chats.select("chat").distinct().join(marks, "chat", "left").select("chat", F.coalesce("high", F.lit(0)).alias("high"))


def attempt_log(attempts: DataFrame, warn: int = 10) -> DataFrame:
    """Attempts of each message, first and last time, the last error, and whether it is worth a warning."""
    return attempts.groupBy("chat", "message_id").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.min("failed_at").alias("first_failed_at"), F.max("failed_at").alias("last_failed_at"),
        F.max_by("error", F.struct("failed_at", "event_id")).alias("error"), (F.count(F.lit(1)) >= warn).alias("warn"),
    )


def backfill(messages: DataFrame, reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """PDF messages that were neither stored nor tried."""
    return messages.join(seen_ids(reports, attempts), ["chat", "message_id"], "left_anti")


def increment(messages: DataFrame, reports: DataFrame, attempts: DataFrame, first_since: datetime | None = None) -> DataFrame:
    """M1, Q11: what to fetch, by chat: failed messages first, then new ones above the high-water mark.

    A chat without history is on its first run: with ``first_since``, it gives the messages sent from then on only.
    """
    pdf = messages.filter(has_pdf(F.col("mime"), F.array("file_name"))).withColumn("file_name", safe_file_name(F.col("file_name")))
    stored = reports.select("chat", "message_id")
    retry = pdf.join(attempts.select("chat", "message_id").distinct(), ["chat", "message_id"], "left_semi").join(stored, ["chat", "message_id"], "left_anti").withColumn("turn", F.lit("retry"))
    recent = F.lit(True) if first_since is None else (F.col("high") > 0) | (F.col("sent_at") >= F.lit(first_since).cast("timestamp"))
    new = pdf.join(high_water(reports, attempts, messages), "chat").filter((F.col("message_id") > F.col("high")) & recent).drop("high").withColumn("turn", F.lit("new"))
    return retry.unionByName(new)


def run_counts(fetched: DataFrame) -> DataFrame:
    """Processed, skipped, failed and retried of a run, from (turn, outcome) rows."""
    return fetched.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("processed", "skipped", "failed")], F.count_if(F.col("turn") == "retry").alias("retried"))
