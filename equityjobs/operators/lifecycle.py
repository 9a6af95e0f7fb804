"""Merges, guarded status changes, requeue, review, retention and fingerprints."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions.texts import filename_tag
from equityjobs.operators.classify import NO_TEXTS, names_to_canonical
from equityjobs.schemas import CLASSIFICATION_ARRAYS, CLASSIFICATION_TEXTS, CLASSIFIED_STATUSES, OOS_CLEARED_ARRAYS, OOS_REASONS, TAGGING_META

CRITERIA = ("unreadable", "publisher_not_in_dictionary", "publisher_filename_mismatch", "publisher_type_mismatch", "krx_unmatched")


def one_per_key(received: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Received rows once per key: the last by ``order``; without an order, a key with two different rows is an error.

    Rows are compared by partial aggregation, so a key that was received very often is no task's whole load.
    """
    rest = [c for c in received.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    if order:
        found = received.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(order), row)).alias("_row"))
    else:
        differ = F.raise_error(F.lit(f"two different rows of one key ({', '.join(keys)}): name the column that orders them"))
        ends = received.groupBy(*keys).agg(F.min(row).alias("_row"), F.max(row).alias("_other"))
        found = ends.select(*keys, F.when(F.col("_row").eqNullSafe(F.col("_other")), F.col("_row")).otherwise(differ).alias("_row"))
    return found.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def upsert(stored: DataFrame, received: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Received rows replace stored ones by key; columns that were not sent keep their values.

    Of a key that was received more than once, the last row by the column ``order`` counts (see ``one_per_key``).
    """
    if set(received.columns) - set(keys):
        received = one_per_key(received, keys, order)
    else:
        received = received.distinct()
    new = received.select(*[F.col(c).alias(f"_new_{c}" if c not in keys else c) for c in received.columns], F.lit(True).alias("_sent"))
    both = stored.join(new, keys, "full_outer")
    sent = set(received.columns) - set(keys)
    return both.select(*[F.when(F.col("_sent"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in sent else F.col(c) for c in stored.columns])


def _reset_values(rows: DataFrame) -> dict[str, Column]:
    values = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("published_at", *CLASSIFICATION_TEXTS, *TAGGING_META) if c in rows.columns}
    values |= {c: F.expr(NO_TEXTS) for c in CLASSIFICATION_ARRAYS if c in rows.columns}
    return {**values, "tagging_status": F.lit("pending")}


def _oos_values(rows: DataFrame, reason: Column) -> dict[str, Column]:
    cleared = {c: F.expr(NO_TEXTS) for c in OOS_CLEARED_ARRAYS if c in rows.columns}
    return {**cleared, "published_at": F.lit(None).cast("date"), "out_of_scope_reason": reason}


def reset_shape(rows: DataFrame) -> DataFrame:
    """rows as pending: classification and tagging meta emptied, collector columns kept."""
    return rows.withColumns(_reset_values(rows))


def oos_shape(rows: DataFrame, reason: Column) -> DataFrame:
    """out-of-scope rows: the reason, no published date, the six cleared columns."""
    return rows.withColumns(_oos_values(rows, reason))


def reviewed(reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: (rows after the decisions, refused decisions).

    ``decisions``: decision (a number, in the order they were made), id, action (verify, oos, retag), reason. Only a row
    still in review changes, so of several decisions on it the first valid one counts; the others, decisions on other rows,
    unknown actions and bad reasons are refused. Reports are joined and written once, whatever their action.
    """
    good = F.col("action").isin("verify", "retag") | ((F.col("action") == "oos") & F.col("reason").isin(*OOS_REASONS))
    waiting = reports.filter("tagging_status = 'review_needed'").select("id")
    able = decisions.filter(good).join(waiting, "id", "left_semi")
    first = able.groupBy("id").agg(F.min(F.struct("decision", "action", "reason")).alias("_first"))
    refused = decisions.join(first.select(F.col("_first.decision").alias("decision")), "decision", "left_anti")
    joined = reports.join(first.select("id", F.col("_first.action").alias("_action"), F.col("_first.reason").alias("_reason")), "id", "left")
    verified = {"tagging_status": F.lit("verified")}
    shapes = {"verify": verified, "oos": _oos_values(reports, F.col("_reason")) | verified, "retag": _reset_values(reports)}

    def after(column: str) -> Column:
        value = F.col(column)
        for action, values in shapes.items():
            if column in values:
                value = F.when(F.col("_action") == action, values[column]).otherwise(value)
        return value.alias(column)

    return joined.select(*map(after, reports.columns)), refused


def same_row(a: str, b: str, columns: list[str]) -> Column:
    """All columns equal, nulls included."""
    equal = F.lit(True)
    for c in columns:
        equal &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return equal


def undone(current: DataFrame, before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """M6: the before-snapshot where the current row still equals the after-snapshot, else the current row."""
    kept = [c for c in columns if c in current.columns and c != "id"]
    snapshots = after.alias("a").join(before.alias("b"), F.col("a.id") == F.col("b.id")).select(F.col("a.id").alias("id"), F.struct(*[F.col(f"a.{c}") for c in kept]).alias("_after"), F.struct(*[F.col(f"b.{c}") for c in kept]).alias("_before"))
    joined = current.alias("c").join(snapshots.alias("s"), F.col("c.id") == F.col("s.id"), "left")
    equal = F.col("s.id").isNotNull()
    for c in kept:
        equal &= F.col(f"c.{c}").eqNullSafe(F.col(f"s._after.{c}"))
    return joined.select(*[F.when(equal, F.col(f"s._before.{c}")).otherwise(F.col(f"c.{c}")).alias(c) if c in kept else F.col(f"c.{c}").alias(c) for c in current.columns])


def guarded_reset(current: DataFrame, backup: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the backup that are unchanged since, as pending."""
    kept = current.alias("c").join(backup.alias("b"), (F.col("c.id") == F.col("b.id")) & same_row("c", "b", columns), "left_semi")
    return reset_shape(kept)


def changed_rows(before: DataFrame, after: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Keys whose ``column`` differs between two versions of a table, or that only one of them has."""
    old, new = before.select(key, F.col(column).alias("_old")), after.select(key, F.col(column).alias("_new"))
    both = old.withColumn("_there", F.lit(True)).join(new.withColumn("_here", F.lit(True)), key, "full_outer")
    return both.filter(F.col("_there").isNull() | F.col("_here").isNull() | ~F.col("_old").eqNullSafe(F.col("_new"))).select(key)


def met_criteria(rows: DataFrame, publishers: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """``met``, the requeue criteria that each auto or review row meets (``renders``: its first page renders)."""
    types = publishers.select(F.col("canonical").alias("publisher"), F.col("publisher_type").alias("_type"), F.lit(True).alias("_known")).distinct()
    tags = names_to_canonical(publishers).select(F.col("name").alias("_tag"), F.col("canonical").alias("_pointed"))
    joined = rows.withColumn("_tag", filename_tag(F.col("file_name"))).join(types, "publisher", "left").join(tags, "_tag", "left")  # bounded dictionary
    notes, review = F.coalesce("tagging_notes", F.lit("")), F.col("tagging_status") == "review_needed"
    unread = notes.startswith("first_page_unreadable")
    rules = {
        "unreadable": review & unread & F.coalesce("renders", F.lit(False)),
        "publisher_not_in_dictionary": F.col("publisher").isNotNull() & F.col("_known").isNull(),
        "publisher_filename_mismatch": ~(F.contains(notes, F.lit("publisher_suspect")) | unread | notes.startswith("llm_refusal")) & F.col("_pointed").isNotNull() & ~F.col("publisher").eqNullSafe(F.col("_pointed")),
        "publisher_type_mismatch": F.col("_known").isNotNull() & ~F.col("publisher_type").eqNullSafe(F.col("_type")),
        "krx_unmatched": review & notes.startswith("krx_unmatched_in_scope"),
    }
    able = F.col("tagging_status").isin("auto", "review_needed")
    met = F.array_compact(F.array(*[F.when(able & rules[c], c) for c in CRITERIA if c in criteria]))
    return joined.withColumn("met", met).select(*rows.columns, "met")


def requeue_preview(rows: DataFrame) -> DataFrame:
    """Rows per criterion and in total, from ``met``."""
    each = rows.select(F.explode("met").alias("criterion")).groupBy("criterion").agg(F.count(F.lit(1)).alias("n"))
    return each.unionByName(rows.filter(F.size("met") > 0).agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("criterion"), "n"))


def publisher_values(rows: DataFrame) -> DataFrame:
    """A21."""
    return rows.groupBy(F.coalesce("publisher", F.lit("(null)")).alias("publisher")).agg(F.count(F.lit(1)).alias("n"))


def unknown_filename_tags(rows: DataFrame, publishers: DataFrame) -> DataFrame:
    """Tags of classified rows that the dictionary lacks."""
    tags = rows.filter(F.col("tagging_status").isin(*CLASSIFIED_STATUSES)).select(filename_tag(F.col("file_name")).alias("tag")).filter("tag is not null")
    return tags.join(names_to_canonical(publishers).select(F.col("name").alias("tag")), "tag", "left_anti").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))  # bounded dictionary


def recovered(reports: DataFrame, now: datetime, hours: int) -> DataFrame:
    """M4: rows in progress whose lock is older than ``hours`` go back to pending."""
    stale = (F.col("tagging_status") == "processing") & (F.col("tagging_locked_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return _released(reports, stale)


def _released(reports: DataFrame, which: Column) -> DataFrame:
    which = F.coalesce(which, F.lit(False))
    emptied = {c: F.when(~which, F.col(c)) for c in ("tagging_locked_at", "tagging_worker_id")}
    return reports.withColumns({**emptied, "tagging_status": F.when(which, "pending").otherwise(F.col("tagging_status"))})


def worker_reset(reports: DataFrame, worker: str) -> DataFrame:
    """M8: one worker's rows in progress go back to pending."""
    return _released(reports, (F.col("tagging_status") == "processing") & (F.col("tagging_worker_id") == worker))


def escalation(reports: DataFrame, since: datetime) -> DataFrame:
    """M8: rows in review tagged since a time."""
    return reports.filter((F.col("tagging_status") == "review_needed") & (F.col("tagged_at") >= F.lit(since).cast("timestamp")))


def closed_builds(builds: DataFrame, now: datetime, hours: int = 6) -> DataFrame:
    """M4: running builds silent for more than six hours become failed; exactly six does not."""
    silent = (F.col("status") == "running") & (F.col("heartbeat_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return builds.withColumn("status", F.when(silent, "failed").otherwise(F.col("status")))


def dropped_builds(builds: DataFrame, keep: int = 3) -> DataFrame:
    """Public builds after the latest ``keep``, and closed unpublished ones older than the oldest kept.

    Nothing goes while none is public. ``builds`` is a run log of a few rows a day.
    """
    done = builds.filter("status = 'done'").withColumn("_n", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("finished_no"), F.desc("build_id"))))
    oldest = done.filter(F.col("_n") <= keep).agg(F.min("build_id").alias("_oldest"))
    late = done.filter(F.col("_n") > keep).select("build_id")
    older = builds.filter(F.col("status").isin("pilot", "failed", "incomplete")).join(F.broadcast(oldest), F.col("build_id") < F.col("_oldest"))  # one row
    return late.unionByName(older.select("build_id"))


def unused_keys(keys: DataFrame, builds: DataFrame, dropped: DataFrame, names: list[str], current_version: str) -> DataFrame:
    """Key rows that neither a remaining build nor the current profile version uses."""
    used = builds.join(dropped, "build_id", "left_anti").select(*names)
    return keys.select(*names).distinct().join(used, names, "left_anti").filter(F.col("profile_version") != current_version)


def replaced_profiles(stored: DataFrame, received: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """M9: (profiles after the run, kept earlier ones); new ok rows replace, a failed one does not replace an ok one.

    Of several rows of a key in one run, an ok one counts before a failed one, then the last by ``order``.
    """
    ranked = stored.withColumn("_new", F.lit(0)).unionByName(received.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in ranked.columns])
    best = ranked.groupBy(*keys).agg(F.max_by(row, F.struct(F.col("status") == "ok", "_new", *order)).alias("_row")).select("_row.*")
    failed = received.filter("status <> 'ok'").select(*keys).distinct()
    kept = best.filter("_new = 0 and status = 'ok'").join(failed, keys, "left_semi").select(*stored.columns)
    return best.select(*stored.columns), kept


def kept_children(children: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """M9: segments or embeddings of profiles that were not replaced by a new ok one."""
    return children.join(received.filter("status = 'ok'").select(*keys), keys, "left_anti")


def inspection(profiles: DataFrame) -> DataFrame:
    """Rows and tokens by year, version and status, and in total."""
    sets = [[F.col("fiscal_year"), F.col("profile_version"), F.col("status")], []]
    return profiles.groupingSets(sets, "fiscal_year", "profile_version", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.grouping("status").alias("is_total"))


def fingerprint(rows: DataFrame, order: list[str]) -> DataFrame:
    """F35 for a small dimension: SHA-256 over cells joined by 0x1F, a line a row, in order."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n"), 256).alias("fingerprint"))


def tree_fingerprint(rows: DataFrame) -> DataFrame:
    """F35 for tables of any size: a hash of the hashes of 4,096 buckets, each of its rows' hashes in order of these.

    A row's line is as in ``fingerprint`` and its bucket the first three digits of its hash, so a row that many others repeat is
    counted before buckets are put together. The order of columns counts, that of rows does not.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    counted = rows.select(F.sha2(line, 256).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    listed = F.array_sort(F.collect_list(F.concat("_hash", F.lit("*"), F.col("_n").cast("string"))))
    buckets = counted.groupBy(F.substring("_hash", 1, 3).alias("_bucket")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("_part"))
    parts = F.array_sort(F.collect_list(F.concat("_bucket", F.lit("="), "_part")))
    return buckets.agg(F.sha2(F.array_join(parts, "\n"), 256).alias("fingerprint"))


def content_sum(rows: DataFrame) -> DataFrame:
    """F35 for tables of any size: an order-free sum of row hashes."""
    return rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n"))
