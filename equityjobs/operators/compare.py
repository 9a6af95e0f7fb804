"""Forecast revisions between reports, and grounding of figures in their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions.numbers import numeric_change
from equityjobs.functions.texts import numbers_in
from equityjobs.schemas import METRIC_KEY
from equityjobs.sources.scratch import stored


def comparable_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics with a known period, basis and scenario whose key occurs once in their report."""
    known = (F.coalesce("fiscal_period", F.lit("")) != "") & F.col("accounting_basis").isin("연결", "별도") & F.col("scenario").isin("기본", "낙관", "비관")
    once = F.count(F.lit(1)).over(Window.partitionBy("id", *METRIC_KEY))
    return metrics.filter(known).withColumn("_times", once).filter("_times = 1").drop("_times")


def revisions(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(previous_id, current_id) pairs to changes of metrics on the same basis; actuals are left out."""
    single = comparable_metrics(metrics).filter(F.col("value").isNotNull())
    keys = [F.coalesce(F.col(k), F.lit("\x00")).alias(f"_k{i}") for i, k in enumerate(METRIC_KEY)]
    old = single.select(F.col("id").alias("previous_id"), *keys, F.col("value").alias("previous"))
    new = single.filter(F.coalesce("value_type", F.lit("")) != "실적").select(F.col("id").alias("current_id"), *METRIC_KEY, *keys, F.col("value").alias("current"))
    joined = pairs.join(new, "current_id").join(old, ["previous_id", *[f"_k{i}" for i in range(len(METRIC_KEY))]])
    delta, percent, label = numeric_change(F.col("previous"), F.col("current"), F.col("unit"), F.col("metric"))
    return joined.select("previous_id", "current_id", *METRIC_KEY, "previous", "current", delta.alias("delta"), percent.alias("change_pct"), label.alias("change_label"))


def previous_reports(reports: DataFrame) -> DataFrame:
    """Each report's previous one of the same stock, and of the same stock and publisher."""
    held = reports.select("id", "publisher", "published_at", F.explode(F.array_distinct("stock_codes")).alias("stock_code"))
    order = [F.asc_nulls_first("published_at"), "id"]
    same = F.lag("id").over(Window.partitionBy("stock_code", "publisher").orderBy(*order))
    known = F.coalesce("publisher", F.lit("")) != ""
    both = held.withColumns({"_any": F.lag("id").over(Window.partitionBy("stock_code").orderBy(*order)), "_same": F.when(known, same)})
    kind = F.when(F.col("_same").isNotNull(), "same_publisher").when(F.col("_any").isNotNull(), "cross_publisher")
    return both.select("id", "stock_code", F.coalesce("_same", "_any").alias("prev_report_id"), kind.alias("prev_match_type"))


def _in_blocks(left: DataFrame, right: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with block numbers, so that a key with many rows is many groups of at most about ``block_rows`` rows a side.

    Every left row meets every right row of its key in exactly one group. Only keys above ``block_rows`` are in the table of
    blocks, so it has fewer rows than all rows by that factor; it is broadcast while it has at most 100,000.
    """
    sizes = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
    hot = stored(sizes.select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks")), "hot_keys")
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        known = side.join(hot, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        block = F.pmod(F.xxhash64(f"{name}_id"), F.col("_blocks")).cast("int")
        return known.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    return dealt(left, "left", "_a", "_b"), dealt(right, "right", "_b", "_a"), [*keys, "_a", "_b"]


def report_pairs(reports: DataFrame, most_days: int | None = None, block_rows: int = 2_000) -> DataFrame:
    """Comparable pairs of reports on a common stock, earlier first, each once, with same_publisher.

    Pairs grow with the square of a stock's reports; ``most_days`` bounds them to a window by joining day buckets. A stock with more
    than ``block_rows`` rows on the two sides is dealt to pairs of blocks, so it is never one task's.
    """
    typed = reports.filter(F.col("report_type").isNull() | (F.col("report_type") == "단일종목"))
    held = typed.select("id", "publisher", "published_at", F.explode(F.array_distinct("stock_codes")).alias("_code"))
    left, right = (held.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "publisher", "published_at")], "_code") for side in ("left", "right"))
    keys = ["_code"]
    if most_days is not None:
        slot = F.floor(F.unix_date("left_published_at") / most_days)
        left = left.filter(F.col("left_published_at").isNotNull()).withColumn("_slot", F.explode(F.array(slot, slot + 1)))
        right = right.filter(F.col("right_published_at").isNotNull()).withColumn("_slot", F.floor(F.unix_date("right_published_at") / most_days))
        keys.append("_slot")
    left, right, keys = _in_blocks(left, right, keys, block_rows)
    a, b = (F.struct(F.coalesce(F.col(f"{s}_published_at").cast("string"), F.lit("")), F.col(f"{s}_id")) for s in ("left", "right"))
    pairs = left.join(right, keys).filter(a < b)
    if most_days is not None:
        pairs = pairs.filter(F.date_diff("right_published_at", "left_published_at") <= most_days)
    same = (F.coalesce("left_publisher", F.lit("")) != "") & F.col("left_publisher").eqNullSafe(F.col("right_publisher"))
    return pairs.select("left_id", "right_id", same.alias("same_publisher")).distinct()


def rejected_pairs(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """J13 on a pairs table: the first reason against each pair, or null."""
    side = {s: reports.select(F.col("id").alias(f"{s}_id"), F.col("report_type").alias(f"_{s}_type"), F.col("stock_codes").alias(f"_{s}_codes")) for s in ("left", "right")}
    joined = pairs.join(side["left"], "left_id").join(side["right"], "right_id")
    typed = [F.coalesce(F.col(f"_{s}_type"), F.lit("단일종목")) == "단일종목" for s in ("left", "right")]
    reason = F.when(~(typed[0] & typed[1]), "report_type").when(F.col("left_id") == F.col("right_id"), "same_report").when(~F.arrays_overlap("_left_codes", "_right_codes"), "other_company")
    return joined.select("left_id", "right_id", reason.alias("reason"))


def pages_text(pages: DataFrame, most_tokens: int) -> DataFrame:
    """(doc_id, page_no, body) to one page-marked text, up to the token cap, with pages used and truncated."""
    chunk = F.concat(F.lit("--- Page "), F.col("page_no"), F.lit(" ---\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    running = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.greatest(F.lit(1), F.floor(F.length("_chunk") / 3))
    marked = pages.withColumn("_chunk", chunk).withColumn("_used", F.sum(cost).over(running))
    fits = F.col("_used") <= most_tokens
    ordered = F.array_sort(F.collect_list(F.when(fits, F.struct("page_no", "_chunk"))))
    return marked.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["_chunk"]), "").alias("text"), F.count_if(fits).alias("pages_used"),
        F.count(F.lit(1)).alias("total_pages"), (F.count_if(~fits) > 0).alias("truncated"), F.coalesce(F.max(F.when(fits, F.col("_used"))), F.lit(0)).alias("tokens"),
    )


def lead_pages(pages: DataFrame, keyword: str, most: int = 3) -> DataFrame:
    """Pages 1 to ``most``, up to the first with a metadata keyword."""
    hit = F.min(F.when(F.col("body").rlike(keyword), F.col("page_no"))).over(Window.partitionBy("doc_id"))
    return pages.withColumn("_hit", hit).filter(F.col("page_no") <= F.least(F.lit(most), F.coalesce("_hit", F.lit(most)))).drop("_hit")


def ground_metrics(metrics: DataFrame, pages: DataFrame) -> DataFrame:
    """metrics whose value is in its quote and on its cited page; an unsupported previous value is blanked.

    ``metrics``: id, line, fiscal_period, value, page, quote, previous_value, previous_page, previous_quote.
    ``pages``: id, page, body. ``omitted`` counts what was dropped or blanked per row (0 to 1); a dropped row has kept false.
    """
    found = pages.select("id", "page", numbers_in(F.col("body")).alias("_numbers"))

    def cited(side: str) -> DataFrame:
        return found.select("id", F.col("page").alias(f"{side}page"), F.col("_numbers").alias(f"_{side}numbers"))

    joined = metrics.join(cited(""), ["id", "page"], "left").join(cited("previous_"), ["id", "previous_page"], "left")

    def supported(value: str, side: str) -> Column:
        quoted = F.array_contains(numbers_in(F.col(f"{side}quote")), F.col(value))
        return F.coalesce(F.col(f"{side}quote").isNotNull() & quoted & F.array_contains(F.col(f"_{side}numbers"), F.col(value)), F.lit(False))

    forward = F.coalesce(F.col("quote").rlike(r"(?iU)12\s*M\s*Fwd|12\s*개월\s*선행|\bNTM\b") & F.col("fiscal_period").rlike(r"\A\d{4}[EA]?\z"), F.lit(False))
    kept = ~forward & supported("value", "")
    prior = supported("previous_value", "previous_") & supported("value", "previous_")
    blank = F.col("previous_value").isNotNull() & ~prior
    return joined.select(
        "id", "line", "value", F.when(kept & ~blank, F.col("previous_value")).alias("previous_value"), kept.alias("kept"),
        F.when(~kept | blank, 1).otherwise(0).alias("omitted"),
    )


def kept_drivers(drivers: Column) -> Column:
    """horizon drivers need two different bases; an array of (category, previous_basis, current_basis)."""

    def known(x: Column) -> Column:
        return F.coalesce(x, F.lit("")) != ""

    return F.filter(drivers, lambda d: (d["category"] != "평가기간 변경") | (known(d["previous_basis"]) & known(d["current_basis"]) & ~d["previous_basis"].eqNullSafe(d["current_basis"])))
