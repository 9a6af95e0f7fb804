"""Daily price histories to snapshots with period and excess returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions.numbers import half_up_exact, run_status, with_no_data
from equityjobs.schemas import PERIODS


def market_of(listed: Column) -> Column:
    """KOSDAQ GLOBAL folds into KOSDAQ; other markets are null."""
    name = F.trim(listed)
    return F.when(name == "KOSPI", "KOSPI").when(name.isin("KOSDAQ", "KOSDAQ GLOBAL"), "KOSDAQ")


def usable_rows(prices: DataFrame, arrival: list[str]) -> DataFrame:
    """Closes above 0, the last row of each day by ``arrival``.

    The rows are dealt by stock, so that the period windows need no further shuffle.
    """
    last = Window.partitionBy("stock_code", "day").orderBy(*[F.desc(c) for c in arrival])
    dealt = prices.filter(F.col("close") > 0).repartition("stock_code")
    return dealt.withColumn("_last", F.row_number().over(last)).filter("_last = 1").drop("_last", *arrival)


def snapshots(series: DataFrame, quotes: DataFrame, stocks: DataFrame) -> DataFrame:
    """The latest row of every stock with its period returns, 20-day value and flags."""
    by_day = Window.partitionBy("stock_code").orderBy("day")
    twenty = by_day.rowsBetween(-19, 0)
    base = {f"_base_{p}": F.lag("close", n).over(by_day) for p, n in PERIODS}
    at = series.withColumns(
        {**base, "_sum": F.sum("trading_value").over(twenty), "_n": F.count("trading_value").over(twenty), "_from_end": F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("day")))}
    )
    returns = {f"ret_{p}": (F.col("close") - F.col(f"_base_{p}")) * 100 / F.col(f"_base_{p}") for p, _ in PERIODS}
    latest = at.filter("_from_end = 1").withColumns({**returns, "avg_value_20d": half_up_exact("_sum", "_n")})
    known = latest.join(stocks.select(F.col("code").alias("stock_code"), market_of(F.col("market")).alias("market")), "stock_code", "left").join(quotes, "stock_code", "left")
    short = F.lit(False)
    for p, _ in PERIODS:
        short |= F.col(f"ret_{p}").isNull()
    halted = F.coalesce("halted", F.lit(False))
    flags = F.array_compact(F.array(F.when(short, "short_history"), F.when(halted, "halted"), F.when(F.coalesce("admin_issue", F.lit(False)), "admin_issue")))
    return known.select(
        "stock_code", "market", F.col("day").alias("as_of"), "close", "market_cap", "avg_value_20d", (~halted).alias("traded"), *returns, flags.alias("flags")
    )


def market_medians(rows: DataFrame) -> DataFrame:
    """Exact medians per market and period (one row a market)."""
    return rows.filter(F.col("market").isNotNull()).groupBy("market").agg(*[F.median(f"ret_{p}").alias(f"_median_{p}") for p, _ in PERIODS])


def with_excess(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Each return less its market's median; null when either is missing."""
    joined = rows.join(F.broadcast(medians), "market", "left")  # a row for each market
    excess = {f"xret_{p}": F.col(f"ret_{p}") - F.col(f"_median_{p}") for p, _ in PERIODS}
    return joined.withColumns(excess).drop(*[f"_median_{p}" for p, _ in PERIODS])


def merge_run(received: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("stock_code",)) -> DataFrame:
    """Received rows, and the stored rows of the other stocks with the no_data flag first.

    ``keys``: what tells a stock's rows apart where listings share a code.
    """
    others = stored.join(received.select(*keys), list(keys), "left_anti").withColumn("flags", with_no_data(F.col("flags")))
    return received.unionByName(others)


def run_summary(targets: DataFrame, received: DataFrame, shown: int = 20) -> DataFrame:
    """Latest day, counts, status and the first failed codes of a run."""
    joined = targets.select(F.col("code").alias("stock_code")).join(received.select("stock_code", "as_of"), "stock_code", "left")
    failed = F.col("as_of").isNull()
    worst = joined.filter(failed).orderBy("stock_code").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("stock_code")), ",").alias("failed_codes"))
    counts = joined.agg(F.max("as_of").alias("as_of"), F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("_total"))
    return counts.join(F.broadcast(worst)).select("as_of", "ok", "failed", run_status(F.col("_total"), F.col("failed")).alias("status"), "failed_codes")  # one row each


def price_view(rows: DataFrame) -> DataFrame:
    """A stored row as shown, whole won rounded half up."""
    whole = [F.round(c).cast("long").alias(c) for c in ("close", "market_cap", "avg_value_20d")]
    shown = [p for p, _ in PERIODS[:3]]
    returns = F.struct(*[F.col(f"ret_{p}").alias(p) for p in shown]).alias("returns")
    excess = F.struct(*[F.col(f"xret_{p}").alias(p) for p in shown]).alias("excess")
    return rows.select("stock_code", "market", F.col("as_of").cast("string").alias("as_of"), *whole, "traded", returns, excess, "flags")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run and the latest successful one."""
    at = F.struct("started_at", "run_id")
    ok = F.col("status").isin("ok", "partial")
    return runs.agg(
        F.max_by("run_id", at).alias("run_id"), F.max_by("status", at).alias("status"), F.max_by("as_of", at).alias("as_of"),
        F.max_by("run_id", F.when(ok, at)).alias("ok_run_id"), F.max_by("as_of", F.when(ok, at)).alias("ok_as_of"),
    )
