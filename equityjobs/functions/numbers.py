"""Returns, labels, tiers and statuses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from equityjobs.schemas import FLAG_ORDER, PROFIT_METRICS


def half_up_exact(total: str, count: str) -> Column:
    """A10: total / count rounded half up by integer division (totals are not negative); null without a value."""
    return F.expr(f"case when {count} > 0 then (2 * {total} + {count}) div (2 * {count}) end")


def run_status(total: Column, failed: Column, most_percent: int = 20) -> Column:
    """Ok, partial (up to the percentage failed), failed."""
    return F.when(failed <= 0, "ok").when(failed * 100 <= most_percent * total, "partial").otherwise("failed")


def build_status(eligible: Column, profiled: Column, pilot: Column, done_percent: int = 95) -> Column:
    """A16."""
    return F.when(pilot, "pilot").when((eligible > 0) & (profiled * 100 >= eligible * done_percent), "done").otherwise("incomplete")


def with_no_data(flags: Column) -> Column:
    """no_data first, known flags in order, unknown ones after them."""
    known = F.array(*[F.lit(f) for f in FLAG_ORDER])
    there = F.array_distinct(F.concat(F.array(F.lit("no_data")), F.coalesce(flags, F.expr("cast(array() as array<string>)"))))
    return F.concat(F.array_intersect(known, there), F.array_except(there, known))


def tier(percentile: Column) -> Column:
    """F15."""
    return F.when(percentile >= 99.5, "very_high").when(percentile >= 98, "high").when(percentile >= 95, "related")


def numeric_change(previous: Column, current: Column, unit: Column, metric: Column) -> tuple[Column, Column, Column]:
    """(delta, change_pct, change_label); ratios in points, no growth rate around zero or losses."""
    known = previous.isNotNull() & current.isNotNull()
    delta = F.when(known, current - previous)
    points = unit == "%"
    losses = (previous <= 0) | (current <= 0)
    percent = F.when(known & ~points & ~losses, delta / previous * 100)
    profit = F.coalesce(metric.isin(*PROFIT_METRICS), F.lit(False))
    label = (
        F.when(~known, "비교값 없음")
        .when(points, F.format_string("%+.2f%%p", delta))
        .when((previous < 0) & (current > 0), F.when(profit, "흑자 전환").otherwise("음수→양수"))
        .when((previous > 0) & (current < 0), F.when(profit, "적자 전환").otherwise("양수→음수"))
        .when(losses, F.concat(F.format_string("%+,.2f", delta), F.lit(" "), unit, F.lit(" (증감률 미표시)")))
        .otherwise(F.format_string("%+.2f%%", percent))
    )
    return delta, percent, label


def target_direction(old: Column, new: Column, given: Column) -> Column:
    """by both prices; N/A without any; else as given."""
    return (
        F.when(new.isNotNull() & old.isNotNull(), F.when(new > old, "상향").when(new < old, "하향").otherwise("불변"))
        .when(new.isNull() & old.isNull(), "N/A")
        .otherwise(given)
    )


def same_industry(seed: Column, peer: Column) -> Column:
    """F16: null when either is blank."""
    return F.when((F.trim(seed) != "") & (F.trim(peer) != ""), F.trim(seed) == F.trim(peer))


def is_trading(traded: Column, flags: Column) -> Column:
    """says that it trades, with this run's numbers."""
    stopped = F.arrays_overlap(F.coalesce(flags, F.expr("cast(array() as array<string>)")), F.array(F.lit("halted"), F.lit("no_data")))
    return F.coalesce(traded & ~stopped, F.lit(False))


def reaction(seed_excess: Column, seed_as_of: Column, peer_excess: Column, peer_as_of: Column, trading: Column) -> Column:
    """none, partial or reacted by peer excess over seed excess; undetermined where that says nothing."""
    ratio = peer_excess / F.when(seed_excess != 0, seed_excess)
    judged = (seed_excess >= 10) & trading & peer_excess.isNotNull() & (peer_as_of == seed_as_of)
    return F.when(~F.coalesce(judged, F.lit(False)), "undetermined").when(ratio < 0.25, "none").when(ratio < 0.6, "partial").otherwise("reacted")


def candidate_reasons(label: Column, reacted: Column, trading: Column, avg_value: Column, is_holding: Column, row_tier: Column, least_value: int = 500_000_000) -> Column:
    """what keeps a peer from being a candidate, in order; unknown values never pass."""

    def unless(condition: Column, reason: str) -> Column:
        return F.when(~F.coalesce(condition, F.lit(False)), reason)

    third = F.when(reacted == "reacted", "reacted").when(~F.coalesce(reacted.isin("none", "partial"), F.lit(False)), "undetermined")
    found = [
        unless(label == "none", "has_reports"), third, unless(trading, "not_traded"), unless(avg_value >= least_value, "low_liquidity"),
        unless(~is_holding, "holding"), unless(row_tier.isNotNull(), "weak_similarity"),
    ]
    return F.array_compact(F.array(*found))


def count_at_most(values: Column, steps: int, x: Column) -> Column:
    """How many of the ascending ``values`` (an array of fewer than 2**steps) are at most ``x``, by binary search."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= F.size(values)) & (F.get(values, n + p - 1) <= x), n + p).otherwise(n))
