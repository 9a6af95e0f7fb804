"""Mixing sources to target weights by entropy balancing.

Each document's rate r minimises sum(r log r - r) under the token constraint of its source,
sum(r * words) = target, with 0 <= r <= ``limit``. The dual has one multiplier per source and gives the
tilted rate r = min(limit, exp(lambda * words / mean words)). Newton steps on the dual run as Spark
aggregations over a histogram of (source, words); the rates are then rounded into whole copies so that
each source's words meet its target as closely as its smallest documents allow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.llm.shared import salt_count, salted, sorted_rank, stored

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null source; the others get the prefix "=", so that the two never meet.
NO_SOURCE = "~"


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, limit: int) -> DataFrame:
    """skey, source_size, target: shares by weight, each at most ``limit`` times its source, the rest reshared.

    The water level is found by Newton steps on sum(min(cap, level * weight)), exact after finitely many.
    """
    ranked = sorted_rank(sources, ["skey"], "_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    caps = stored(ranked.select("skey", "source_size", w.alias("_w"), (F.col("source_size") * limit).cast("double").alias("_cap")), "caps")
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        row = caps.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("_cap"))).alias("cap"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        if not row["w"] or not row["all"]:
            break
        nxt = (share * row["all"] - (row["cap"] or 0.0)) / row["w"]
        if nxt <= level:
            break
        level = nxt
    return caps.select("skey", "source_size", F.least("_cap", F.lit(level) * F.col("_w")).alias("target"))


def _multipliers(hist: DataFrame, targets: DataFrame, limit: int, steps: int, tolerance: float) -> DataFrame:
    """skey, lambda: bracketed Newton on each source's dual, all sources in one aggregation a step."""
    means = hist.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_mean"))
    dual = stored(
        targets.join(means, "skey").select(
            "skey", "target", "_mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
            ((F.col("target") >= limit * F.col("source_size")) | (F.col("source_size") == 0)).alias("done"),
        ),
        "dual",
    )
    for _ in range(steps):
        z = F.col("size") / F.col("_mean")
        e = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        rate = F.least(F.lit(float(limit)), e)
        mass = F.col("n") * F.col("size")
        moved = hist.join(dual.filter(~F.col("done")), "skey").groupBy("skey").agg(
            F.sum(mass * rate).alias("_g"), F.sum(F.when(e < limit, mass * z * e)).alias("_h")
        )
        gap = F.col("target") - F.col("_g")
        lo = F.when(gap > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("_h") > 0, F.col("lam") + gap / F.col("_h"))
        inside = (F.col("_lo").isNull() | (F.col("_step") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_step") < F.col("_hi")))
        widen = F.when(F.col("_lo").isNull(), 2 * F.col("_hi") - 1).when(F.col("_hi").isNull(), 2 * F.col("_lo") + 1).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        near = F.col("done") | F.coalesce(F.abs(gap) <= tolerance * F.col("target"), F.lit(False))
        dual = stored(
            dual.join(moved, "skey", "left")
            .withColumns({"_near": near, "_lo": lo, "_hi": hi, "_step": newton})
            .select(
                "skey", "target", "_mean",
                F.when(F.col("_near"), F.col("lam")).when(F.col("_step").isNotNull() & inside, F.col("_step")).otherwise(widen).alias("lam"),
                F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_near").alias("done"),
            ),
            "dual",
        )
        if not dual.filter(~F.col("done")).limit(1).count():
            break
    else:
        raise RuntimeError(f"the dual of some source is not solved to {tolerance:g} of its target in {steps} steps")
    return dual.select("skey", F.round("lam", 9).alias("lam"), "_mean")


def _copies_per_cell(cells: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Whole copies for each (source, words) cell: from long to short documents, the rounding error is carried on."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    owed, copies = 0.0, []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist()):
        if size == 0:
            copies.append(n)
            continue
        owed += n * rate * size
        k = int(min(max(np.floor(owed / size + 0.5), 0), limit * n))
        owed -= k * size
        copies.append(k)
    return pd.DataFrame({"skey": cells["skey"], "size": cells["size"], "n": cells["n"], "k": np.array(copies, dtype="int64")})


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2, steps: int = 40, tolerance: float = 1e-9,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Copies of every document in the mix: doc_id, size, source_size, target, taken, copies, source.

    Words are runs of non-blank characters; a null or empty text has none and keeps one copy. A null source
    is a source of its own, ranked last. Repeated rows are separate documents; ties are broken by a hash of
    the id, so reruns agree. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    skey = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(NO_SOURCE))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    facts = stored(docs.select(F.col(id_col).alias("doc_id"), skey.alias("skey"), size.alias("size")), "sizes")
    hist = stored(facts.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(_targets(sources, weights, share, limit), "targets")
    dual = _multipliers(hist, targets, limit, steps, tolerance)

    capped = F.col("target") >= limit * F.col("source_size")
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("_mean"), F.lit(50.0)))
    rate = F.when(F.col("size") == 0, 1.0).when(capped, float(limit)).otherwise(F.least(F.lit(float(limit)), tilt))
    rated = hist.join(targets.join(dual, "skey"), "skey").select("skey", "size", "n", rate.alias("rate"))
    # A group holds one source's distinct document lengths, not its documents.
    wholes = rated.groupBy("skey").applyInPandas(lambda cells: _copies_per_cell(cells, limit), "skey string, size long, n long, k long")

    # Within a cell the copies go by hash order, spread over salts so that a hot cell is never one task.
    keys = ["skey", "size"]
    dealt = salted(facts, ["doc_id"], salt_count(spark))
    parts = dealt.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    last = F.floor(F.col("k") * (F.col("_first") + F.col("_rows")) / F.col("n"))
    quota = parts.join(wholes.join(targets, "skey"), keys).select(
        *keys, "_salt", "_rows", (last - F.floor(F.col("k") * F.col("_first") / F.col("n"))).cast("long").alias("_k"), "source_size", "target"
    )
    seat = Window.partitionBy(*keys, "_salt").orderBy("doc_id")
    placed = dealt.withColumn("_seat", F.row_number().over(seat) - 1).join(quota, [*keys, "_salt"])
    copies = F.floor(F.col("_k") / F.col("_rows")) + F.when(F.col("_seat") < F.col("_k") % F.col("_rows"), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("int")
    source = F.when(F.col("skey") != NO_SOURCE, F.substring("skey", 2, 1 << 30))
    return placed.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), source.alias("source"))
