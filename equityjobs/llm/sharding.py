"""Sharding by balanced label propagation, with DataFrame operations only.

Documents of equal text are linked. Each starts with the label (shard) that its id hashes to. In each
round, the members of a group ask to move to the shards where most of the group already is; a shard admits
as many as its quota leaves room for. Unlinked documents then fill what is left, so that the row counts
of the shards differ by one at most.

Members of a group are interchangeable, so the rounds work on a table of (group, shard, members) with
at most ``shards`` rows per group instead of on documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.llm.shared import running_total, salt_count, salted, salted_rank, stored

GROUP = ["_h", "_c", "_z"]
#: Label of linked documents that their first shard has no room for; it has no room of its own.
UNPLACED = -1


def _text_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), (size + 16).alias("_z"), F.crc32(text.cast("binary")).alias("_c"), F.xxhash64(text).alias("_h"))


def _rooms(state: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Room left per shard: one row for each shard, so it may be broadcast."""
    used = state.groupBy("shard").agg(F.sum("n").alias("_used"))
    every = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(used, "shard", "left").select("shard", F.greatest(F.lit(capacity) - F.coalesce("_used", F.lit(0)), F.lit(0)).alias("_room"))


def _within(state: DataFrame, capacity: int) -> DataFrame:
    """Never more linked documents in a shard than its quota; larger piles are kept first."""
    salts = salt_count(state.sparkSession)
    level = (F.lit(40) - F.least(F.log2(F.col("n")), F.lit(40))).cast("int") * F.lit(salts) + F.pmod(F.xxhash64(*GROUP), F.lit(salts)).cast("int")
    queue = running_total(state.filter(F.col("shard") != UNPLACED), ["shard"], [F.desc("n"), *[F.col(c) for c in GROUP]], level, "n", "_before")
    return queue.select(*GROUP, "shard", F.least("n", F.greatest(F.lit(capacity) - F.col("_before"), F.lit(0))).alias("n")).filter("n > 0")


def _round(state: DataFrame, capacity: int, shards: int) -> DataFrame:
    """One propagation round over (group, shard, n)."""
    best = Window.partitionBy(*GROUP).orderBy(F.col("shard") == UNPLACED, F.desc("n"), F.pmod(F.xxhash64(*GROUP, "shard"), F.lit(1 << 30)), "shard")
    upto = best.rowsBetween(Window.unboundedPreceding, 0)
    after = best.rowsBetween(1, Window.unboundedFollowing)
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    # Shards by members: the first ones receive as far as their room goes, the others give.
    ranked = (
        state.join(F.broadcast(_rooms(state, capacity, shards)), "shard", "left")
        .withColumn("_room", F.coalesce("_room", zero))
        .withColumn("_room_upto", F.sum("_room").over(upto))
        .withColumn("_room_before", F.coalesce(F.sum("_room").over(before), zero))
        .withColumn("_rest", F.coalesce(F.sum("n").over(after), zero))
        .withColumn("_takes", F.coalesce(F.lag(F.col("_room_upto") < F.col("_rest")).over(best), F.lit(True)) & (F.col("_room") > 0))
        .withColumn("_wants", F.when(F.col("_takes"), F.least(F.col("_room"), F.greatest(F.col("_rest") - F.col("_room_before"), zero))).otherwise(zero))
    )
    asks = ranked.filter("_wants > 0").select(*GROUP, "shard", F.col("_wants").cast("long").alias("_wants"))
    level = F.pmod(F.xxhash64(*GROUP), F.lit(salt_count(state.sparkSession))).cast("int")
    queue = running_total(asks, ["shard"], [F.col(c) for c in GROUP], level, "_wants", "_before")
    rooms = F.broadcast(_rooms(state, capacity, shards))
    got = (
        queue.join(rooms, "shard")
        .select(*GROUP, "shard", F.least("_wants", F.greatest(F.col("_room") - F.col("_before"), zero)).alias("_got"))
        .filter("_got > 0")
    )
    # What a group was granted leaves its smallest piles first.
    giving = ranked.filter(~F.col("_takes")).select(*GROUP, "shard", "n")
    granted = got.groupBy(*GROUP).agg(F.sum("_got").alias("_granted"))
    least = Window.partitionBy(*GROUP).orderBy(F.col("shard") != UNPLACED, "n", "shard").rowsBetween(Window.unboundedPreceding, -1)
    lost = (
        giving.join(granted, GROUP)
        .withColumn("_gone", F.coalesce(F.sum("n").over(least), zero))
        .select(*GROUP, "shard", F.least("n", F.greatest(F.col("_granted") - F.col("_gone"), zero)).alias("_lost"))
    )
    # Grants beyond what the giving piles hold are void: the last receiver takes less.
    supply = lost.groupBy(*GROUP).agg(F.sum("_lost").alias("_supply"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("_got"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    gains = (
        got.join(supply, GROUP)
        .withColumn("_had", F.coalesce(F.sum("_got").over(order), zero))
        .select(*GROUP, "shard", F.least("_got", F.greatest(F.col("_supply") - F.col("_had"), zero)).alias("_d"))
    )
    moved = gains.unionByName(lost.select(*GROUP, "shard", (-F.col("_lost")).alias("_d")))
    now = state.select(*GROUP, "shard", F.col("n").alias("_d")).unionByName(moved)
    return now.groupBy(*GROUP, "shard").agg(F.sum("_d").alias("n")).filter("n > 0")


def _interval_of(value: Column, ends: list[int]) -> Column:
    """Index of the half-open interval [ends[i-1], ends[i]) that holds ``value``."""
    bounds = F.array(*[F.lit(int(x)).cast("long") for x in ends])
    return F.size(F.filter(bounds, lambda b: b <= value)).cast("int")


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row of ``docs`` to a shard; rows: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shard counts differ by one at most. Size is UTF-8 bytes plus 16; a null text counts as
    the empty text (16, crc of no bytes). Repeated rows are placed apart, each once. An empty table gives
    no rows. Other columns are ignored. A group larger than a shard fills whole shards and leaves the rest
    together as far as room allows.
    """
    spark = docs.sparkSession
    facts = stored(_text_facts(docs, id_col, text_col), "facts")
    total = facts.count()
    capacity = total // shards
    salts = salt_count(spark)

    labels = facts.withColumn("shard", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(shards)).cast("int"))
    piles = labels.groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*GROUP)
    linked = piles.withColumn("_members", F.sum("n").over(whole)).filter("_members > 1").drop("_members")
    first = stored(_within(linked, capacity), "labels")
    over = linked.unionByName(first.select(*GROUP, "shard", (-F.col("n")).alias("n"))).groupBy(*GROUP).agg(F.sum("n").alias("n")).filter("n > 0")
    state = stored(first.unionByName(over.select(*GROUP, F.lit(UNPLACED).alias("shard"), "n")), "labels")
    for _ in range(rounds):
        state = stored(_round(state, capacity, shards), "labels")

    kept = stored(_within(state, capacity), "kept")

    # Members of a group by rank: intervals of ranks go to shards; ranks are built per (group, salt).
    runs = Window.partitionBy(*GROUP).orderBy("shard")
    spans = kept.withColumn("_hi", F.sum("n").over(runs.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lo", F.col("_hi") - F.col("n"))
    dealt = salted(facts, ["doc_id"], salts)
    cells = dealt.groupBy(*GROUP, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    cells = cells.withColumn("_first", F.coalesce(F.sum("_rows").over(Window.partitionBy(*GROUP).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cuts = (
        cells.join(spans.drop("n"), GROUP)
        .filter((F.col("_first") < F.col("_hi")) & (F.col("_first") + F.col("_rows") > F.col("_lo")))
        .select(*GROUP, "_salt", "shard", (F.col("_lo") - F.col("_first")).alias("_lo"), (F.col("_hi") - F.col("_first")).alias("_hi"))
    )
    seat = Window.partitionBy(*GROUP, "_salt").orderBy("doc_id")
    seated = dealt.withColumn("_seat", F.row_number().over(seat) - 1)
    s, c = seated.alias("s"), cuts.alias("c")
    on = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in [*GROUP, "_salt"]] + [F.col("s._seat") >= F.col("c._lo"), F.col("s._seat") < F.col("c._hi")]
    placed = stored(s.join(c, on, "left").select("s.doc_id", *[f"s.{k}" for k in GROUP], "c.shard"), "placed")

    # The others fill each shard up to its quota: the first total % shards shards hold one row more.
    used = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    ends, end = [], 0
    for k in range(shards):
        end += capacity + (k < total % shards) - used.get(k, 0)
        ends.append(end)
    fill = placed.filter(F.col("shard").isNull()).drop("shard")
    filled = salted_rank(fill, [], ["doc_id", *GROUP], "_rank").withColumn("shard", _interval_of(F.col("_rank"), ends)).drop("_rank")
    everyone = placed.filter(F.col("shard").isNotNull()).unionByName(filled)
    slotted = salted_rank(everyone, ["shard"], ["doc_id", *GROUP], "slot")
    return slotted.select(
        "doc_id", F.col("_z").alias("size"), F.col("_c").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
