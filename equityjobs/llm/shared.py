"""Helpers that the training-data operators share: scratch tables and skew-proof ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equityjobs.sources.scratch import scratch_path, stored  # noqa: F401

#: Rows of a narrow table (an id and a number) that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def join_side(narrow: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow table, to be broadcast if its counted rows allow; else it is joined by a shuffle."""
    return F.broadcast(narrow) if narrow.count() <= most_rows else narrow


def text_batches(spark: SparkSession, most_bytes: int = 2 << 20) -> None:
    """Texts go to Python workers in Arrow batches of bounded bytes, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most_bytes))


def give_back() -> None:
    """Hand freed memory back to the system, so that a Python worker that waits for its next task stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a C library that keeps freed memory
        pass


def lean(run: Callable) -> Callable:
    """``run`` (batches to batches) for a task that gives its memory back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """``rows`` joined with the stored narrow ``table`` (one row for each ``key``), however many rows share a key.

    A table of counted size is broadcast; a larger one is copied to ``salts`` salts, over which ``spread`` deals each key's rows.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(13), spread), F.lit(salts)).cast("int"))
    return salted_rows.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "_salt"]).drop("_salt")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the name of that column (none that ``docs`` has).

    The number is the row's place in its file, so every evaluation gives the same, however the scan is split and
    whatever executors are lost. ``docs`` is a scan of Parquet files, columns and filters apart; a table that is none
    is stored first (the result of joins over scans is to be stored by the caller).
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    try:
        places = docs.select(docs.metadataColumn("_metadata").getField("file_path").alias("_file"))
        places.schema  # noqa: B018  (analysis happens here)
    except AnalysisException:
        return numbered(stored(docs, "rows"))
    # One row for each file.
    files = places.distinct().select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_number"))
    meta = docs.metadataColumn("_metadata")
    # All columns of a row travel in one struct, so no name can clash.
    placed = docs.select(F.struct("*").alias("_doc"), meta.getField("file_path").alias("_file"), meta.getField("row_index").alias("_index"))
    number = F.shiftleft(F.col("_number"), 40) + F.col("_index")
    return placed.join(F.broadcast(stored(files, "files")), "_file").select("_doc.*", number.alias(name)), name


def salt_count(spark: SparkSession) -> int:
    """Salts per key: a few per shuffle partition, so that one key's rows spread over all tasks."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted(df: DataFrame, order: list[str], salts: int, out: str = "_salt") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit(17), *order), F.lit(salts)).cast("int"))


def running_total(df: DataFrame, keys: list[str], order: list[Column], level: Column, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys``, by ``level`` (a small int) and then ``order``.

    Each (keys, level) pair is one window partition, so a key with many rows never meets in one task;
    only the sums of the levels are put together per key.
    """
    leveled = df.withColumn("_level", level)
    inside = Window.partitionBy(*keys, "_level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = leveled.groupBy(*keys, "_level").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_level", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    local = leveled.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(starts, [*keys, "_level"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_level")


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Gapless rank from 0 within ``keys`` (not null) that no hot key gathers in one task.

    The order is (salt of ``order``, ``order``): the same at every run, but not sorted by ``order``.
    """
    n = salts or salt_count(df.sparkSession)
    one = df.withColumn("_one", F.lit(1).cast("long"))
    level = F.pmod(F.xxhash64(F.lit(17), *order), F.lit(n)).cast("int")
    return running_total(one, keys, [F.col(c) for c in order], level, "_one", out).drop("_one")


def sorted_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Gapless rank from 0 in the global order of ``order``: range partitions, ranked apart, plus their starts."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")
