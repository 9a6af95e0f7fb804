"""Reports stored by month, so that a period reads the months it needs and no others."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equityjobs.functions.dates import effective_date
from equityjobs.operators.reports import period_rows

#: The partition column: the month of the effective date, ``yyyy-MM``; null where a report has no date.
MONTH = "month"


def write_by_month(reports: DataFrame, path: str, files: int = 8, mode: str = "errorifexists") -> None:
    """The reports under ``path``, a folder for each month and up to ``files`` files in it, so that no month is one task's."""
    dealt = reports.withColumn(MONTH, F.date_format(effective_date(), "yyyy-MM")).withColumn("_file", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.repartition(MONTH, "_file").drop("_file").write.mode(mode).partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str, schema: T.StructType, first: date | None = None, last: date | None = None) -> DataFrame:
    """The reports of the months from ``first`` to ``last``; without either bound also those without a date.

    ``schema`` is that of the reports. The bounds prune whole folders before a file is opened.
    """
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])).parquet(path)
    if first is not None:
        rows = rows.filter(F.col(MONTH) >= f"{first:%Y-%m}")
    if last is not None:
        rows = rows.filter(F.col(MONTH) <= f"{last:%Y-%m}")
    return rows.drop(MONTH)


def read_period(spark: SparkSession, path: str, schema: T.StructType, start: date, include_oos: bool = False) -> DataFrame:
    """P3 on the layout: the same rows as ``period_rows`` of the whole table.

    A row's month is that of its published date, if it has one, so no row of the period is in an earlier folder.
    """
    return period_rows(read_months(spark, path, schema, first=start), start, include_oos)
