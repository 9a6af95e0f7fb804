"""Line formats and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def backup_line(columns: list[str]) -> Column:
    """One CSV line in which null is an empty unquoted field and every value, also '', is quoted."""

    def cell(c: str) -> Column:
        return F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))

    return F.concat_ws(",", *[cell(c) for c in columns])


def write_backup(rows: DataFrame, path: str) -> None:
    """Backup lines as text files; the column order is that of ``rows``."""
    rows.select(backup_line(rows.columns).alias("value")).write.text(path)


def read_backup(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """S6 read back: the cells as text, whatever line breaks and quotes they hold."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return spark.read.csv(path, schema=schema, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")


def json_record(columns: list[str]) -> Column:
    """S7."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
