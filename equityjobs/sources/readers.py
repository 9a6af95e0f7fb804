"""Readers of the stock list and of report files."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equityjobs.functions.texts import strip
from equityjobs.sources.scratch import bounded_batches, scratch_path, stored

# The six headers of the stock list, line breaks taken out.
STOCK_HEADERS = ("종목코드", "종목명", "시장", "산업명(대)", "산업명(중)", "주요제품")
STOCK_COLUMNS = ("code", "name", "market", "sector_major", "sector_minor", "products_text")


def read_stock_list(spark: SparkSession, path: str, headers: tuple[str, ...] = STOCK_HEADERS) -> DataFrame:
    """line_no and the six columns of a CSV list whose header cells may hold line breaks.

    Rows with fewer than six cells are left out, further cells ignored, cells trimmed; a wrong header is an error.
    A list in several files is read in the order of their names, the header in the first; each file is one task.
    """
    raw = spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    if len(raw.columns) < 6:
        raise ValueError(f"the stock list needs 6 columns, it has {len(raw.columns)}")
    # Numbers rise within a partition, and a file is not split, so a row's place in its file is a difference.
    rows = stored(raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id")), "stock_list")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = rows.groupBy("_file").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = rows.join(F.broadcast(files), "_file").withColumn("line_no", F.col("_before") + F.col("_id") - F.col("_first"))
    first = numbered.filter("line_no = 0").first()
    found = tuple((first[c] or "").replace("\r", "").replace("\n", "").strip() for c in raw.columns[:6]) if first else ()
    if found != headers:
        raise ValueError(f"unexpected header of the stock list: {found}")
    cells = [strip(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in zip(raw.columns, STOCK_COLUMNS)]
    return numbered.filter((F.col("line_no") > 0) & F.col(raw.columns[5]).isNotNull()).select("line_no", *cells)


#: Files of more bytes are read as a stream: a row cannot hold 2 GB, and a task should not hold a file.
_WHOLE_BYTES = 64 << 20


def read_report_files(spark: SparkSession, path: str, pattern: str = "*.pdf", whole: int = _WHOLE_BYTES) -> DataFrame:
    """Path, size and SHA-256 of the files under ``path``; Spark leaves out files without a byte.

    Files of over ``whole`` bytes are read by ``_hashed_streams``, each in one task, since SHA-256 has no parts.
    """

    def found() -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    small = found().filter(F.col("length") <= whole).select("path", F.col("length").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    if found().filter(F.col("length") > whole).select("path").isEmpty():
        return small
    return small.unionByName(_hashed_streams(spark, path, pattern, whole))


def _hashed_streams(spark: SparkSession, path: str, pattern: str, over: int) -> DataFrame:
    """path, size, sha256 of the files of more than ``over`` bytes, stored, whatever their size and the store they are in.

    Spark's text source reads a file piece by piece. Its lines, cut at line feeds only, are the file's bytes but for a byte order mark at the
    start and the last line feed; the size tells whether these were there. A file of which other bytes are read (Spark unpacks some by the
    end of their names) is an error, and so are 2 GB without a line feed.
    """
    own = spark.newSession()  # in which files are not split
    for key, value in spark.conf.getAll.items():
        if not key.startswith("spark.") or spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(key, str(1 << 40))
    bounded_batches(own)
    lines = own.read.format("text").option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = lines.filter(F.col("_metadata.file_size") > over).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    def digest(name: str, size: int, length: int, plain, marked) -> pa.RecordBatch:
        if size - length not in (0, 1, 3, 4):
            raise ValueError(f"{name} has {size} bytes, but {length} were read")
        state = plain if size - length < 2 else marked
        state.update(b"\n" * ((size - length) % 3))
        return pa.RecordBatch.from_pydict({"path": [unquote(name)], "size": [size], "sha256": [state.hexdigest()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, length, plain, marked = None, 0, 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            paths = batch.column(0).to_pylist() if batch.column(0)[0] != batch.column(0)[-1] else [batch.column(0)[0].as_py()] * len(batch)
            starts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
            for first, after in zip(starts, [*starts[1:], len(paths)]):
                data = b"\n".join(batch.column(2)[first:after].to_pylist())
                if paths[first] == name:
                    data = b"\n" + data
                else:
                    if name is not None:
                        yield digest(name, size, length, plain, marked)
                    name, size, length, plain, marked = paths[first], batch.column(1)[first].as_py(), 0, hashlib.sha256(), hashlib.sha256(codecs.BOM_UTF8)
                length += len(data)
                plain.update(data)
                marked.update(data)
        if name is not None:
            yield digest(name, size, length, plain, marked)

    schema, place = "path string, size long, sha256 string", scratch_path(spark, "file_hashes")
    rows.mapInArrow(run, schema).write.parquet(place)
    return spark.read.schema(schema).parquet(place)
