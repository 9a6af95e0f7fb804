"""Line dedup by distinct-site spread: lines on many sites are boilerplate and stay in one document only.

Each line's hash gets a HyperLogLog sketch of the sites it stands on; partial sketches merge by aggregation.
Lines whose estimate is clear of the threshold are decided by it, lines near the threshold by an exact
distinct count. Only lines with as many rows as the threshold asks for sites can reach it, so the others
never get a sketch. Rows of lines meet the narrow tables of lines by broadcast or over salts, so no very common line
is one task's; texts stay where they are read as long as the boilerplate lines may be broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityjobs.llm import shared
from equityjobs.llm.shared import looked_up, numbered, stored


def _lines(text: Column) -> Column:
    """Lines of a text, parted by line feeds; null has none."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _hash(line: Column) -> Column:
    """Hash of a line without the blanks around it; null for a blank line, which is never boilerplate."""
    return F.when(_bare(line) != "", F.xxhash64(_bare(line)))


def _need(line: Column, sites: int, long_sites: int, long_words: int) -> Column:
    """Sites that make the line boilerplate; a line of over ``long_words`` words has over twice as many characters."""
    words = F.when(F.length(line) > 2 * long_words, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0)
    return F.when(words > long_words, long_sites).otherwise(sites)


def boilerplate(standings: DataFrame, sites: int, lg_k: int = 12, sigmas: float = 6.0) -> DataFrame:
    """Line hashes on at least ``sites`` distinct sites: ``h``, from stored rows (h, site), with an exact edge.

    With 2**lg_k registers the relative standard error is at most 1.04 / sqrt(2**lg_k); lines within ``sigmas``
    of them (and of 1) around the threshold are counted exactly. A null site is a site of its own. A column
    ``need`` has the threshold of each line instead of ``sites``.
    """
    need = F.min("need") if "need" in standings.columns else F.lit(sites)
    spread = "_row" if "_row" in standings.columns else "site"
    often = standings.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), need.alias("_need")).filter("_n >= _need").select("h", "_need")
    often = stored(often, "often")
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit("~"))
    candidates = looked_up(standings, often, "h", spread).select("h", "_need", site.alias("site"))
    # Each task sketches the lines that it reads; the shuffle merges sketches.
    sketched = candidates.groupBy("h", "_need").agg(F.hll_sketch_agg("site", lg_k).alias("_sketch"))
    estimated = stored(sketched.select("h", "_need", F.hll_sketch_estimate("_sketch").alias("_sites")), "spread")
    slack = F.greatest(F.lit(1.0), F.col("_need") * (sigmas * 1.04 / (2**lg_k) ** 0.5))
    sure = estimated.filter(F.col("_sites") >= F.col("_need") + slack).select("h")
    near = estimated.filter((F.col("_sites") < F.col("_need") + slack) & (F.col("_sites") > F.col("_need") - slack - 1)).select("h")
    counted = looked_up(candidates, stored(near, "near"), "h", "site").distinct().groupBy("h", "_need").agg(F.count(F.lit(1)).alias("_sites"))
    return stored(sure.unionByName(counted.filter("_sites >= _need").select("h")), "boilerplate")


def _stays(lines: pa.ListArray, rows: np.ndarray, hashes: np.ndarray, owners: np.ndarray) -> pa.Array:
    """For each text's line hashes which lines stay; null where all do. ``hashes`` is sorted, with the owning row of each."""
    flat = lines.flatten()
    ends = np.cumsum(np.concatenate([[0], lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
    text = np.repeat(np.arange(len(lines)), np.diff(ends))
    value = flat.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(hashes, value), max(len(hashes) - 1, 0))
    known = (hashes[at] == value) & flat.is_valid().to_numpy(zero_copy_only=False) if len(hashes) else np.zeros(len(value), bool)
    stays = ~known
    mine = np.flatnonzero(known)
    mine = mine[owners[at[mine]] == rows[text[mine]]]
    if len(mine):  # the first of each line in the text that owns it
        order = mine[np.lexsort((mine, value[mine], text[mine]))]
        first = np.append(True, (value[order][1:] != value[order][:-1]) | (text[order][1:] != text[order][:-1]))
        stays[order[first]] = True
    touched = np.zeros(len(lines), bool)
    touched[text[~stays]] = True
    return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(stays), mask=pa.array(~touched))


def dedup_lines(docs: DataFrame, sites: int = 12, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", long_sites: int | None = None, long_words: int = 50) -> DataFrame:
    """All rows and columns of ``docs``, with boilerplate lines left out of ``text_col``, and lines_removed.

    A line (blanks around it apart) on at least ``sites`` distinct sites stays where it stands first in the
    row with the smallest id (of rows that repeat it, the first; null ids come last) and goes everywhere else, so no
    content is lost. Blank lines stay. A null or empty text stays as it is. A null site is a site of its own. An
    empty table gives no rows. ``lines_removed`` takes the place of a column of that name.
    With ``long_sites``, that many sites are enough for a line of over ``long_words`` words.
    """
    least = sites if long_sites is None else long_sites

    def entry(line: Column) -> Column:
        return F.when(_bare(line) != "", F.struct(_hash(line).alias("h"), _need(_bare(line), sites, least, long_words).alias("need")))

    rows, row = numbered(docs)
    entries = F.array_compact(F.transform(_lines(F.col(text_col)), entry if least != sites else _hash))
    per_doc = rows.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), F.col(site_col).alias("site"), F.explode(F.array_distinct(entries)).alias("_line"))
    columns = ["_line.*"] if least != sites else [F.col("_line").alias("h")]
    standings = stored(per_doc.select("_row", "_id", "site", *columns), "standings")
    common = boilerplate(standings.drop("_id"), sites)
    hits = stored(looked_up(standings, common, "h", "_row").select("_row", "_id", "h"), "hits")
    owner = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row")))["_row"]
    owners = stored(hits.groupBy("h").agg(owner.alias("_owner")), "owners")
    # All columns of a document travel in one struct, so no name can clash.
    wrapped = rows.select(F.struct(*docs.columns).alias("_doc"), F.col(row).alias("_row"))
    lines = _lines(F.col(f"_doc.{text_col}"))
    known = F.transform(lines, _hash)
    if owners.count() <= shared.BROADCAST_ROWS:
        table = owners.orderBy("h").toArrow()
        held = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("h", "_owner")))

        @F.arrow_udf("array<boolean>")
        def stays(hashes: pa.Array, number: pa.Array) -> pa.Array:
            return _stays(hashes, number.to_numpy(zero_copy_only=False), *held.value)

        kept = wrapped.withColumn("_stays", stays(known, F.col("_row")))
    else:
        # Per document: its boilerplate hashes, and those of them that it owns.
        owned = F.when(F.col("_row") == F.col("_owner"), F.col("h"))
        marks = looked_up(hits, owners, "h", "_row").groupBy("_row").agg(F.collect_set("h").alias("_common"), F.collect_set(owned).alias("_own"))

        def line_stays(h: Column, at: Column) -> Column:
            mine = F.coalesce(F.array_contains("_own", h), F.lit(False)) & (F.array_position("_known", h) == at + 1)
            return ~F.coalesce(F.array_contains("_common", h), F.lit(False)) | mine

        marked = wrapped.join(marks, "_row", "left").withColumn("_known", F.when(F.col("_common").isNotNull(), known))
        kept = marked.withColumn("_stays", F.transform("_known", line_stays))
    left = F.filter(lines, lambda line, at: F.get("_stays", at))
    touched = F.col("_stays").isNotNull()
    text = F.when(touched, F.array_join(left, "\n")).otherwise(F.col(f"_doc.{text_col}"))
    removed = F.when(touched, F.size(F.filter("_stays", lambda x: ~x))).otherwise(0).alias("lines_removed")
    others = [c for c in docs.columns if c != "lines_removed"]
    return kept.select(*[text.alias(c) if c == text_col else F.col(f"_doc.{c}").alias(c) for c in others], removed)
