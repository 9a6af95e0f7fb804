"""From raw documents to packed training windows: five stages, each one operator.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's documents. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equityjobs.llm import language_id, line_dedup, mixing, packing, simhash
from equityjobs.llm.shared import join_side, numbered, stored, text_batches

#: A line on so many distinct sources is boilerplate; for a line of over LONG_LINE_WORDS words, LONG_LINE_SITES are enough.
LINE_SITES = 6
LONG_LINE_SITES = 4
LONG_LINE_WORDS = 50
#: Score at which the network's language replaces the given one.
SURE = 0.95
END_ID = 0
WINDOW = 1024


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go (null and empty texts too); lang becomes the predicted one where it is
    missing, or where the network disagrees with a score of at least ``SURE``.

    Scores reject no document: on sf0.1 those under 0.6 are short or mixed texts of a language. An empty table stays
    empty; columns of any name are kept.
    """
    found = language_id.labeller(language_id.fit(docs))(F.col("text"))
    text_batches(spark)
    both = docs.select(F.struct("*").alias("_doc"), found.alias("_found")).filter(F.col("_found.lang_pred") != language_id.UNDETERMINED)
    lang = F.when(F.col("_found.score") >= SURE, F.col("_found.lang_pred")).otherwise(F.coalesce("_doc.lang", "_found.lang_pred"))
    return both.select(*[(lang if c == "lang" else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all documents but the first that has them; n_chars follows the text.

    Null and empty texts, null sources and null ids have the results that ``line_dedup.dedup_lines`` states. An empty
    table stays empty; columns of any name but ``lines_removed`` (whose values then are the counts) are kept.
    """
    cleaned = line_dedup.dedup_lines(docs, sites=LINE_SITES, long_sites=LONG_LINE_SITES, long_words=LONG_LINE_WORDS)
    n_chars = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[n_chars.alias("n_chars") if c == "n_chars" else c for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates on five-word shingles, one document stays.

    Texts without a word are copies of each other. Rows are told apart by their place in the stored table, so
    null and repeated ids are documents of their own. An empty table stays empty; columns of any name are kept.
    """
    rows, row = numbered(docs)
    found = simhash.near_copies(rows.select(row, "text"), id_col=row)
    others = stored(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(row)), "near_copies")
    return rows.join(join_side(others), row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it does not take go.

    A null source is a source of its own, a text without a word is taken once. An empty table stays empty;
    columns of any name are kept.
    """
    rows, row = numbered(docs)
    taken = mixing.mix(rows.select(row, "text", "source"), id_col=row).filter("copies > 0").select(F.col("doc_id").alias(row), F.array_repeat(F.lit(1), F.col("copies")).alias(row + "copies"))
    both = rows.join(join_side(stored(taken, "copies")), row)
    return both.select(*docs.columns, F.explode(row + "copies").alias(row + "copy")).drop(row + "copy")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset: the packed pieces with their token ids.

    A null or empty text is the end id alone; an empty table gives no rows; other columns are left out.
    """
    import public_tokenizers

    pieces = stored(packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, WINDOW), "pieces", compression="zstd")
    return packing.pack(pieces, WINDOW).select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL cannot express the network, the Newton steps or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
