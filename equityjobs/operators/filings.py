"""Filing sections to target companies and extraction inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions.texts import strip, supported_parser, version_parts

# Section codes, block labels and caps of the extraction input.
OVERVIEW, PRODUCTS, SALES, NOTES, FINANCIAL = "020100", "020200", "020400", "020700", "020800"
LABELS = {"overview": "[사업의 개요]", "products": "[주요 제품 및 서비스]", "product_tables": "[주요 제품 표]", "notes": "[기타 참고사항]", "sales": "[매출 및 수주]", "financial": "[영업의 현황]"}
CAPS = {"overview": 6000, "products": 2500, "product_tables": 2500, "notes": 3000, "sales": 1500, "financial": 6000}
SHORT_OVERVIEW, INPUT_CAP = 800, 12000
TABLE_WORDS, PRICE_MARKS = "품목|제품|부문|용도|상표", r"천/톤|원/|\$/|단가"


def sections_of_year(sections: DataFrame, fiscal_year: int) -> DataFrame:
    """S3: final sections of a year from supported parsers; the filters reach the scan, and texts only if selected."""
    return sections.filter((F.col("fiscal_year") == fiscal_year) & F.col("is_final") & supported_parser(F.col("parser_version")))


def newest_sections(sections: DataFrame) -> DataFrame:
    """Per filing and section code the numerically newest parser version (then the highest doc_id)."""
    newest = Window.partitionBy("stock_code", "rcept_no", "section_code").orderBy(F.desc(version_parts(F.col("parser_version"))), F.desc("doc_id"))
    return sections.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def latest_filings(sections: DataFrame) -> DataFrame:
    """One filing per company, by fiscal end, then receipt number."""
    latest = F.max_by(F.struct("corp_cls", "corp_name", "fiscal_end"), F.struct("fiscal_end", "rcept_no", "section_code")).alias("_f")
    return sections.groupBy("stock_code").agg(latest, F.max(F.struct("fiscal_end", "rcept_no")).alias("_k")).select("stock_code", F.col("_k.rcept_no").alias("rcept_no"), "_f.*")


def targets(filings: DataFrame, stocks: DataFrame, excluded: str, reit_sector: str) -> DataFrame:
    """Listed companies of class Y or K, no REIT, without an excluded word in either name."""
    listed = stocks.select(F.col("code").alias("stock_code"), "name", "sector_minor")
    kept = filings.filter(F.col("corp_cls").isin("Y", "K")).join(listed, "stock_code")
    bad = F.coalesce(F.col("corp_name").rlike(excluded), F.lit(False)) | F.coalesce(F.col("name").rlike(excluded), F.lit(False))
    return kept.filter((F.trim(F.coalesce("sector_minor", F.lit(""))) != reit_sector) & ~bad)


def is_product_table(table: Column) -> Column:
    """a header word, two rows or more, no unit price, and at most 70 % numeric cells."""
    rows = F.filter(F.split(table, "\n"), lambda r: strip(r) != "")
    cells = F.flatten(F.transform(rows, lambda r: F.transform(F.split(r, r"\|"), strip)))
    filled = F.filter(cells, lambda c: ~c.rlike(r"\A[-–—]*\z"))
    bare = F.transform(filled, lambda c: F.regexp_replace(c, r"[,% ]", ""))
    plain = F.transform(bare, lambda c: F.when(c.rlike(r"\A\(.*\)\z"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c))
    numeric = F.filter(plain, lambda c: c.rlike(r"\A[+\-−△▲▽]?\d+(?:\.\d+)?\z"))
    return (F.size(rows) >= 2) & F.get(rows, F.lit(0)).rlike(TABLE_WORDS) & ~table.rlike(PRICE_MARKS) & (F.size(numeric) * 100 <= 70 * F.size(filled))


def product_tables(tables: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(tables, F.lit("")), r"\n\s*\n"), strip), lambda t: t != "")
    return F.array_join(F.filter(parts, is_product_table), "\n\n")


def assembled_inputs(sections: DataFrame) -> DataFrame:
    """one labelled, capped text per (stock_code, rcept_no), with the sections used and whether it was cut."""

    def text(code: str, part: str) -> Column:
        return F.max(F.when(F.col("section_code") == code, strip(F.coalesce(F.col(part), F.lit("")))))

    wide = sections.groupBy("stock_code", "rcept_no").agg(
        text(OVERVIEW, "prose_text").alias("overview"), text(PRODUCTS, "prose_text").alias("products"),
        F.max(F.when(F.col("section_code") == PRODUCTS, product_tables(F.col("table_text")))).alias("product_tables"),
        text(NOTES, "prose_text").alias("notes"), text(SALES, "prose_text").alias("sales"),
        text(FINANCIAL, "prose_text").alias("_prose"), text(FINANCIAL, "table_text").alias("_tables"),
    )
    joined = F.concat_ws("\n\n", F.nullif(F.col("_prose"), F.lit("")), F.nullif(F.col("_tables"), F.lit("")))
    short = F.length(F.coalesce("overview", F.lit(""))) < SHORT_OVERVIEW
    business = F.col("_prose").isNull() | F.col("products").isNotNull()
    shown = {"overview": F.lit(True), "products": business, "product_tables": business, "notes": short, "sales": short, "financial": F.col("_prose").isNotNull()}
    codes = {"overview": OVERVIEW, "products": PRODUCTS, "product_tables": PRODUCTS, "notes": NOTES, "sales": SALES, "financial": FINANCIAL}
    wide = wide.withColumn("financial", joined)
    there = {b: shown[b] & (F.coalesce(F.col(b), F.lit("")) != "") for b in LABELS}
    blocks = [F.when(there[b], F.concat(F.lit(f"{LABELS[b]}\n"), F.substring(F.col(b), 1, CAPS[b]))) for b in LABELS]
    over = F.lit(False)
    for b in LABELS:
        over |= there[b] & (F.length(F.col(b)) > CAPS[b])
    used = F.array_distinct(F.array_compact(F.array(*[F.when(there[b], codes[b]) for b in LABELS])))
    whole = wide.withColumn("_text", F.concat_ws("\n\n", *blocks)).withColumn("truncated", over | (F.length("_text") > INPUT_CAP))
    return whole.select("stock_code", "rcept_no", F.substring("_text", 1, INPUT_CAP).alias("text"), used.alias("sections"), "truncated")


def profile_work(wanted: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to do, reused) targets; a target is reused when its ok profile has the same filing and parser version."""
    keys = ["stock_code", "rcept_no", "parser_version"]
    done = profiles.filter("status = 'ok'").select(*keys)
    return wanted.join(done, keys, "left_anti"), wanted.join(done, keys, "left_semi")


def missing_embeddings(profiles: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """Ok profiles without an embedding under ``keys``."""
    return profiles.filter("status = 'ok'").join(embeddings.select(*keys), keys, "left_anti")
