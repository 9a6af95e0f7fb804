"""Boundary values of the column functions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from equityjobs.functions import dates, numbers, texts


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("moment", "day"),
    [("2026-05-11 10:59:59", "2026-05-08"), ("2026-05-11 11:00:00", "2026-05-11"), ("2026-05-09 12:00:00", "2026-05-08"), ("2026-05-10 12:00:00", "2026-05-08"), ("2026-05-12 00:00:00", "2026-05-11")],
)
def test_expected_trading_day(spark, moment, day):
    assert value(spark, dates.expected_trading_day(F.lit(datetime.fromisoformat(moment)).cast("timestamp"))) == date.fromisoformat(day)


def test_korean_date_is_the_next_day_after_three(spark):
    assert value(spark, dates.korean_date(F.lit("2026-05-11 16:00:00").cast("timestamp"))) == date(2026, 5, 12)
    assert value(spark, dates.bucket(F.lit(date(2026, 5, 17)), "W")) == date(2026, 5, 11)


@pytest.mark.parametrize(
    ("old", "new", "unit", "metric", "label"),
    [
        (100.0, 112.5, "원", "매출", "+12.50%"), (5.0, 4.0, "%", "ROE", "-1.00%p"), (-1.0, 2.0, "원", "영업이익", "흑자 전환"), (1.0, -2.0, "원", "EPS", "적자 전환"), (-1.0, 2.0, "원", "매출", "음수→양수"),
        (0.0, 2.0, "원", "매출", "+2.00 원 (증감률 미표시)"), (None, 2.0, "원", "매출", "비교값 없음"),
    ],
)
def test_change_labels(spark, old, new, unit, metric, label):
    columns = numbers.numeric_change(F.lit(old).cast("double"), F.lit(new).cast("double"), F.lit(unit), F.lit(metric))
    assert value(spark, columns[2]) == label


@pytest.mark.parametrize(("total", "failed", "status"), [(10, 0, "ok"), (10, 2, "partial"), (10, 3, "failed")])
def test_run_status_boundary(spark, total, failed, status):
    assert value(spark, numbers.run_status(F.lit(total), F.lit(failed))) == status


@pytest.mark.parametrize(("seed", "peer", "reaction"), [(9.99, 1.0, "undetermined"), (10.0, 2.4, "none"), (10.0, 2.5, "partial"), (10.0, 5.9, "partial"), (10.0, 6.0, "reacted"), (None, 6.0, "undetermined")])
def test_reaction_boundaries(spark, seed, peer, reaction):
    day = F.lit("2026-05-11")
    assert value(spark, numbers.reaction(F.lit(seed).cast("double"), day, F.lit(peer), day, F.lit(True))) == reaction
    assert value(spark, numbers.reaction(F.lit(seed).cast("double"), day, F.lit(peer), F.lit("2026-05-08"), F.lit(True))) == "undetermined"


def test_candidate_needs_all_six(spark):
    good = numbers.candidate_reasons(F.lit("none"), F.lit("partial"), F.lit(True), F.lit(500_000_000), F.lit(False), F.lit("related"))
    assert value(spark, good) == []
    unknown = numbers.candidate_reasons(F.lit(None), F.lit("undetermined"), F.lit(None).cast("boolean"), F.lit(None).cast("long"), F.lit(None).cast("boolean"), F.lit(None))
    assert value(spark, unknown) == ["has_reports", "undetermined", "not_traded", "low_liquidity", "holding", "weak_similarity"]


@pytest.mark.parametrize(
    ("text", "found"), [("1,234.5 and (20)", [1234.5, -20.0]), ("−7 or －8", [-7.0, -8.0]), ("(-5) is dropped", []), ("", []), (None, []), ("3 3", [3.0])]
)
def test_numbers_in(spark, text, found):
    assert value(spark, texts.numbers_in(F.lit(text).cast("string"))) == found


@pytest.mark.parametrize(
    ("name", "tag"),
    [("A_20260511_Mirae+Asset_123.pdf", "Mirae+Asset"), ("A_20260511_31780_1.pdf", None), ("A_20260511_+_1.pdf", None), ("A_20260511_가나_1.pdf", "가나"), ("A_20260511_x_1.pdf\n", None), (None, None)],
)
def test_filename_tag(spark, name, tag):
    assert value(spark, texts.filename_tag(F.lit(name).cast("string"))) == tag


def test_keys_replace_whole_words_only(spark):
    spellings = texts.spelling_map({"양극재": ["cathode", "양극 활물질"]})
    for term, key in (("Cathode", "양극재"), ("양극-활물질", "양극재"), ("high cathode/NCM", "high양극재/ncm"), ("cathodes", "cathodes"), ("", ""), (None, "")):
        assert value(spark, texts.term_key(F.lit(term).cast("string"), spellings)) == key


def test_safe_file_names(spark):
    for name, safe in (("a:b?.txt", "a_b_.txt.pdf"), (" .", "unnamed.pdf"), ("x" * 120 + ".pdf", "x" * 96 + ".pdf"), ("R.PDF", "R.PDF")):
        assert value(spark, texts.safe_file_name(F.lit(name))) == safe


def test_versions_compare_as_numbers(spark):
    for version, ok in (("0.1.9", False), ("0.2.0", True), ("v0.10.0", True), ("0.2", True), ("rc", False), (None, False)):
        assert value(spark, texts.supported_parser(F.lit(version).cast("string"))) is ok


def test_flags_and_shares(spark):
    assert value(spark, numbers.with_no_data(F.array(F.lit("zz"), F.lit("halted")))) == ["no_data", "halted", "zz"]
    assert value(spark, numbers.with_no_data(F.lit(None).cast("array<string>"))) == ["no_data"]
    assert [value(spark, texts.format_share(F.lit(x))) for x in (98.1, 50.0, 0.0, -1.0)] == ["98.1", "50", "0", None]
