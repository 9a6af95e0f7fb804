"""Operators on small hand-made rows."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from equityjobs.functions import texts
from equityjobs.operators import classify, compare, coverage, filings, lifecycle, peers, prices, terms, vectors
from equityjobs.sources import readers, sinks


def test_series_returns_and_twenty_day_value(spark):
    days = [(("A", date(2026, 1, 1).fromordinal(date(2026, 1, 1).toordinal() + i), 100 + i, None if i % 2 else 10 * i + 1, i)) for i in range(6)]
    days += [("A", days[-1][1], 0, 5, 99), ("A", days[-1][1], 210, 7, 98), ("B", days[0][1], 50, None, 0)]
    rows = spark.createDataFrame(days, "stock_code string, day date, close long, trading_value long, seq long")
    stocks = spark.createDataFrame([("A", "KOSDAQ GLOBAL"), ("B", "KONEX")], "code string, market string")
    quotes = spark.createDataFrame([("A", True, False, 1)], "stock_code string, halted boolean, admin_issue boolean, market_cap long")
    got = {r["stock_code"]: r for r in prices.snapshots(prices.usable_rows(rows, ["seq"]), quotes, stocks).collect()}
    assert got["A"]["close"] == 210 and got["A"]["ret_1w"] == pytest.approx(110.0) and got["A"]["ret_1m"] is None
    assert got["A"]["market"] == "KOSDAQ" and got["A"]["avg_value_20d"] == (1 + 21 + 41 + 7 + 2) // 4 and got["A"]["flags"] == ["short_history", "halted"]
    assert got["B"]["market"] is None and got["B"]["avg_value_20d"] is None and got["B"]["ret_1w"] is None


@pytest.mark.parametrize("by", ["broker", "data_provider", "ir_agency", "other", None, ""])
@pytest.mark.parametrize("kind", ["단일종목", "산업", "섹터", "IR자료", "전략·시황", "기타", None, ""])
@pytest.mark.parametrize("codes", [["1"], ["1", "2"], ["1", "1"]])
def test_report_kinds_are_exclusive(by, kind, codes, counted):
    broker = by in ("broker", None, "")
    expected = (0, 0, 0)
    if broker and kind in ("단일종목", "기타", None, "") and codes == ["1"]:
        expected = (1, 0, 0)
    elif broker and kind == "섹터":
        expected = (0, 1, 0)
    elif not broker:
        expected = (0, 0, 1)
    assert counted[(by, kind, "|".join(codes))] == expected


@pytest.fixture(scope="module")
def counted(spark):
    cases = [(b, k, c) for b in ("broker", "data_provider", "ir_agency", "other", None, "") for k in ("단일종목", "산업", "섹터", "IR자료", "전략·시황", "기타", None, "") for c in (["1"], ["1", "2"], ["1", "1"])]
    rows = spark.createDataFrame([(i, date(2026, 5, 1), datetime(2026, 5, 1), "p", b, k, [f"{i}-{x}" for x in c]) for i, (b, k, c) in enumerate(cases)], "id long, published_at date, sent_at timestamp, publisher string, publisher_type string, report_type string, stock_codes array<string>")
    codes = spark.createDataFrame([(f"{i}-1",) for i in range(len(cases))], "code string")
    got = {r["code"]: (r["stock_reports"], r["sector_mentions"], r["other_research"]) for r in coverage.report_counts(rows, codes, date(2026, 5, 2)).collect()}
    return {(b, k, "|".join(c)): got[f"{i}-1"] for i, (b, k, c) in enumerate(cases)}


def test_report_count_dates_and_labels(spark):
    today = date(2026, 5, 11)

    def ago(n):
        return today.fromordinal(today.toordinal() - n)

    rows = [(ago(365), None, "in"), (ago(366), None, "out"), (None, datetime(2025, 5, 10, 15), "sent in"), (None, datetime(2025, 5, 10, 14, 59, 59), "sent out"), (None, None, "never")]
    rows += [(ago(180), None, "fresh")] * 3 + [(ago(181), None, "late")] * 3 + [(ago(1), None, "two")] * 2
    df = spark.createDataFrame([(p, s, None, None, None, [c]) for p, s, c in rows], "published_at date, sent_at timestamp, publisher string, publisher_type string, report_type string, stock_codes array<string>")
    codes = spark.createDataFrame([(c,) for c in {r[2] for r in rows}] + [("nobody",), ("nobody",)], "code string")
    got = {r["code"]: (r["stock_reports"], r["label"], r["brokers"]) for r in coverage.report_counts(df, codes, today).collect()}
    assert got == {"in": (1, "few", 0), "out": (0, "none", 0), "sent in": (1, "few", 0), "sent out": (0, "none", 0), "never": (0, "none", 0), "fresh": (3, "covered", 0), "late": (3, "few", 0), "two": (2, "few", 0), "nobody": (0, "none", 0)}


def test_percentile_table_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    groups = rng.integers(0, 7, 60)
    rows = spark.createDataFrame([(i, int(g), [float(x) for x in row]) for i, (g, row) in enumerate(zip(groups, v))], "id long, g int, vector array<double>")
    got = {r["percentile"]: r["cosine"] for r in vectors.percentile_table(vectors.pair_cosines(rows, ["id"], group="g", size=16)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.triu_indices(60, 1)
    keep = groups[i] != groups[j]
    expected = np.percentile((u @ u.T)[i[keep], j[keep]], sorted(got))
    assert np.allclose([got[p] for p in sorted(got)], expected, atol=1e-8)
    assert vectors.percentile_table(vectors.pair_cosines(rows.limit(1), ["id"])).count() == 0


def test_percentile_of_a_similarity(spark):
    table = spark.createDataFrame([(95.0, 0.5), (98.0, 0.625), (99.0, 0.625), (99.5, 0.75), (100.0, 0.875)], "percentile double, cosine double")
    rows = spark.createDataFrame([(0.49,), (0.5,), (0.5625,), (0.625,), (0.8125,), (0.9,)], "s double")
    got = {r["s"]: r["p"] for r in peers.with_percentile(rows, table, "s", "p").collect()}
    assert got == {0.49: None, 0.5: 95.0, 0.5625: 97.0, 0.625: 99.0, 0.8125: 99.75, 0.9: 100.0}


def test_metrics_must_occur_once_on_both_sides(spark):
    base = ("매출", "2026E", "원", "KRW", "연결", "추정", "기본")
    rows = [(1, *base, 100.0), (2, *base, 110.0), (1, "EPS", *base[1:], 5.0), (1, "EPS", *base[1:], 6.0), (2, "EPS", *base[1:], 7.0), (1, "영업이익", *base[1:4], "미기재", *base[5:], 1.0), (2, "영업이익", *base[1:4], "미기재", *base[5:], 2.0)]
    rows += [(1, "순이익", *base[1:5], "실적", base[6], 1.0), (2, "순이익", *base[1:5], "실적", base[6], 2.0), (1, "DPS", base[1], base[2], None, *base[4:], 3.0), (2, "DPS", base[1], base[2], None, *base[4:], 3.0)]
    metrics = spark.createDataFrame(rows, "id long, metric string, fiscal_period string, unit string, currency string, accounting_basis string, value_type string, scenario string, value double")
    pairs = spark.createDataFrame([(1, 2)], "previous_id long, current_id long")
    got = {r["metric"]: r["change_label"] for r in compare.revisions(pairs, metrics).collect()}
    assert got == {"매출": "+10.00%", "DPS": "+0.00%"}


def test_horizon_drivers_need_two_bases(spark):
    row = [("평가기간 변경", "a", "b"), ("평가기간 변경", "a", "a"), ("평가기간 변경", None, "b"), ("실적", None, None)]
    df = spark.createDataFrame([(row,)], "d array<struct<category: string, previous_basis: string, current_basis: string>>")
    assert [tuple(x) for x in df.select(compare.kept_drivers(F.col("d")).alias("d")).first()["d"]] == [row[0], row[3]]


def test_spellings_multiply_up_to_the_cap(spark):
    words = spark.createDataFrame([("cathode NCM",), ("plain",), ("  ",)], "term string")
    got = {r["term"]: r["spellings"] for r in terms.term_spellings(words, {"양극재": ["cathode"], "엔씨엠": ["NCM"]}).collect()}
    assert got["cathode NCM"] == ["cathodencm", "cathode엔씨엠", "양극재ncm", "양극재엔씨엠"] and got["plain"] == ["plain"] and got["  "] == []
    many = {f"s{i}": [f"v{i}a", f"v{i}b"] for i in range(6)}
    long = spark.createDataFrame([(" ".join(f"s{i}" for i in range(6)),)], "term string")
    assert len(terms.term_spellings(long, many).first()["spellings"]) == 64


def test_tidy_keeps_the_first_of_a_key(spark):
    spellings = texts.spelling_map({"양극재": ["cathode"]})
    df = spark.createDataFrame([([" Cathode ", "양극재", "", "b", "B", "c"],)], "t array<string>")
    assert df.select(terms.tidy(F.col("t"), 2, spellings).alias("t")).first()["t"] == ["Cathode", "b"]
    assert df.select(terms.capped_roles(F.expr("cast(array() as array<string>)")).alias("r")).first()["r"] == ["기타"]


def test_financial_format_has_no_product_blocks(spark):
    rows = [("1", 1, "020100", "short", ""), ("1", 1, "020800", "bank", "t | 1"), ("1", 1, "020700", "notes", ""), ("2", 2, "020100", "x" * 6001, ""), ("2", 2, "020200", "p", "품목 | 비중\na | 1%\nb | c"), ("2", 2, "020700", "hidden", "")]
    df = spark.createDataFrame(rows, "stock_code string, rcept_no long, section_code string, prose_text string, table_text string")
    got = {r["stock_code"]: r for r in filings.assembled_inputs(df).collect()}
    assert got["1"]["text"] == "[사업의 개요]\nshort\n\n[기타 참고사항]\nnotes\n\n[영업의 현황]\nbank\n\nt | 1" and got["1"]["sections"] == ["020100", "020700", "020800"]
    assert got["2"]["truncated"] and "hidden" not in got["2"]["text"] and "[주요 제품 표]" in got["2"]["text"]


def test_upsert_keeps_unsent_columns(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, note string")
    received = spark.createDataFrame([(2, None), (3, "c")], "id long, title string")
    assert sorted(tuple(r) for r in lifecycle.upsert(stored, received, ["id"]).collect()) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_nothing_is_dropped_without_a_public_build(spark):
    builds = spark.createDataFrame([(i, s, i) for i, s in enumerate(["pilot", "failed", "running"])], "build_id long, status string, finished_no long")
    assert lifecycle.dropped_builds(builds).count() == 0


def test_exactly_six_hours_is_not_silent(spark):
    now = datetime(2026, 5, 11, 12)
    builds = spark.createDataFrame([(1, "running", datetime(2026, 5, 11, 6)), (2, "running", datetime(2026, 5, 11, 5, 59, 59)), (3, "done", datetime(2026, 5, 1))], "build_id long, status string, heartbeat_at timestamp")
    assert {r["build_id"]: r["status"] for r in lifecycle.closed_builds(builds, now).collect()} == {1: "running", 2: "failed", 3: "done"}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id long, published_at date, sent_at timestamp, publisher string, publisher_type string, report_type string, stock_codes array<string>, sectors_major array<string>, out_of_scope_reason string")
    codes = spark.createDataFrame([("1",)], "code string")
    assert coverage.sector_timeseries(empty, "sectors_major", [], "D").count() == 0 and coverage.market_totals(empty).first()["total"] == 0
    assert coverage.report_counts(empty, codes, date(2026, 1, 1)).first()["label"] == "none"


def test_stock_list_rules(spark, tmp_path):
    heads = ",".join(f'"{h[:2]}\n{h[2:]}"' for h in readers.STOCK_HEADERS)
    (tmp_path / "list.csv").write_text(heads + '\n"000001"," A ",KOSPI,S,M,"x, y 등",extra\nshort,row\n000002,B,KOSDAQ,S,M,z\n', encoding="utf-8")
    got = readers.read_stock_list(spark, f"file://{tmp_path}/list.csv").orderBy("line_no").collect()
    assert [(r["code"], r["name"], r["products_text"]) for r in got] == [("000001", "A", "x, y 등"), ("000002", "B", "z")]
    (tmp_path / "bad.csv").write_text("a,b,c,d,e,f\n1,2,3,4,5,6\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_stock_list(spark, f"file://{tmp_path}/bad.csv")


def test_backup_lines_tell_null_from_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ""), (2, 'a"b', "c")], "id long, x string, y string")
    sinks.write_backup(df, f"file://{tmp_path}/backup")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/backup").collect()) == ['"1",,""', '"2","a""b","c"']


def test_repeated_codes_and_names(spark):
    rows = [(0, "1", "Big Co"), (1, "1", "Renamed"), (2, "2", "bigco")]
    by_code, by_name = classify.keyed_stocks(spark.createDataFrame(rows, "line_no long, code string, name string"))
    assert {r["code"]: r["name"] for r in by_code.collect()} == {"1": "Renamed", "2": "bigco"}
    assert {r["name_key"]: r["code"] for r in by_name.collect()} == {"bigco": "1", "renamed": "1"}


def test_sampled_cosines_are_cosines_of_given_pairs(spark):
    """A15 has no SQL: its draws are checked one by one against all pairs."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 5))
    rows = [(f"c{i // 2:02d}", i % 2, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "code string, seg_no int, vector array<double>")
    got = vectors.sampled_cosines(df, ["code", "seg_no"], "code", 500, seed=3).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    pairs = np.sort([unit[i] @ unit[j] for i in range(40) for j in range(i) if i // 2 != j // 2])
    at = np.searchsorted(pairs, [r["cosine"] for r in got])
    near = np.minimum(np.abs(pairs[np.minimum(at, len(pairs) - 1)] - [r["cosine"] for r in got]), np.abs(pairs[np.maximum(at - 1, 0)] - [r["cosine"] for r in got]))
    assert len(got) == 500 and near.max() < 1e-12
    assert [tuple(r) for r in got] == [tuple(r) for r in vectors.sampled_cosines(df, ["code", "seg_no"], "code", 500, seed=3).collect()]
    assert len({round(r["cosine"], 9) for r in got}) > 300  # drawn from all over


def test_pair_percentiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(90, 6))
    rows = [(f"c{i:02d}", f"g{i % 7}", [float(x) for x in v]) for i, v in enumerate(m)] + [("zero", "g1", [0.0] * 6)]
    df = spark.createDataFrame(rows, "code string, grp string, vector array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cosines = [round(float(unit[i] @ unit[j]), 9) for i in range(90) for j in range(i) if i % 7 != j % 7]
    got = vectors.pair_percentiles(df, ["code"], group="grp", size=20, points=(0.0, 37.5, 95.0, 99.99, 100.0)).collect()
    assert [r["percentile"] for r in got] == [0.0, 37.5, 95.0, 99.99, 100.0]
    assert np.allclose([r["cosine"] for r in got], np.percentile(cosines, [0, 37.5, 95, 99.99, 100]), atol=2e-9)
    assert vectors.pair_percentiles(df.limit(1), ["code"]).count() == 0


def test_report_files_by_content(spark, tmp_path):
    """S4 has no SQL: names, sizes and checksums are those of the files."""
    import hashlib

    from equityjobs.sources import readers

    files = {"a.pdf": b"%PDF-1", "b.pdf": b"2" * 70_000, "c.txt": b"other"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in readers.read_report_files(spark, f"file://{tmp_path}", "*.pdf").collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items() if n.endswith(".pdf")}


def test_requeue_resets_only_what_is_unchanged(spark, tmp_path):
    from equityjobs.plans import jobs

    schema = "id long, tagging_status string, tagging_notes string, publisher string, publisher_type string, file_name string, title string, renders boolean"
    rows = [(i, "review_needed", "krx_unmatched_in_scope:x", None, None, "plain.pdf", 'a "title"\nof two lines', True) for i in range(6)] + [(9, "verified", None, None, None, "p.pdf", "t", True)]
    before = spark.createDataFrame(rows, schema)
    for c in ("published_at date", "report_type string", "out_of_scope_reason string", "tagging_confidence string", "tagged_at timestamp", "tagger_version string", "taxonomy_version string", "tagging_locked_at timestamp", "tagging_worker_id string"):
        name, kind = c.split()
        before = before.withColumn(name, F.lit(None).cast(kind))
    for name in ("analysts", "stock_codes", "company_names", "stock_codes_raw", "company_names_raw", "sectors_major", "sectors_minor", "products"):
        before = before.withColumn(name, F.expr("cast(array() as array<string>)"))
    now = before.withColumn("title", F.when(F.col("id") == 2, "changed").otherwise(F.col("title"))).withColumn("tagging_notes", F.when(F.col("id") != 3, F.col("tagging_notes")))
    publishers = spark.createDataFrame([("P1", "p1", "broker")], "canonical string, alias string, publisher_type string")
    done = jobs.requeue(before, now, publishers, ["title", "tagging_status"], f"file://{tmp_path}/backup")
    assert sorted(r["id"] for r in done.collect()) == [0, 1, 4, 5] and {r["tagging_status"] for r in done.collect()} == {"pending"}
    text = "".join(sorted(p.read_text() for p in (tmp_path / "backup").glob("part-*")))
    assert text.count('""title""') == 6


def test_a_failed_price_run_changes_nothing(spark):
    import datetime

    from equityjobs.plans import jobs

    day = datetime.date(2024, 1, 2)
    stocks = spark.createDataFrame([(f"{i:06d}", "KOSPI") for i in range(10)], "code string, market string")
    quotes = spark.createDataFrame([("000001", False, False, 5)], "stock_code string, halted boolean, admin_issue boolean, market_cap long")
    daily = spark.createDataFrame([(f"{i:06d}", day, 100 + i, 5, 1) for i in range(10)], "stock_code string, day date, close long, trading_value long, no int")
    before = jobs.price_snapshot(daily.withColumn("close", F.lit(7).cast("long")), quotes, stocks, ["no"])
    for received, status in ((9, "partial"), (3, "failed")):
        summary, after = jobs.price_run(stocks, daily.filter(F.col("close") < 100 + received), quotes, before, ["no"])
        closes = {r["stock_code"]: (r["close"], r["flags"][:1]) for r in after.collect()}
        assert summary.first()["status"] == status and len(closes) == 10
        assert closes["000009"] == (7, ["no_data"] if status == "partial" else ["short_history"]) and closes["000001"][0] == (101 if status == "partial" else 7)


def test_a_code_that_is_listed_twice_has_two_counts(spark):
    rows = spark.createDataFrame([(1, "p", "broker", "단일종목", ["A"], date(2026, 1, 1))], "id long, publisher string, publisher_type string, report_type string, stock_codes array<string>, published_at date")
    rows = rows.withColumn("sent_at", F.lit(None).cast("timestamp"))
    codes = spark.createDataFrame([("A",), ("A",), ("B",)], "code string")
    got = coverage.report_counts(rows, codes, date(2026, 2, 1)).collect()
    assert sorted((r["code"], r["stock_reports"], r["label"]) for r in got) == [("A", 1, "few"), ("A", 1, "few"), ("B", 0, "none")]


def test_listings_that_share_a_code_stay_in_a_partial_run(spark):
    rows = spark.createDataFrame([("A", True, ["x"]), ("A", False, ["x"]), ("B", False, [])], "stock_code string, traded boolean, flags array<string>")
    got = prices.merge_run(rows.filter("traded"), rows, ("stock_code", "traded")).collect()
    assert sorted((r["stock_code"], r["traded"]) for r in got) == [("A", False), ("A", True), ("B", False)]
    assert all(r["traded"] or r["flags"][0] == "no_data" for r in got)
    assert prices.merge_run(rows.filter("traded"), rows).count() == 2


def test_shared_terms_meet_as_one_row_a_pair(spark):
    """Lists of key numbers meet, so that a pair with many shared keys is one row until its rarest are chosen."""
    held = [("1", f"k{i:02d}") for i in range(40)] * 2 + [("2", f"k{i:02d}") for i in range(10, 60)] + [("3", "zz"), ("3", "k50"), ("1", "unlisted"), ("2", "unlisted")]
    terms = spark.createDataFrame(held, "code string, key string")
    listed = [(f"k{i:02d}", f"K{i}", 1 + i % 3) for i in range(60)] + [("zz", "ZZ", 1)]
    table = spark.createDataFrame(listed, "key string, display string, companies long")
    pairs = spark.createDataFrame([("1", "2"), ("2", "1"), ("2", "3"), ("1", "3"), ("1", "none")], "seed string, peer string")
    _, lists = peers.numbered_keys(terms, table)
    assert lists.count() == 3 and peers.shared_ids(pairs, lists).count() == 3
    assert {(r["seed"], r["peer"]): r["shared"] for r in peers.shared_counts(pairs, terms, table).collect()} == {("1", "2"): 30, ("2", "1"): 30, ("2", "3"): 1}
    best = sorted((n, k, d) for k, d, n in listed if k in {f"k{i:02d}" for i in range(10, 40)})[:5]
    got = {(r["seed"], r["peer"], r["place"]): (r["companies"], r["key"], r["display"]) for r in peers.shared_terms(pairs, terms, table).collect()}
    assert got == {(a, b, i + 1): x for a, b in (("1", "2"), ("2", "1")) for i, x in enumerate(best)} | {("2", "3", 1): (3, "k50", "K50")}


def listed_several_times(spark):
    """Peers whose codes stand several times in each table, a code that no table has, and rows without a code."""
    day = date(2026, 5, 4)
    rows = spark.createDataFrame([("A", "B", 1, "high"), ("B", "A", 1, None), ("A", "X", 2, "related"), ("X", "A", 11, "high")], "seed string, peer string, rank int, tier string")
    price = [("A", day, 20.0, True, [], 900_000_000)] * 3 + [("A", day, 5.0, True, ["halted"], 900_000_000)] * 2 + [("B", day, 3.0, True, None, None)] * 4 + [(None, day, 1.0, True, [], 5)] * 2
    prices = spark.createDataFrame(price, "stock_code string, as_of date, xret_1m double, traded boolean, flags array<string>, avg_value_20d long")
    counts = spark.createDataFrame([("A", "none")] * 2 + [("B", "few")] * 5 + [(None, "few")], "code string, label string")
    holdings = spark.createDataFrame([("A", False), ("B", None), (None, True)], "code string, is_holding boolean")
    stocks = spark.createDataFrame([("A", "a1", "S"), ("A", "a2", "S"), ("A", "a2", "S"), ("B", "b", "S"), ("B", "b", " "), (None, "n", "S")], "code string, name string, sector_minor string")
    return rows, prices, counts, holdings, stocks


def joined_plainly(rows, prices, counts, holdings, stocks):
    """How often each (seed, peer, rank, peer's excess, label, name, both sectors, peer's value, flags) stands in the join of the tables."""
    from collections import Counter

    prices, counts, holdings, stocks = (df.collect() for df in (prices, counts, holdings, stocks))

    def side(table, code):
        return [r for r in table if r[0] == code] or [None]

    return Counter(
        (r["seed"], r["peer"], p and p["xret_1m"], c and c["label"], t and t["name"], (s and s["sector_minor"], t and t["sector_minor"]), p and p["avg_value_20d"])
        for r in rows.collect() for _ in side(prices, r["seed"]) for p in side(prices, r["peer"]) for c in side(counts, r["peer"]) for _ in side(holdings, r["peer"]) for s in side(stocks, r["seed"]) for t in side(stocks, r["peer"])
    )


def test_reactions_of_repeated_listings_are_counted_without_their_rows(spark):
    """equal rows are one with a count, which sums up to the rows of the plain join."""
    tables = listed_several_times(spark)
    once = peers.judged_once(*tables).collect()
    expected = joined_plainly(*tables)
    assert sum(r["times"] for r in once) == sum(expected.values()) > 5 * len(once)
    found = {}
    for r in once:
        found[r["reaction"], r["trading"]] = found.get((r["reaction"], r["trading"]), 0) + r["times"]
    rows = peers.judged(*tables).groupBy("reaction", "trading").count().collect()
    assert found == {(r["reaction"], r["trading"]): r["count"] for r in rows} and found["none", True] == 3 * 4 * 5 * 3 * 2


def test_answers_of_repeated_listings_have_all_their_rows(spark):
    """A further join multiplies the counts, and repeating gives the rows of the plain joins."""
    from collections import Counter

    tables = listed_several_times(spark)
    excess = peers.tallied(tables[1], "stock_code", "peer", F.col("xret_1m").alias("excess"))
    once = peers.joined_tallies(peers.judged_once(*tables).filter("rank <= 10").select("seed", "peer", "name", "label", "times"), [(excess, "peer")])
    found = Counter(tuple(r) for r in peers.repeated(once).select("seed", "peer", "name", "label", "excess").collect())
    moves = {"A": [20.0] * 3 + [5.0] * 2, "B": [3.0] * 4}
    expected = Counter()
    for (seed, peer, _, label, name, *_), n in joined_plainly(*tables).items():
        if (seed, peer) != ("X", "A"):
            for x in moves.get(peer, [None]):
                expected[seed, peer, name, label, x] += n
    assert found == expected and once.count() * 5 < sum(expected.values())


def test_visible_rows_of_repeated_listings(spark):
    """The filter sees equal rows once, and what passes is there as often as in the plain join."""
    tables = listed_several_times(spark)
    kept = peers.visible(peers.judged_once(*tables).withColumn("same_industry", F.coalesce("same_industry", F.lit(False))), ["same_industry"], 700_000_000)
    expected = {}
    for (seed, peer, _, _, _, (a, b), value), n in joined_plainly(*tables).items():
        if a == b == "S" and (value or 0) >= 700_000_000:
            expected[seed, peer] = expected.get((seed, peer), 0) + n
    assert kept.count() < 10 and {(r["seed"], r["peer"]): r["count"] for r in peers.repeated(kept).groupBy("seed", "peer").count().collect()} == expected == {("B", "A"): 4 * 5 * 2 * 3}


def test_rows_are_repeated_in_bounded_steps(spark):
    """Q6: a row that stands for many is repeated without an array of all of them; a row that stands for itself stays one."""
    rows = spark.createDataFrame([("a", 1), ("b", 25_001), ("c", 20_000), (None, 3)], "seed string, times long")
    got = peers.repeated(rows)
    assert got.columns == ["seed"] and {r["seed"]: r["count"] for r in got.groupBy("seed").count().collect()} == {"a": 1, "b": 25_001, "c": 20_000, None: 3}
    assert peers.repeated(rows, 7).count() == 45_005


def test_large_report_files_are_read_as_streams(spark, tmp_path):
    """A file that is over the bound has the checksum of all its bytes, whatever they are."""
    import hashlib

    rng = np.random.default_rng(0)
    files = {
        "random.pdf": rng.bytes(300_000), "feeds.pdf": b"\n" * 500, "ends with one.pdf": b"a\r\nb\r" * 40 + b"\n", "marked 100%.pdf": b"\xef\xbb\xbf" + b"x\n" * 50, "inside/marked.pdf": b"\xef\xbb\xbf\xff" * 60,
        "no feed.pdf": b"\x00" * 5000, "small.pdf": b"%PDF\n", "other.txt": b"y" * 900,
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = readers.read_report_files(spark, f"file://{tmp_path}", "*.pdf", whole=100).collect()
    expected = {f"file:{tmp_path}/{n}": (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items() if n.endswith(".pdf")}
    assert len(got) == len(expected) and {r["path"]: (r["size"], r["sha256"]) for r in got} == expected
    (tmp_path / "packed.pdf.gz").write_bytes(__import__("gzip").compress(b"z" * 100_000))
    with pytest.raises(Exception, match="bytes"):
        readers.read_report_files(spark, f"file://{tmp_path}", "*.gz", whole=100).collect()
