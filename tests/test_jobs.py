"""Whole jobs, streams and operators whose results, plans or work grow in ways that single rows do not show."""

import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from equityjobs.functions import texts
from equityjobs.operators import collect, compare, lifecycle, peers, terms, vectors
from equityjobs.plans import jobs
from equityjobs.plans import peers as plans
from equityjobs.sources import layout, readers
from equityjobs.sources.scratch import stored
from equityjobs.streaming import streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- grounding --------------------------------------------------------------------------------------------


def test_terms_of_a_long_text_are_found_in_one_pass(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(20_000)]
    text = " ".join(rng.choices(words[:10_000], k=160_000))
    began = time.time()
    hay = text.replace(" ", "")
    found = terms.found_terms(hay, {w: [w] for w in words})
    assert time.time() - began < 30 and len(text) > 1_000_000
    assert all((w in found) == (w in hay) for w in words[::40])
    docs = spark.createDataFrame([(1, "The NCM-cathode and (양극재)", ["양극재", "ncm  cathode", "ncm  cathode", "anode", "", " - "]), (2, None, ["x"]), (3, "y", None), (None, "y", [None, "Y "])], "doc_id long, text string, terms array<string>")
    got = {r["doc_id"]: (r["kept_terms"], r["given"], round(r["grounding_ratio"], 4), r["ask_again"]) for r in terms.grounded_terms(docs, {"양극재": ["cathode"]}).collect()}
    assert got == {1: (["양극재", "ncm  cathode", "ncm  cathode"], 4, 0.75, True), 2: ([], 1, 0.0, True), 3: ([], 0, 1.0, False), None: (["Y"], 1, 1.0, False)}


# --- theme search -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def theme(spark):
    """Companies that all hold the key "the", with others; queries that ask for some keys."""
    rng = random.Random(2)
    held = [(f"{i:04d}", k) for i in range(300) for k in {"the", *rng.choices("abcdefghij", k=3)}]
    asked = [(f"q{j}", k) for j in range(7) for k in {"the", *rng.choices("abcdefghijz", k=3)}]
    table = [(k, sum(x == k for _, x in held)) for k in "abcdefghij"]  # "the" is not in the table: it counts one holder
    frames = spark.createDataFrame(held + held[:50], "code string, key string"), spark.createDataFrame(asked, "query string, key string"), spark.createDataFrame(table, "key string, companies long")
    weight = dict(table)
    ranks = {}
    for q in sorted({q for q, _ in asked}):
        keys = {k for x, k in asked if x == q}
        rows = {}
        for code, k in held:
            if k in keys:
                n, total = rows.get(code, (0, 0))
                rows[code] = (n + 1, total + weight.get(k, 1))
        order = sorted(rows, key=lambda c: (-rows[c][0], rows[c][1], c))
        ranks |= {(q, c): (i + 1, *rows[c]) for i, c in enumerate(order)}
    return stored(frames[0], "held"), frames[1], frames[2], ranks


def test_term_rankings_without_a_join_of_matches(spark, theme, monkeypatch):
    held, asked, table, ranks = theme
    monkeypatch.setattr(peers, "ASKED_ROWS", 10)  # several blocks of queries
    holders = peers.term_holders(held)
    matched = peers.profiles_with_terms(holders, asked)
    assert "Exchange" not in plan_of(matched) and "Join" not in plan_of(matched)
    assert matched.count() == matched.distinct().count() == sum(n for _, n, _ in ranks.values())
    blocks = peers.asked_blocks(asked, table)
    assert len(blocks) > 1
    got = peers.term_ranking(peers.term_totals(holders, blocks)).collect()
    assert {(r["query"], r["code"]): (r["rank"], r["keys"], r["holders"]) for r in got} == ranks
    first = peers.term_ranking(peers.term_totals(holders, blocks, 5), 5).collect()
    assert {(r["query"], r["code"]): (r["rank"], r["keys"], r["holders"]) for r in first} == {k: v for k, v in ranks.items() if v[0] <= 5}
    few = [k for k in ranks if int(k[1]) % 17 == 0]
    only = spark.createDataFrame(few, "query string, code string").groupBy("code").agg(F.collect_list("query").alias("only"))
    scored = stored(peers.term_totals(holders.join(only, "code"), blocks), "scored")
    deep = peers.term_ranks_of(holders, blocks, scored).collect()
    assert {(r["query"], r["code"]): r["rank"] for r in deep} == {k: ranks[k][0] for k in few}


def test_theme_search_equals_full_fusion(spark, theme):
    held, asked, table, ranks = theme
    rng = np.random.default_rng(3)
    codes = [f"{i:04d}" for i in range(300)]
    companies = spark.createDataFrame([(c, rng.normal(size=4).tolist()) for c in codes], "code string, vector array<double>")
    segments = spark.createDataFrame([(c, n, rng.normal(size=4).tolist()) for c in codes[:200] for n in (0, 1)], "code string, seg_no int, vector array<double>")
    stocks = spark.createDataFrame([(c, f"n{c}") for c in codes if c != "0007"], "code string, name string")
    names = sorted({q for q, _ in ranks})
    keys = asked.groupBy("query").agg(F.collect_list("key").alias("keys"))
    points = spark.createDataFrame([(q, rng.normal(size=4).tolist()) for q in names[:-1]], "query string, vector array<double>")
    queries = keys.join(points, "query", "left")
    holders = peers.term_holders(held)
    got = {(r["query"], r["code"]): r["rank"] for r in plans.theme_search(queries, companies, segments, holders, table, stocks, 10).collect()}
    full = {(r["query"], r["code"]): r["rank"] for r in plans.theme_search(queries, companies, segments, holders, table, stocks, 1 << 30).collect()}
    assert got == {k: r for k, r in full.items() if r <= 10} and len(got) == 10 * len(names)


# --- similarities -----------------------------------------------------------------------------------------


def test_percentiles_are_searched_not_joined(spark):
    table = spark.createDataFrame([(95.0, 0.5), (98.0, 0.625), (99.5, 0.75), (99.9, 0.75), (100.0, 0.875)], "percentile double, cosine double")
    rows = spark.createDataFrame([(0.4999,), (0.5,), (0.5625,), (0.75,), (0.9,), (None,)], "s double")
    found = peers.with_percentile(rows, table, "s", "p")
    assert "NestedLoop" not in plan_of(found) and [r["p"] for r in found.collect()] == [None, 95.0, 96.5, 99.9, 100.0, None]
    assert [r["p"] for r in peers.with_percentile(rows, table.limit(0), "s", "p").collect()] == [None] * 6


def test_every_draw_is_a_pair(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "big" if i < 19 else "one", rng.normal(size=4).tolist()) for i in range(20)]
    got = vectors.sampled_cosines(spark.createDataFrame(rows, "k int, g string, vector array<double>"), ["k"], "g", 500).collect()

    def cosine(a, b):
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    allowed = {cosine(a[2], rows[19][2]) for a in rows[:19]}
    assert sorted(r["draw"] for r in got) == list(range(500)) and {round(r["cosine"], 9) for r in got} == allowed
    alone = spark.createDataFrame(rows[:19], "k int, g string, vector array<double>")
    assert vectors.sampled_cosines(alone, ["k"], "g", 500).count() == 0


def test_pairs_of_blocks_are_skipped_and_nearest_stays_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(20, 16))[rng.integers(0, 20, 1200)] + 0.05 * rng.normal(size=(1200, 16))
    df = stored(spark.createDataFrame([(f"{i // 2:05d}", i % 2, r.tolist()) for i, r in enumerate(points)], "code string, seg int, vector array<double>"), "vectors")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    expected = set()
    for i in range(0, 1200, 10):
        sims, best = np.round(unit @ unit[i], 9), {}
        for j in np.flatnonzero(np.arange(1200) // 2 != i // 2).tolist():
            if j // 2 not in best or sims[j] > best[j // 2][0]:
                best[j // 2] = (sims[j], j)
        expected |= {(i, j, n + 1) for n, (_, (_, j)) in enumerate(sorted(best.items(), key=lambda t: (-t[1][0], t[0]))[:5])}
    seeds = df.filter("seg = 0 and cast(code as int) % 5 = 0")
    got = {(2 * int(r["seed_code"]) + r["seed_seg"], 2 * int(r["peer_code"]) + r["peer_seg"], r["rank"]) for r in vectors.nearest(df, ["code", "seg"], "code", 5, 60, seeds).collect()}
    assert got == expected
    blocks = vectors._clustered(df, ["code", "seg"], 60, vectors._centres(df, ["code", "seg"], 20))
    n = blocks.count()
    assert vectors.block_pairs_to_meet(blocks, blocks, "code", 5).count() < 0.2 * n * n
    monkeypatch.setattr(vectors, "_CENTRE_BYTES", 0)
    assert vectors.block_pairs_to_meet(blocks, blocks, "code", 5).count() == n * n


def test_blocks_are_stored_once_for_percentiles(spark, monkeypatch):
    written = []
    keep = vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, name, **o: written.append(name) or keep(df, name, **o))
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "k int, vector array<double>")
    assert vectors.pair_percentiles(rows, ["k"], size=10).count() > 0 and written == ["vector_blocks"]


def test_blocks_hold_floats_as_floats_and_give_the_unit_vectors_bit_by_bit(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(200)] + [(200, [0.0] * 64)], "k long, vector array<float>")
    expected = {r["k"]: r["u"] for r in df.select("k", vectors.unit(F.col("vector")).alias("u")).collect() if r["u"]}
    for rows, most in ((df, 6), (df.withColumn("vector", F.col("vector").cast("array<double>")), 12)):
        for blocks in (vectors._blocks(rows, ["k"], 60)[0], vectors._clustered(rows, ["k"], 60, vectors._centres(rows, ["k"], 3))):
            data = [r["data"] for r in blocks.collect()]
            assert sum(map(len, data)) < most * 64 * 200
            found = [vectors._load(x) for x in data]
            assert {k: v.tolist() for b in found for k, v in zip(b["k"].tolist(), b["m"])} == expected


def test_each_pair_of_blocks_meets_in_one_of_the_few_tasks_that_a_block_goes_to(spark):
    assert [vectors._sides(x) for x in (1, 2, 3, 4, 24, 28, 29)] == [1, 2, 2, 3, 7, 7, 8]
    for n, tiles in ((40, 7), (5, 5), (3, 1)):
        blocks = spark.createDataFrame([(i, bytes([i])) for i in range(n)], "block int, data binary")
        tasks, copies, pairs = {}, {}, []
        for r in vectors._met_once(blocks, n, tiles).withColumn("_p", F.spark_partition_id()).collect():
            held = tasks.setdefault((r["_p"], r["task"]), [])
            copies[r["block"]] = copies.get(r["block"], 0) + 1
            if r["role"] < 2:
                held.append(r["block"])
            pairs += [tuple(sorted((x, r["block"]))) for x in held if r["role"]]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i, n)]
        assert set(copies.values()) == {tiles} and len(tasks) == len({p for p, _ in tasks}) == tiles * (tiles + 1) // 2


def test_no_match_but_the_final_ones_leaves_a_task(spark):
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(30, 6)), 1)[rng.integers(0, 30, 400)]  # many copies: ties go by name, an owner's rows stand in several blocks
    df = stored(spark.createDataFrame([(f"{i // 3:05d}", i % 3, r.tolist()) for i, r in enumerate(points)], "code string, seg int, vector array<double>"), "vectors")
    near = vectors.nearest(df, ["code", "seg"], "code", 7, 40)
    assert "Window" not in plan_of(near)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    sims, expected = np.round(unit @ unit.T, 9), set()
    for i in range(400):
        best = {}
        for j in range(400):
            if j // 3 != i // 3 and (j // 3 not in best or sims[i, j] > best[j // 3][0]):
                best[j // 3] = (sims[i, j], j)
        expected |= {(i, j, n + 1) for n, (_, (_, j)) in enumerate(sorted(best.items(), key=lambda t: (-t[1][0], t[0]))[:7])}
    assert {(3 * int(r["seed_code"]) + r["seed_seg"], 3 * int(r["peer_code"]) + r["peer_seg"], r["rank"]) for r in near.collect()} == expected


def test_the_driver_reads_coarse_cells_only(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    read, keep = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: read.append(1) or keep(df))
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 4))
    rows = stored(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "k int, vector array<double>"), "vectors")
    got = {r["percentile"]: r["cosine"] for r in vectors.pair_percentiles(rows, ["k"], size=25).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = np.percentile(np.round((unit @ unit.T)[np.triu_indices(300, 1)], 9), sorted(got))
    assert len(read) == 1 and np.allclose([got[p] for p in sorted(got)], expected, atol=2e-9)


# --- reports ----------------------------------------------------------------------------------------------


def test_a_hot_stock_is_many_groups(spark):
    rows = [(i, None if i % 4 == 0 else f"p{i % 3}", date(2026, 1, 1) + timedelta(days=i % 40), "단일종목", ["hot"] if i % 3 else ["hot", f"c{i % 5}"]) for i in range(90)]
    reports = spark.createDataFrame(rows, "id long, publisher string, published_at date, report_type string, stock_codes array<string>")

    def expected(days):
        return {
            (a[0], b[0], bool(a[1]) and a[1] == b[1]) for a in rows for b in rows
            if (a[2], a[0]) < (b[2], b[0]) and set(a[4]) & set(b[4]) and (days is None or (b[2] - a[2]).days <= days)
        }

    for days in (None, 7):
        assert {tuple(r) for r in compare.report_pairs(reports, days, block_rows=20).collect()} == expected(days)
    left = reports.select(F.col("id").alias("left_id"), F.lit("hot").alias("_code"))
    a, b, keys = compare._in_blocks(left, left.withColumnRenamed("left_id", "right_id"), ["_code"], 20)
    most = a.groupBy(*keys).count().agg(F.max("count")).first()[0]
    assert a.select(*keys).distinct().count() >= 81 and most < 30 and b.count() == a.count()


def test_a_period_reads_its_months_only(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else date(2025, 1 + i % 12, 1 + i % 28), None if i == 5 else datetime(2025, 1 + i % 12, 3), "auto" if i % 3 else "pending", None if i % 4 else "fund") for i in range(120)]
    reports = spark.createDataFrame(rows, "id long, published_at date, sent_at timestamp, tagging_status string, out_of_scope_reason string")
    path = f"file://{tmp_path}/reports"
    layout.write_by_month(reports, path, files=2)
    from equityjobs.operators.reports import period_rows

    for oos in (False, True):
        read = layout.read_period(spark, path, reports.schema, date(2025, 10, 5), oos)
        assert read.columns == reports.columns and sorted(map(str, read.collect())) == sorted(map(str, period_rows(reports, date(2025, 10, 5), oos).collect()))
        assert "PartitionFilters: [isnotnull(month" in plan_of(read) and len(read.inputFiles()) >= 1
    months = layout.read_months(spark, path, reports.schema, date(2025, 10, 1), date(2025, 11, 30))
    read_files = {r["f"] for r in months.select(F.input_file_name().alias("f")).distinct().collect()}
    assert {f.split("month=")[1][:7] for f in read_files} == {"2025-10", "2025-11"}
    assert layout.read_months(spark, path, reports.schema).count() == 120


def test_decisions_on_one_report(spark):
    reports = spark.createDataFrame([(1, "review_needed", None, date(2026, 1, 1)), (2, "auto", None, None), (3, "review_needed", None, None)], "id long, tagging_status string, out_of_scope_reason string, published_at date")
    made = [(1, 1, "oos", "moon"), (2, 1, "verify", None), (3, 1, "oos", "fund"), (4, 2, "verify", None), (5, 3, "retag", None), (6, 3, "verify", None), (7, 9, "verify", None)]
    after, refused = lifecycle.reviewed(reports, spark.createDataFrame(made, "decision long, id long, action string, reason string"))
    assert sorted((r["id"], r["tagging_status"], r["out_of_scope_reason"]) for r in after.collect()) == [(1, "verified", None), (2, "auto", None), (3, "pending", None)]
    assert sorted(r["decision"] for r in refused.collect()) == [1, 3, 4, 6, 7]


def test_keys_that_were_received_twice(spark):
    kept = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, no long")
    sent = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 1), (3, "e", 1)], "id long, v string, no long")
    assert sorted(map(tuple, lifecycle.upsert(kept, sent, ["id"], "no").collect())) == [(1, "d", 2), (2, "b", 0), (3, "e", 1)]
    with pytest.raises(Exception, match="two different rows"):
        lifecycle.upsert(kept, sent, ["id"]).collect()
    same = sent.filter("id = 3")
    assert sorted(map(tuple, lifecycle.upsert(kept, same, ["id"]).collect())) == [(1, "a", 0), (2, "b", 0), (3, "e", 1)]
    before = spark.createDataFrame([(1, "ok", 0), (2, "failed", 0)], "k long, status string, v long")
    run = spark.createDataFrame([(1, "failed", 5), (1, "failed", 6), (2, "ok", 1), (2, "ok", 3), (2, "failed", 9)], "k long, status string, v long")
    after, earlier = lifecycle.replaced_profiles(before, run, ["k"], ["v"])
    assert sorted(map(tuple, after.collect())) == [(1, "ok", 0), (2, "ok", 3)] and [tuple(r) for r in earlier.collect()] == [(1, "ok", 0)]


def test_requeue_notices_a_table_that_was_not_written_whole(spark, monkeypatch, tmp_path):
    rows = [(i, "auto", "P1" if i % 2 else "nobody", 'say "hi"\n"12",x' if i == 3 else None, "broker", f"R_20260511_pub_{i}.pdf", True) for i in range(8)]
    reports = spark.createDataFrame(rows, "id long, tagging_status string, publisher string, tagging_notes string, publisher_type string, file_name string, renders boolean")
    publishers = spark.createDataFrame([("P1", "pub", "broker")], "canonical string, alias string, publisher_type string")
    columns = ["tagging_status", "publisher", "tagging_notes"]
    now = reports.withColumn("publisher", F.when(F.col("id") == 4, "P1").otherwise(F.col("publisher")))
    reset = jobs.requeue(reports, now, publishers, columns, f"file://{tmp_path}/a", table=f"file://{tmp_path}/after")
    after = spark.read.parquet(f"file://{tmp_path}/after")
    assert sorted(r["id"] for r in reset.collect()) == [0, 2, 6] and sorted(r["id"] for r in after.filter("tagging_status = 'pending'").collect()) == [0, 2, 6] and after.count() == 8
    monkeypatch.setattr(jobs.lifecycle, "reset_shape", lambda df: df)
    with pytest.raises(RuntimeError, match="reset rows"):
        jobs.requeue(reports, now, publishers, columns, f"file://{tmp_path}/b")
    monkeypatch.undo()
    monkeypatch.setattr(jobs.sinks, "write_backup", lambda df, path: df.limit(1).selectExpr("cast(id as string) value").write.text(path))
    with pytest.raises(RuntimeError, match="nothing was reset"):
        jobs.requeue(reports, now, publishers, columns, f"file://{tmp_path}/c")


def test_a_stock_list_in_several_files(spark, tmp_path):
    folder = tmp_path / "list"
    folder.mkdir()
    head = ",".join(f'"{h[:2]}\n{h[2:]}"' for h in readers.STOCK_HEADERS)
    (folder / "a.csv").write_text(f'{head}\n1,"one\nline",m,x,y,z\n')
    (folder / "b.csv").write_text("".join(f"{i},n{i},m,x,y,z\n" for i in range(2, 50)))
    got = [(r["line_no"], r["code"]) for r in readers.read_stock_list(spark, f"file://{folder}").orderBy("line_no").collect()]
    assert got == [(i, str(i)) for i in range(1, 50)]


def test_fingerprints_follow_rows_and_not_their_order(spark):
    rows = [(i % 40, f"v{i % 7}", None) for i in range(300)]
    a, b = spark.createDataFrame(rows, "a int, b string, c string"), spark.createDataFrame(rows[::-1], "a int, b string, c string")
    first = lifecycle.tree_fingerprint(a).first()[0]
    assert first == lifecycle.tree_fingerprint(b.repartition(3)).first()[0] != lifecycle.tree_fingerprint(a.limit(299)).first()[0]


def test_a_build_reads_its_answers_once_and_joins_them_capped(spark, monkeypatch):
    from conftest import DATA
    from equityjobs.catalog import jobs as J
    from equityjobs.sources.adapters import Tables

    read, given = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    grounded = terms.grounded_terms
    monkeypatch.setattr(terms, "grounded_terms", lambda df, forms: grounded(df.mapInPandas(counted, df.schema), forms))
    build = plans.peer_build
    monkeypatch.setattr(plans, "peer_build", lambda *a: given.append(a[3]) or build(*a))
    made = J.build(Tables(spark, str(DATA)))
    made.run.collect()
    asked = given[0].join(made.todo, ["stock_code", "rcept_no", "parser_version"], "left_semi").count()
    assert asked > 0 and read.value == asked
    assert given[0].agg(F.max(F.size("terms"))).first()[0] <= 15


def test_tidy_of_plain_words_is_that_of_others(spark):
    spelled = texts.spelling_map({"the": ["and", "of"]})
    rows = spark.createDataFrame([(["And", "b", "The", "B", None, "", "b", "c1", "of"],), ([],), (None,)], "t array<string>")
    plain = terms.tidy(F.col("t"), 9, spelled)
    marked = terms.tidy(F.concat("t", F.array(F.lit("x-y"))), 9, spelled)  # a mark among them: the general way
    got = [tuple(r) for r in rows.select(plain.alias("p"), marked.alias("m")).collect()]
    assert got == [(["And", "b", "c1"], ["And", "b", "c1", "x-y"]), ([], ["x-y"]), (None, None)]


def test_an_unfinished_build_publishes_nothing(spark):
    sections = [(f"{s:06d}", s, code, "0.2.0", "Y", f"Corp {s}", True, 2024, "2024-12", "alpha beta gamma " * 80, "품목 | 비중\nalpha | 12%\nbeta | -" if code == "020200" else "", s * 10 + n) for s in range(1, 21) for n, code in enumerate(("020100", "020200"))]
    filed = spark.createDataFrame(sections, "stock_code string, rcept_no long, section_code string, parser_version string, corp_cls string, corp_name string, is_final boolean, fiscal_year int, fiscal_end string, prose_text string, table_text string, doc_id long")
    stocks = spark.createDataFrame([(f"{s:06d}", f"name {s}", "sector") for s in range(1, 21)], "code string, name string, sector_minor string")
    profiles = spark.createDataFrame([(2024, "p2", "000001", 1, "0.2.0", "ok", ["alpha"]), (2024, "p2", "000002", 1, "0.2.0", "ok", ["old"]), (2023, "p1", "000003", 1, "0.2.0", "ok", ["gone"])], "fiscal_year int, profile_version string, stock_code string, rcept_no long, parser_version string, status string, terms array<string>")
    said = [(f"{s:06d}", s, "0.2.0", "failed" if s in (2, 3) else "ok", ["Alpha", "ALPHA", "delta", "gamma"]) for s in range(1, 21)]
    extracted = spark.createDataFrame(said, "stock_code string, rcept_no long, parser_version string, status string, terms array<string>")
    companies = spark.createDataFrame([(f"{s:06d}", [1.0, s / 9]) for s in range(1, 19)], "code string, vector array<double>")
    segments = companies.withColumn("seg_no", F.lit(0))
    builds = spark.createDataFrame([(n, "done", 2020 + n, f"p{n}", n) for n in range(5)], "build_id long, status string, fiscal_year int, profile_version string, finished_no long")
    made = plans.peer_build(filed, stocks, profiles, extracted, companies, segments, builds, 2024, "p2", 99, "never", "REIT", {"delta": ["beta"]})
    row = made.run.first()
    assert (row["eligible"], row["profiled"], row["failed"], row["status"]) == (20, 18, 2, "incomplete")
    assert plans.publication(made, companies, segments, {}, F.create_map()) == {}
    after = {r["stock_code"]: (r["status"], r["terms"]) for r in made.profiles.collect()}
    assert after["000001"] == ("ok", ["alpha"]) and after["000002"] == ("ok", ["old"]) and after["000003"][0] == "failed" and after["000004"] == ("ok", ["Alpha", "delta", "gamma"])
    assert [r["stock_code"] for r in made.kept_previous.collect()] == ["000002"] and made.reused.count() == 1 and made.todo.count() == 19
    assert "품목 | 비중" in made.inputs.first()["text"] and sorted(r["stock_code"] for r in made.missing_companies.collect()) == ["000019", "000020"]
    assert sorted(r["build_id"] for r in made.dropped_builds.collect()) == [0, 1] and [tuple(r) for r in made.unused_profiles.collect()] == [(2023, "p1")]
    better = plans.peer_build(filed, stocks, profiles, extracted.withColumn("status", F.lit("ok")), companies, segments, builds, 2024, "p2", 99, "never", "REIT", {})
    tables = plans.publication(better, companies, segments, {}, texts.spelling_map({}))
    assert {r["key"]: r["companies"] for r in tables["terms"].collect()} == {"alpha": 20, "gamma": 19} and tables["company_percentiles"].count() > 0


# --- streams ----------------------------------------------------------------------------------------------


def write(rows, schema, spark, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def arriving(spark, path, schema):
    return streams.arriving(spark, f"{path}/*", spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_silent_for_exactly_six_hours_is_not_silent(spark, tmp_path):
    schema, at = "build long, seen timestamp, state string", datetime(2026, 1, 1)
    rows = [(1, at, "running"), (2, at - timedelta(milliseconds=1), "running"), (3, at - timedelta(hours=2), "running"), (3, at + timedelta(hours=1), "running"), (4, at - timedelta(days=1), "running"), (4, at - timedelta(hours=20), "done")]
    write(rows, schema, spark, tmp_path, "a")
    write([(9, at + timedelta(hours=6), "done")], schema, spark, tmp_path, "b")
    stream = streams.silent(arriving(spark, tmp_path, schema), ["build"], "seen", "state", "running", 6)
    got = streams.drained(stream, "append", "silent").collect()
    builds = spark.createDataFrame([(b, s, t) for b, t, s in (rows[0], rows[1], rows[3], rows[5])], "build_id long, status string, heartbeat_at timestamp")
    batch = [r["build_id"] for r in lifecycle.closed_builds(builds, at + timedelta(hours=6)).filter("status = 'failed'").collect()]
    assert [r["build"] for r in got] == batch == [2] and got[0]["last_seen"] == rows[1][1]


def test_increments_of_two_runs(spark, tmp_path):
    schema = "chat long, message_id long, mime string, file_name string, sent_at timestamp"
    day = datetime(2026, 5, 1)

    def message(chat, n, sent=day, name="a.pdf"):
        return chat, n, None, name, sent

    first = [message(1, 5), message(1, 11), message(1, 12, name="a.txt"), message(1, 9), message(2, 3), message(2, 2, day - timedelta(days=60)), message(3, 70)]
    write(first, schema, spark, tmp_path, "a")
    write([message(1, 13), message(1, 11), message(2, 4), message(1, 9)], schema, spark, tmp_path, "b")
    reports = spark.createDataFrame([(1, 10), (3, 80)], "chat long, message_id long")
    attempts = spark.createDataFrame([(1, 9), (1, 9), (3, 80)], "chat long, message_id long")
    since = day - timedelta(days=30)
    got = streams.drained(streams.increments(arriving(spark, tmp_path, schema), reports, attempts, since), "append", "runs")
    rows = sorted((r["chat"], r["message_id"], r["turn"]) for r in got.collect())
    assert rows == [(1, 9, "retry"), (1, 11, "new"), (1, 13, "new"), (2, 3, "new"), (2, 4, "new")]
    run = collect.increment(spark.createDataFrame(first, schema), reports, attempts, since)
    assert sorted((r["chat"], r["message_id"], r["turn"]) for r in run.collect()) == [r for r in rows if r[1] not in (13, 4)]


def test_deliveries_again_change_nothing(spark, tmp_path):
    schema, table = "k long, v string, no long", f"file://{tmp_path}/table"
    write([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema, spark, tmp_path / "in", "a")
    write([(1, "a", 1), (3, "d", 1)], schema, spark, tmp_path / "in", "b")
    expected = [(1, "b", 2), (2, "c", 1), (3, "d", 1)]
    rows = arriving(spark, tmp_path / "in", schema)
    assert sorted(map(tuple, streams.merged(rows, table, ["k"], "no").collect())) == expected
    assert sorted(map(tuple, streams.merged(rows, table, ["k"], "no").collect())) == expected  # nothing new
    assert sorted(map(tuple, streams.merged(rows, table, ["k"], "no", "again").collect())) == expected  # all delivered again
    write([(2, "e", 5), (4, "f", 1)], schema, spark, tmp_path / "in", "c")
    assert sorted(map(tuple, streams.merged(rows, table, ["k"], "no").collect())) == [(1, "b", 2), (2, "e", 5), (3, "d", 1), (4, "f", 1)]


# --- words in dealt partitions, one search a similarity, one pass over reports ------------------------------


def test_words_are_cut_in_dealt_partitions(spark, tmp_path):
    from equityjobs.catalog import terms as T
    from equityjobs.sources.adapters import Tables

    rows = [(i, "The cat and le CAT" if i % 2 else None, 3) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    assert "REPARTITION" in plan_of(T.with_terms(t)) and "REPARTITION" in plan_of(T.with_said_terms(t))
    found = {r["doc_id"]: r["terms"] for r in T.with_said_terms(t).collect()}
    assert found == {i: ["The", "cat", "and", "le", "CAT"] if i % 2 == 0 and i < 39 else [] for i in range(40)}


def test_keys_of_plain_and_other_words(spark):
    lists = [["The", "AND", "cat", "Cat", "", None, "x9"], ["양극재", "The", "n c-m", "cathode"], ["and", "N·C·M", "ncm", "The"], [], None, [None], ["a b", "AB"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, terms array<string>").withColumn("code", F.concat(F.lit("c"), "doc_id"))
    spellings = texts.spelling_map({"the": ["and"], "양극재": ["cathode"]})
    found = terms.keyed_terms(rows, spellings, ["doc_id"], ("code",))
    plain = rows.select("doc_id", "code", F.posexplode(F.array_distinct("terms")).alias("pos", "raw")).withColumn("key", texts.term_key(F.col("raw"), spellings)).filter("key <> ''")
    wanted = plain.groupBy("key", "doc_id", "code").agg(F.min_by("raw", "pos").alias("raw"))
    assert found.columns == ["key", "doc_id", "code", "raw"] and "MapInArrow" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_a_percentile_is_searched_once(spark):
    table = spark.createDataFrame([(95.0, 0.5), (100.0, 0.875)], "percentile double, cosine double")
    found = peers.with_percentile(spark.range(5).select((F.col("id") / 5).alias("s")), table, "s", "p")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_reports_under_review_are_joined_once(spark):
    rows = [(i, "review_needed" if i != 4 else "auto", None, f"t{i}", ["s"]) for i in range(6)]
    reports = spark.createDataFrame(rows, "id long, tagging_status string, out_of_scope_reason string, title string, sectors_major array<string>").withColumn("published_at", F.lit("2001-01-01").cast("date"))
    made = [(1, 0, "verify", None), (2, 1, "oos", "fund"), (3, 2, "retag", None), (4, 3, "oos", "moon"), (5, 4, "verify", None), (6, 0, "retag", None)]
    after, refused = lifecycle.reviewed(reports, spark.createDataFrame(made, "decision long, id long, action string, reason string"))
    got = {r["id"]: (r["tagging_status"], r["out_of_scope_reason"], r["title"], r["sectors_major"], r["published_at"] is None) for r in after.collect()}
    kept = {i: ("review_needed", None, f"t{i}", ["s"], False) for i in (3, 5)}
    assert got == kept | {0: ("verified", None, "t0", ["s"], False), 1: ("verified", "fund", "t1", [], True), 2: ("pending", None, None, [], True), 4: ("auto", None, "t4", ["s"], False)}
    assert sorted(r["decision"] for r in refused.collect()) == [4, 5, 6] and "Union" not in plan_of(after)
    back = lifecycle.undone(after, reports, after, ["tagging_status", "title"])
    assert {r["id"]: (r["tagging_status"], r["title"]) for r in back.collect()} == {i: (s, t) for i, s, _, t, _ in rows}


def test_percentiles_need_few_exact_cosines_and_are_exact(spark, monkeypatch):
    """Pairs are looked through as floats; whatever cosine the first pass starts from, values are those of all pairs."""
    rng = np.random.default_rng(8)
    for wide in (64, 300):
        m = rng.normal(size=(260, wide)).astype("float32")
        m[200:230] = m[:30]  # copies
        m[230:] = m[:30] + 0.01 * m[30:60]
        df = stored(spark.createDataFrame([(f"{i:03d}", f"g{i % 50}", v.tolist()) for i, v in enumerate(m)], "code string, grp string, vector array<float>"), "vectors")
        unit = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
        a, b = np.triu_indices(260, 1)
        apart = a % 50 != b % 50
        cosines = np.sort(np.round(np.einsum("ij,ij->i", unit[a[apart]], unit[b[apart]]), 9))
        keep = vectors._least_wanted
        for least in ("sampled", None, -0.5, 0.9):
            monkeypatch.setattr(vectors, "_least_wanted", keep if least == "sampled" else lambda *_: least)
            got = {r["percentile"]: r["cosine"] for r in vectors.pair_percentiles(df, ["code"], group="grp", size=70).collect()}
            assert np.allclose([got[p] for p in sorted(got)], np.percentile(cosines, sorted(got)), atol=1.1e-9, rtol=0), (wide, least)
            monkeypatch.undo()
        blocks = [vectors._narrow({"m": unit[i : i + 130], "grp": np.array([f"g{j % 50}" for j in range(i, i + 130)])}, "grp") for i in (0, 130)]
        seen, pairs = 0, 0
        for x, y in ((blocks[0], blocks[0]), (blocks[0], blocks[1]), (blocks[1], blocks[1])):
            value, n = vectors._narrow_cosines(x, y, "grp")
            there = value > -1.5
            assert there.sum() == n and np.abs(value - x["m"] @ y["m"].T)[there].max() <= vectors._slack(x)
            seen, pairs = seen + there.sum(), pairs + n
        assert seen == pairs == apart.sum()


def test_a_cap_is_filled_by_the_first_terms(spark):
    """terms beyond those that fill the cap are not keyed; where keys repeat or are few, all terms are."""
    spellings = texts.spelling_map({"ab": ["cd"]})
    many, same = [f"w{i}" for i in range(500)], ["ab", "CD", "Ab"] * 40 + ["x", None, "", " Y-z ", "y z"]
    rows = spark.createDataFrame([(1, many), (2, same), (3, ["-", "a b"] * 20 + many), (4, None), (5, []), (6, many[:2])], "id int, terms array<string>")
    df = rows.withColumn("kept", terms.tidy(F.col("terms"), 3, spellings))
    assert {r["id"]: r["kept"] for r in df.collect()} == {1: ["w0", "w1", "w2"], 2: ["ab", "x", "Y-z"], 3: ["a b", "w0", "w1"], 4: None, 5: [], 6: ["w0", "w1"]}
    assert plan_of(df).count("slice(") >= 3


def test_nearest_owners_need_few_exact_cosines(monkeypatch):
    """K3: once a row has k owners, only pairs whose cosine of floats comes near its floor are worked out as doubles."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(6000, 64))
    m[3000:3100] = m[:100]  # equal cosines go by name
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    worked, keep = [], vectors._exact
    monkeypatch.setattr(vectors, "_exact", lambda x, y, row, col: worked.append(len(row)) or keep(x, y, row, col))
    for per in (1, 3):
        keys = ["code"] if per == 1 else ["code", "seg"]
        order = rng.permutation(6000).reshape(6, 1000)  # an owner's rows stand in several blocks
        blocks = []
        for part in np.sort(order, axis=1):
            block = {"m": m[part], "code": np.array([f"{i // per:05d}" for i in part]), "seg": part % per}
            blocks.append(vectors._narrow(block, "code" if per > 1 else None))
        best, part = vectors._Best(blocks[0], keys, 50), np.sort(order[0])
        worked.clear()
        for y in blocks:
            best.meet(y)
        got = best.ranked().to_pandas()
        assert 0 < sum(worked) < 0.15 * 1000 * 5000
        sims = np.round(m[part] @ m.T, 9)
        for at in (0, 1, 500, 999):
            first = {}
            for j in np.lexsort((np.arange(6000), -sims[at])).tolist():
                if j // per != part[at] // per:
                    first.setdefault(j // per, (-sims[at, j], f"{j // per:05d}", j % per))
            expected = [(name, -s) for s, name, _ in sorted(first.values())[:50]]
            mine = got[(got["seed_code"] == f"{part[at] // per:05d}") & ((got["seed_seg"] == part[at] % per) if per > 1 else True)]
            assert list(zip(mine["peer_code"], mine["similarity"])) == expected and mine["rank"].tolist() == list(range(1, 51))
            if per > 1:
                assert mine["peer_seg"].tolist() == [s[2] for s in sorted(first.values())[:50]]
