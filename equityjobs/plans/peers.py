"""Whole jobs over peers: the tables of a build, peer lists of all companies, and theme search.

``vectors``: code, vector; ``segments``: code, seg_no, share, vector; ``stocks``: the stock list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions import numbers, texts
from equityjobs.operators import filings, lifecycle, peers, terms, vectors
from equityjobs.sources.scratch import stored

#: Matches that a vector search gives, and eligible ones that are kept of them.
MATCHES, KEPT = 200, 100


def percentile_tables(companies: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Percentiles of the cosines of all pairs of companies, and of segments of different companies."""
    return vectors.pair_percentiles(companies, ["code"]), vectors.pair_percentiles(segments, ["code", "seg_no"], group="code")


def company_matches(companies: DataFrame, stocks: DataFrame, k: int = KEPT) -> DataFrame:
    """K4: the listed companies most like each company: seed, peer, similarity, rank."""
    rows = companies.select("code", "vector")
    listed = rows.join(stocks.select("code"), "code", "left_semi")
    near = vectors.nearest(listed, ["code"], "code", k, seeds=rows)
    return near.select(F.col("seed_code").alias("seed"), F.col("peer_code").alias("peer"), "similarity", "rank")


def segment_matches(segments: DataFrame, stocks: DataFrame, k: int = KEPT) -> DataFrame:
    """K4: the listed companies with a segment most like each company's first one: seed, peer, seg_no, similarity, rank."""
    first = terms.ordered_segments(segments, ["code"]).filter("place = 1").select("code", "seg_no", "vector")
    listed = segments.select("code", "seg_no", "vector").join(stocks.select("code"), "code", "left_semi")
    near = vectors.nearest(listed, ["code", "seg_no"], "code", k, seeds=first)
    return near.select(F.col("seed_code").alias("seed"), F.col("peer_code").alias("peer"), F.col("peer_seg_no").alias("seg_no"), "similarity", "rank")


def peer_lists(companies: DataFrame, segments: DataFrame, stocks: DataFrame, shared: DataFrame | None = None, bonus: float = 0.0) -> DataFrame:
    """The ranked peers of every company, by both sides' percentiles."""
    tables = percentile_tables(companies, segments)
    return peers.merged_peers(company_matches(companies, stocks), segment_matches(segments, stocks), *tables, shared, bonus)


def peers_all_once(companies: DataFrame, segments: DataFrame, stocks: DataFrame, prices: DataFrame, counts: DataFrame, holdings: DataFrame) -> DataFrame:
    """``peers_all`` with equal rows as one and how many they are (``times``, see ``peers.judged_once``)."""
    return peers.judged_once(peer_lists(companies, segments, stocks), prices, counts, holdings, stocks)


def peers_all(companies: DataFrame, segments: DataFrame, stocks: DataFrame, prices: DataFrame, counts: DataFrame, holdings: DataFrame) -> DataFrame:
    """Q6: the peers of every company with price reaction, report label, same industry and candidate reasons.

    ``prices``: snapshots; ``counts``: code, label; ``holdings``: code, is_holding.
    """
    return peers.repeated(peers_all_once(companies, segments, stocks, prices, counts, holdings))


def eligible(near: DataFrame, stocks: DataFrame, matches: int = MATCHES, kept: int = KEPT) -> DataFrame:
    """The first ``kept`` listed ones of each query's ``matches`` matches: (query, code, similarity, rank)."""
    listed = near.filter(F.col("rank") <= matches).join(stocks.select("code"), "code", "left_semi")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "code")
    return listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept)


def theme_search(queries: DataFrame, companies: DataFrame, segments: DataFrame, holders: DataFrame, table: DataFrame, stocks: DataFrame, limit: int = 30) -> DataFrame:
    """Query, code, name, score, rank: company, segment and term rankings of every query, fused.

    ``queries``: query, keys (``texts.query_terms``), vector; ``holders``: ``peers.term_holders``; ``table``: key, companies. A query
    with no vector is ranked by its terms alone, and the other way round.

    A company that is in neither vector ranking and not among the first ``limit`` by terms has ``limit`` companies
    before it, so only these two groups are scored: the first ``limit`` come from partial rankings, and the exact term rank
    of a company in a vector ranking is counted where the companies are.
    """
    asking = queries.filter("vector is not null").select(F.concat(F.lit("query:"), F.col("query")).alias("code"), F.lit(0).alias("seg_no"), "vector")  # no company's code
    name = F.substring("seed_code", 7, 1 << 20).alias("query")

    def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
        near = vectors.nearest(rows.select(*keys, "vector"), keys, "code", MATCHES, seeds=asking.select(*keys, "vector"))
        return stored(eligible(near.select(name, F.col("peer_code").alias("code"), "similarity", "rank"), stocks).select("query", "code", "rank"), "ranking")

    by_company, by_segment = ranked(companies, ["code"]), ranked(segments, ["code", "seg_no"])
    wanted = peers.asked_blocks(queries.select("query", F.explode("keys").alias("key")), table)
    listed = holders.join(stocks.select("code"), "code", "left_semi")
    first = stored(peers.term_ranking(peers.term_totals(listed, wanted, limit), limit), "first_by_terms")
    near = by_company.select("query", "code").unionByName(by_segment.select("query", "code")).distinct()
    deep = near.join(first, ["query", "code"], "left_anti").groupBy("code").agg(F.collect_list("query").alias("only"))
    scored = stored(peers.term_totals(listed.join(deep, "code"), wanted), "near_by_terms")
    by_terms = first.select("query", "code", "rank").unionByName(peers.term_ranks_of(listed, wanted, scored))
    found = peers.fused([by_company, by_segment, by_terms]).filter(F.col("rank") <= limit)
    return found.join(stocks.select("code", "name"), "code").select("query", "code", "name", "score", "rank")


@dataclass
class Build:
    """What one build made: see ``peer_build``."""

    targets: DataFrame
    todo: DataFrame
    reused: DataFrame
    inputs: DataFrame
    profiles: DataFrame
    kept_previous: DataFrame
    missing_companies: DataFrame
    missing_segments: DataFrame
    run: DataFrame
    dropped_builds: DataFrame
    unused_profiles: DataFrame


def peer_build(
    sections: DataFrame, stocks: DataFrame, profiles: DataFrame, extracted: DataFrame, companies: DataFrame, segments: DataFrame, builds: DataFrame, year: int, version: str, build_id: int,
    skip_names: str, skip_sector: str, synonyms: dict[str, list[str]], most_terms: int = terms.PROFILE_CAPS["keywords"], pilot: bool = False,
) -> Build:
    """Q5: one build over the filings of ``year``.

    Targets (J6) whose stored ok profile has the same filing and parser version are reused (J7); the others' texts are assembled
    with their product tables (F10, F11). ``extracted`` (stock_code, rcept_no, parser_version, status, terms) answers for these: terms
    are capped by comparison key (F9) and kept where the assembled text has one of their spellings, ``synonyms`` included (F8). A new ok
    profile replaces the stored one, a failed one only where no ok one is stored (M9). ``profiles``: fiscal_year, profile_version,
    stock_code, rcept_no, parser_version, status, terms. Then come the profiles that lack an embedding (J8), the build's row with its
    status (A16), and what retention drops (W14). Tables are published by ``publication``.
    """
    spellings = texts.spelling_map(synonyms)
    filed = filings.newest_sections(filings.sections_of_year(sections, year))
    parser = filed.groupBy("stock_code", "rcept_no").agg(F.max_by("parser_version", texts.version_parts(F.col("parser_version"))).alias("parser_version"))
    chosen = filings.targets(filings.latest_filings(filed), stocks, skip_names, skip_sector)
    targets = stored(chosen.select("stock_code", "rcept_no").join(parser, ["stock_code", "rcept_no"]), "targets")
    mine = profiles.filter((F.col("fiscal_year") == year) & (F.col("profile_version") == version))
    todo, reused = filings.profile_work(targets, mine)
    filing = ["stock_code", "rcept_no"]
    texted = filed.join(todo.select(*filing), filing, "left_semi")
    if "table_text" not in texted.columns:
        texted = texted.withColumn("table_text", F.lit(None).cast("string"))
    inputs = stored(filings.assembled_inputs(texted), "inputs")
    asked = extracted.join(todo, [*filing, "parser_version"], "left_semi")
    capped = asked.withColumn("terms", terms.tidy(F.coalesce("terms", F.expr("cast(array() as array<string>)")), most_terms, spellings))
    said = capped.join(inputs.select(*filing, "text"), filing).select("stock_code", F.struct(*filing).alias("doc_id"), "text", "terms")
    grounded = terms.grounded_terms(said.select("doc_id", "text", "terms"), synonyms)
    kept = grounded.select("doc_id.*", F.col("kept_terms").alias("terms"), F.round("grounding_ratio", 4).alias("grounding_ratio"))
    fresh = capped.drop("terms").join(kept, filing).select(
        F.lit(year).alias("fiscal_year"), F.lit(version).alias("profile_version"), *filing, "parser_version", "status", F.when(F.col("status") == "ok", F.col("terms")).alias("terms"), "grounding_ratio"
    )
    fresh = stored(fresh, "fresh_profiles")  # counted twice and merged: texts are grounded once
    before = mine.withColumn("grounding_ratio", F.lit(None).cast("double")).select(*fresh.columns)
    after, kept_previous = lifecycle.replaced_profiles(before, fresh, ["stock_code"], ["rcept_no"])
    after = stored(after, "profiles")
    served = reused.count() + fresh.filter("status = 'ok'").count()
    eligible = targets.count()
    failed = fresh.filter("status <> 'ok'").count()
    row = targets.sparkSession.createDataFrame([(build_id, year, version, eligible, served, failed)], "build_id long, fiscal_year int, profile_version string, eligible long, profiled long, failed long")
    run = row.withColumn("status", F.when(F.col("eligible") == 0, "failed").otherwise(numbers.build_status(F.col("eligible"), F.col("profiled"), F.lit(pilot))))
    closed = builds.select("build_id", "status", "fiscal_year", "profile_version", "finished_no").unionByName(
        run.select("build_id", "status", "fiscal_year", "profile_version", F.lit(1 << 40).alias("finished_no"))  # this build is the last to finish
    )
    dropped = stored(lifecycle.dropped_builds(closed), "dropped_builds")
    ok = after.filter("status = 'ok'")
    return Build(
        targets, todo, reused, inputs, after, kept_previous,
        filings.missing_embeddings(ok, companies.select(F.col("code").alias("stock_code")), ["stock_code"]).select("stock_code"),
        ok.select("stock_code").join(segments.select(F.col("code").alias("stock_code")), "stock_code", "left_anti"),
        run, dropped, lifecycle.unused_keys(profiles, closed, dropped, ["fiscal_year", "profile_version"], version),
    )


def publication(build: Build, companies: DataFrame, segments: DataFrame, synonyms: dict[str, list[str]], displays: Column) -> dict[str, DataFrame]:
    """Q5: the tables that a build publishes, none unless its status is done: the term table of the stored (capped and grounded) ok
    profiles, and the percentile tables of their companies' and segments' vectors (A14), which are worked out here.
    """
    if build.run.first()["status"] != "done":  # one row
        return {}
    ok = build.profiles.filter("status = 'ok'")
    codes = ok.select(F.col("stock_code").alias("code"))
    company_table, segment_table = percentile_tables(companies.join(codes, "code", "left_semi"), segments.join(codes, "code", "left_semi"))
    table = terms.term_table(ok, texts.spelling_map(synonyms), displays, ["stock_code"])
    return {"terms": table, "company_percentiles": company_table, "segment_percentiles": segment_table}


def build_counts(targets: DataFrame, profiles: DataFrame, table: DataFrame) -> DataFrame:
    """Q5: one row for a build's log: eligible and profiled companies, terms and their holders."""
    ok = profiles.filter("status = 'ok'").select("stock_code").distinct().withColumn("_ok", F.lit(True))
    counts = targets.join(ok, "stock_code", "left").agg(F.count(F.lit(1)).alias("eligible"), F.count("_ok").alias("profiled"))
    held = table.agg(F.count(F.lit(1)).alias("terms"), F.sum("companies").alias("holdings"))
    return counts.join(F.broadcast(held))  # one row each
