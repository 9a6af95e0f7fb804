"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equityjobs.llm import binary_output, conversations, html_text, language_id, line_dedup, media, mixing, packing, periodic_runs, secret_scan, sharding, simhash, topk
from equityjobs.llm.shared import scratch_path

#: A line on so many distinct sources is boilerplate; one of over LONG_LINE_WORDS words is on LONG_LINE_SITES.
LINE_SITES, LONG_LINE_SITES, LONG_LINE_WORDS = 6, 4, 50
TOKENIZER = "byte_bpe_50k.json"


def _tokenizer() -> str:
    import public_tokenizers  # only where a tokenizer is needed

    return public_tokenizers.path(TOKENIZER)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    net = language_id.fit(docs)
    found = language_id.predict(docs.withColumn("held_out", language_id.held_out()), net, keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op4_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_ids")
    binary_output.write_ids(_documents(spark, sf_dir), path, _tokenizer(), end_id=2)
    return binary_output.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), factor=256)
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(_documents(spark, sf_dir), _tokenizer(), end_id=0, capacity=1024)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_column(_documents(spark, sf_dir)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), width=4, radius=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_documents(spark, sf_dir), shards=40)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    found = line_dedup.dedup_lines(docs, sites=LINE_SITES, long_sites=LONG_LINE_SITES, long_words=LONG_LINE_WORDS)
    return found.select("doc_id", "text", F.col("lines_removed").cast("long").alias("lines_removed"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_digest(conversations.damaged(rows), rows)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("seed"))
    found = periodic_runs.find_runs(periodic_runs.repeated_tails(docs, "seed"))
    # Quotients of numbers below 10 million differ by more than a double's precision, so equal ones are ties.
    keyed = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("key"), r["start"], r["period"], r["length"]))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", F.array_min(keyed)).withColumn("listed", listed)
    milli = F.expr("(1000 * best.length) div best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages, html_text.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_mixing, op3_secret_scan, op4_binary_output, op5_topk, op6_packing, op7_media, op8_simhash, op9_sharding,
        op10_line_dedup, op11_conversation_repair, op12_periodic_runs, op13_html_text,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_topk": """
        WITH valid AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
            FROM valid q JOIN valid d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5""",
    "op10_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents),
        bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS b FROM lines),
        common AS (
            SELECT b, min(doc_id) AS owner FROM bare WHERE b <> '' GROUP BY b
            HAVING count(DISTINCT coalesce('=' || source, '~'))
                   >= CASE WHEN len(regexp_extract_all(b, '[^\\x20\\x09-\\x0D]+')) > {LONG_LINE_WORDS} THEN {LONG_LINE_SITES} ELSE {LINE_SITES} END),
        marked AS (
            SELECT x.*, c.b IS NULL OR (x.doc_id = c.owner
                   AND row_number() OVER (PARTITION BY x.doc_id, x.b ORDER BY x.pos) = 1) AS stays
            FROM bare x LEFT JOIN common c ON x.b = c.b)
        SELECT d.doc_id,
               CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE m.stays), '') END AS text,
               CAST(count(*) FILTER (WHERE NOT m.stays) AS BIGINT) AS lines_removed
        FROM documents d JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE remainders AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                   lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        marked AS (
            SELECT c.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1]))) % 20 AS kind FROM keyed c, remainders),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM marked WHERE kind <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat(length(role), ':', role, text)), copy) AS i
            FROM damaged),
        judged AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
                   regexp_extract(text, '[^\x20\x09-\x0D][\x20\x09-\x0D]*$', 0)[1] AS tail,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed),
        faulty AS (
            SELECT *, CASE WHEN tail = '' THEN 'b' WHEN seen THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault FROM judged),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                   count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faulty GROUP BY conv_id),
        inserts(q, ins, said, r, price) AS (
            VALUES ('', '', '', '', 0), ('', 'I', 'user:,', 'u', 5), ('', 'II', 'user:,assistant:,', 'a', 10),
                   ('s', '', '', 's', 0), ('s', 'I', 'user:,', 'u', 5), ('s', 'II', 'user:,assistant:,', 'a', 10),
                   ('u', '', '', 'u', 0), ('u', 'I', 'assistant:,', 'a', 5), ('a', '', '', 'a', 0), ('a', 'I', 'user:,', 'u', 5)),
        moves(r, edit, initial, p, price) AS (
            VALUES ('', 'D', '', '', 2), ('s', 'D', '', 's', 2), ('u', 'D', '', 'u', 2), ('a', 'D', '', 'a', 2),
                   ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0), ('a', 'K', 'u', 'u', 0),
                   ('', 'R', '', 'u', 1), ('s', 'R', '', 'u', 1), ('u', 'R', '', 'a', 1), ('a', 'R', '', 'u', 1)),
        ways AS (
            SELECT q, ins, replace(said, ',', chr(10)) AS said, edit, initial, p, inserts.price + moves.price AS price
            FROM inserts JOIN moves USING (r)),
        steps AS (
            SELECT conv_id, 0 AS i, '' AS q, {'cost': 0, 'audit': '', 'turns': ''} AS best FROM counts
            UNION ALL
            SELECT s.conv_id, s.i + 1, w.p,
                   min({'cost': s.best.cost + w.price + CASE WHEN f.fault = 't' AND w.edit <> 'D' THEN 5 ELSE 0 END,
                        'audit': s.best.audit || w.ins || w.edit,
                        'turns': s.best.turns || w.said || CASE w.edit WHEN 'K' THEN f.role || ':' || f.text || chr(10)
                                 WHEN 'R' THEN CASE w.p WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) ELSE '' END})
            FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN ways w ON w.q = s.q
            WHERE (w.edit = 'D' OR f.fault IN ('t', 'o')) AND (w.edit <> 'K' OR left(f.role, 1) = w.initial)
            GROUP BY s.conv_id, s.i, w.p),
        ended AS (
            SELECT c.conv_id, min({'cost': s.best.cost + e.price, 'audit': s.best.audit || e.ins, 'turns': s.best.turns || replace(e.said, ',', chr(10))}) AS best
            FROM counts c JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n JOIN inserts e ON e.q = s.q AND e.r IN ('', 'a')
            GROUP BY c.conv_id)
        SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
               CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit,
               sha256(CASE WHEN coalesce(e.best.turns, '') = '' THEN '' ELSE left(e.best.turns, length(e.best.turns) - 1) END) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
