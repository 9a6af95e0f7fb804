"""The registered opN queries on a small table: their columns, and what the contract says of each row, worked out plainly."""

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from equityjobs.llm import language_id, queries

BIGGER = Path("/root/testdata/sf0.01")
WORDS = {"en": "the and that with from river stone hill road".split(), "de": "der und dass mit von fluss stein berg weg".split()}


def corpus():
    rng = np.random.default_rng(12)
    rows = []
    for i in range(90):
        lang = ["en", "de"][i % 2]
        text = "\n".join(" ".join(rng.choice(WORDS[lang], rng.integers(3, 40))) for _ in range(rng.integers(1, 6)))
        rows.append((i, text, lang, [None, "a", "b", "c"][i % 4], len(text)))
    rows[11] = (11, None, "en", "a", 0)
    rows[12] = (12, "", "en", "b", 0)
    rows[13] = (13, "12 -- 34 <|endoftext|> 5", None, "c", 0)
    rows += [(i, rows[3][1], "en", "a", 0) for i in range(90, 96)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = [(*r, "clash", "clash") for r in corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def found(spark, folder, name, columns):
    df = queries.QUERIES[name](spark, folder)
    assert df.columns[: len(columns)] == columns
    return df.collect()


def words_of(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return ids_of.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op1(spark, folder):
    got = {r["doc_id"]: r for r in found(spark, folder, "op1_language_id", ["doc_id", "held_out", "lang_pred", "score"])}
    assert set(got) == {r[0] for r in corpus()}
    for i, text, lang, *_ in corpus():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))


@pytest.mark.skipif(not BIGGER.exists(), reason="test tables are not here")
def test_held_out_accuracy_of_op1(spark):
    """Some sixty documents teach the network nothing; the thousand of this table do."""
    got = queries.QUERIES["op1_language_id"](spark, str(BIGGER)).filter("held_out and lang_pred <> 'und'")
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet").filter("lang is not null")
    row = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 250 and row["right"] > 0.95


def test_pooled_probabilities_are_those_of_one_document_at_a_time():
    rng = np.random.default_rng(2)
    net = language_id.Network.fresh(["a", "b", "c"], 6, rng)
    texts = [bytes(rng.integers(97, 123, n, dtype="u1")) for n in (1, 5, 127, 128, 129, 400, 3, 256)]
    plain = []
    for t in texts:
        parts = [np.frombuffer(t[i : i + language_id.WINDOW], "u1") for i in range(0, len(t), language_id.WINDOW)]
        each = []
        for p in parts:
            grid = np.zeros((1, language_id.WINDOW), "u1")
            grid[0, : len(p)] = p
            each += [q[0].copy() for at, q in net.position_probabilities(grid) if at < len(p)]
        plain.append(np.mean(each, axis=0))
    assert np.allclose(language_id._pooled(net, texts), plain, atol=1e-5)
    assert np.allclose(language_id._pooled(net, [texts[5]]), plain[5:6], atol=1e-5)


def test_op2(spark, folder):
    got = found(spark, folder, "op2_mixing", ["doc_id", "size", "source_size", "target", "taken"])
    sizes = {r[0]: len(words_of(r[1])) for r in corpus()}
    source = {r[0]: r[3] for r in corpus()}
    total = {s: sum(sizes[i] for i in sizes if source[i] == s) for s in ("a", "b", "c", None)}
    weight = dict(zip(("a", "b", "c", None), (5, 2, 1, 5)))
    goal, open_, left = {}, set(total), 1.5 * sum(total.values())
    while open_:  # fill up, the excess is shared again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    # The tilted rates, by bisection: min(2, exp(lambda * size / mean)).
    for s in total:
        docs = np.array([sizes[i] for i in sizes if source[i] == s], float)
        low, high = -60.0, 60.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if (docs * np.minimum(2, np.exp(np.minimum(lam * docs / docs.mean(), 50)))).sum() < goal[s] else (low, lam)
        rate = {i: min(2, np.exp(min(lam * sizes[i] / docs.mean(), 50))) for i in sizes if source[i] == s}
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert all(r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[s] and r["target"] == pytest.approx(goal[s]) for r in mine)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= max(sizes[i] for i in rate)
        # Copies follow the rates: over the documents, long to short, both add up to the same but for one document.
        order = sorted(mine, key=lambda r: -r["size"])
        gap = np.cumsum([r["taken"] - rate[r["doc_id"]] * r["size"] for r in order])
        assert np.abs(gap).max() <= 2 * max(sizes[i] for i in rate)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op2_mixing(spark, folder).collect()))


def test_op4(spark, folder):
    got = found(spark, folder, "op4_binary_output", ["doc_id", "start", "n_tokens", "ids_crc32"])
    start, expected = 0, []
    for i, text, *_ in sorted(corpus(), key=lambda r: r[0]):
        ids = [*ids_of(text), 2]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got)) == expected
    assert 50256 in ids_of(corpus()[13][1])


def test_op6(spark, folder):
    got = found(spark, folder, "op6_packing", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    expected = {i: [*ids_of(text), 0] for i, text, *_ in corpus()}
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, ids in expected.items():
        mine = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist() and sum(r["length"] for r in mine) == len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in mine)
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for places in windows.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 1024


def test_op7(spark, folder):
    import hashlib

    got = {r["doc_id"]: r for r in found(spark, folder, "op7_media", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])}
    for i, text, *_ in corpus():
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(got[i]["media_sha256"], got[i]["feature"]) for i in (3, *range(90, 96))}) == 1


def test_op8(spark, folder):
    got = {r["doc_id"]: r for r in found(spark, folder, "op8_simhash", ["doc_id", "fingerprint", "component_id"])}
    prints = {}
    for i, text, *_ in corpus():
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words_of(text)]
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}
    while True:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == root:
            break
        root = new
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_op9(spark, folder):
    got = found(spark, folder, "op9_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(shards.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in shards.values())
    # Cut edges (equal texts in two shards) against the least that quotas of two and three rows allow.
    groups = {}
    for r in got:
        groups.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    parts = {t: len(set(g)) for t, g in groups.items() if len(g) > 1}
    assert all(n <= -(-len(groups[t]) // 2) for t, n in parts.items())


def test_columns_of_the_others(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES["op10_line_dedup"](spark, folder)
    assert got.columns == ["doc_id", "text", "lines_removed"] and got.count() == docs.count()
    assert queries.QUERIES["op3_secret_scan"](spark, folder).columns == ["doc_id", "start", "length", "sha256", "score"]
    vectors = spark.range(120).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.sin(F.col("id") * (k + 1))).cast("array<float>").alias("embedding"))
    vectors.write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    top = queries.QUERIES["op5_topk"](spark, folder)
    assert top.columns == ["query_id", "rank", "vec_id", "score"]
    v = {r["vec_id"]: [int(np.floor(256 * float(x))) for x in r["embedding"]] for r in vectors.collect()}
    expected = [(q, n + 1, i, -s) for q in (0, 50, 100) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:5])]
    assert sorted(map(tuple, top.collect())) == expected
