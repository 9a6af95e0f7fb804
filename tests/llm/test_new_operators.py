"""Conversation repair, periodic runs and main texts against plain computations, and their edge cases."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from equityjobs.llm import conversations, html_text, periodic_runs, queries, secret_scan

DATA = "/root/testdata/sf0.001"

# --- op 11 ------------------------------------------------------------------------------------------------


def cheapest_by_states(rows):
    """(cost, audit) by dynamic programming over the states, with the audits spelled out."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                way = (cost + 5, audit + "I")
                now[follow[state]] = min(now.get(follow[state], way), way)
        return now

    now = {"": (0, "")}
    for code in rows:
        after = {}
        for state, (cost, audit) in inserted(now).items():
            extra = 5 * code.isupper()
            ways = [(state, cost + 2, "D")]
            if code != "-":
                ways.append((follow[state], cost + extra + 1, "R"))
                if code.lower() == follow[state] or (state == "" and code.lower() == "s"):
                    ways.append((code.lower(), cost + extra, "K"))
            for to, total, edit in ways:
                after[to] = min(after.get(to, (10**9, "")), (total, audit + edit))
        now = after
    now = inserted(now)
    return min(now[s] for s in ("", "a") if s in now)


def test_edits_are_the_cheapest_and_the_ascii_least():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 5, 9, 40):
        for _ in range(150):
            rows = "".join(rng.choices("suaxSUAX-", weights=[2, 5, 5, 1, 1, 1, 1, 1, 1], k=n))
            assert conversations.cheapest_edits(rows) == cheapest_by_states(rows), rows


def test_the_search_is_linear_in_the_rows():
    rng = random.Random(6)
    rows = "".join(rng.choices("suaUA-", weights=[1, 9, 9, 1, 1, 2], k=20_000))
    began = time.time()
    cost, audit = conversations.cheapest_edits(rows)
    assert time.time() - began < 20 and sum(c != "I" for c in audit) == len(rows) and cost > 0


CONVERSATIONS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Hello?"), (1, 4, "assistant", "Fine, thanks"), (1, None, "user", "First!"),
    (None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (2, None, None, None), (3, 7, "tool", "x" * 100_000 + "."), (4, 0, "assistant", "Only me."), (4, 0, "assistant", "Only me."),
]


def test_repairs_of_nulls_ties_and_repeated_rows(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, audit string, digest int")
    found = {r["conv_id"]: r for r in conversations.repairs(rows).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    assert tuple(found[1])[1:6] == (1, 0, 1, 1, 2)  # rows: u s u u(duplicate) a(truncated)
    assert (found[None]["cost"], found[None]["audit"]) == (0, "KK")
    assert (found[2]["blank"], found[2]["audit"], found[2]["cost"]) == (1, "D", 2)
    assert (found[3]["audit"], found[3]["gaps"]) == ("D", 0)  # a role of its own costs less to delete than to pair
    assert (found[4]["duplicate"], found[4]["cost"], found[4]["audit"]) == (1, 4, "DD")
    stored = conversations.stored(conversations.repairs(rows), "repairs")
    turns = conversations.repaired_turns(rows, stored).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in turns if r["conv_id"] is None] == [(None, "user", "Who?"), (None, "assistant", "Me.")]
    for key, found_row in found.items():
        roles = "".join(r["role"][0] for r in turns if r["conv_id"] == key)
        assert re.fullmatch("(s?(ua)+)?", roles) and len(roles) == sum(c != "D" for c in found_row["audit"])
    assert conversations.repairs(rows.limit(0)).count() == 0
    digest = {r["conv_id"]: r for r in conversations.repair_digest(rows.filter("conv_id = 1"), rows).collect()}
    assert digest[4]["audit"] == "" and digest[4]["repaired_sha256"] == hashlib.sha256().hexdigest() and digest[1]["repaired_sha256"] != digest[4]["repaired_sha256"]


def test_a_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.createDataFrame([(5, i, ("user", "assistant")[i % 2], f"Text {i}.") for i in range(100)] + [(6, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
        got = {r["conv_id"]: r for r in conversations.repair_digest(rows, rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = "\n".join(f"{('user', 'assistant')[i % 2]}:Text {i}." for i in range(100))
    assert got[5]["audit"] == "K" * 100 and got[5]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[6]["audit"] == "D"


# --- op 12 ------------------------------------------------------------------------------------------------


def runs_by_letters(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def digest_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(runs_by_letters(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    spot = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *spot, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def some_words(rng):
    parts = [np.zeros(0, "i8")]
    for _ in range(rng.integers(0, 6)):
        kind, letters = rng.integers(0, 4), int(rng.choice([1, 2, 3, 30]))
        if kind == 0:
            parts.append(rng.integers(0, letters, rng.integers(1, 50)))
        elif kind == 1:
            parts.append(np.resize(rng.integers(0, letters, rng.integers(1, 25)), rng.integers(1, 120)))
        else:
            parts.append(parts[rng.integers(0, len(parts))])
    return np.concatenate(parts).astype("i8")


@pytest.mark.parametrize("least", [24, 6])
def test_runs_on_the_grammar_are_all_runs(least):
    rng = np.random.default_rng(least)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.integers(1, 6))]
        texts += texts[:1]  # a copy shares its nonterminals
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = periodic_runs.runs_of(np.concatenate(texts), offsets, least)
        expected = [(i, *r) for i, t in enumerate(texts) for r in sorted(runs_by_letters(t.tolist(), least), key=lambda r: (r[0], r[2]))]
        assert [tuple(r) for r in got.tolist()] == expected
        assert all(sorted(map(tuple, periodic_runs.plain_runs(t, least).tolist())) == runs_by_letters(t.tolist(), least) for t in texts)


def test_one_word_repeated_very_often():
    words = np.zeros(200_000, "i8")
    began = time.time()
    assert periodic_runs.runs_of(words, np.array([0, 200_000])).tolist() == [[0, 0, 200_000, 1]]
    assert time.time() - began < 30


def test_words_are_parted_by_ascii_white_space_only():
    texts = pa.array(["a\x1cb c\x0bd\x85e\xa0f　g\x1f  ", None, "", " \t\n"])
    ids, offsets, words = periodic_runs.word_lists(texts)
    assert [words[i].as_py() for i in ids] == re.findall(r"[^\x20\x09-\x0D]+", texts[0].as_py()) and offsets.tolist() == [0, 3, 3, 3, 3]


def test_registered_runs_equal_the_plain_ones(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    short = [r for r in docs if len((r["text"] or "").split()) < 1500]
    assert len(got) == len(docs) and len(short) > 150 and all(got[r["doc_id"]] == digest_of(r["doc_id"], r["text"]) for r in short)


def test_runs_take_nulls_repeats_and_extra_columns(spark):
    text = "a b c " * 20 + "end"
    rows = [(None, text, 1), (7, None, 2), (7, "", 3), (7, text, 4), (7, text, 4), (8, "x " * 23, 5), (9, "x " * 24, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(docs).collect())
    run = [(0, 60, 3)]
    assert got == sorted([("None", 61, run, "a b c end"), ("7", 0, [], ""), ("7", 0, [], ""), ("7", 61, run, "a b c end"), ("7", 61, run, "a b c end"), ("8", 23, [], "x " * 22 + "x"), ("9", 24, [(0, 24, 1)], "x")])
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# --- op 13 ------------------------------------------------------------------------------------------------

P = "The quick brown fox jumps over the lazy dog and keeps on running through the long grass of the meadow."
PAGES = {
    f"<div id='header'><a href='/'>Site</a></div><ul class='menu'><li><a href=x>Home page</a></li></ul><div class='content'><h1>Title</h1><p>{P}</p><p>Short.</p><div class='ad-box'>Buy now</div><p>{P}</p></div>"
    f"<div class='sidebar'><p>{P}</p></div><div id='comments'><p>{P}</p><p>{P}{P}{P}</p></div><div class='footer'>Copyright</div>": f"Title\n{P}\nShort.\n{P}",
    f"<body><table><tr><td><a href=1>aa</a></td></tr></table><div><div><h2>Head</h2><p>{P}</p><ul><li>first point</li><li>second</li></ul><p>{P}</p></div></div><div><a href=3>cc</a></div></body>": f"Head\n{P}\nfirst point\nsecond\n{P}",
    f"<main><article class='post has-sidebar'><header><h1>Big &amp; bold</h1><span>by Ann</span></header><p>A &lt;b&gt; &eacute;&#233;&nbsp;x {P}</p><aside>more</aside><form><label>Mail</label></form><p>Last</p>"
    f"<section class='comments'><article class='comment'><p>{P}</p></article></section></article></main>": f"Big & bold\nA <b> éé x {P}\nLast",
    f"<div><nav><a href=x>m</a></div><article><p>{P}": P,
    f"<form id='aspnetForm'><div class=nav>x y</div><div class=main><p>{P}</p></div></form>": P,
    f"<article><script>var a='</p><p>no';</script><p>{P}</p><style>p{{}}</style><!-- hidden <p>no</p> --><noscript>enable</noscript></article>": P,
    f"<div class='cookie-notice'><p>{P}</p></div><div role='main'><p>{P}</p></div>": P,
    f"<header><h1>Site</h1></header><h1>Real title</h1><div class='story'><p>{P}</p></div>": f"Real title\n{P}",
    f"<article><p>one<b>two</b>three  <i>four</i><br>five</p><p>{P}</p></article>": f"onetwothree four five\n{P}",
    f"<div class='topbar'>Call us today</div><section id='story'><h2>Head</h2><p>{P}</p><div class='adslot'><p>{P}</p></div><p>{P}</p></section><ol class='commentlist'><li>{P}</li><li>{P}</li><li>{P}</li></ol>": f"Head\n{P}\n{P}",
    f"<div id=page><div id=nav-main>{'<a href=x>go there now</a> ' * 40}</div><div id=body><blockquote>{P}</blockquote>text in no paragraph<ul><li>a</li></ul></div><div role=contentinfo><p>{P}</p></div></div>": f"{P}\ntext in no paragraph\na",
    "just words": "just words", "": "", "<p></p>": "",
}


def test_main_texts_of_many_layouts():
    learned = html_text.learned([(page, None) for page in PAGES])
    for weights in (html_text.learned([]), learned):
        assert {page: html_text.main_text(page, weights) for page in PAGES} == PAGES


def test_the_best_region_is_the_maximum_of_all():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.integers(-4, 4, rng.integers(0, 12)).astype(float).tolist()
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        first, after = html_text.best_region(scores)
        most = max(sums.values(), default=0)
        assert (sum(scores[first:after]) == most if most > 0 else (first, after) == (0, 0))


def test_weights_are_learned_from_labelled_texts():
    """In these pages, links are the content: words in links get a weight that the first weights do not give them."""
    links = "".join(f"<p><a href={i}>entry number {i} of the list</a></p>" for i in range(20))
    page = f"<div><h2>Some words about it all that nobody asked to read today</h2></div><div class=x>{links}</div>"
    main = "\n".join(f"entry number {i} of the list" for i in range(20))
    weights = html_text.learned([(page, main)] * 20)
    assert weights["link word"] > html_text.FIRST_WEIGHTS["link word"] and html_text.main_text(page, weights) == main


@pytest.mark.parametrize("part", ["<", "<a ", '<p class="', "<!--", "<div><b>", "<script>", "&amp;", "a='", "<li>", "</p>", "<table><tr><td>"])
def test_broken_markup_is_read_in_linear_time(part):
    began = time.time()
    html_text.main_text(part * (400_000 // len(part)), html_text.FIRST_WEIGHTS)
    html_text.main_text("<a " + part * (400_000 // len(part)), html_text.FIRST_WEIGHTS)
    assert time.time() - began < 20


def test_extract_takes_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>", "t"), (1, "u", f"<article><p>{P}</p></article>", "t"), (None, None, None, None), (2, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = html_text.fit(pages)
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"]) for r in html_text.extract(pages, weights).collect())
    assert got == [("1", "u", P), ("1", "u", P), ("2", "v", ""), ("None", "None", "")]
    assert html_text.fit(pages.limit(0)) == html_text.FIRST_WEIGHTS and html_text.extract(pages.limit(0), weights).count() == 0


def test_registered_texts_are_the_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op13_html_text(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:p|h1)>", inner)]
        import html

        texts = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r["text"] == "\n".join(t for t in texts if t) and r["n_chars"] == len(r["text"])


# --- op 3 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["token" * 200_000, "token=" * 50_000, "token = " * 50_000, "token='" * 50_000, "token" + " " * 1_000_000, "://a:" + "x@" * 200_000])
def test_candidates_are_found_in_linear_time(text):
    corpus = secret_scan.Corpus(np.zeros((64, 64)), np.zeros(26**4, bool))
    began = time.time()
    spans = secret_scan._spans(text)
    assert all(np.isfinite(secret_scan._numbers(text[a:b], "", "", corpus)).all() for a, b, _ in spans[:5])
    assert time.time() - began < 10 and sum(b - a for a, b, _ in spans) <= 5 * len(text)


def test_blanks_around_a_mark_are_not_capped_and_values_in_values_are_found():
    text = "token" + " " * 30 + "=" + " " * 30 + "hunter2x"
    assert [text[a:b] for a, b, _ in secret_scan._spans(text)] == ["hunter2x"]
    text = "call('pwd=secret=abc,') my_api_key_2: 'x y'"
    assert [text[a:b] for a, b, _ in secret_scan._spans(text)] == ["secret=abc", "abc", "x y"]


def labelled_documents():
    """(doc_id, text, source, [(value, secret)]): findings in which assignments and known shapes mislead both ways."""
    rng = random.Random(8)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    words = "the of and that with report value server client request answer table column update".split()

    def key(n):
        return "".join(rng.choices(letters, k=n))

    rows = []
    for i in range(600):
        prose, found = [" ".join(rng.choices(words, k=12)) for _ in range(3)], []
        kind = i % 6
        if kind == 0:  # a real key after a word that no rule knows
            value, secret, line = key(32), True, "signing material {}"
        elif kind == 1:  # a real password
            value, secret, line = key(5) + rng.choice("!#%&") + key(6), True, 'password: "{}"'
        elif kind == 2:  # a placeholder after a secret-like word
            value, secret, line = rng.choice(["changeme", "your-token-here", "example-value", "insert-secret"]) + str(rng.randint(1, 99)), False, 'token = "{}"'
        elif kind == 3:  # a commit
            value, secret, line = "".join(rng.choices("0123456789abcdef", k=40)), False, "commit {} merged"
        elif kind == 4:  # a long identifier
            value, secret, line = "_".join(rng.choices(words, k=4)), False, "calls {} again"
        else:  # a date-like version after a secret-like word
            value, secret, line = f"release-2024-{rng.randint(10, 12)}-{rng.randint(10, 28)}", False, "credential_version={}"
        found.append((value, secret))
        text = "\n".join([prose[0], line.format(value), *prose[1:]])
        rows.append((i, text, f"site{i % 5}", found))
    return rows


def test_labelled_findings_remove_what_the_rules_mistake(spark):
    rows = labelled_documents()
    docs = conversations.stored(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string"), "docs")
    truth = [(i, text.index(v), s) for i, text, _, found in rows for v, s in found]
    train = spark.createDataFrame([t for t in truth if t[0] // 6 % 2 == 0], "doc_id long, start long, secret boolean")
    got = {(r["doc_id"], r["start"]) for r in secret_scan.scan(docs, train).collect() if r["doc_id"] // 6 % 2}
    held = {(i, s): secret for i, s, secret in truth if i // 6 % 2}
    corpus = secret_scan.corpus_statistics(docs)
    shaped = {(r["doc_id"], r["start"]) for r in secret_scan.candidates(docs, corpus).filter("shaped").collect() if r["doc_id"] // 6 % 2}

    def quality(found):
        of_labelled = [held[k] for k in found if k in held]  # a run around a value has no label
        return sum(of_labelled) / max(1, len(of_labelled)), sum(of_labelled) / sum(held.values())

    forest, rules = quality(got), quality(shaped)
    print("forest", forest, "rules", rules)
    assert forest[0] > 0.95 and forest[1] > 0.95 and rules[0] < 0.7
