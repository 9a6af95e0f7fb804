"""Terms of company profiles: tables, grounding, caps, and the texts built from them."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.functions.texts import HYPHENS, MIDDLE_DOTS, SLASHES, WHITE, format_share, squash, strip, term_key
from equityjobs.sources.scratch import bounded_batches

NO_ROLE = "기타"
#: What ``strip`` takes from both ends.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
#: The most terms of each kind in a profile.
PROFILE_CAPS = {"products": 12, "keywords": 15, "applications": 8, "customers": 8, "competitors": 8}


def keyed_terms(profiles: DataFrame, spellings: Column, order: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """``order``, ``also``, key, raw: each comparison key of a profile's terms once, with its first spelling there.

    ``order`` tells profiles apart; rows stay where they are. Most profiles hold words of plain letters and digits only, whose key is
    their lower case or its standard: these are keyed once for each distinct word of an Arrow batch (``spellings`` is a literal map). The
    others go by ``texts.term_key``.
    """
    spark = profiles.sparkSession
    bounded_batches(spark)
    known = spark.range(1).select(spellings).first()[0]  # the literal map
    named = [*order, *also]
    n = len(named)

    def parted(terms: Column) -> Column:
        firsts = F.transform(_first_of_keys(F.array_distinct(terms), spellings), lambda e: F.struct(e["key"].alias("key"), e["term"].alias("raw")))
        words, keyed = (F.expr(f"cast(null as array<{kind}>)") for kind in ("string", "struct<key: string, raw: string>"))
        odd = F.array_join(terms, "").rlike("[^A-Za-z0-9]")
        return F.when(odd, F.struct(words.alias("words"), firsts.alias("keyed"))).otherwise(F.struct(terms.alias("words"), keyed.alias("keyed")))

    read = profiles.select(*named, _let(F.col("terms"), parted).alias("_terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, other = batch.column(n).flatten()
            row, key, raw = _keys_of_words(words, known)
            entries = other.flatten()
            row = np.append(row, np.repeat(np.arange(len(other)), _lengths(other)))
            columns = [c.take(pa.array(row)) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([key, entries.field(0)]), *columns, pa.concat_arrays([raw, entries.field(1)])], ["key", *named, "raw"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*named).schema.fields)
    return read.mapInArrow(run, f"key string, {kinds}, raw string")


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("i8")


def _keys_of_words(words: pa.Array, known: dict[str, str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, key, word) of the first word of each key of each row, of lists of plain words."""
    flat, row = words.flatten(), np.repeat(np.arange(len(words)), _lengths(words))
    full = pc.fill_null(pc.greater(pc.binary_length(flat), 0), False)
    coded, row = flat.filter(full).dictionary_encode(), row[full.to_numpy(zero_copy_only=False)]
    lower = pc.ascii_lower(coded.dictionary).to_pylist()
    keys = pa.array([known.get(w, w) for w in lower], pa.string()).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype("i8")
    key = keys.indices.to_numpy(zero_copy_only=False).astype("i8")[word]
    _, first = np.unique(row * (len(keys.dictionary) + 1) + key, return_index=True)
    return row[first], keys.dictionary.take(pa.array(key[first])), coded.dictionary.take(pa.array(word[first]))


def table_of(keyed: DataFrame, displays: Column, order: list[str]) -> DataFrame:
    """Key, display, companies of ``keyed_terms``.

    The display is the standard spelling, else the spelling of the first profile in ``order`` that has the key.
    """
    found = keyed.groupBy("key").agg(F.min_by("raw", F.struct(*order)).alias("_raw"), F.count(F.lit(1)).alias("companies"))
    return found.select("key", F.coalesce(F.try_element_at(displays, F.col("key")), strip(F.col("_raw"))).alias("display"), "companies")


def term_table(profiles: DataFrame, spellings: Column, displays: Column, order: list[str]) -> DataFrame:
    """Key, display, companies over (terms, ``order``) rows."""
    return table_of(keyed_terms(profiles, spellings, order), displays, order)


def spelling_violations(spellings: DataFrame) -> DataFrame:
    """spellings under more than one standard, from (standard, spelling) rows."""
    keyed = spellings.select(squash(F.col("spelling")).alias("key"), squash(F.col("standard")).alias("_standard"))
    return keyed.groupBy("key").agg(F.count_distinct("_standard").alias("standards")).filter("standards > 1")


def spelling_rule(forms: dict[str, list[str]], most: int = 64) -> Callable[[str], list[str]]:
    """what gives the squashed spellings that stand for a term in a squashed text.

    ``forms`` maps a standard spelling to its other spellings. Spellings of a term's words multiply, up to ``most``.
    """
    gaps, parting = re.compile(f"[{WHITE}{MIDDLE_DOTS}{HYPHENS}]+"), re.compile(f"([{WHITE}{MIDDLE_DOTS}{HYPHENS}{SLASHES}]+)")

    def flat(s: str) -> str:
        return gaps.sub("", s.lower())

    families = {}
    for standard, others in forms.items():
        family = list(dict.fromkeys([flat(standard), *map(flat, others)]))
        families |= dict.fromkeys(family, family)

    def spell(term: str) -> list[str]:
        if term.isascii() and term.isalnum() and term.lower() not in families:
            return [term.lower()]  # one word without another spelling
        options = []
        for part in parting.split(term):
            word = flat(part)
            options.append([word, *(f for f in families[word] if f != word)] if word and word in families else [part])
        built = (flat("".join(c)) for c in itertools.islice(itertools.product(*options), most))
        return [s for s in dict.fromkeys([flat(term), *families.get(flat(term), []), *built]) if s][:most]

    return spell


def term_spellings(terms: DataFrame, forms: dict[str, list[str]], most: int = 64) -> DataFrame:
    """term, spellings of each distinct ``term``; the work is per distinct term, in Arrow batches."""
    spell = spelling_rule(forms, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"term": batch["term"], "spellings": [spell(t) for t in batch["term"]]})

    return terms.select("term").filter("term is not null").distinct().mapInPandas(run, "term string, spellings array<string>")


def found_terms(hay: str, terms: dict[str, list[str]]) -> set[str]:
    """The terms any of whose spellings stands in ``hay``, which an automaton of all spellings reads once."""
    import ahocorasick

    standing: dict[str, list[str]] = {}
    for term, spellings in terms.items():
        for s in spellings:
            standing.setdefault(s, []).append(term)
    if not standing or not hay:
        return set()
    automaton = ahocorasick.Automaton()
    for s in standing:
        automaton.add_word(s, s)
    automaton.make_automaton()
    return {term for s in {s for _, s in automaton.iter(hay)} for term in standing[s]}


def grounded_terms(documents: DataFrame, forms: dict[str, list[str]], most: int = 64) -> DataFrame:
    """Per document the terms with a spelling that occurs in its squashed text, and the kept share.

    ``documents``: doc_id, text, terms; ``forms`` as in ``spelling_rule``. Rows stay where they are. Each text is read once, by an
    automaton of the spellings of its distinct terms, so the work is linear in the text, the terms and what they match.
    A term without a character that counts is not asked for; a document without terms has a share of 1.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    spell = spelling_rule(forms, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(2)
            coded, ends = terms.flatten().dictionary_encode(), np.cumsum(_lengths(terms))
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            distinct = coded.dictionary.to_pylist()
            spelled = [spell(t) for t in distinct]
            asked = np.array([bool(s) for s in spelled] + [False])  # the last is null
            kept = np.zeros(len(code), bool)
            for hay, low, high in zip(batch.column(1).to_pylist(), np.append(0, ends[:-1]), ends):
                here = code[low:high]
                there = found_terms(hay, {t: spelled[t] for t in np.unique(here).tolist() if asked[t]})
                kept[low:high] = np.isin(here, list(there))
            given, left = (np.append(0, np.cumsum(x))[np.append(0, ends)] for x in (asked[code], kept))
            values = pa.array([t.strip(_BLANKS) for t in distinct], pa.string()).take(pa.array(code[kept]))
            columns = [batch.column(0), pa.array(np.diff(given), pa.int32()), pa.ListArray.from_arrays(pa.array(left, pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "given", "kept_terms"])

    bounded_batches(documents.sparkSession)
    read = documents.select("doc_id", squash(F.col("text")).alias("_hay"), "terms").mapInArrow(run, f"doc_id {kind}, given int, kept_terms array<string>")
    ratio = F.when(F.col("given") == 0, 1.0).otherwise(F.size("kept_terms") / F.col("given"))
    return read.select("doc_id", "kept_terms", "given", ratio.alias("grounding_ratio"), (ratio < 0.8).alias("ask_again"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_of_keys(terms: Column, spellings: Column, key: Callable[[Column, Column], Column] = term_key) -> Column:
    """(key, pos, term) of the first term of each comparison key, by key; the empty key is left out."""
    keyed = F.transform(terms, lambda t, i: F.struct(key(t, spellings).alias("key"), i.alias("pos"), t.alias("term")))

    def firsts(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]))

    return _let(F.array_sort(F.filter(keyed, lambda e: e["key"] != "")), firsts)


def _plain_key(term: Column, spellings: Column) -> Column:
    """``term_key`` of a term of plain letters and digits."""
    return F.coalesce(F.try_element_at(spellings, F.lower(term)), F.lower(term))


def tidy(terms: Column, cap: int, spellings: Column) -> Column:
    """terms once per comparison key, the first spelling kept, up to the cap.

    A word is keyed once, however often it stands; terms of plain letters and digits only have no blanks or marks to take out.
    """

    def firsts(distinct: Column) -> Column:
        odd = F.array_join(distinct, "").rlike("[^A-Za-z0-9]")
        return F.when(odd, _first_of_keys(F.transform(distinct, strip), spellings)).otherwise(_first_of_keys(distinct, spellings, _plain_key))

    def capped(some: Column) -> Column:
        ordered = F.array_sort(F.transform(_let(F.array_distinct(some), firsts), lambda e: F.struct(e["pos"].alias("pos"), e["term"].alias("term"))))
        return F.transform(F.slice(ordered, 1, cap), lambda e: e["term"])

    def of_all(every: Column) -> Column:
        # Where the first terms fill the cap, the others do not matter.
        return _let(capped(F.slice(every, 1, 4 * cap + 16)), lambda head: F.when(F.size(head) >= cap, head).otherwise(capped(every)))

    return _let(terms, of_all)


def capped_share(share: Column) -> Column:
    return F.when((share >= 0) & (share <= 100), share.cast("double")).otherwise(-1.0)


def capped_roles(roles: Column) -> Column:
    cut = F.slice(F.array_distinct(roles), 1, 2)
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit(NO_ROLE)))


def ordered_segments(segments: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Segments by revenue share, unknown ones last, ties by number; ``place`` 1 is the default segment."""
    unknown = F.col("share").isNull() | (F.col("share") < 0)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(unknown, F.when(~unknown, -F.col("share")), "seg_no"))
    ranked = segments.withColumn("place", place)
    return ranked if most is None else ranked.filter(F.col("place") <= most)


def company_text(profile: str = "profile") -> Column:
    """the company's embedding text, from a struct of niche_industry, summary, products, keywords, segments, applications."""
    p = F.col(profile)

    def listed(x: Column) -> Column:
        return F.array_join(F.coalesce(x, F.expr("cast(array() as array<string>)")), ", ")

    def head(s: Column) -> Column:
        share = format_share(s["revenue_share_pct"])
        return F.concat(s["name"], F.when(share.isNotNull(), F.concat(F.lit("("), share, F.lit("%)"))).otherwise(""), F.lit(": "), listed(s["products"]))

    lines = (("업종", p["niche_industry"]), ("요약", p["summary"]), ("제품", listed(p["products"])), ("키워드", listed(p["keywords"])), ("사업부문", F.array_join(F.transform(p["segments"], head), "; ")), ("적용처", listed(p["applications"])))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(text, F.lit(""))) for name, text in lines])


def segment_text(niche: Column, name: Column, products: Column, keywords: Column) -> Column:
    return F.concat(niche, F.lit(" — "), name, F.lit(": "), F.array_join(products, ", "), F.lit(" / "), F.array_join(keywords, ", "))
