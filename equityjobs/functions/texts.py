"""Comparison keys, names, codes and other text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alikes of the middle dot, the hyphen and the slash in Korean documents.
MIDDLE_DOTS = "·ㆍ・‧∙⋅"
HYPHENS = "\\-‐‑‒–−﹣－"
SLASHES = "/／"
#: White space of any script, as a character class for patterns outside Spark.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAPS = rf"(?U)[\s{MIDDLE_DOTS}{HYPHENS}]+"
_PARTS = rf"(?U)[\s{MIDDLE_DOTS}{HYPHENS}{SLASHES}]+|[^\s{MIDDLE_DOTS}{HYPHENS}{SLASHES}]+"
_QUERY_GAPS = rf"(?U)[\s,，、{MIDDLE_DOTS}]+"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """lower case without white space, middle dots and hyphens."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAPS, "")


def spelling_map(synonyms: dict[str, list[str]]) -> Column:
    """Squashed spelling (standard ones included) to its standard key, as a literal map."""
    import re

    def flat(s: str) -> str:
        return re.sub(f"[\\s{MIDDLE_DOTS}{HYPHENS}]+", "", s.lower())

    pairs = {flat(spelling): flat(standard) for standard, others in synonyms.items() for spelling in (*others, standard)}
    if not pairs:
        return F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def term_key(term: Column, spellings: Column) -> Column:
    """the standard key of a whole spelling, else the squashed term with each whole word that is a spelling replaced.

    Most terms are one word of letters and digits, which has nothing to squash but its case.
    """
    low = F.lower(term)
    whole = F.try_element_at(spellings, squash(term))
    words = F.regexp_extract_all(F.coalesce(term, F.lit("")), F.lit(f"({_PARTS})"), F.lit(1))
    parted = F.coalesce(whole, squash(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(spellings, squash(w)), w)), "")))
    return F.when(term.rlike(r"\A[A-Za-z0-9가-힣]+\z"), F.coalesce(F.try_element_at(spellings, low), low)).otherwise(parted)


def term_keys(terms: Column, spellings: Column) -> Column:
    """keys of the terms, each once and in order, without empty ones."""
    keys = F.transform(terms, lambda t: term_key(t, spellings))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def query_terms(query: Column, spellings: Column) -> Column:
    """keys of the whole query, then of its pieces of two characters or more."""
    whole = strip(F.coalesce(query, F.lit("")))
    pieces = F.filter(F.split(whole, _QUERY_GAPS), lambda p: F.length(strip(p)) >= 2)
    return term_keys(F.concat(F.array(whole), pieces), spellings)


def normalized_query(query: Column, spellings: Column, displays: Column) -> Column:
    """one blank between words, and spellings made standard: the whole query, else word by word."""
    text = strip(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)\s+", " "))
    words = F.regexp_extract_all(text, F.lit(f"({_PARTS})"), F.lit(1))

    def shown(w: Column) -> Column:
        return F.coalesce(F.try_element_at(displays, term_key(w, spellings)), w)

    return F.coalesce(F.try_element_at(displays, term_key(text, spellings)), F.array_join(F.transform(words, shown), ""))


def split_products(text: Column) -> Column:
    """parts between commas without a trailing " 등"; blank parts go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: strip(F.regexp_replace(strip(p), r"(?U)\s등$", "")))
    return F.filter(parts, lambda p: p != "")


def filename_tag(name: Column) -> Column:
    """the tag in ``_YYYYMMDD_<tag>_<digits>.pdf`` at the very end; it has a letter and only letters, blanks, + & . -"""
    tag = F.regexp_extract(F.coalesce(name, F.lit("")), r"_[0-9]{8}_([^_]+)_[0-9]+\.pdf\z", 1)
    return F.when(tag.rlike(r"\A[\p{L}+&.\- ]+\z") & tag.rlike(r"\p{L}"), tag)


def safe_file_name(name: Column, longest: int = 100) -> Column:
    """F32: forbidden characters, edge dots and blanks, the .pdf ending and the length."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")
    clean = F.when(clean == "", "unnamed").otherwise(clean)
    clean = F.when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest - 4), F.lit(".pdf"))).otherwise(clean)


def lookup_code(code: Column, width: int = 6) -> Column:
    """shorter codes are padded with zeros for the stock list; longer ones stay."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def valid_code(code: Column) -> Column:
    """P11 (shape part): six digits or capitals."""
    return F.coalesce(code.rlike(r"\A[0-9A-Z]{6}\z"), F.lit(False))


def version_parts(version: Column) -> Column:
    """leading numbers as an array of three or more ints; an unreadable version is null."""
    text = F.regexp_extract(F.coalesce(version, F.lit("")), r"^v?(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("int"))
    padded = F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(0), 3 - F.size(parts))))
    return F.when(text != "", padded)


def supported_parser(version: Column, least: tuple[int, int, int] = (0, 2, 0)) -> Column:
    return F.coalesce(version_parts(version) >= F.array(*[F.lit(x) for x in least]), F.lit(False))


def numbers_in(text: Column) -> Column:
    """numbers of a text; commas go, (x) is negative, look-alike minus signs count; (-5) is no number."""
    plain = F.translate(F.coalesce(text, F.lit("")), "−－", "--")
    found = F.regexp_extract_all(plain, F.lit(r"(\(?-?\d[\d,]*(?:\.\d+)?\)?)"), F.lit(1))

    def value(raw: Column) -> Column:
        bare = F.replace(raw, F.lit(","), F.lit(""))
        inner = F.regexp_replace(bare, r"^\(|\)$", "")
        return F.when(bare.startswith("(") & bare.endswith(")"), F.concat(F.lit("-"), inner)).otherwise(inner).try_cast("double")

    return F.array_distinct(F.filter(F.transform(found, value), lambda v: v.isNotNull()))


def format_share(share: Column) -> Column:
    """a share without trailing zeros (six significant digits); null when unknown."""
    exact = F.round(share, 4).cast("decimal(12,4)").cast("string")
    return F.when(share >= 0, F.regexp_replace(exact, r"\.?0+$", ""))
