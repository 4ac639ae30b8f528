"""Identifiers, titles, dates, keywords and names taken from messy metadata."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from litquarry.functions.core import _c, fold_space_ascii, nz

# Patterns and word lists that decide results.
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
DOI_WITH_UNDERSCORE = r"(?i)(10\.\d{4,9})_(\S+)"
TITLE_NOTICE_PHRASES = [
    "this article has been accepted for publication",
    "undergone full peer review",
    "copyediting, typesetting, pagination",
    "version of record",
    "please cite this article as",
    "this article is protected by copyright",
    "all rights reserved",
    "accepted manuscript",
    "author manuscript",
    "uncorrected proof",
    "article in press",
    "early view",
    "corresponding author",
    "department of",
    "college of",
]
TITLE_CONTACT = r"(?i)(\bdoi\s*:|https?://doi\.org/|10\.\d{4,9}/|\be-?mail\b|\btel\b|\bfax\b)"
TITLE_JUNK_FIRST_WORDS = ["of", "and", "the", "for", "in", "on", "with", "a", "an"]
KEYWORD_NOISE = [
    "copyright", "grant/award", "grant award", "will notify", "volume:", "issue:", "correspondence", "department",
    "university", "fax", "e-mail", "email", "telephone", "received", "accepted", "published", "doi:", "http://",
    "https://",
]
MIN_YEAR, MAX_YEAR = 1800, 2027
LOCAL_LABEL = (r"(?i)^(?:compound|deriv(?:ative)?|analog(?:ue)?|化合物|衍生物|类似物)\s*"
               r"(?:no\.?|#|number)?\s*[0-9]+[a-zA-Z]?$")
BARE_LABEL = r"^[0-9]{1,3}[a-zA-Z]{0,2}$"
TRAILING_NUMBER = r"\s*\(\s*\d+\s*\)\s*$"
EXTRACT_WORDS = r"(?i)(extract|fraction|提取物|精油|essential\s+oil|crude|tincture|decoction|infusion)"
MIXTURE_WORDS = r"(?i)(混合物|mixture|精油|essential\s+oil|crude)"
SOLVENTS = [
    ("aqueous", ["aqueous", "水提", "水煎"]),
    ("methanol", ["methanol", "甲醇"]),
    ("ethanol", ["ethanol", "乙醇"]),
    ("ethyl_acetate", ["ethyl acetate", "乙酸乙酯"]),
    ("hexane", ["hexane", "正己烷"]),
    ("chloroform", ["chloroform", "氯仿"]),
    ("essential_oil", ["essential oil", "精油"]),
]
MAX_KEY_LENGTH = 256


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def doi_normalise(raw: Column | str) -> Column:
    bare = F.trim(F.replace(F.replace(F.replace(F.trim(_c(raw)), F.lit("https://doi.org/"), F.lit("")),
                                      F.lit("http://doi.org/"), F.lit("")), F.lit("doi:"), F.lit("")))
    found = F.regexp_extract(bare, DOI, 0)
    return nz(F.lower(F.regexp_replace(F.when(found != "", found).otherwise(bare), r"[\.,;:]+$", "")))


def first_doi(text: Column | str) -> Column:
    found = F.regexp_extract(_c(text), DOI, 0)
    return F.when(found != "", doi_normalise(found))


def doi_from_filename(name: Column | str) -> Column:
    """DOI of a file name, where the slash may have become an underscore."""
    bare = F.regexp_replace(fold_space_ascii(name), r"(?i)\.pdf$", "")
    prefix = F.regexp_extract(bare, DOI_WITH_UNDERSCORE, 1)
    suffix = F.regexp_replace(F.regexp_extract(bare, DOI_WITH_UNDERSCORE, 2), r"[.,;:]+$", "")
    return F.coalesce(first_doi(bare), F.when(F.length(suffix) >= 3, F.lower(F.concat(prefix, F.lit("/"), suffix))))


def key_normalise(name: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(_c(name))), r"[^a-z0-9]+", "_")
    return F.regexp_replace(F.coalesce(dashed, F.lit("")), r"^_+|_+$", "")


def name_uuid(key: Column | str) -> Column:
    """Version-3 UUID of the key's MD5 digest."""
    h = F.md5(_c(key))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def title_is_invalid(title: Column | str, journal: Column | str) -> Column:
    """Boilerplate, contact data, the journal's own name, or text too long to be a title."""
    t = nz(fold_space_ascii(F.translate(_c(title), " ", " ")))
    j = nz(fold_space_ascii(F.translate(_c(journal), " ", " ")))
    return (
        t.isNull() | _any_of(F.lower(t), TITLE_NOTICE_PHRASES) | F.rlike(t, F.lit(TITLE_CONTACT))
        | F.coalesce(F.lower(t) == F.lower(j), F.lit(False))
        | (F.length(t) > 250) | (F.size(F.split(t, " ")) > 45) | (F.regexp_count(t, F.lit(r"[.!?]")) > 2)
    )


def title_is_junk(title: Column | str) -> Column:
    t = F.trim(_c(title))
    shouting = F.rlike(t, F.lit(r"\p{L}")) & ~F.rlike(t, F.lit(r"\p{Ll}")) & (F.length(t) < 40)
    first = F.lower(F.regexp_extract(t, r"^(\S+)", 1))
    return F.coalesce((F.length(t) < 8) | shouting | first.isin(TITLE_JUNK_FIRST_WORDS), F.lit(True))


def display_title(title: Column | str, filename: Column | str, fallback: str = "Untitled document") -> Column:
    stem = F.regexp_replace(_c(filename), r"(?i)\.pdf$", "")
    ordered = F.when(title_is_junk(title), F.coalesce(nz(stem), nz(title))).otherwise(F.coalesce(nz(title), nz(stem)))
    return F.coalesce(ordered, F.lit(fallback))


def year_in(text: Column | str) -> Column:
    """First plausible four-digit year."""
    years = F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?<!\d)((?:18|19|20)\d{2})(?!\d)"), F.lit(1)),
                        lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: (y >= MIN_YEAR) & (y <= MAX_YEAR)), F.lit(0))


def partial_date(text: Column | str, fallback_year: Column | None = None) -> Column:
    """``yyyy[-mm[-dd]]`` found in the text, else the short text itself, else the fallback year."""
    t = nz(fold_space_ascii(F.translate(_c(text), " ", " ")))
    pattern = r"(?<!\d)((?:18|19|20)\d{2})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?(?!\d)"
    y, m, d = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    iso = F.concat_ws("-", y, F.when(m != "", F.lpad(m, 2, "0")), F.when(d != "", F.lpad(d, 2, "0")))
    in_range = y.try_cast("int").between(MIN_YEAR, MAX_YEAR)
    out = F.when(in_range, iso).when(F.length(t) <= 64, t)
    return F.coalesce(out, fallback_year.cast("string")) if fallback_year is not None else out


def title_key(title: Column | str) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(_c(title), F.lit(""))), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def title_similarity(left: Column | str, right: Column | str) -> Column:
    """Matching-block ratio of title keys, lifted when one long title contains the other."""
    a, b = title_key(left), title_key(right)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    contained = (F.contains(b, a) | F.contains(a, b)) & (shorter >= 30) & (shorter / longer >= 0.65)
    base = _sequence_ratio(a, b)
    return F.when((a == "") | (b == ""), 0.0).when(contained, F.greatest(base, F.lit(0.92))).otherwise(base)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_edges(keyword: Column | str) -> Column:
    return nz(fold_space_ascii(F.regexp_replace(fold_space_ascii(keyword), r"^[ .;,:/\-\t\r\n]+|[ .;,:/\-\t\r\n]+$", "")))


def _unless_noise(k: Column) -> Column:
    letters, digits = F.regexp_count(k, F.lit(r"\p{L}")), F.regexp_count(k, F.lit(r"\p{Nd}"))
    bad = (_any_of(F.lower(k), KEYWORD_NOISE) | (F.length(k) < 2) | (F.length(k) > 120) | (letters < 2)
           | (digits > letters) | (F.size(F.split(k, r"\s+")) > 14))
    return F.when(~bad, k)


def clean_keyword(keyword: Column | str) -> Column:
    """Keyword without edge punctuation; missing when it looks like noise."""
    return _bound(_without_edges(keyword), _unless_noise)


def keyword_key(keyword: Column) -> Column:
    return F.regexp_replace(F.lower(keyword), r"[^a-z0-9]+", "")


def dedupe_keywords(keywords: Column, limit: int = 12) -> Column:
    """Cleaned keywords in order, one per key, at most ``limit``; each is cleaned once and compared with those kept."""
    clean = F.filter(F.transform(F.transform(keywords, _without_edges), _unless_noise), lambda k: k.isNotNull())
    keyed = F.filter(F.transform(clean, lambda k: F.struct(k.alias("word"), keyword_key(k).alias("key"))), lambda x: x["key"] != "")
    new = lambda kept, x: (F.size(kept) < limit) & ~F.exists(kept, lambda y: y["key"] == x["key"])
    first = F.aggregate(keyed, F.array().cast("array<struct<word:string,key:string>>"),
                        lambda kept, x: F.when(new(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return F.transform(first, lambda x: x["word"])


def split_keywords(text: Column | str, limit: int = 12) -> Column:
    """Split on list marks; long parts are also split on commas."""
    def parts(t: Column) -> Column:
        marks = F.split(t, r"\s*[;•·]\s*|\s+--\s+|\s+-\s*(?=[A-Z])")
        return F.when((F.size(marks) == 1) & F.contains(t, F.lit(" - ")), F.split(t, r"\s+-\s*")).otherwise(marks)

    wide = F.flatten(F.transform(_bound(nz(fold_space_ascii(text)), parts), lambda p: F.when(
        (F.length(p) > 80) & F.contains(p, F.lit(",")), F.split(p, r"\s*,\s*")).otherwise(F.array(p))))
    return F.coalesce(dedupe_keywords(wide, limit), F.array().cast("array<string>"))


def is_local_label(original: Column, standard: Column) -> Column:
    """An in-text label such as "compound 3b" that names nothing outside its paper."""
    o = F.trim(F.coalesce(original, F.lit("")))
    return nz(standard).isNull() & (o != "") & (F.rlike(o, F.lit(LOCAL_LABEL)) | F.rlike(o, F.lit(BARE_LABEL)))


def name_kind(original: Column, standard: Column, source_category: Column, source_description: Column,
              structure_type: Column) -> Column:
    has = lambda c, p: F.coalesce(F.rlike(c, F.lit(p)), F.lit(False))
    plant = F.coalesce(_any_of(F.lower(source_category), ["植物", "plant"]), F.lit(False))
    natural = (plant & (has(original, EXTRACT_WORDS) | has(source_description, EXTRACT_WORDS)
                        | has(structure_type, MIXTURE_WORDS))) | (has(original, EXTRACT_WORDS) & nz(standard).isNull())
    return (F.when(is_local_label(original, standard), "LOCAL_LABEL").when(natural, "NATURAL_EXTRACT")
            .otherwise("PURE_COMPOUND"))


def _key_text(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")


def compound_key(document_id: Column, kind: Column, original: Column, standard: Column,
                 source_description: Column) -> Column:
    """Key under which rows about the same substance meet; bounded length."""
    clean = lambda c: F.coalesce(F.trim(F.regexp_replace(F.trim(c), TRAILING_NUMBER, "")), F.lit(""))
    o, desc = F.coalesce(original, F.lit("")), F.coalesce(source_description, F.lit(""))
    after_of = F.trim(F.regexp_extract(o, r"(?is)^.*?\s+of\s+(.*)$", 1))
    species = (F.when(nz(desc).isNotNull(), F.trim(F.element_at(F.split(desc, "[,，;；]"), 1)))
               .when(F.contains(F.lower(o), F.lit(" of ")), after_of).otherwise(o))
    wide_comma, comma = F.instr(desc, "，"), F.instr(desc, ",")
    part = (F.when(wide_comma > 0, F.trim(F.substr(desc, wide_comma + 1)))
            .when(comma > 0, F.trim(F.substr(desc, comma + 1))).otherwise(""))
    both = F.lower(F.concat_ws(" ", o, desc))
    solvent = None
    for name, words in SOLVENTS:
        solvent = F.when(_any_of(both, words), name) if solvent is None else solvent.when(_any_of(both, words), name)
    solvent = solvent.otherwise("unspecified")
    extract = F.concat_ws("|", nz(species), nz(part), solvent)
    pure = F.coalesce(nz(clean(standard)), clean(original))
    key = (F.when(kind == "LOCAL_LABEL", F.concat(F.lit("local:"), document_id.cast("string"), F.lit(":"),
                                                  _key_text(clean(original))))
           .when(kind == "NATURAL_EXTRACT", F.concat(F.lit("extract:"), _key_text(extract)))
           .otherwise(F.concat(F.lit("compound:"), _key_text(pure))))
    return F.when(F.length(key) <= MAX_KEY_LENGTH, key).otherwise(
        F.concat(F.substring(key, 1, 32), F.lit(":"), F.sha2(key, 256)))


def dedupe_authors(authors: Column) -> Column:
    """One spelling per author, in first-seen order, preferring a spelling that has spaces.

    The first spelling is replaced only by a later one with a space, and only while it has none.
    """
    key = lambda a: F.lower(F.regexp_replace(a, r"[^\p{L}\p{Nd}]+", ""))
    named = F.filter(authors, lambda a: nz(a).isNotNull())
    keys = F.array_distinct(F.transform(named, key))

    def best(k):
        same = F.filter(named, lambda a: key(a) == k)
        spaced = F.filter(same, lambda a: F.contains(a, F.lit(" ")))
        return F.when(F.size(spaced) > 0, F.get(spaced, F.lit(0))).otherwise(F.get(same, F.lit(0)))

    return F.transform(keys, best)
