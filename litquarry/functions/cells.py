"""Evidence cells: similarity, measurements, quotes, JSON, Markdown and digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from litquarry.functions.core import UNIT_SEPARATOR, _c, nz, squash_space

# Patterns and thresholds that decide results.
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
NUMERIC_HEADERS = ["activity", "ec50", "ic50", "mic", "%", "size", "count", "n50", "bp", "sensitivity", "efficacy"]
SEQUENCE_HEADERS = ["sequence", "primer", "probe"]
NUMBER_WITH_UNIT = (r"(?i)(?:\d+(?:\.\d+)?(?:\s*±\s*\d+(?:\.\d+)?)?\s*)"
                    r"(?:%|μg/mL|ug/mL|mg/L|g/L|ng/mL|μM|uM|mM|mol/L|mmol/g|g/ha|mg/kg)")
CITATION = r"\[文献(\d+)\]"
CITATION_BRACKET = r"\[[^\]]*文献[^\]]*\]"
RAW_CITATION = r"(?i)\[(?:EVIDENCE|LITERATURE):"
NEAR, CLOSE = 0.05, 0.2


def row_fingerprint(scope: Column, cells: Column) -> Column:
    """Digest of a question scope and its folded cells."""
    folded = F.transform(cells, lambda c: F.lower(squash_space(F.coalesce(c, F.lit("")))))
    return F.sha2(F.concat(F.upper(F.trim(F.coalesce(scope, F.lit("")))), F.lit(UNIT_SEPARATOR),
                           F.array_join(folded, UNIT_SEPARATOR)), 256)


def table_row_fingerprint(cells: Column) -> Column:
    """Digest of one full-width table row."""
    return F.sha2(F.lower(F.trim(F.array_join(cells, UNIT_SEPARATOR, ""))), 256)


def field_kind(header: Column | str) -> Column:
    h = F.lower(_c(header))
    hit = lambda words: F.greatest(*[F.contains(h, F.lit(w)) for w in words])
    return F.when(hit(NUMERIC_HEADERS), "numeric").when(hit(SEQUENCE_HEADERS), "sequence").otherwise("text")


def fold_cell(cell: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " ")))


def cell_tokens(folded: Column) -> Column:
    return F.array_distinct(F.filter(F.split(folded, r"[^a-z0-9\x{4e00}-\x{9fff}]+"), lambda t: t != ""))


def cell_parts(cell: Column) -> Column:
    """Struct of folded text, tokens and first number of a cell, for repeated comparison."""
    folded = fold_cell(cell)
    return F.struct(folded.alias("text"), cell_tokens(folded).alias("tokens"),
                    F.regexp_extract(folded, NUMBER, 0).try_cast("double").alias("number"))


def parts_similarity(a: Column, b: Column, kind: Column) -> Column:
    """1 for equal cells; graded closeness for numbers; otherwise token Jaccard."""
    na, nb, ta, tb = a["number"], b["number"], a["tokens"], b["tokens"]
    scale = F.greatest(F.abs(na), F.abs(nb))
    rel = F.abs(na - nb) / F.nullif(scale, F.lit(0.0))
    numeric = (F.when(scale == 0, 1.0).when(rel <= NEAR, 1.0).when(rel <= CLOSE, 0.6).otherwise(0.0))
    common = F.size(F.array_intersect(ta, tb))
    jaccard = F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(common / (F.size(ta) + F.size(tb) - common))
    return (F.when(a["text"] == b["text"], 1.0).when((a["text"] == "") | (b["text"] == ""), 0.0)
            .when((kind == "numeric") & na.isNotNull() & nb.isNotNull(), numeric).otherwise(jaccard))


def cell_similarity(left: Column, right: Column, kind: Column) -> Column:
    return parts_similarity(cell_parts(left), cell_parts(right), kind)


def quote_in(text: Column, quote: Column) -> Column:
    """True when the quote occurs in the text after white-space folding of both."""
    return F.contains(squash_space(F.coalesce(text, F.lit(""))), squash_space(quote))


def locate_quote(text: Column, quote: Column, start: Column | None = None) -> Column:
    """Struct of status and code-point offsets; a quote that occurs twice needs a start offset."""
    pos = F.position(quote, text)
    again = F.position(quote, text, pos + 1)
    given = start if start is not None else F.lit(None).cast("int")
    given_ok = (given >= 0) & (F.substr(text, given + 1, F.length(quote)) == quote)
    status = (F.when(nz(quote).isNull(), "EMPTY_QUOTE")
              .when(given.isNotNull() & given_ok, "OK").when(given.isNotNull(), "OFFSET_MISMATCH")
              .when(pos == 0, "NOT_FOUND").when(again > 0, "AMBIGUOUS").otherwise("OK"))
    begin = F.coalesce(given, pos - 1)
    return F.struct(status.alias("status"), F.when(status == "OK", begin).alias("start_offset"),
                    F.when(status == "OK", begin + F.length(quote)).alias("end_offset"))


def parse_measurement(raw: Column | str) -> Column:
    """Struct of relation (ND, GT, EQ), value and deviation of a printed measurement."""
    t = F.trim(F.replace(F.trim(_c(raw)), F.lit("AE"), F.lit("±")))
    numbers = F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    nd = (t == "") | (F.upper(t) == "ND")
    num = lambda i: F.when(~nd, F.get(numbers, F.lit(i)).try_cast("double"))
    return F.struct(F.when(nd, "ND").when(F.startswith(t, F.lit(">")), "GT").otherwise("EQ").alias("relation"),
                    num(0).alias("value"), num(1).alias("deviation"))


def parse_bracketed_activity(raw: Column | str) -> Column:
    """Struct of unit, relation and value of ``IC50 [unit]: value``; unit is null when it does not parse."""
    p = r"(?i)IC\s*50\s*\[([^\]]+)\]\s*:\s*(>\s*)?([0-9.]+)"
    part = lambda i: F.regexp_extract(_c(raw), p, i)
    return F.struct(F.nullif(part(1), F.lit("")).alias("unit"),
                    F.when(part(1) != "", F.when(part(2) != "", "GT").otherwise("EQ")).alias("relation"),
                    part(3).try_cast("double").alias("value"))


def fold_numeric(text: Column) -> Column:
    t = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("μ"), F.lit("u"))
    return F.regexp_replace(F.regexp_replace(t, r"±\s*\d+(?:\.\d+)?", ""), r"\s+", "")


def numbers_untraceable(text: Column, source: Column) -> Column:
    """True when some number with a unit does not occur in the source."""
    folded = fold_numeric(source)
    facts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_WITH_UNIT), F.lit(0))
    return F.exists(facts, lambda f: ~F.contains(folded, fold_numeric(f)))


def citations_illegal(text: Column, literature_count: Column) -> Column:
    """Raw tokens, malformed citation brackets or numbers outside the literature list."""
    t = F.coalesce(text, F.lit(""))
    brackets = F.regexp_extract_all(t, F.lit(CITATION_BRACKET), F.lit(0))
    cited = F.regexp_extract_all(t, F.lit(CITATION), F.lit(1))
    return (F.rlike(t, F.lit(RAW_CITATION)) | F.exists(brackets, lambda b: ~F.rlike(b, F.lit("^" + CITATION + "$")))
            | F.exists(cited, lambda n: (n.cast("int") < 1) | (n.cast("int") > literature_count)))


def sentences(text: Column | str) -> Column:
    t = F.regexp_replace(_c(text), r"\s*\n+\s*", ". ")
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def markdown_cell(cell: Column) -> Column:
    c = F.replace(F.coalesce(cell, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("|"), F.lit("\\|"))
    return F.translate(c, "\r\n", "  ")


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def json_object_in(text: Column | str) -> Column:
    """Text from the first opening to the last closing brace; null when there is none."""
    return F.nullif(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0), F.lit(""))


def read_json_object(text: Column | str, schema: str) -> Column:
    """Struct of the parsed object and an error code."""
    body = json_object_in(text)
    parsed = F.from_json(body, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return F.struct(parsed.alias("value"), F.when(body.isNull(), "NO_JSON_OBJECT").alias("error"))


def keyed_payload(headers: list[str], cells: Column) -> Column:
    """Header to cell map of a positional row."""
    n = F.lit(len(headers))
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), len(headers))), 1, n)
    return F.map_from_arrays(F.array(*[F.lit(h) for h in headers]), padded)


def guard_formula(text: Column | str) -> Column:
    """Prefix text that a spreadsheet would read as a formula."""
    t = _c(text)
    return F.when(F.rlike(t, F.lit(r"^\s*[=+\-@]")), F.concat(F.lit("'"), t)).otherwise(t)


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys and no blanks; for text and integer fields."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    """Text given to an embedding model: paper, section, body."""
    return F.concat(
        F.when(nz(title).isNotNull(), F.concat(F.lit("Paper: "), title, F.lit("\n"))).otherwise(""),
        F.when(nz(section).isNotNull(), F.concat(F.lit("Section: "), section, F.lit("\n"))).otherwise(""), text)
