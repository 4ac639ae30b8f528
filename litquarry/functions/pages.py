"""Text signals of document pages, chunks and lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from litquarry.functions.core import _c, nz

# Patterns and weights that decide results.
ORGANISM = (r"(?i)oomyc|phytophthora|pythium|plasmopara|peronospora|downy mildew|late blight|"
            r"疫霉|腐霉|霜霉|卵菌")
ACTIVITY = (r"(?i)ic\s*50|ec\s*50|mic\b|inhibi|activity|efficacy|control|fungicidal|mycel|sporang|zoospore|preventive|"
            r"curative|disease rating|防效|抑制率|抑制|活性|菌丝|孢子|病情指数")
COMPOUND = (r"(?i)cmpd\s*(?:no\.?)?|compound\s*(?:no\.?)?|formula|example|preparation|synthesis|化合物|通式|实施例|制备例")
ABSTRACT = r"(?i)\babstract\b|摘要"
ROW_ID = r"^\s*(\d{1,5})\s+(?:[-+]?\d|\*{1,3}|[-+])"
COMPOUND_MAP = (r"(?i)\bA\s+is\b|\bR\d*\b|\bG\s+is\b|\bZ\s+is\b|molecular weight|\bMS\b|\bNMR\b|formula|synthesis|"
                r"preparation|通式|取代基|制备")
LABEL_WITH_AMOUNT = r"(?i)\b(?:\d+[a-z]|\d+)\s+(?:\d{1,4}(?:\.\d+)?|\d+\s*u?m)\b"
TABLE_LABEL = r"(?i)\btable\s+\d+\b"
SUPPORT_WORDS = ["table ", "caption", "activity", "assay", "experimental", "method", "phytophthora"]
PAIR_ZH = r"(?:含有|含|包含|包括)([^，。；\r\n]{1,60}?)(?:和|与|及)([^，。；\r\n]{1,60}?)(?:的)?(?:杀菌|农药|组合物|复配)"
PAIR_EN = (r"(?i)(?:containing|comprising|including)\s+([A-Za-z0-9\- ]{2,60}?)\s+(?:and|with)\s+([A-Za-z0-9\- ]{2,60}?)"
           r"(?:\s+fungicidal|\s+composition|\.|,|$)")
SERIES = r"(?i)通式|式\s*[（(]?[I1]|formula\s+[I1]"
FORMULATION = r"(?i)悬浮剂|乳油|水分散粒剂|可湿性粉剂|制剂|formulation|composition"
TARGETS = r"(?i)马铃薯晚疫病|黄瓜霜霉病|霜霉病|晚疫病|疫霉|卵菌|downy mildew|late blight|phytophthora|oomycete"
CAPTION = r"(?i)^\s*(?:续\s*)?(?:表\s*\d+(?:[-－]\d+)?|table\s+[\dIVX]+)\b?.{0,120}$"
_MEASURE = r"(?:EC\s*50|IC\s*50|MIC|CTC|共毒系数|抑制率|防效)"
_SUBJECT = r"(?:处理|药剂|compound|cmpd|treatment|ratio|配比|比例)"
MATRIX = rf"(?i){_MEASURE}.{{0,80}}{_SUBJECT}|{_SUBJECT}.{{0,80}}{_MEASURE}"
TABLE_ACTIVITY = r"(?i)EC\s*50|IC\s*50|MIC|CTC|共毒系数|毒力|抑制|防效|活性|fungicidal|activity|inhibition"
TABLE_FORMULATION = r"(?i)配方|制剂|悬浮剂|乳油|可湿性粉剂|水分散粒剂|formulation|composition"
TABLE_STRUCTURE = r"(?i)结构|通式|取代基|合成|制备|formula|structure|synthesis|preparation"
BIOLOGICAL_NAME = r"(?i)\b(protein|gene|transcription factor|receptor|transcript|enzyme)\b|蛋白|基因|转录因子"
BIOLOGICAL_STRUCTURE = ["protein", "gene", "transcription factor", "enzyme", "蛋白", "基因", "转录因子", "酶"]
INACTIVE = ["无抑制", "无活性", "未见活性", "no inhibition", "no activity", "inactive", "not active", "ei% ≈ 0", "ei%=0"]
APPLICATION = ["leaf", "叶片", "温室", "田间", "field", "in vivo", "plant", "植株"]


def has(text: Column | str, pattern: str) -> Column:
    return F.coalesce(F.rlike(_c(text), F.lit(pattern)), F.lit(False))


def contains_any(text: Column | str, words: list[str]) -> Column:
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return out


def text_layer(text: Column | str) -> Column:
    """Struct of visible, replacement and letter-or-digit characters of a page."""
    t = F.coalesce(_c(text), F.lit(""))
    visible = F.length(F.regexp_replace(t, r"(?U)\s", ""))
    return F.struct(visible.alias("visible"), F.regexp_count(t, F.lit("�")).alias("replaced"),
                    F.regexp_count(t, F.lit(r"[\p{L}\p{Nd}]")).alias("signal"))


def page_is_usable(layer: Column, max_replacement: float = 0.02) -> Column:
    v = layer["visible"]
    return (v >= 80) & (layer["replaced"] / F.greatest(v, F.lit(1)) <= max_replacement) & (
        layer["signal"] / F.greatest(v, F.lit(1)) >= 0.45)


def text_layer_status(chars: Column, usable_ratio: Column, replacement_ratio: Column, max_replacement: float = 0.02,
                      min_usable: float = 0.6, min_chars: int = 3000) -> Column:
    return (F.when((chars < 1000) | (usable_ratio < 0.10), "SCANNED_NEEDS_OCR")
            .when(replacement_ratio > max_replacement, "TEXT_LAYER_GARBLED")
            .when((usable_ratio >= min_usable) & (chars >= min_chars), "TEXT_LAYER_USABLE")
            .otherwise("MIXED_OR_LOW_QUALITY"))


def page_score(text: Column, eligible: Column, method: Column, table: Column, claims: Column) -> Column:
    """Weighted sum of page signals and section roles."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    return (points(has(text, ABSTRACT), 2) + points(has(text, ORGANISM), 4) + points(has(text, ACTIVITY), 3)
            + points(has(text, COMPOUND), 2) + points(eligible, 5) + points(method, 9) + points(table, 9)
            - points(claims & ~eligible & ~table, 3))


def row_ids(text: Column) -> Column:
    """Leading row numbers of table-like lines."""
    ids = F.transform(F.split(text, r"\r?\n"), lambda ln: F.regexp_extract(ln, ROW_ID, 1))
    return F.array_distinct(F.transform(F.filter(ids, lambda i: i != ""), lambda i: i.cast("int")))


def linear_table_score(section: Column, text: Column) -> Column:
    """How much a chunk looks like a table that lost its grid; candidates score 4 or more."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    inc = lambda w: F.contains(low, F.lit(w))
    labels = F.regexp_count(t, F.lit(LABEL_WITH_AMOUNT))
    return (F.when(inc("compound conc"), 5).otherwise(0)
            + F.when(inc("activity is preventive value") | inc("inhibition") | inc("antifungal activities"), 2).otherwise(0)
            + F.when(inc("tlb:") | inc("phytophthora infestans"), 2).otherwise(0)
            + F.when(labels >= 4, F.least(F.lit(4), F.floor(labels / 2).cast("int"))).otherwise(0)
            + F.when(has(F.concat_ws(" ", F.coalesce(section, F.lit("")), t), TABLE_LABEL), 1).otherwise(0))


def is_table_support(section: Column, text: Column) -> Column:
    return contains_any(F.concat_ws(" ", F.coalesce(section, F.lit("")), F.coalesce(text, F.lit(""))), SUPPORT_WORDS)


def subject(source: Column) -> Column:
    """Struct of subject type, component names and targets by the first rule that fits."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"^[的\s]+|[的\s]+$", ""))
    zh, en = has(source, PAIR_ZH), has(source, PAIR_EN)
    pair = lambda p: F.array_distinct(F.array(clean(F.regexp_extract(source, p, 1)), clean(F.regexp_extract(source, p, 2))))
    kind = (F.when(zh | en, "COMBINATION").when(has(source, SERIES), "COMPOUND_SERIES")
            .when(has(source, FORMULATION), "FORMULATION").otherwise("UNKNOWN"))
    none = F.array().cast("array<string>")
    targets = F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(TARGETS), F.lit(0)), lambda x: F.lower(x)))
    return F.struct(kind.alias("type"), F.when(zh, pair(PAIR_ZH)).when(en, pair(PAIR_EN)).otherwise(none).alias("components"),
                    targets.alias("targets"))


def table_kind(line: Column, activity_page: Column) -> Column:
    return (F.when(has(line, TABLE_ACTIVITY) | activity_page, "ACTIVITY").when(has(line, TABLE_FORMULATION), "FORMULATION")
            .when(has(line, TABLE_STRUCTURE), "STRUCTURE").otherwise("UNKNOWN"))


def looks_non_compound(name: Column, structure_type: Column, source_category: Column) -> Column:
    bare = nz(structure_type).isNull() & nz(source_category).isNull()
    return has(name, BIOLOGICAL_NAME) & (contains_any(structure_type, BIOLOGICAL_STRUCTURE) | bare)


def is_inactive(activity: Column | str) -> Column:
    return contains_any(activity, INACTIVE)


def is_application(assay: Column | str) -> Column:
    return contains_any(assay, APPLICATION)
