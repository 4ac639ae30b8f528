"""Null handling, rounding, hashing and token helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIT_SEPARATOR = "\u001f"
WORD = r"[\p{L}\p{N}_]+"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nz(value: Column | str) -> Column:
    """Blank text counts as missing."""
    return F.nullif(F.trim(_c(value)), F.lit(""))


def first_non_blank(*values: Column | str) -> Column:
    return F.coalesce(*[nz(v) for v in values])


def is_blank(value: Column | str) -> Column:
    return nz(value).isNull()


def round_half_up(value: Column | str, digits: int = 4) -> Column:
    scale = float(10**digits)
    return F.floor(_c(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Rounded quotient that is 0 when there is nothing to divide by."""
    return F.when(denominator > 0, round_half_up(numerator / denominator, digits)).otherwise(F.lit(0.0))


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(value), F.lit(low)), F.lit(high))


def tokens(text: Column | str) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def squash_space(text: Column | str) -> Column:
    """Every run of Unicode white space becomes one blank."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def fold_space_ascii(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def fingerprint(scope: list[Column], cells: Column) -> Column:
    """SHA-256 over scope values and cells, joined by the unit separator."""
    return F.sha2(
        F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(s.cast("string"), F.lit("")) for s in scope],
                    F.array_join(cells, UNIT_SEPARATOR, "")),
        256,
    )


def token_estimate(text: Column | str) -> Column:
    """Rough token count: four ASCII characters or one other character per token."""
    t = _c(text)
    wide = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    ascii_chars = F.length(t) - wide
    return F.when(nz(t).isNull(), F.lit(0)).otherwise(
        F.greatest(F.lit(1), (F.ceil(ascii_chars / 4.0) + wide).cast("int"))
    ).cast("int")


def seeded_order(key: Column | str, seed: int) -> Column:
    """Repeatable pseudo-random order key."""
    return F.xxhash64(_c(key).cast("string"), F.lit(seed))


def md5_order(key: Column | str, seed: int) -> Column:
    """Repeatable pseudo-random order key that other engines can compute as well."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), _c(key).cast("string")))
