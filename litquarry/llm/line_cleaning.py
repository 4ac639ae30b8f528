"""Line-first cleaning: rules judge every line, failing lines go, documents that lose too much text are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from litquarry.llm.common import WHITE, bind, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 30  # of the words, when failing lines go
SYMBOLS = r"[#*$%&|<>]"
# A line fails that is long and holds no sentence end, or whose words mostly carry runs of symbols.
LONG_LINE = 25  # words
SENTENCE_END = r"[.!?…]"
NOISY = r"(?:[#*$%&<>=~^]{2,}|[!?]{2,})"
# Menus: several short items between bars or arrows.
NAVIGATION = r"[|»›•] [^|»›•]{0,80} [|»›•] "
BOILERPLATE = (r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|"
               r"click here|sign up|log in|subscribe to our|newsletter|follow us on|share this|read more|lorem ipsum)\b")


def failing_line(line: Column) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rule removes."""
    gaps = F.regexp_count(line, F.lit(WHITE))
    noisy = F.regexp_count(line, F.lit(NOISY)) * 5 > gaps
    unfinished = (gaps >= LONG_LINE) & ~line.rlike(SENTENCE_END)
    return noisy | line.rlike(NAVIGATION) | (line.rlike(BOILERPLATE) & (F.length(line) <= 300)) | unfinished


def repeated_words(w: Column) -> Column:
    """Words that lie in a WINDOW of words found twice or more in the text, first place included.

    Windows are compared by 64-bit hashes. Equal ones meet by sorting (hash, place), so a text that repeats
    one phrase all through costs no more than any other.
    """
    def by_hash(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            bind(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), by_place))

    def by_place(s: Column) -> Column:
        near = lambda i, d: F.get(s, i + d)["h"]
        again = F.filter(F.transform(s, lambda x, i: F.when(
            F.coalesce(near(i, F.lit(1)) == x["h"], F.lit(False)) | F.coalesce(F.when(i > 0, near(i, F.lit(-1)) == x["h"]), F.lit(False)), x["i"])), lambda x: x.isNotNull())
        return bind(F.array_sort(again), covered)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    def doubled(d: int):
        """From hashes of runs of d words to hashes of runs of 2 d words."""
        return lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - d, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + d)))

    windows = F.transform(w, lambda x: F.xxhash64(x))
    for d in (1, 2, 4):
        windows = bind(windows, doubled(d))
    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(bind(windows, by_hash)).cast("long")


def clean_lines(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, kept, n_lost_words and the ``cleaned`` text.

    ``kept`` is false where the base rules fail or where the lines that go hold over MAX_LOST_PERCENT of the words.
    A null text is empty: no words, so it fails. Repeated rows give repeated results; other columns are not read.
    Everything happens inside the row, so no row waits for another and a hot source changes nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("_t")).select("doc_id", "_t", words(F.col("_t")).alias("_w"))
    own = own.select("doc_id", "_t", "_w", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    own = own.select("*", F.filter("_l", lambda line: ~failing_line(line)).alias("_k"))
    own = own.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"), F.array_join("_k", "\n").alias("cleaned"))
    own = own.withColumn("n_lost_words", F.col("n_words") - F.size(words(F.col("cleaned"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    own = own.withColumn("base_failed", failed)
    return own.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MAX_LOST_PERCENT * F.col("n_words")))
