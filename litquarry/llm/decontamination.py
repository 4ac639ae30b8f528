"""Benchmark decontamination: a positional inverted index of the documents, searched for windows of benchmark words.

Postings (term, document, position) of every document word that some benchmark item uses are stored in the shared
folder. A window of benchmark words is looked up by intersecting posting lists, each moved back by its word's offset,
from the window's rarest word on. Everything is DataFrame operations; no window, term or document is a special case.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from litquarry.scale import cut, ensure_checkpoint_dir, small_side

WINDOW = 10
REACH = 30  # words around the rarest word of a window that a proximity match may span
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between the words of lower-cased text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = ""  # stands in front of a document's words, so that one without a benchmark word is in the index, too


def tokens(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATOR), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words) and which items hold them (wid, item_id).

    A window is ``size`` consecutive words; an item of fewer words is one window; items without a word or
    without an id have none. A window that many items share is looked up once.
    """
    own = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("_w"))
    own = own.where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    cut_up = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("words")).distinct()
    windows = cut(cut_up.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return windows, cut_up.join(windows, "words").select("wid", "item_id")


def term_numbers(windows: DataFrame) -> DataFrame:
    """(word, term) for every word of the windows, and term 0 for the head of a document."""
    used = windows.select(F.explode("words").alias("word")).distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    return cut(used.union(used.sparkSession.createDataFrame([(_HEAD, 0)], used.schema)))


def build_index(docs: DataFrame, terms: DataFrame, folder: str | None = None) -> DataFrame:
    """Write and read back the postings (term, row, pos) of all words of ``docs`` that ``terms`` names.

    ``row`` numbers the rows of ``docs``, so equal or null ids stay apart; ``pos`` counts from 1. The posting of term 0 at
    position 0 carries a row's doc_id and n_words. Postings are written where the texts are read, in term order within a
    file, so that a lookup of rare terms reads few pages; no text and no posting is shuffled.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/positional-index-{uuid.uuid4().hex}"
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", tokens(F.col("text")).alias("_w"))
    own = own.select("row", "doc_id", F.size("_w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(_HEAD)), "_w")).alias("pos", "word"))
    head = F.col("pos") == 0
    found = own.join(small_side(terms), "word").select(
        "term", "row", F.col("pos").cast("long").alias("pos"), F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n_words")).alias("n_words"))
    found.sortWithinPartitions("term").write.parquet(folder)
    return spark.read.parquet(folder)


def _by_rarity(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(wid, length, places): the words of every window as (postings, term, offset), rarest first.

    Windows with a word that no document holds have no match and are gone.
    """
    frequency = index.where(F.col("term") > 0).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = windows.select("wid", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    known = places.join(small_side(cut(terms.join(frequency, "term"))), "word")
    listed = known.groupBy("wid", "length").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("places"))
    return listed.where(F.size("places") == F.col("length"))


def _lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings of the terms wanted (wid, term, offset) as (wid, row, start): the position less the word's offset."""
    return index.join(small_side(wanted), "term").select("wid", "row", (F.col("pos") - F.col("offset")).alias("start"))


def phrase_matches(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(wid, row, start, length) of every occurrence of every window; occurrences may overlap.

    The lists of the two rarest words are intersected first, which leaves little else than true matches; the remaining
    words are looked up at their places. The join keys hold a place in a document, so no frequent word, passage or
    long document meets in one task.
    """
    by_rarity = cut(_by_rarity(index, windows, terms))
    first = F.col("places")[0]
    # a second word that differs from the first one says more than its repeat
    unlike = F.filter("places", lambda p: p["term"] != F.col("places")[0]["term"])
    by_rarity = by_rarity.withColumn("_1", first).withColumn("_2", F.coalesce(F.get(unlike, F.lit(0)), F.get("places", F.lit(1))))
    postings = index.where(F.col("term") > 0).select("term", "row", "pos")
    rare = _lookup(postings, by_rarity.select("wid", F.col("_1.term").alias("term"), F.col("_1.offset").alias("offset")))
    second = _lookup(postings, by_rarity.where(F.col("_2").isNotNull()).select("wid", F.col("_2.term").alias("term"), F.col("_2.offset").alias("offset")))
    lengths = by_rarity.select("wid", "length", F.filter("places", lambda p: (p["offset"] != F.col("_1.offset")) & (p["offset"] != F.col("_2.offset"))).alias("rest"))
    alone = rare.join(small_side(lengths.where("length = 1")), "wid")
    both = cut(rare.join(second, ["wid", "row", "start"], "left_semi").join(small_side(lengths), "wid"))
    checks = both.where("length > 2").select("wid", "row", "start", "length", F.explode("rest").alias("_p")).select(
        "wid", "row", "start", "length", F.col("_p.term").alias("term"), (F.col("start") + F.col("_p.offset")).alias("pos"))
    there = postings.join(small_side(both.select("row").distinct()), "row", "left_semi")
    whole = checks.join(there, ["row", "pos", "term"]).groupBy("wid", "row", "start", "length").count().where(F.col("count") == F.col("length") - 2)
    kept = ["wid", "row", "start", "length"]
    return alone.select(kept).union(both.where("length = 2").select(kept)).union(whole.select(kept))


def proximity_matches(index: DataFrame, windows: DataFrame, terms: DataFrame, reach: int = REACH) -> DataFrame:
    """(wid, row, pos): places of a window's rarest word around which, at most ``reach`` words off, all its other words lie.

    The order of the words and repeats do not matter, so every phrase match whose window is no longer than ``reach`` is a
    proximity match. Ties for the rarest word go to the smaller term number. The second rarest word thins the places out
    before the others are looked up; lists meet by document, term and stretch of ``reach`` positions.
    """
    by_rarity = cut(_by_rarity(index, windows, terms)).select("wid", F.array_distinct(F.transform("places", lambda p: p["term"])).alias("terms"))
    postings = index.where(F.col("term") > 0).select("term", "row", "pos")
    lists = postings.withColumn("stretch", F.floor(F.col("pos") / reach))
    places = postings.join(small_side(by_rarity.select("wid", F.col("terms")[0].alias("term"))), "term").select("wid", "row", "pos")

    def near(found: DataFrame, others: DataFrame, least: Column) -> DataFrame:
        """Places that have ``least`` of their other terms (wid, others) within reach."""
        asked = found.join(small_side(others), "wid").select("wid", "row", F.col("pos").alias("at"), least.alias("_n"), F.explode("others").alias("term"))
        at = F.floor(F.col("at") / reach)
        asked = asked.withColumn("stretch", F.explode(F.array(at - 1, at, at + 1)))
        rows = small_side(found.select("row").distinct())
        met = asked.join(lists.join(rows, "row", "left_semi"), ["row", "term", "stretch"]).where(F.abs(F.col("pos") - F.col("at")) <= reach)
        return met.select("wid", "row", "at", "term", "_n").distinct().groupBy("wid", "row", "at", "_n").count().where(
            F.col("count") == F.col("_n")).select("wid", "row", F.col("at").alias("pos"))

    several = by_rarity.where(F.size("terms") > 1).select("wid", F.slice("terms", 2, 1).alias("others"))
    rest = by_rarity.where(F.size("terms") > 2).select("wid", F.expr("slice(terms, 3, size(terms))").alias("others"))
    close = cut(near(places, several, F.size("others")))
    done = near(close, rest, F.size("others"))
    one = places.join(small_side(by_rarity.where(F.size("terms") == 1).select("wid")), "wid", "left_semi")
    two = close.join(small_side(by_rarity.where(F.size("terms") == 2).select("wid")), "wid", "left_semi")
    return one.union(two).union(done)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit that lies inside any occurrence of a window; overlapping occurrences count once. Null, empty and wordless
    texts have no words and no hits; null doc_ids and repeated rows stay as they are. Items with a null id take
    no part, rows of one item_id count as one item. An empty benchmark leaves all documents clean. Other columns are not read.
    """
    windows, holders = item_windows(items, size)
    terms = term_numbers(windows)
    index = build_index(docs, terms)
    matches = cut(phrase_matches(index, windows, terms))
    places = matches.select("row", "start", "length").distinct()
    hit = places.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("n_hit"))
    found = matches.select("row", "wid").distinct().join(small_side(holders), "wid").select("row", "item_id").distinct()
    listed = found.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    heads = index.where("term = 0").select("row", "doc_id", "n_words")
    out = heads.join(hit, "row", "left").join(listed, "row", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items_ = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
