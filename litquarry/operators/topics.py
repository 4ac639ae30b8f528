"""Topic statistics, class-based TF-IDF, topic similarity and keyword generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from litquarry.functions.core import ratio, round_half_up, tokens
from litquarry.scale import cut, same_key, small_side, spread
from litquarry.functions.identifiers import clean_keyword, keyword_key
from litquarry.operators.retrieval import _changes, _whole_groups

PHRASE_WORDS = 1 << 18  # words of texts whose phrases are counted at once, or one text
OUT_ROWS = 1 << 16
SAME_ID_TEXTS = 32  # texts of one id that one task may count

# Words that never make a keyword and phrases that come first.
STOPWORDS = [
    "about", "above", "after", "again", "against", "also", "among", "analysis", "and", "another", "any", "are", "article", "because", "been",
    "before", "being", "between", "both", "but", "can", "case", "cells", "could", "data", "did", "different", "does", "during", "each", "effect",
    "effects", "either", "from", "had", "has", "have", "having", "how", "however", "into", "its", "may", "more", "most", "not", "only", "other",
    "our", "paper", "plant", "plants", "present", "results", "show", "showed", "shown", "study", "studies", "such", "than", "that", "the", "their",
    "these", "this", "those", "through", "treatment", "two", "under", "using", "was", "were", "when", "where", "which", "while", "with", "within",
    "without", "would",
]
DOMAIN_PHRASES = [
    "anti-oomycete activity", "antifungal activity", "antimicrobial activity", "biological control", "cell wall", "disease resistance", "downy mildew",
    "essential oil", "fungicidal activity", "late blight", "mode of action", "mycelial growth", "plant extract", "plant pathogen", "plant pathogenic",
    "root rot", "seed treatment", "zoospore germination", "phytophthora", "pythium", "oomycete", "oomycetes", "fungicide", "fungicides", "resistance",
    "elicitor",
]
SPECIES = (r"\b(?:Phytophthora|Pythium|Plasmopara|Saprolegnia|Aphanomyces|Peronospora|Bremia|Albugo|Achlya|Fusarium|Alternaria|Botrytis|Rhizoctonia)"
           r"\s+[a-z][a-z-]{2,}\b")


def topic_sizes(assignments: DataFrame) -> DataFrame:
    """Documents per topic with their share; ``assignments(document_id, topic)``, topic -1 holds outliers."""
    n = assignments.groupBy("topic").agg(F.count("*").alias("documents"))
    total = n.agg(F.sum("documents").alias("_t"))
    return n.join(F.broadcast(total), F.lit(True)).select("topic", "documents", ratio(F.col("documents"), F.col("_t")).alias("share"),
                                                          (F.col("topic") == -1).alias("is_outlier"))  # one row


def ngrams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return words if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def class_tfidf(texts: DataFrame, max_ngram: int = 1, stop: list[str] | None = None) -> DataFrame:
    """``topic, term, tf, weight`` with weight = sqrt(tf / class total) * ln(1 + mean class total / term total).

    ``texts(topic, text)``. Counting combines inside each task first, so a topic of any size shuffles one
    row per term and task.
    """
    words = tokens("text") if not stop else F.filter(tokens("text"), lambda w: ~w.isin(stop))
    base = texts.select("topic", words.alias("_w"))
    grams = F.concat(*[ngrams(F.col("_w"), n) for n in range(1, max_ngram + 1)]) if max_ngram > 1 else F.col("_w")
    # read four times below, so the texts are tokenised once and the counts kept
    tf = cut(base.select("topic", F.explode(grams).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("tf")))
    per_class = tf.groupBy("topic").agg(F.sum("tf").alias("_ct"))
    per_term = tf.groupBy("term").agg(F.sum("tf").alias("_ft"))
    mean = per_class.agg(F.avg("_ct").alias("_a"))
    w = F.sqrt(F.col("tf") / F.col("_ct")) * F.log(1 + F.col("_a") / F.col("_ft"))
    return tf.join(per_class, "topic").join(per_term, "term").join(F.broadcast(mean), F.lit(True)).select("topic", "term", "tf", w.alias("weight"))  # mean is one row


def top_terms(weights: DataFrame, n: int = 10) -> DataFrame:
    w = W.partitionBy("topic").orderBy(F.col("score").desc(), "term")
    return weights.withColumn("score", round_half_up("weight", 6)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select(
        "topic", "term", "score", "position")


def topic_similarity(weights: DataFrame) -> DataFrame:
    """Cosine of every two topics' term weights; a term links the topics that use it, at most topics squared sums."""
    norm = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    l = weights.select(F.col("topic").alias("topic_a"), "term", F.col("weight").alias("_wa"))
    r = weights.select(F.col("topic").alias("topic_b"), "term", F.col("weight").alias("_wb"))
    dots = l.join(r, "term").where(F.col("topic_a") <= F.col("topic_b")).groupBy("topic_a", "topic_b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_d"))
    na, nb = norm.select(F.col("topic").alias("topic_a"), F.col("_n").alias("_na")), norm.select(F.col("topic").alias("topic_b"), F.col("_n").alias("_nb"))
    return dots.join(na, "topic_a").join(nb, "topic_b").select("topic_a", "topic_b", round_half_up(F.col("_d") / (F.col("_na") * F.col("_nb")), 6).alias("similarity"))


def phrase_scores(docs: DataFrame) -> DataFrame:
    """Candidate phrases of one to three words per document with score and order of first use.

    ``docs(document_id, title, text)``. A phrase earns one point per use plus two per word of it that is in the title.
    Texts are moved by document, which is less than their phrases; phrases are moved only of an id with many texts, or null.
    """
    docs = docs.select("document_id", "title", "text")
    many = cut(docs.groupBy("document_id").agg(F.count("*").alias("_n")).where((F.col("_n") > SAME_ID_TEXTS) | F.col("document_id").isNull()).select("document_id"))
    if many.isEmpty():
        return _phrase_sums(spread(docs, "document_id"))
    many = small_side(many)
    few = docs.join(many, same_key(docs, many, ["document_id"]), "left_anti")
    return _phrase_sums(spread(few, "document_id")).unionByName(_phrase_sums(docs.join(many, same_key(docs, many, ["document_id"]), "left_semi").withColumn("_apart", F.lit(True))))


def _phrase_sums(docs: DataFrame) -> DataFrame:
    """``phrase_scores`` of texts, all those of an id in one task; with a column ``_apart`` they are in many."""
    together = "_apart" not in docs.columns
    raw = F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z-]{2,}"), F.lit(0)), lambda w: F.btrim(F.lower(w), F.lit("-")))
    words = F.filter(raw, lambda w: ~w.isin(STOPWORDS) & (F.length(w) >= 4))
    title = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"[a-z][a-z-]{2,}"), F.lit(0)))
    ordered = docs.sortWithinPartitions("document_id") if together else docs
    texts = ordered.select("document_id", words.alias("_w"), title.alias("_t"))
    grams = texts.mapInArrow(_count_together if together else _count_apart, T.StructType([texts.schema["document_id"], T.StructField("n", T.IntegerType()), T.StructField("phrase", T.StringType()),
                                                            T.StructField("score", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("title_words", T.IntegerType())]))
    if together:
        return grams
    return grams.groupBy("document_id", "n", "phrase").agg(F.sum("score").alias("score"), F.min("first").alias("first"), F.max("title_words").alias("title_words"))


def _count_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_count_phrases`` of rows in order of their id, each id counted once."""
    for table in _whole_groups(batches):
        batch = table.combine_chunks().to_batches()[0]
        yield from _count_phrases(batch, np.flatnonzero(_changes(batch.columns[:1])))


def _count_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _count_phrases(batch, np.arange(batch.num_rows))


def _count_phrases(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``document_id, n, phrase, score, first, title_words`` of ``document_id, words, title words``, whose documents begin at ``starts``.

    Words are numbered in a piece of a batch, so a phrase is a number as well and is written out once for each document.
    """
    if batch.num_rows:
        document = np.cumsum(np.isin(np.arange(batch.num_rows), starts)) - 1
        at = 0
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PHRASE_WORDS, "right")))
            to = int(np.append(starts, batch.num_rows)[np.searchsorted(starts, to)])
            piece, doc_of, alone = batch.slice(at, to - at), document[at:to], len(np.unique(document[at:to])) == to - at
            of, lists = sizes[at:to], piece.column(1)
            at = to
            if not of.sum():
                continue
            words = lists.flatten().dictionary_encode()
            code, known = words.indices.to_numpy().astype("int64"), len(words.dictionary)
            text = np.repeat(np.arange(piece.num_rows), of)
            pos = np.arange(len(code)) - np.repeat(np.cumsum(of) - of, of)
            titles = piece.column(2)
            named = pc.fill_null(pc.index_in(titles.flatten(), value_set=words.dictionary), -1).to_numpy()
            owner = np.repeat(np.arange(piece.num_rows), pc.fill_null(pc.list_value_length(titles), 0).to_numpy())
            in_title = np.isin(text * known + code, (owner * known + named)[named >= 0]).astype("int32")
            phrase, hits, written = code, in_title, words.dictionary
            for n in (1, 2, 3):
                if n > 1:  # a phrase goes on with the word behind it in its text
                    here = np.flatnonzero(pos[:len(pos) - n + 1] + n <= of[text[:len(pos) - n + 1]])
                    both = phrase[here] * known + code[here + n - 1]
                    held, number = np.unique(both, return_inverse=True)
                    written = pc.binary_join_element_wise(written.take(pa.array(held // known)), words.dictionary.take(pa.array(held % known)), " ")
                    phrase, hits = np.full(len(code), -1), hits.copy()
                    phrase[here] = number
                    hits[here] += in_title[here + n - 1]
                else:
                    here = np.arange(len(code))
                if not len(here):
                    break
                key, first, uses = np.unique(text[here] * len(written) + phrase[here], return_index=True, return_counts=True)
                named_words, first = hits[here[first]].astype("int64"), pos[here[first]]
                score = uses * (1 + 2 * named_words)
                if not alone:
                    key = (doc_of[key // len(written)] - doc_of[0]) * len(written) + key % len(written)
                    order = np.argsort(key, kind="stable")
                    key, begin = np.unique(key[order], return_index=True)
                    score, first, named_words = (f.reduceat(x[order], begin) for f, x in ((np.add, score), (np.minimum, first), (np.maximum, named_words)))
                    key = np.searchsorted(doc_of, key // len(written) + doc_of[0]) * len(written) + key % len(written)  # by the first text again
                length = pc.utf8_length(written).to_numpy()[key % len(written)]
                ok = np.flatnonzero((length >= 4) & (length <= 60))
                for lo in range(0, len(ok), OUT_ROWS):
                    part = ok[lo:lo + OUT_ROWS]
                    own = pa.array(key[part] // len(written))
                    yield pa.RecordBatch.from_arrays([
                        piece.column(0).take(own), pa.array(np.full(len(part), n, "int32")), written.take(pa.array(key[part] % len(written))),
                        pa.array(score[part]), pa.array(first[part].astype("int32")), pa.array(named_words[part].astype("int32"))],
                        names=["document_id", "n", "phrase", "score", "first", "title_words"])


def generated_keywords(docs: DataFrame, shortlist: int = 30, limit: int = 8) -> DataFrame:
    """Keywords per document: domain phrases, species names, then the best phrases, without repeats."""
    low = F.lower("text")
    phrases = docs.select("document_id", F.posexplode(F.filter(F.array(*[F.lit(p) for p in DOMAIN_PHRASES]), lambda p: F.contains(low, p))).alias("o", "keyword")).withColumn("src", F.lit(0))
    species = docs.select("document_id", F.posexplode(F.regexp_extract_all("text", F.lit(SPECIES), F.lit(0))).alias("o", "keyword")).withColumn("src", F.lit(1))
    w = W.partitionBy("document_id").orderBy(F.col("score").desc(), "n", "first")
    best = phrase_scores(docs).withColumn("o", F.row_number().over(w)).where(F.col("o") <= shortlist).where(
        "n > 1 OR score >= 3 OR title_words > 0").select("document_id", "o", F.col("phrase").alias("keyword"), F.lit(2).alias("src"))
    every = phrases.unionByName(species).unionByName(best).withColumn("keyword", clean_keyword("keyword")).where("keyword IS NOT NULL").withColumn("_k", keyword_key(F.col("keyword"))).where("_k <> ''")
    once = every.groupBy("document_id", "_k").agg(F.min(F.struct("src", "o", "keyword")).alias("b")).select("document_id", "b.*")
    order = W.partitionBy("document_id").orderBy("src", "o", "keyword")
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("document_id", "position", "keyword")
