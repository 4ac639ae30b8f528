"""Entity linking, dictionary matching, mention merging, review and graph tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from litquarry.functions.cells import quote_in, sentences
from litquarry.functions.core import nz, round_half_up, squash_space, tokens
from litquarry.functions.identifiers import key_normalise
from litquarry.scale import cut, small_side

MIN_ALIAS = 2
SHARD_BYTES = 4 << 20  # of aliases in one automaton, which takes some twenty times as much
UNKNOWN_CONFIDENCE = 0.5
MIN_CONFIDENCE = 0.6


# ---- linking and matching ------------------------------------------------------------------------

def link_entities(rows: DataFrame, library: DataFrame, row_id: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Canonical name per primary field and the unknown names as candidates.

    ``fields`` maps a column to its entity type; ``library(entity_type, normalized_key, canonical_name)``.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("entity_type"), F.col(f).alias("mention")) for f, t in fields.items()]))
    long = rows.select(row_id, pairs.alias("x")).select(row_id, "x.*").where(nz("mention").isNotNull()).withColumn("normalized_key", key_normalise("mention"))
    linked = long.join(library.select("entity_type", "normalized_key", "canonical_name"), ["entity_type", "normalized_key"], "left")
    names = linked.groupBy(row_id).agg(*[F.max(F.when(F.col("field") == f, F.coalesce("canonical_name", "mention"))).alias(f) for f in fields])
    unknown = linked.where("canonical_name IS NULL").groupBy("entity_type", "normalized_key").agg(
        F.min("mention").alias("mention"), F.count("*").alias("mentions")).withColumn("confidence", F.lit(UNKNOWN_CONFIDENCE))
    return names, unknown


_automata: dict[str, object] = {}


def _automaton(name: str, aliases: list[str]):
    """Automaton over the aliases of one broadcast, built once in a worker."""
    if name not in _automata:
        import ahocorasick
        found = ahocorasick.Automaton()
        for i, alias in enumerate(aliases):
            found.add_word(alias, i)
        found.make_automaton()
        _automata.clear()
        _automata[name] = found
    return _automata[name]


def _scan(texts: DataFrame, key: list[str], aliases: DataFrame, shard_bytes: int) -> DataFrame:
    """Distinct (key, alias) of the aliases that occur in ``texts(key, _t)``: every text is read once per dictionary shard.

    The dictionary is cut by a hash to shards of about ``shard_bytes``, of which one at a time is brought to the driver and
    broadcast; a common dictionary is one shard.
    """
    spark = texts.sparkSession
    distinct = cut(aliases.select("alias").distinct())
    shards = max(1, -(-(distinct.agg(F.sum(F.octet_length("alias") + 8)).first()[0] or 0) // shard_bytes))
    schema = T.StructType([texts.schema[k] for k in key] + [T.StructField("alias", T.StringType())])
    out_schema = to_arrow_schema(schema)

    def scan(shared):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            named = shared.value
            automaton = _automaton(name, named)
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column(len(key)).to_pylist()):
                    own = {at for _, at in automaton.iter(text)}
                    rows += [i] * len(own)
                    found += [named[at] for at in own]
                at = pa.array(rows, pa.int64())
                columns = [batch.column(k).take(at) for k in range(len(key))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], schema=out_schema)
        return run

    parts = []
    for shard in range(shards):
        own = distinct.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == shard).collect()
        if own:
            shared = spark.sparkContext.broadcast([r["alias"] for r in own])
            parts.append(texts.select(*key, "_t").mapInArrow(scan(shared), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def find_terms(texts: DataFrame, key: list[str], text: str, vocab: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Distinct canonical terms whose alias occurs in the text, as ``key, canonical, category, alias``.

    One automaton of all aliases reads each lower-cased text once. ``vocab(alias, canonical, category)`` with lower-case
    aliases; those below MIN_ALIAS characters take no part, an alias of several terms names all of them.
    """
    low = texts.select(*key, F.lower(F.coalesce(text, F.lit(""))).alias("_t"))
    known = vocab.where(F.length("alias") >= MIN_ALIAS)
    found = _scan(low, key, known, shard_bytes)
    return found.join(small_side(known.select("alias", "canonical", "category").distinct()), "alias").select(*key, "canonical", "category", "alias").distinct()


def find_words(texts: DataFrame, key: list[str], text: str, vocab: DataFrame, longest: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Aliases of at most ``longest`` words that occur as whole words: the automaton reads the text's tokens between single spaces."""
    spaced = texts.select(*key, F.concat(F.lit(" "), F.array_join(F.coalesce(tokens(text), F.array().cast("array<string>")), " "), F.lit(" ")).alias("_t"))
    known = vocab.where(F.size(F.split("alias", " ")) <= longest).select("alias", "canonical", "category").distinct()
    found = _scan(spaced, key, known.select(F.concat(F.lit(" "), "alias", F.lit(" ")).alias("alias")), shard_bytes)
    return found.withColumn("alias", F.expr("substring(alias, 2, length(alias) - 2)")).join(small_side(known), "alias").select(*key, "canonical", "category", "alias").distinct()


def confident(mentions: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    return mentions.where(F.col("confidence") >= minimum)


# ---- merging -------------------------------------------------------------------------------------

def merge_mentions(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One entity per (document, key, type): longest name, best confidence; lists stay rows (kind, value).

    ``mentions(document_id, normalized_key, entity_type, canonical_name, confidence, alias, chunk_id, evidence_text)``.
    """
    key = ["document_id", "normalized_key", "entity_type"]
    name = F.struct(F.length("canonical_name"), F.col("canonical_name"))
    merged = mentions.groupBy(*key).agg(F.max_by("canonical_name", name).alias("canonical_name"), F.max("confidence").alias("confidence"),
                                        F.count("*").alias("mentions"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in
                                (("alias", "alias"), ("chunk", "chunk_id"), ("evidence", "evidence_text"))]))
    lists = mentions.select(*key, pairs.alias("x")).select(*key, "x.*").where(nz("value").isNotNull()).distinct()
    return merged, lists


def merge_relations(relations: DataFrame) -> DataFrame:
    """One relation per (head, type, tail) with best confidence and counts of chunks and quotes."""
    return relations.groupBy("head", "relation_type", "tail").agg(
        F.max("confidence").alias("confidence"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("evidence_text").alias("quotes"))


def merge_document_entities(batches: DataFrame) -> DataFrame:
    """Entities of a document over extraction batches: first non-blank name, best confidence, sorted by type and name.

    ``batches(document_id, batch_no, entity_type, normalized_key, name, confidence)``.
    """
    key = ["document_id", "entity_type", "normalized_key"]
    m = batches.groupBy(*key).agg(F.min_by("name", F.when(nz("name").isNotNull(), F.struct("batch_no", "name"))).alias("name"),
                                  F.max("confidence").alias("confidence"), F.countDistinct("batch_no").alias("batches"))
    w = W.partitionBy("document_id").orderBy("entity_type", "name", "normalized_key")
    return m.withColumn("position", F.row_number().over(w))


def union_aliases(*arrays: Column) -> Column:
    """Ordered distinct union of alias arrays without blanks."""
    return F.array_distinct(F.filter(F.transform(F.concat(*arrays), lambda a: F.trim(a)), lambda a: a != ""))


# ---- review --------------------------------------------------------------------------------------

def entity_candidates(mentions: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates (one per type and key) that the library lacks."""
    c = mentions.groupBy("entity_type", "normalized_key").agg(
        F.max_by("canonical_name", F.struct("confidence", "canonical_name")).alias("canonical_name"), F.max("confidence").alias("confidence"),
        F.countDistinct("document_id").alias("documents"), F.count("*").alias("mentions"))
    return c.join(library.select("entity_type", "normalized_key"), ["entity_type", "normalized_key"], "left_anti")


def review_merge(library: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library after approvals, and its alias rows.

    An approval inserts an entity or adds aliases and raises its count by one per approved candidate;
    a rejection changes nothing. ``library(entity_type, normalized_key, canonical_name, source_count, aliases)``,
    ``reviewed(entity_type, normalized_key, canonical_name, alias, decision)``.
    """
    key = ["entity_type", "normalized_key"]
    ok = reviewed.where("decision = 'APPROVED'")
    new = ok.groupBy(*key).agg(F.min("canonical_name").alias("_name"), F.count("*").alias("_n"))
    merged = library.select(*key, "canonical_name", "source_count").join(new, key, "full").select(
        *key, F.coalesce("canonical_name", "_name").alias("canonical_name"),
        (F.coalesce("source_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("source_count"))
    aliases = library.select(*key, F.explode("aliases").alias("alias")).unionByName(ok.select(*key, "alias")).where(
        nz("alias").isNotNull()).distinct()
    return merged, aliases


def unique_quotes(evidence: DataFrame) -> DataFrame:
    """Evidence rows unique per entity and quote hash; the first document keeps the quote."""
    h = F.sha2(squash_space("quote"), 256)
    return evidence.withColumn("quote_hash", h).groupBy("entity_type", "normalized_key", "quote_hash").agg(F.min("document_id").alias("document_id"))


# ---- graph ---------------------------------------------------------------------------------------

def validate_mentions(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Failing check per mention, null when valid: blank fields, confidence range, quote in chunk, repeated output."""
    c = F.col
    j = mentions.join(chunks.select("document_id", "chunk_id", c("text").alias("_text")), ["document_id", "chunk_id"], "left")
    blank = F.greatest(*[nz(x).isNull() for x in ("canonical_name", "entity_type", "normalized_key", "evidence_text")])
    code = (F.when(c("_text").isNull(), "UNKNOWN_CHUNK").when(blank, "BLANK_FIELD").when(~c("confidence").between(0.0, 1.0), "BAD_CONFIDENCE")
            .when(~quote_in(c("_text"), c("evidence_text")), "QUOTE_NOT_IN_CHUNK"))
    coded = j.withColumn("code", code).drop("_text")
    key = ["document_id", "chunk_id", "normalized_key", "entity_type"]
    quote = F.sha2(squash_space("evidence_text"), 256)
    first = coded.where("code IS NULL").groupBy(*key, quote.alias("_q")).agg(F.min("mention_id").alias("_first"))
    out = coded.withColumn("_q", quote).join(first, [*key, "_q"], "left")
    return out.withColumn("code", F.when(c("code").isNull() & (c("mention_id") != c("_first")), "DUPLICATE").otherwise(c("code"))).drop("_q", "_first")


def validate_relations(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations whose both ends were extracted in their chunk and differ, once per quote."""
    ends = mentions.select("document_id", "chunk_id", "normalized_key").distinct()
    k = ["document_id", "chunk_id"]
    ok = relations.where(F.col("head") != F.col("tail")).join(ends.withColumnRenamed("normalized_key", "head"), [*k, "head"], "left_semi").join(
        ends.withColumnRenamed("normalized_key", "tail"), [*k, "tail"], "left_semi")
    return ok.dropDuplicates([*k, "head", "relation_type", "tail", "evidence_text"])


def graph_tables(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables: papers, passages and entities; passage, mention and typed edges."""
    node_id = F.concat_ws("|", "entity_type", "normalized_key")
    passages = mentions.select("document_id", "chunk_id").distinct()
    nodes = (entities.select(node_id.alias("id"), F.lit("Entity").alias("label"))
             .unionByName(passages.select(F.col("chunk_id").alias("id"), F.lit("Passage").alias("label")))
             .unionByName(passages.select(F.col("document_id").cast("string").alias("id"), F.lit("Paper").alias("label")))).distinct()
    edges = (passages.select(F.col("document_id").cast("string").alias("src"), F.lit("HAS_PASSAGE").alias("type"), F.col("chunk_id").alias("dst"))
             .unionByName(mentions.select(node_id.alias("src"), F.lit("MENTIONED_IN").alias("type"), F.col("chunk_id").alias("dst")))
             .unionByName(relations.select(F.col("head").alias("src"), F.col("relation_type").alias("type"), F.col("tail").alias("dst")))).distinct()
    return nodes, edges


def one_hop(starts: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """Up to ``cap`` distinct neighbours per start node in either direction: ``starts(id)``, ``edges(src, type, dst)``."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "type").unionByName(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "type")).distinct()
    w = W.partitionBy("id").orderBy("neighbour", "type")
    return starts.join(both, "id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def neighbourhood(matches: DataFrame, edges: DataFrame, papers: DataFrame, entity_limit: int, neighbour_cap: int = 4, paper_cap: int = 3):
    """Nodes with degree over distinct edges, the edges, and papers of matched entities, per question.

    ``matches(question_id, id)``, ``papers(id, paper)``; the caps are the size of the view.
    """
    w = W.partitionBy("question_id").orderBy("id")
    kept = matches.select("question_id", "id").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= entity_limit).drop("_n")
    hop = one_hop(kept.select("id").distinct(), edges, neighbour_cap)
    view = kept.join(hop, "id").select("question_id", F.col("id").alias("src"), "type", F.col("neighbour").alias("dst"))
    ends = view.select("question_id", F.explode(F.array("src", "dst")).alias("id"), "src", "type", "dst").distinct()
    degree = ends.groupBy("question_id", "id").agg(F.count("*").alias("degree"))
    nodes = kept.withColumn("matched", F.lit(True)).join(degree, ["question_id", "id"], "full").na.fill(0, ["degree"]).withColumn(
        "matched", F.coalesce("matched", F.lit(False)))
    wp = W.partitionBy("question_id", "id").orderBy("paper")
    cited = kept.join(papers.distinct(), "id").withColumn("_n", F.row_number().over(wp)).where(F.col("_n") <= paper_cap).drop("_n")
    return nodes, view, cited


# ---- dictionary extraction with review -----------------------------------------------------------

def extract_from_sentences(docs: DataFrame, vocab: DataFrame, longest: int) -> DataFrame:
    """Entities per sentence: ``document_id, sentence_no, sentence, canonical, category``."""
    s = docs.select("document_id", F.posexplode(sentences("text")).alias("sentence_no", "sentence"))
    return find_words(s, ["document_id", "sentence_no"], "sentence", vocab, longest)


def sentence_relations(found: DataFrame, rules: list[tuple[str, str, str, float]], cues: DataFrame | None = None) -> DataFrame:
    """Typed relations between different categories inside one sentence; best confidence and first place kept.

    ``rules`` are (head category, relation, tail category, confidence). A sentence holds each dictionary
    term once, so pairs are bounded by the dictionary.
    """
    f = found if cues is None else found.join(cues, ["document_id", "sentence_no"], "left_semi")
    once = f.select("document_id", "sentence_no", "canonical", "category").distinct()
    out = None
    for head, name, tail, conf in rules:
        h = once.where(F.col("category") == head).select("document_id", "sentence_no", F.col("canonical").alias("head"))
        t = once.where(F.col("category") == tail).select("document_id", "sentence_no", F.col("canonical").alias("tail"))
        part = h.join(t, ["document_id", "sentence_no"]).select("document_id", "sentence_no", "head", F.lit(name).alias("relation_type"), "tail", F.lit(conf).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("head", "relation_type", "tail").agg(F.max("confidence").alias("confidence"), F.min(F.struct("document_id", "sentence_no")).alias("_p"),
                                                            F.count("*").alias("sentences")).select(
        "head", "relation_type", "tail", "confidence", "sentences", F.col("_p.document_id").alias("document_id"), F.col("_p.sentence_no").alias("sentence_no"))


def apply_relation_review(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Approved relations whose both ends are in the reviewed library."""
    e = entities.select("canonical").distinct()
    return relations.join(e.withColumnRenamed("canonical", "head"), "head", "left_semi").join(e.withColumnRenamed("canonical", "tail"), "tail", "left_semi")
