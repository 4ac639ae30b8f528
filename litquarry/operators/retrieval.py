"""Inverted index, BM25, all-terms text match and dense nearest neighbours."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from litquarry.functions.core import round_half_up, tokens
from litquarry.scale import block_count, cut, is_small, small_side, spread

K1 = 1.2
B = 0.75
QUERY_BROADCAST_ROWS = 4_096
BLOCK_ROWS = 8_192
SCORE_CELLS = 2 << 20  # scores of documents by queries held at once
READ_ROWS = 1 << 17
OUT_ROWS = 1 << 16
DENSE_GAIN = 100  # products of a matrix product in the time of one added singly
TERM_SHARDS = 64
SHARD_OF = "term_shard_of_"
POSTING = ("doc_id", "field", "dl", "term", "tf")


@dataclass
class InvertedIndex:
    """``postings(doc_id, field, term, tf, dl)``, as planned from the texts or, with ``shards``, as stored by term.

    A stored index has a column of the term's shard, by which its files are laid out and whose name tells the number
    of shards, so that a search reads the files of its terms' shards and never the texts again. ``words(doc_id, field, dl, t)``
    are the tokens, spread by document, of which an index is planned; ``lists`` are kept ones, counted (see ``materialised``).
    """

    postings: DataFrame
    shards: int = 0
    words: DataFrame | None = None
    lists: DataFrame | None = None

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """Postings of ``terms(term)``, from their shards only where the index is stored."""
        found = self.postings
        if self.shards:
            named = [r[0] for r in terms.select(shard_of("term", self.shards)).distinct().collect()]  # at most ``shards`` numbers
            shard = f"{SHARD_OF}{self.shards}"
            found = found.where(F.col(shard).isin(named)).drop(shard)
        return found.join(small_side(terms), "term", "left_semi")

    def field_stats(self) -> DataFrame:
        """Documents and mean length per field."""
        per_doc = self.postings.select("doc_id", "field", "dl").distinct()
        return per_doc.groupBy("field").agg(
            F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl")
        )

    def document_frequency(self, terms: DataFrame | None = None) -> DataFrame:
        p = self.postings if terms is None else self.of_terms(terms)
        return p.groupBy("field", "term").agg(F.count("*").alias("df"))


def shard_of(term: Column | str, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def build_index(docs: DataFrame, doc_id: str, fields: dict[str, Column]) -> InvertedIndex:
    """Tokenise each field and count terms; one shuffle, by document."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(f) for f, c in fields.items()])
    rows = spread(narrow, "doc_id").select(
        "doc_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])).alias("x"),
    )
    words = rows.select("doc_id", F.col("x.field").alias("field"), F.size("x.t").cast("long").alias("dl"), F.col("x.t").alias("t"))
    exploded = words.select("doc_id", "field", "dl", F.explode("t").alias("term"))
    return InvertedIndex(exploded.groupBy("doc_id", "field", "dl", "term").agg(F.count("*").alias("tf")), words=words)


def write_index(index: InvertedIndex, path: str, shards: int = TERM_SHARDS) -> None:
    """Store postings by shard of the term in a folder that must not exist yet, so a read of it is never overwritten.

    Adaptive execution divides a shard that a very frequent term fills, and merges small ones.
    """
    shard = f"{SHARD_OF}{shards}"
    (index.postings.select(*POSTING).withColumn(shard, shard_of("term", shards)).hint("rebalance", shard)
     .write.mode("errorifexists").partitionBy(shard).parquet(path))


def read_index(spark: SparkSession, path: str, postings: T.StructType | None = None, shards: int = TERM_SHARDS) -> InvertedIndex:
    """A stored index; with the type of its ``postings`` also one of no posting can be read."""
    reader = spark.read
    if postings is not None:
        reader = reader.schema(T.StructType([*postings, T.StructField(f"{SHARD_OF}{shards}", T.IntegerType())]))
    stored_rows = reader.parquet(path)
    return InvertedIndex(stored_rows, int(stored_rows.columns[-1].removeprefix(SHARD_OF)))


def materialised(index: InvertedIndex) -> InvertedIndex:
    """The index kept by document on the executors' disks: one pass over the texts, however often one query reads it.

    For a search with many queries this beats shards of terms, as the contributions to a document need not be moved: the
    kept postings still lie by document, which a checkpoint would forget. What a lost executor kept is computed
    anew from the texts. The last KEPT indexes stay; an older one would be computed anew.

    An index planned from texts is kept as ``lists(doc_id, field, dl, terms, tfs)``, a row for each document, field and length:
    its terms, parted by blanks, and their counts. Rows of a document are neighbours in one task's output.
    """
    kept = (index.postings.select(*POSTING) if index.words is None else _term_lists(index.words)).persist(StorageLevel.DISK_ONLY)
    _kept.append(kept)
    if len(_kept) > KEPT:
        _kept.pop(0).unpersist()
    if index.words is None:
        return InvertedIndex(kept)
    held = F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf")))
    return InvertedIndex(kept.select("doc_id", "field", "dl", held.alias("p")).select(
        "doc_id", "field", "dl", F.col("p.term").alias("term"), F.col("p.tf").cast("long").alias("tf")), lists=kept)


def _term_lists(words: DataFrame) -> DataFrame:
    """Tokens counted by document, field and length; ``words`` are spread by document."""
    rows = words.where("dl > 0").select("doc_id", "field", "dl", F.array_join("t", " ").alias("t")).sortWithinPartitions("doc_id", "field", "dl")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("terms", T.StringType()), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which the next batch may go on with
        for batch in batches:
            if batch.num_rows:
                table = _counted(batch)
                if held is not None:
                    same = held.select([0, 1, 2]).equals(table.slice(0, 1).select([0, 1, 2]))
                    table = pa.concat_tables([_added(held, table.slice(0, 1)), table.slice(1)] if same else [held, table])
                held = table.slice(table.num_rows - 1)
                yield from table.slice(0, table.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(count, schema)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """True for rows that differ from the row before in a column; the first row does."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            other = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
            new[1:] |= other.to_numpy(zero_copy_only=False)
    return new


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Sorted rows ``doc_id, field, dl, t`` with each key once, its terms and their counts."""
    new = _changes(batch.columns[:3])
    lists = pc.split_pattern(batch.column(3), " ")
    words = lists.flatten().dictionary_encode()
    n, known = int(new.sum()), len(words.dictionary)
    key = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy()) * known + words.indices.to_numpy()
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key)))
    group, term = np.divmod(key[first], known)
    starts = pa.array(np.searchsorted(group, np.arange(n + 1)), pa.int32())
    terms = pc.binary_join(pa.ListArray.from_arrays(starts, words.dictionary.take(pa.array(term))), " ")
    at = pa.array(np.flatnonzero(new))
    return pa.Table.from_arrays([*[c.take(at) for c in batch.columns[:3]], terms, pa.ListArray.from_arrays(starts, pa.array(tf, pa.int32()))],
                                names=["doc_id", "field", "dl", "terms", "tfs"])


def _added(a: pa.Table, b: pa.Table) -> pa.Table:
    """Two rows of one key as one."""
    sums = Counter()
    for t in (a, b):
        sums.update(dict(zip(t.column(3)[0].as_py().split(" "), t.column(4)[0].as_py())))
    last = [pa.array([" ".join(sums)], a.schema.field(3).type), pa.array([list(sums.values())], a.schema.field(4).type)]
    return pa.Table.from_arrays([*a.columns[:3], *last], schema=a.schema)


KEPT = 4
_kept: list[DataFrame] = []


def query_terms(queries: DataFrame, query_id: list[str], text: str = "query") -> DataFrame:
    """Terms per query with their multiplicity."""
    return (
        queries.select(*query_id, F.explode(tokens(text)).alias("term"))
        .groupBy(*query_id, "term").agg(F.count("*").alias("qtf"))
    )


def top_k(scored: DataFrame, query_id: list[str], key: str, k: int, score: str = "score") -> DataFrame:
    """Best k rows per query; the row-number filter becomes a per-task group limit."""
    w = W.partitionBy(*query_id).orderBy(F.col(score).desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(index: InvertedIndex, queries: DataFrame, query_id: list[str], k: int,
         boosts: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """Boosted multi-field BM25 with exact document lengths: ``query_id, doc_id, score, rank``."""
    terms = query_terms(queries, query_id)
    few = _few_queries(terms, query_id)
    if few and index.lists is not None:
        known = sorted({t for _, held in few for t, _ in held})
        stats = _frequencies(index.lists, known)
        weights = {}
        for field, (n, total, df) in stats.items():
            w = np.log(1 + (n - df + 0.5) / (df + 0.5)) * boosts[field] if field in boosts else np.zeros(len(known))
            weights[field] = w, total / n

        def adds(field: str, no: np.ndarray, dl: np.ndarray, tf: np.ndarray) -> np.ndarray:
            w, avgdl = weights[field]
            return w[no] * (tf / (tf + k1 * (1 - b + b * dl / avgdl)))

        return top_k(_best_in_lists(index.lists, known, adds, few, terms, query_id, k, False), query_id, "doc_id", k)
    postings = index.of_terms(terms.select("term").distinct())
    boost = F.create_map(*[F.lit(v) for f, w in boosts.items() for v in (f, float(w))])
    weights = cut(
        postings.groupBy("field", "term").agg(F.count("*").alias("df"))
        .join(F.broadcast(index.field_stats()), "field")  # one row per field
        .select("field", "term", "avgdl",
                (F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
                 * F.element_at(boost, F.col("field"))).alias("w"))
    )
    saturation = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    matched = postings.join(small_side(weights), ["field", "term"]).select("doc_id", "term", (F.col("w") * saturation).alias("x"))
    if few:
        return top_k(_best_documents(matched, few, terms, query_id, k, False), query_id, "doc_id", k)
    scored = matched.join(small_side(terms), "term").groupBy(*query_id, "doc_id").agg(
        round_half_up(F.sum(F.col("qtf") * F.col("x")), 6).alias("score")
    )
    return top_k(scored, query_id, "doc_id", k)


def text_match(index: InvertedIndex, queries: DataFrame, query_id: list[str], k: int) -> DataFrame:
    """Documents that hold every query term in any field, ranked by damped term frequency."""
    terms = query_terms(queries, query_id)
    few = _few_queries(terms.withColumn("qtf", F.lit(1).cast("long")), query_id)
    if few and index.lists is not None:
        known = sorted({t for _, held in few for t, _ in held})
        return top_k(_best_in_lists(index.lists, known, None, few, terms, query_id, k, True), query_id, "doc_id", k)
    by_doc = index.of_terms(terms.select("term").distinct()).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    damped = by_doc.select("doc_id", "term", F.log1p("tf").alias("x"))
    if few:
        return top_k(_best_documents(damped, few, terms, query_id, k, True), query_id, "doc_id", k)
    wanted = terms.groupBy(*query_id).agg(F.count("*").alias("n_terms"))
    scored = (
        damped.join(small_side(terms.drop("qtf")), "term")
        .groupBy(*query_id, "doc_id")
        .agg(F.count("*").alias("n"), round_half_up(F.sum("x"), 6).alias("score"))
        .join(small_side(wanted), query_id)
        .where(F.col("n") == F.col("n_terms"))
        .select(*query_id, "doc_id", "score")
    )
    return top_k(scored, query_id, "doc_id", k)


def _few_queries(terms: DataFrame, query_id: list[str]) -> list[tuple[tuple, list[tuple[str, int]]]]:
    """Terms of each query if they can go to every task, else nothing."""
    few = _query_rows(terms, query_id) if is_small(terms) else []
    return few if len(few) <= QUERY_BROADCAST_ROWS else []


def _query_rows(terms: DataFrame, query_id: list[str]) -> list[tuple[tuple, list[tuple[str, int]]]]:
    """Terms of each of a few queries, on the driver: ``terms`` is known to be small."""
    found: dict[tuple, list[tuple[str, int]]] = {}
    for r in terms.select(*query_id, "term", "qtf").collect():
        found.setdefault(tuple(r[:-2]), []).append((r[-2], r[-1]))
    return list(found.items())


def _best_documents(matches: DataFrame, queries: list, terms: DataFrame, query_id: list[str], k: int, every: bool) -> DataFrame:
    """Best ``k`` documents of each task for every query: ``query_id, doc_id, score``; the best of all are among them.

    ``matches(doc_id, term, x)``: what a term of a document adds to the score of a query that holds it. With ``every`` only
    documents that hold all terms of a query count. Queries are few and go to the tasks, which read documents in order of
    their id and score blocks of them against all queries; pairs of query and document never become rows.
    """
    known = sorted({t for _, held in queries for t, _ in held})
    numbers = matches.sparkSession.createDataFrame([(t, i) for i, t in enumerate(known)], "term string, no int")
    rows = spread(matches.join(F.broadcast(numbers), "term").select("doc_id", "no", F.coalesce("x", F.lit(0.0)).alias("x")), "doc_id").sortWithinPartitions("doc_id")
    return _best_of_rows(rows, _whole_documents, known, queries, terms, query_id, k, every)


def _best_in_lists(lists: DataFrame, known: list[str], adds: Callable | None, queries: list, terms: DataFrame, query_id: list[str], k: int, every: bool) -> DataFrame:
    """``_best_documents`` over kept term lists, in which rows of a document are neighbours: nothing is moved before the best rows.

    ``adds(field, no, dl, tf)``: what terms, by their place in ``known``, add to a score; without it the damped sum over all fields.
    """
    shared = lists.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        wanted = pa.array(shared.value, pa.string())
        for table in _whole_groups(batches):
            batch = table.combine_chunks().to_batches()[0]
            new = _changes(batch.columns[:1])
            row, no, tf = _known_terms(batch, wanted)
            doc = (np.cumsum(new) - 1)[row]
            if adds is None:
                both, inverse = np.unique(doc * len(wanted) + no, return_inverse=True)
                doc, no = np.divmod(both, len(wanted))
                x = np.log1p(np.bincount(inverse, tf, len(both)))
            else:
                x, dl, fields = np.zeros(len(no)), batch.column(2).to_numpy()[row], batch.column(1).dictionary_encode()
                of = fields.indices.to_numpy()[row]
                for i, field in enumerate(fields.dictionary.to_pylist()):
                    here = of == i
                    x[here] = adds(field, no[here], dl[here], tf[here])
            yield batch.column(0).take(pa.array(np.flatnonzero(new))), np.searchsorted(doc, np.arange(int(new.sum()) + 1)), no, x

    return _best_of_rows(lists.select("doc_id", "field", "dl", "terms", "tfs"), read, known, queries, terms, query_id, k, every)


def _known_terms(batch: pa.RecordBatch, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in ``wanted`` and count of every wanted term of lists."""
    lists = pc.split_pattern(batch.column(3), " ")
    no = pc.fill_null(pc.index_in(lists.flatten(), value_set=wanted), -1).to_numpy()
    here = np.flatnonzero(no >= 0)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())[here]
    return row, no[here].astype("int64"), batch.column(4).flatten().to_numpy()[here].astype("float64")


def _frequencies(lists: DataFrame, known: list[str]) -> dict[str, tuple[int, int, np.ndarray]]:
    """Of each field the documents, the sum of their lengths and the documents that hold each known term: as many numbers as terms."""
    shared = lists.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.string())
        sums: dict[str, np.ndarray] = {}  # documents of each term, then documents and their length
        for batch in batches:
            if batch.num_rows:
                fields = batch.column(1).dictionary_encode()
                of, dl = fields.indices.to_numpy(), batch.column(2).to_numpy()
                row, no, _ = _known_terms(batch, wanted)
                for i, field in enumerate(fields.dictionary.to_pylist()):
                    here = of == i
                    found = np.concatenate([np.bincount(no[here[row]], minlength=len(wanted)), [here.sum(), dl[here].sum()]])
                    sums[field] = sums.get(field, 0) + found
        for field, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["field", "no", "n"])

    found: dict[str, np.ndarray] = {}
    counts = lists.select("doc_id", "field", "dl", "terms", "tfs").mapInArrow(count, "field string, no long, n long")
    for field, no, n in counts.groupBy("field", "no").agg(F.sum("n").alias("n")).collect():
        found.setdefault(field, np.zeros(len(known) + 2, "int64"))[no] = n
    return {field: (int(n[-2]), int(n[-1]), n[:-2]) for field, n in found.items()}


def _best_of_rows(rows: DataFrame, read: Callable, known: list[str], queries: list, terms: DataFrame, query_id: list[str], k: int, every: bool) -> DataFrame:
    """Best documents of each task, of the blocks of documents that ``read`` makes of its rows."""
    spark = rows.sparkSession
    number = {t: i for i, t in enumerate(known)}
    entries = sorted((number[t], q, n) for q, (_, held) in enumerate(queries) for t, n in held)  # by term
    held = np.array([e[0] for e in entries], "int64")
    starts = np.searchsorted(held, np.arange(len(number) + 1))
    shared = spark.sparkContext.broadcast((starts, np.array([e[1] for e in entries], "int64"), np.array([e[2] for e in entries], "float64")))
    ids, n_queries = [q for q, _ in queries], len(queries)
    schema = T.StructType([*[terms.schema[c] for c in query_id], rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in schema]
    names = schema.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n_queries, k, types[-2])
        docs_at_once = max(1, SCORE_CELLS // n_queries)
        for docs, first, term, x in read(batches):
            for at in range(0, len(docs), docs_at_once):
                n = min(docs_at_once, len(docs) - at)
                lo, hi = first[at], first[at + n]
                row = np.repeat(np.arange(n), np.diff(first[at:at + n + 1]))
                block = (row, term[lo:hi], n, n_queries, *shared.value)
                scores = _products(x[lo:hi], *block)
                if every:
                    wanted = np.bincount(shared.value[1], minlength=n_queries)
                    hit = _products(None, *block) == wanted
                elif (x[lo:hi] > 0).all():
                    hit = scores > 0
                else:
                    hit = _products(None, *block) > 0
                best.offer(scores, hit, docs.slice(at, n))
        for at in range(0, len(best.query), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            found = [ids[q] for q in best.query[part].tolist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([i[c] for i in found], types[c]) for c in range(len(types) - 2)],
                                              best.docs.slice(at, OUT_ROWS), pa.array(best.score[part])], names=names)

    return rows.mapInArrow(search, schema)


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows ``doc_id, no, x`` as documents with the place of their first row, where no document is cut in two."""
    def cut_up(table, last):
        runs = pc.run_end_encode(table.column(0).combine_chunks())
        first = np.concatenate([[0], np.asarray(runs.run_ends)]).astype("int64")
        n = len(first) - 1 if last else len(first) - 2
        whole = table.slice(0, int(first[n]))
        found = runs.values.slice(0, n), first[:n + 1], whole.column(1).to_numpy().astype("int64"), whole.column(2).to_numpy()
        return found, table.slice(int(first[n]))

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows >= READ_ROWS:
            found, rest = cut_up(pa.concat_tables(held), False)
            yield found
            held, rows = [rest], 0  # a document of more rows is read on
    if held:
        yield cut_up(pa.concat_tables(held), True)[0]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut anew so that neighbouring rows of one first column stay together."""
    held: list[pa.Table] = []  # rows of one document
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            starts = np.flatnonzero(_changes(batch.columns[:1]))
            goes_on = bool(held) and held[0].column(0)[0] == table.column(0)[0]
            last = int(starts[-1])
            if goes_on and not last:
                held.append(table)
                continue
            if held or last:
                yield pa.concat_tables([*held, table.slice(0, last)])
            held = [table.slice(last)]
    if held:
        yield pa.concat_tables(held)


def _products(x: np.ndarray | None, row: np.ndarray, term: np.ndarray, n: int, n_queries: int, starts: np.ndarray, query: np.ndarray,
              qtf: np.ndarray) -> np.ndarray:
    """Sums over shared terms by document and query: of ``x`` times the term's count in the query; without ``x`` the number of terms."""
    out = np.zeros(n * n_queries)
    if x is None:
        row, term = np.divmod(np.unique(row * len(starts) + term), len(starts))  # a term in several fields is one
        x, qtf = np.ones(len(row)), np.ones(len(qtf))
    queries_of = starts[term + 1] - starts[term]
    n_used = np.count_nonzero(np.bincount(term))
    if queries_of.sum() * DENSE_GAIN < n * n_queries * n_used:
        ends = np.cumsum(queries_of)
        at = 0
        while at < len(term):  # about SCORE_CELLS products at once
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - queries_of[at] + SCORE_CELLS, "right")))
            times = queries_of[at:to]
            place = np.arange(times.sum()) + np.repeat(starts[term[at:to]] - (np.cumsum(times) - times), times)
            cell = np.repeat(row[at:to] * n_queries, times) + query[place]
            out += np.bincount(cell, np.repeat(x[at:to], times) * qtf[place], n * n_queries)
            at = to
        return out.reshape(n, n_queries)
    out = out.reshape(n, n_queries)
    used, col = np.unique(term, return_inverse=True)
    step = max(1, SCORE_CELLS // max(n, n_queries))
    for at in range(0, len(used), step):
        part = used[at:at + step]
        here = (col >= at) & (col < at + len(part))
        left = np.bincount(row[here] * len(part) + col[here] - at, x[here], n * len(part)).reshape(n, len(part))
        right = np.zeros((len(part), n_queries))
        for i, t in enumerate(part):
            right[i, query[starts[t]:starts[t + 1]]] = qtf[starts[t]:starts[t + 1]]
        out += left @ right
    return out


class _Best:
    """Best ``k`` documents of every query so far; documents come in the order that decides ties."""

    def __init__(self, n_queries: int, k: int, doc_type: pa.DataType):
        self.k, self.seen = k, 0
        self.query, self.score, self.place = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
        self.docs = pa.array([], doc_type)
        self.floor = np.full(n_queries, -np.inf)  # the k-th score, once there are k

    def offer(self, scores: np.ndarray, hit: np.ndarray, docs: pa.Array) -> None:
        row, query = np.nonzero(hit & (scores > self.floor - 1e-6))
        score = np.floor(scores[row, query] * 1e6 + 0.5) / 1e6
        better = score > self.floor[query]
        row, query, score = row[better], query[better], score[better]
        if len(row):
            query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
            place = np.concatenate([self.place, self.seen + row])
            order = np.lexsort((place, -score, query))
            first = np.searchsorted(query[order], query[order])
            order = order[np.arange(len(order)) - first < self.k]
            self.docs = pa.concat_arrays([self.docs, docs.take(pa.array(row))]).take(pa.array(order))
            self.query, self.score, self.place = query[order], score[order], place[order]
            count = np.bincount(self.query, minlength=len(self.floor))
            full = count >= self.k
            self.floor[full] = self.score[np.cumsum(count)[full] - 1]
        self.seen += len(docs)


# ---- dense vectors -------------------------------------------------------------------------------

def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """Bag-of-words vector over hashed tokens; stands in for a model in tests."""
    bucket = F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim)
    # the buckets are bound to a variable, else every place of the vector would hash all tokens anew
    counts = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))
    return F.element_at(F.transform(F.array(bucket), counts), 1)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score desc, id asc)."""
    n = len(scores)
    if n > k:
        floor = np.partition(scores, n - k)[n - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(n)
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _local_top(qids: list, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, min_score: float,
               exclude_self: bool):
    scores = np.floor(((q @ m.T) + 1.0) / 2.0 * 1e6 + 0.5) / 1e6
    out_q, out_i, out_s = [], [], []
    for row, qid in enumerate(qids):
        ok = scores[row] >= min_score
        if exclude_self:
            ok &= ids != qid
        pos = np.flatnonzero(ok)
        best = pos[_best(scores[row][pos], ids[pos], k)]
        out_q.extend([qid] * len(best))
        out_i.extend(ids[best].tolist())
        out_s.extend(scores[row][best].tolist())
    return out_q, out_i, out_s


def knn(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0,
        exclude_self: bool = False) -> DataFrame:
    """Exact cosine top-k: ``vectors(id, vector)`` x ``queries(query_id, vector)``.

    Few queries: the query matrix is shipped to every vector partition and each
    task keeps its own best k over all that it reads. Many queries: both sides are cut into blocks of
    bounded size and every pair of blocks is one bounded task.
    """
    id_type = vectors.schema["id"].dataType
    q_type = queries.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", q_type), T.StructField("id", id_type),
                           T.StructField("score", T.DoubleType())])
    arrow_schema = None

    def emit(out_q, out_i, out_s):
        return pa.RecordBatch.from_arrays(
            [pa.array(out_q, q_arrow), pa.array(out_i, i_arrow), pa.array(out_s, pa.float64())],
            names=["query_id", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    q_arrow, i_arrow = to_arrow_type(q_type), to_arrow_type(id_type)
    narrow = vectors.select("id", "vector")
    if is_small(queries, QUERY_BROADCAST_ROWS):
        rows = queries.select("query_id", "vector").orderBy("query_id").collect()  # at most QUERY_BROADCAST_ROWS
        if not rows:
            return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
        qids = [r[0] for r in rows]
        qm = _matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())), len(rows))
        shared = vectors.sparkSession.sparkContext.broadcast((qids, qm))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_q, q = shared.value
            best, rows_at_once = _Best(len(ids_q), k, i_arrow), max(1, SCORE_CELLS // len(ids_q))
            for batch in batches:
                for at in range(0, batch.num_rows, rows_at_once):
                    part = batch.slice(at, rows_at_once)
                    scores = ((_matrix(part.column(1), part.num_rows) @ q.T) + 1.0) / 2.0
                    hit = np.floor(scores * 1e6 + 0.5) / 1e6 >= min_score if min_score > 0 else np.ones(scores.shape, bool)
                    if exclude_self:
                        hit &= np.array(part.column(0).to_pylist())[:, None] != np.array(ids_q)[None, :]
                    best.offer(scores, hit, part.column(0).cast(i_arrow))
            for at in range(0, len(best.query), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([ids_q[x] for x in best.query[part].tolist()], q_arrow), best.docs.slice(at, OUT_ROWS),
                                                  pa.array(best.score[part])], names=["query_id", "id", "score"])

        hits = narrow.sortWithinPartitions("id").mapInArrow(score, schema)  # equal scores go by id
    else:
        nv = block_count(vectors.count(), BLOCK_ROWS)
        nq = block_count(queries.count(), BLOCK_ROWS)
        left = narrow.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(nv))).withColumn(
            "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
        right = queries.select("query_id", F.col("vector").alias("q_vector")).withColumn(
            "q_qb", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn(
            "q_vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))))

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            if a.num_rows == 0 or b.num_rows == 0:
                return pa.Table.from_batches([emit([], [], [])])
            ids = np.array(a.column("id").to_pylist())
            return pa.Table.from_batches([emit(*_local_top(
                b.column("query_id").to_pylist(), _matrix(b.column("q_vector"), b.num_rows), ids,
                _matrix(a.column("vector"), a.num_rows), k, min_score, exclude_self))])

        hits = left.groupBy("qb", "vb").cogroup(right.groupBy("q_qb", "q_vb")).applyInArrow(pair, schema)
    return top_k(hits, ["query_id"], "id", k)


# ---- index maintenance ---------------------------------------------------------------------------

def update_index(index: InvertedIndex, changed: InvertedIndex, deleted: DataFrame | None = None) -> InvertedIndex:
    """Replace postings of changed documents and drop those of deleted ones (``deleted(doc_id)``)."""
    gone = changed.postings.select("doc_id").distinct()
    if deleted is not None:
        gone = gone.unionByName(deleted.select("doc_id")).distinct()
    kept = index.postings.select(*POSTING).join(gone, "doc_id", "left_anti")
    fresh = changed.postings.select(*POSTING)
    if deleted is not None:
        fresh = fresh.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
    return InvertedIndex(kept.unionByName(fresh))


def needs_rebuild(index: InvertedIndex, docs: DataFrame, doc_id: str) -> DataFrame:
    """One row: indexed and stored document counts, and whether they differ."""
    a = index.postings.agg(F.countDistinct("doc_id").alias("indexed"))
    b = docs.agg(F.countDistinct(doc_id).alias("stored"))
    return a.join(F.broadcast(b), F.lit(True)).withColumn("rebuild", F.col("indexed") != F.col("stored"))
