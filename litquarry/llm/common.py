"""What several operators share: registry, words, held-out split, bounded samples, batch size."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from litquarry.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WHITE = r"[\x20\x09-\x0D]+"  # what separates words
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 1 << 20  # text handed to a Python worker at once


def register(name: str, oracle: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_BYTES, so that many long rows never meet in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """Rows kept from every learner: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def hashed_share(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of the distinct keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * F.lit(float(1 << 20))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind)


def row_hash(df: DataFrame, names: list[str]) -> Column:
    """Hash of the named columns; those that hold maps, which have no hash, count by their JSON."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{n}`").alias("v"))) if _has_map(kinds[n]) else F.col(f"`{n}`") for n in names])


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per doc_id that learners may see; a repeated id takes its largest label."""
    lab = labels.select("doc_id", F.col(column).cast("int").alias("label"))
    lab = lab.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    return lab.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: dict[int, int]) -> DataFrame:
    """Rows of ``docs`` with ``label``: about ``per_class[label]`` labelled documents of each class, chosen by a hash of the id.

    Of rows that share an id one is taken, so the sample is bounded however often an id comes.
    """
    lab = clean_labels(labels, column)
    counts = {r["label"]: r["count"] for r in lab.groupBy("label").count().where(F.col("label").isin(*per_class)).collect()}
    keep = F.lit(False)
    for value, most in per_class.items():
        keep = keep | ((F.col("label") == value) & hashed_share(F.col("doc_id"), min(1.0, most / max(1, counts.get(value, 0)))))
    chosen = lab.where(keep)
    small = sum(min(per_class.get(k, 0), n) for k, n in counts.items()) <= 100_000
    found = docs.join(F.broadcast(chosen) if small else chosen, "doc_id")
    names = [n for n in docs.columns if n != "doc_id"]
    one = found.groupBy("doc_id", "label").agg(F.min_by(F.struct(*[F.col(f"`{n}`") for n in names]), row_hash(docs, names)).alias("_one"))
    return one.select("doc_id", "_one.*", "label")
