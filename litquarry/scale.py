"""Building blocks that keep operators safe on skewed and very large inputs."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ROW_BITS = 33  # monotonically_increasing_id keeps the row offset in the low 33 bits
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20  # of text and nested values


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the checkpoint folder the cluster names; invent one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
        named = tempfile.mkdtemp(prefix="litquarry-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    For the state of loops: ``cut`` forgets the lineage, but keeps what the optimizer inferred about the columns, and that
    multiplies where each round joins the state with itself.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of at most ``max_bytes`` in all; reads no more rows than that.

    Only rows that hold text or nested values are weighed, others are of known size.
    """
    sizes = [F.lit(0)]
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(F.col(f"`{field.name}`")))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`").alias("v")))))
    size = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)).cast("long") for x in sizes])
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` if its rows are proven few and small, else leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def join_known(df: DataFrame, other: DataFrame, key: str, how: str) -> DataFrame:
    """Left or left anti join by ``key`` in which null matches nothing and rows with null are spread over all tasks.

    ``other`` holds no null key. A second join column, zero where the key is known, takes the other rows apart.
    """
    rest = F.when(F.col(key).isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).otherwise(F.lit(0).cast("long"))
    return df.withColumn("_apart", rest).join(other.withColumn("_apart", F.lit(0).cast("long")), [key, "_apart"], how).drop("_apart")


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality over ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def global_rank(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based row number inside each group, with no group held by a single task.

    The rows are range-sorted across all tasks, so one hot group is spread over
    many of them; a position is the offset of the range partition plus the row
    offset inside it. The sorted frame is materialised because the partition
    offsets and the rows must come from the same sort.
    """
    spark = df.sparkSession
    ordered = cut(df.orderBy(*group, *order).withColumn("_pos", F.monotonically_increasing_id()))
    pid = F.shiftright("_pos", ROW_BITS).cast("long")
    # one row per range partition, so its size follows the number of partitions only
    counts = sorted(tuple(r) for r in ordered.groupBy(pid.alias("pid")).count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "_pid long, _start long")
    positioned = (
        ordered.withColumn("_pid", pid)
        .join(F.broadcast(starts), "_pid")
        .withColumn("_idx", F.col("_start") + F.col("_pos").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_pid", "_start", "_pos")
    )
    if not group:
        return positioned.withColumn(rank, F.col("_idx") + 1).drop("_idx")
    firsts = positioned.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(
        F.min("_idx").alias("_first")
    )
    cond = reduce(
        lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    )
    return (
        positioned.join(firsts, cond)
        .withColumn(rank, F.col("_idx") - F.col("_first") + 1)
        .drop("_idx", "_first", *[f"_g{i}" for i in range(len(group))])
    )


def exact_median(df: DataFrame, group: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group through distributed ranks rather than per-group buffers."""
    ranked = global_rank(
        df.where(F.col(value).isNotNull()).select(*group, value), group, [F.col(value).asc()], "_r"
    )
    sizes = ranked.groupBy(*group).agg(F.max("_r").alias("_n"))
    return (
        ranked.join(sizes, group)
        .where(
            (F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1)
        )
        .groupBy(*group)
        .agg(F.avg(value).alias(out))
    )


def block_count(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Hash-partition ``df`` into the configured number of shuffle partitions.

    For steps whose cost is computation per row rather than bytes: adaptive execution merges
    partitions by size and would leave such a step to few tasks; a fixed number is not merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
