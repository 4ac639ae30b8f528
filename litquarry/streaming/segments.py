"""A table that batches append to, kept as few segments: full tiers are merged, and every batch has a manifest.

A batch writes one segment of the lowest tier. When a tier holds FAN segments they are merged into one of the next tier,
so the number of segments grows with the logarithm of the batches, and a row is rewritten once a tier. The manifest of
a batch lists the segments that hold everything up to it. A batch that is replayed starts from the manifest
of the batch before and replaces its own files, so it leaves the same table. Nothing that an older manifest
names is touched; what no manifest in use names may be removed by the storage's retention.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

FAN = 4
MANIFEST = "name string, tier int, batch long"


@dataclass
class Segments:
    spark: SparkSession
    root: str
    ddl: str
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    fan: int = FAN

    def manifest(self, before: int | None = None) -> list[tuple[str, int]]:
        """(name, tier) of the segments of the newest manifest, or of the newest one of a batch before ``before``."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        newest = rows.agg(F.max("batch")).first()[0]
        # as many rows as there are segments, a logarithm of the batches
        return sorted((r["name"], r["tier"]) for r in rows.where(F.col("batch") == F.lit(newest)).collect() if r["name"])

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before ``before``."""
        return self._rows([name for name, _ in self.manifest(before)])

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*[f"{self.root}/{n}" for n in names])

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of a batch, merge full tiers and write the batch's manifest."""
        segments = self.manifest(batch) + [(f"batch-{batch}-0", 0)]
        rows.write.mode("overwrite").parquet(f"{self.root}/{segments[-1][0]}")
        tier = 0
        while len(full := [n for n, t in segments if t == tier]) >= self.fan:
            name = f"batch-{batch}-{tier + 1}"
            self.merge(self._rows(full)).write.mode("overwrite").parquet(f"{self.root}/{name}")
            segments = [(n, t) for n, t in segments if t != tier] + [(name, tier + 1)]
            tier += 1
        self.spark.createDataFrame(segments, "name string, tier int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
