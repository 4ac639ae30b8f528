"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record: payload length (8 bytes), masked checksum of those 8 bytes (4), payload, masked checksum of the payload (4),
line feed (1). All numbers are little-endian. A payload: 1 byte for the width of an id, with 0x80 added if the id of
the document is null; doc_id (8 bytes); the ids. A checksum is CRC-32, rotated right by 15 bits, plus 0xa282ead8.
Records go through Spark's text writer, which adds the line feed and commits a file only when its task has ended.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from litquarry.llm.common import bounded_batches
from litquarry.llm.tokenise import encoder
from litquarry.scale import ensure_checkpoint_dir

FILE_BYTES = 24 << 20  # text that goes to one file
END = 0
HEAD = "<QI"
START = "<Bq"
CHECK = "<I"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its line feed."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(CHECK, masked(length)), payload, struct.pack(CHECK, masked(payload))))


def unframe(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, payload) of every record in a file's bytes; a wrong checksum or a torn record raises."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + struct.calcsize(HEAD) > len(data):
            raise ValueError(f"torn record at {at}")
        n, check = struct.unpack_from(HEAD, data, at)
        body = at + struct.calcsize(HEAD)
        if masked(view[at:at + 8]) != check:
            raise ValueError(f"wrong length checksum at {at}")
        if body + n + struct.calcsize(CHECK) >= len(data) or data[body + n + struct.calcsize(CHECK)] != 10:
            raise ValueError(f"torn record at {at}")
        payload = view[body:body + n]
        if masked(payload) != struct.unpack_from(CHECK, data, body + n)[0]:
            raise ValueError(f"wrong checksum at {at}")
        yield at, payload
        at = body + n + struct.calcsize(CHECK) + 1


def write_records(docs: DataFrame, vocabulary: str, folder: str, end: int = END) -> None:
    """Encode every row's text (null: empty) and write records to ``folder`` in ascending doc_id order, null ids first.

    Rows are range-partitioned by doc_id, one file for about FILE_BYTES of text; texts, not ids, are shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = own.repartitionByRange(max(1, -(-size // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        wide = enc.tokenizer.get_vocab_size() > 1 << 16 or end >= 1 << 16
        tail = np.array([end], "<u4")
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"]):
                ids = np.concatenate([np.frombuffer(enc.encode(text if isinstance(text, str) else ""), "<u4"), tail])
                none = doc_id is None or doc_id is pd.NA or doc_id != doc_id
                start = struct.pack(START, (4 if wide else 2) | (0x80 if none else 0), 0 if none else int(doc_id))
                out.append(frame(start + (ids if wide else ids.astype("<u2")).tobytes()))
            yield pd.DataFrame({"value": out})

    own.mapInPandas(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index, from the files alone: path, part, position, doc_id, at, n_tokens, ids_crc32 of every record.

    ``at`` counts the ids before it in its file. Every checksum is held against its bytes.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                out, before = [], 0
                for place, payload in unframe(content):
                    kind, doc_id = struct.unpack_from(START, payload, 0)
                    ids = np.frombuffer(payload, "<u4" if kind & 4 else "<u2", offset=struct.calcsize(START))
                    out.append((path, place, None if kind & 0x80 else doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                frame_ = pd.DataFrame(out, columns=["path", "position", "doc_id", "at", "n_tokens", "ids_crc32"])
                frame_["doc_id"] = frame_["doc_id"].astype("Int64")
                yield frame_

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    out = files.mapInPandas(run, "path string, position long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return out.withColumn("part", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))


def write_dataset(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = END) -> tuple[str, DataFrame]:
    """Records under ``folder``/records and their index under ``folder``/index; the folder and the index, read back.

    The index adds ``start``, the ids of all documents before. Without a folder a new one is made under
    spark.checkpoint.dir. No row gives no record. The driver sees one number per file.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/token-records-{uuid.uuid4().hex}"
    write_records(docs, vocabulary, f"{folder}/records", end)
    read_records(spark, f"{folder}/records").write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    sums = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sums:
        starts.append((r["part"], total))
        total += r["n"]
    before = F.broadcast(spark.createDataFrame(starts, "part long, _before long"))
    found.join(before, "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before", "at").write.parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index")
