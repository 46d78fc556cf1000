"""Token ids of a corpus in Simple-8b files, in document order, and back.

A file row is a chunk of consecutive documents: their ids and lengths, the packed words and
the first word of each block. Spark's Parquet commit makes the files safe against lost tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.llm import simple8b, tokens
from tenderlens.llm.common import scratch, ship, shuffle_parts, table

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
CHUNK_IDS = 1 << 18

_CHUNK = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("n_ids", pa.int64()), ("blocks", pa.list_(pa.int64())), ("words", pa.binary()),
])
_CHUNK_DDL = "part int, chunk int, doc_ids array<long>, lengths array<long>, n_ids long, blocks array<long>, words binary"


def write_token_files(docs: DataFrame, spec: bytes, path: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write files in ascending doc_id order.

    ``docs`` needs doc_id and text; other columns are not read. Null doc_ids come first; rows
    with equal doc_id stay side by side, ordered by text. An empty table writes no chunk. A
    chunk closes at the first document that brings it to ``chunk_ids`` ids, so no document is
    cut and a task holds one chunk at a time.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.library_encoder(shared.value)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        chunk, held_ids, held, size = 0, [], [], 0

        def packed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            words, blocks = simple8b.encode(ids)
            row = [part, chunk, held_ids, [len(x) // 4 for x in held], len(ids), blocks.tolist(), words.astype("<u8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _CHUNK.types)], schema=_CHUNK)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in tokens.in_slices(texts):
                for doc_id, ids in zip(doc_ids[first:], encoder.ids(run)):
                    held_ids.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= chunk_ids:
                        yield packed()
                        chunk, held_ids, held, size = chunk + 1, [], [], 0
        if held:
            yield packed()

    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, _CHUNK_DDL)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, and ids (little-endian unsigned 32-bit) with ``with_ids``."""

    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], "<u8")
                ids = simple8b.decode(words, np.array(row["blocks"], np.int64), row["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                pieces = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(pieces), pa.int32()), pa.array([row["chunk"]] * len(pieces), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    pa.array(pieces if with_ids else [None] * len(pieces), pa.binary()),
                ], names=["part", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"])

    chunks = spark.read.schema(_CHUNK_DDL).parquet(path)
    sizes = chunks.select("part", "chunk", "n_ids")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each part of the range layout, so a single window task holds as many rows as there were tasks.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(
        "part", earlier(Window.partitionBy(F.lit(0)).orderBy("part")).alias("before_part")
    )
    bases = sizes.withColumn("in_part", earlier(Window.partitionBy("part").orderBy("chunk"))).join(parts, "part").select(
        "part", "chunk", (F.col("in_part") + F.col("before_part")).alias("base")
    )
    rows = chunks.mapInArrow(decode, "part int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(bases, ["part", "chunk"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), tokens.tokenizer_file(TOKENIZER), path)
    return read_token_files(spark, path, with_ids=False)
