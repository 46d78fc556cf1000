"""Packing by power-of-two decomposition.

A document of n ids becomes pieces whose lengths are powers of two: as many of the longest
length as fit, then one for each binary digit of the rest. A piece is a sequence of its own,
kept with the others of its length, so batches of equal lengths need no padding and no
sequence holds two documents.
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

from tenderlens.llm import tokens
from tenderlens.llm.common import ship, stored, table

LONGEST = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, none above ``longest``, largest first, that add up to ``n``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(
    docs: DataFrame, spec: bytes, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids
    (little-endian unsigned 32-bit) with ``with_ids``.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text is the end
    id alone. Rows with equal doc_id are packed each on its own. A null doc_id stays null. An
    empty table gives no row. ``longest`` is a power of two.

    Sequences are numbered length by length, longest first: tasks number their own pieces, the
    counts of each task and length are added up, and the sum of the earlier ones is added.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.library_encoder(shared.value)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in tokens.in_slices(texts):
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids[first:], encoder.ids(run)):
                    ids += end
                    at, total = 0, len(ids) // 4
                    for length in piece_lengths(total, longest):
                        piece = ids[4 * at : 4 * (at + length)]
                        number = seen.get(length, 0)
                        seen[length] = number + 1
                        out.append((doc_id, at, length, zlib.crc32(piece), total, task, number, piece if with_ids else None))
                        at += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), _PIECE.types)], schema=_PIECE
                )

    pieces = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _PIECE_DDL))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # At most log2(longest) + 1 rows.
    longer = Window.partitionBy(F.lit(0)).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).select(
        "length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("longer")
    )
    bases = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).join(totals, "length").select(
        "length", "task", (F.col("earlier") + F.col("longer")).alias("base")
    )
    return pieces.join(bases, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("task", pa.int32()), ("number", pa.int64()), ("ids", pa.binary()),
])
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, number long, ids binary"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokens.tokenizer_file(TOKENIZER), with_ids=False)
