"""Dense vectors with a persistent cache and a user-supplied encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.sources.tables import EMBEDDING_SCHEMA

Encoder = Callable[[Sequence[str]], np.ndarray]


def cache_hits(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Cached vectors of the given texts for one model."""
    known = cache.filter(F.col("model") == model).select("text_hash", "embedding")
    return texts.select("text_hash").join(known, "text_hash")


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    known = cache.filter(F.col("model") == model).select("text_hash")
    return texts.join(known, "text_hash", "left_anti")


def encode_texts(texts: DataFrame, make_encoder: Callable[[], Encoder], model: str, batch_size: int = 64) -> DataFrame:
    """Encode (text_hash, text) rows. The encoder is built once per task and fed
    ``batch_size`` texts at a time; vectors are scaled to unit length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for frame in frames:
            encode = encode or make_encoder()
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                vectors = np.asarray(encode(part["text"].tolist()), dtype=np.float32)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(norms == 0, 1, norms)
                yield pd.DataFrame({
                    "text_hash": part["text_hash"].to_numpy(), "model": model, "embedding": list(vectors),
                })

    return texts.select("text_hash", "text").mapInPandas(run, EMBEDDING_SCHEMA)


def embed_missing(
    texts: DataFrame, cache: DataFrame, make_encoder: Callable[[], Encoder], model: str, batch_size: int = 64
) -> DataFrame:
    """Cache rows for the texts the cache lacks; append them, then look everything up."""
    return encode_texts(cache_misses(texts, cache, model), make_encoder, model, batch_size)
