"""Vector arithmetic on ``array<float>`` columns and the float32 BLOB codec."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def unit(vector: Column) -> Column:
    """Vector scaled to length one; null for a null or zero vector."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda v: v.cast("double") / length))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def unit_values(values: Sequence[float]) -> list[float]:
    """Driver-side counterpart of :func:`unit` for a query vector; empty when it has no length."""
    array = np.asarray(values, dtype="float64")
    length = float(np.sqrt((array * array).sum()))
    return (array / length).tolist() if length > 0 else []


@F.pandas_udf(VECTOR)
def decode_float32(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def encode_float32(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


class Embedder(Protocol):
    """Anything that turns a batch of texts into vectors; must be picklable."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Offline stand-in: hashed token counts, scaled to unit length."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        vectors = []
        for text in texts:
            if not text:
                vectors.append([])
                continue
            counts = np.zeros(self.width)
            for token in re.findall(r"[^\W_]{2,}", text.lower()):
                code = zlib.crc32(token.encode())
                counts[code % self.width] += 1.0 if code & 0x10000 else -1.0
            vectors.append(unit_values(counts) or counts.tolist())
        return vectors


def with_embedding(df: DataFrame, text_column: str, embedder: Embedder, batch: int = 32,
                   output: str = "embedding") -> DataFrame:
    """Add the embedding of ``text_column``; the model sees at most ``batch`` texts per call."""

    @F.pandas_udf(VECTOR)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [t or "" for t in part]
            vectors: list = []
            for start in range(0, len(texts), batch):
                vectors.extend(embedder.embed(texts[start:start + batch]))
            yield pd.Series([np.asarray(v, dtype="float32") for v in vectors], dtype=object)

    return df.withColumn(output, run(F.col(text_column)))
