"""Vector expressions: cosine on the JVM, and Arrow helpers that see a batch as one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col

# Scores are ranked after rounding, so that equal vectors tie exactly and the id decides.
RANK_DIGITS = 9


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """A list column as a matrix of unit rows; a zero vector stays zero.

    Every vector has to be there and of one length.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if n == 0:
        return np.zeros((0, 0))
    if vectors.null_count:
        raise ValueError("vector is NULL")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size % n or not (np.diff(vectors.offsets.to_numpy()) == flat.size // n).all():
        raise ValueError("vectors differ in length")
    matrix = flat.reshape(n, -1)
    size = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(size > 0, size, 1.0)[:, None]


def hyperplanes(dim: int, bands: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bands * bits))


def signatures(unit: np.ndarray, bands: int, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Per row and band the bits of the random-hyperplane signature, and the margins behind them."""
    margin = unit @ hyperplanes(unit.shape[1], bands, bits, seed)
    margin = margin.reshape(len(unit), bands, bits)
    codes = (margin > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    return codes, margin


def band_signature(vector: str | Column, bands: int, bits: int, seed: int = 7) -> Column:
    """array<bigint>: one bucket code per band."""

    @F.arrow_udf("array<bigint>")
    def sign(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.int64()))
        codes, _ = signatures(unit_rows(vectors), bands, bits, seed)
        offsets = np.arange(0, codes.size + 1, bands, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))

    return sign(col(vector))


def probe_signatures(vector: str | Column, bands: int, bits: int, probes: int, seed: int = 7) -> Column:
    """array<array<bigint>>: per band the own code, then those with one of the least certain bits flipped."""

    @F.arrow_udf("array<array<bigint>>")
    def probe(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.list_(pa.list_(pa.int64())))
        codes, margin = signatures(unit_rows(vectors), bands, bits, seed)
        flips = np.argsort(np.abs(margin), axis=2)[:, :, :probes]
        near = codes[:, :, None] ^ (np.int64(1) << flips.astype(np.int64))
        return pa.array(np.concatenate([codes[:, :, None], near], axis=2).tolist(), pa.list_(pa.list_(pa.int64())))

    return probe(col(vector))
