"""Vector expressions; all sums run in double precision."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StringType

from rankmill.functions.binding import let


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_score(left: Column, right: Column) -> Column:
    """Similarity in [0, 1]: half of one plus the cosine."""
    return (F.lit(1.0) + dot(left, right) / (norm(left) * norm(right))) / 2


def l2_normalize(vector: Column) -> Column:
    """Unit vector; null for a zero vector."""
    return let(
        vector,
        lambda v: let(
            norm(v),
            lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)),
        ),
    )


def truncate_then_normalize(vector: Column, dims: int) -> Column:
    return l2_normalize(F.slice(vector, 1, dims))


def vector_fault(vector: Column, dims: int, tolerance: float) -> Column:
    """Why a vector is unusable, or null: wrong length, non-finite value, not of unit length."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return (
        F.when(vector.isNull() | (F.size(vector) != dims), "dimension")
        .when(~finite, "not_finite")
        .when(F.abs(norm(vector) - 1.0) > tolerance, "not_unit_length")
    )


@F.pandas_udf(BinaryType())
def float32_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian single-precision bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def float32_array(payload: pd.Series) -> pd.Series:
    return payload.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(ArrayType(StringType()))
def canonical_float32(vectors: pd.Series) -> pd.Series:
    """Big-endian single-precision hex per component, for digests that ignore formatting."""

    def words(vector: np.ndarray) -> list[str]:
        text = np.asarray(vector, dtype=">f4").tobytes().hex()
        return [text[i : i + 8] for i in range(0, len(text), 8)]

    return vectors.map(lambda v: None if v is None else words(v))


def to_base64(vector: Column) -> Column:
    """One line of base64; the built-in breaks lines at 76 characters."""
    return F.translate(F.base64(float32_bytes(vector)), "\r\n", "")


def from_base64(text: Column) -> Column:
    return float32_array(F.unbase64(text))


def vector_hash(vector: Column) -> Column:
    return F.sha2(float32_bytes(vector), 256)


def base64_length(dims: Column) -> Column:
    """Characters of padded base64 for `dims` single-precision values."""
    return (4 * F.floor((dims * 4 + 2) / 3)).cast("long")


def deterministic_embedding(text: Column, dims: int = 256) -> Column:
    """Two-byte digest prefixes of `text:i`, scaled to [-1, 1] and normalised; null for null texts.

    The digest state of the text is taken once per row and continued for each number.
    """
    numbers = [str(i).encode() for i in range(dims)]

    def prefixes(value: str) -> bytes:
        state, parts = hashlib.sha256(f"{value}:".encode()), []
        for number in numbers:
            own = state.copy()
            own.update(number)
            parts.append(own.digest()[:2])
        return b"".join(parts)

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            raw = None if value is None else np.frombuffer(prefixes(value), ">u2") / 65535.0 * 2.0 - 1.0
            length = 0.0 if raw is None else np.sqrt(raw @ raw)
            out.append(raw / length if length > 0 else None)
        return pd.Series(out, index=texts.index, dtype=object)

    return embed(text)


def hash_embedding(docs: DataFrame, key: str, text: str, dims: int = 32) -> DataFrame:
    """(key, embedding): words and neighbour pairs hashed into signed buckets, then normalised.

    All features of a row sit in one task, so the partial aggregate leaves at most `dims` rows per
    key for the shuffle. Rows without words produce no vector.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.when(
        F.size("__tokens") > 1,
        F.zip_with(
            F.slice("__tokens", 1, F.size("__tokens") - 1),
            F.slice("__tokens", 2, F.size("__tokens") - 1),
            lambda a, b: F.concat(a, F.lit("_"), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    digest = F.sha2(F.col("__feature"), 256)
    buckets = (
        docs.select(key, tokens.alias("__tokens"))
        .select(key, F.explode_outer(F.concat("__tokens", pairs)).alias("__feature"))  # outer: no second cut of the text to test for words
        .where(F.col("__feature").isNotNull())
        .select(key, digest.alias("__digest"))
        .select(
            key,
            (F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long") % dims).alias("__bucket"),
            F.when(
                F.conv(F.substring("__digest", 9, 2), 16, 10).cast("int") % 2 == 1, 1.0
            ).otherwise(-1.0).alias("__sign"),
        )
        .groupBy(key, "__bucket")
        .agg(F.sum("__sign").alias("__value"))
    )
    return (
        buckets.groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("__bucket", "__value"))).alias("__map"))
        .select(
            key,
            l2_normalize(
                F.transform(
                    F.sequence(F.lit(0), F.lit(dims - 1)),
                    lambda i: F.coalesce(F.try_element_at("__map", i.cast("long")), F.lit(0.0)),
                )
            ).alias("embedding"),
        )
        .where(F.col("embedding").isNotNull())
    )


def decode_base64_numpy(text: str) -> np.ndarray:
    """One payload on the driver, for tests and spot checks."""
    return np.frombuffer(base64.b64decode(text), dtype="<f4")
