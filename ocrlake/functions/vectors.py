"""Vector functions: cosine, byte codec, the deterministic stand-in embedding."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING_DIMS = 384

# Word groups of the stand-in embedding and the first of the 15 dimensions that each lifts
CONCEPTS = (
    (10, ("database", "db", "sql", "prisma", "prismaclient", "transaction", "p2028", "postgres", "mysql", "sqlite", "cơ", "sở", "dữ", "liệu")),
    (25, ("error", "failure", "failed", "timeout", "closed", "crash", "bug", "lỗi", "hỏng", "requesterror")),
    (40, ("payment", "pay", "checkout", "card", "invoice", "thanh", "toán", "tiền", "funds")),
    (55, ("terminal", "bash", "zsh", "npm", "cmd", "powershell", "console")),
)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, in [-1, 1]; 0 for unequal or no lengths and for vectors without length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm >= 1e-12)
    return F.when(ok, F.greatest(F.least(dot(a, b) / norm, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)


def cosine_to(query: list[float]):
    """Pandas UDF: cosine of a column of vectors with one query vector, a block of rows at a time."""
    q = np.asarray(query, np.float64)
    qn = float(np.linalg.norm(q))

    @F.pandas_udf(T.DoubleType())
    def run(vectors: pd.Series) -> pd.Series:
        fits = np.array([v is not None and len(v) == len(q) and len(q) > 0 for v in vectors], bool)
        out = np.zeros(len(vectors))
        if fits.any():
            m = np.array(vectors[fits].tolist(), np.float64)
            denom = np.linalg.norm(m, axis=1) * qn
            safe = denom >= 1e-12
            out[fits] = np.where(safe, np.clip(np.einsum("ij,j->i", m, q) / np.where(safe, denom, 1), -1, 1), 0.0)
        return pd.Series(out)

    return run


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    """Floats of a byte string; bytes that don't fill a float at the end are dropped."""
    return b.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4").tolist())


def mock_embedding_of(text: str) -> list[float]:
    """The deterministic test embedding of a text."""
    v = np.zeros(EMBEDDING_DIMS, np.float32)
    tokens = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split()]
    tokens = [w for w in tokens if w]
    if not tokens:
        v[0] = 1.0
        return v.tolist()
    for w in tokens:
        h = 5381
        for byte in w.encode():
            h = (h * 33 + byte) & 0xFFFFFFFFFFFFFFFF
        v[h % EMBEDDING_DIMS] += 0.5
        for first, words in CONCEPTS:
            if any(x in w for x in words):
                v[first : first + 15] += 2.0
    return (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def mock_embedding(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else mock_embedding_of(t))
