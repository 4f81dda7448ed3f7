"""What embeds texts, and an embedder that needs no model."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Gives vectors of length 1, so that a dot product is a cosine."""

    #: Names the model; stored vectors of another one aren't used.
    model_id: str
    dim: int

    def embed(self, text: str) -> np.ndarray: ...

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


def _hash(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 32)


class HashEmbedder:
    """Signed hashes of words and of their character trigrams; the same vector in every process.

    Texts that share words, or words with shared parts, are near.  A text without any word is the first axis.
    """

    def __init__(self, dim: int = 256):
        self.dim, self.model_id = dim, f"hash-trigrams-{dim}"

    def embed(self, text: str) -> np.ndarray:
        out = np.zeros(self.dim)
        for word in (text or "").lower().split():
            parts = [f" {word} "[i : i + 3] for i in range(len(word))]
            for part, weight in [(word, 1.0), *((p, 1.0 / len(parts)) for p in parts)]:
                h = _hash(part.encode())
                out[h % self.dim] += weight if h >> 63 else -weight
        norm = np.sqrt((out * out).sum())
        if not norm:
            out[0] = norm = 1.0
        return (out / norm).astype(np.float32)

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.embed(t) for t in texts]) if texts else np.zeros((0, self.dim), dtype=np.float32)


def embed_column(embedder: Embedder) -> Callable[[Column], Column]:
    """A function of a text column for embed_missing: vectors by Arrow batches, null for null."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(text: pa.Array) -> pa.Array:
        got = embedder.embed_batch([t or "" for t in text.to_pylist()])
        return pa.array([None if not ok else v.tolist() for v, ok in zip(got, text.is_valid().to_pylist(), strict=True)], pa.list_(pa.float32()))

    return vectors
