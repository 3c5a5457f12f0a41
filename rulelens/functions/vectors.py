"""Vector expressions and the offline text embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITY_DIGITS = 9
MAX_CACHED_WORDS = 100_000
_WORD = re.compile("[A-Za-z0-9_]+")

Embedder = Callable[[Sequence[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, rounded so that the order of summation cannot change a ranking."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(dot(a, b) / F.nullif(norms, F.lit(0.0)), SIMILARITY_DIGITS)


def hash_embedder(dims: int = 64) -> Embedder:
    """Offline default: word counts hashed into ``dims`` slots, scaled to unit length."""

    slots: dict[str, int] = {}

    def slot(word: str) -> int:
        found = slots.get(word)
        if found is None:
            found = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims
            if len(slots) < MAX_CACHED_WORDS:
                slots[word] = found
        return found

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            for word in _WORD.findall(text):
                out[row, slot(word.lower())] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0.0, 1.0, norms)

    return embed
