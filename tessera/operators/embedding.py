"""Embedding plug-ins: an interface, a deterministic stand-in, and late chunking over any token encoder."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Texts to a matrix with one row each; called once per Arrow batch.
Embedder = Callable[[list[str]], np.ndarray]
#: A text to its tokens' (start, end) offsets and a matrix with one row per token.
TokenEncoder = Callable[[str], tuple[list[tuple[int, int]], np.ndarray]]


def stand_in(dims: int) -> Embedder:
    """Unit vectors seeded by the text's digest: a test double, the same everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big") for t in texts]
        made = np.array([np.random.RandomState(s).standard_normal(dims) for s in seeds]).reshape(-1, dims)
        return made / np.maximum(np.sqrt((made * made).sum(1, keepdims=True)), 1e-12)

    return embed


def retried(embedder: Embedder, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """An embedder that asks again after a failure, each time after twice the wait; the last failure is raised."""

    def ask(texts: list[str]) -> np.ndarray:
        for n in range(tries):
            try:
                return embedder(texts)
            except Exception:
                if n + 1 == tries:
                    raise
                sleep(wait * 2**n)
        raise ValueError("no tries")

    return ask


def with_fallback(embedder: Embedder, other: Embedder) -> Embedder:
    """An embedder whose place another one takes, for a whole batch, where it fails: rows of one batch never mix models."""

    def ask(texts: list[str]) -> np.ndarray:
        try:
            return embedder(texts)
        except Exception:
            return other(texts)

    return ask


def hashing(dims: int) -> Embedder:
    """Signed counts of hashed words of unit length; a text without words is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall("[0-9a-z가-힣_]+", text.lower()):
                digest = hashlib.sha1(word.encode()).hexdigest()
                row[int(digest[:8], 16) % dims] += 1 if int(digest[8:10], 16) % 2 == 0 else -1
        return out / np.where((norm := np.sqrt((out * out).sum(1, keepdims=True))) > 0, norm, 1)

    return embed


def embed(rows: DataFrame, id_col: str, text_col: str, embedder: Embedder) -> DataFrame:
    """``id, embedding`` of every row; null texts count as empty."""
    key = dict(rows.dtypes)[id_col]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = embedder(frame[text_col].fillna("").tolist()) if len(frame) else np.empty((0, 0))
            yield pd.DataFrame({id_col: frame[id_col], "embedding": [v.astype(np.float32).tolist() for v in made]})

    return rows.select(id_col, text_col).mapInPandas(work, f"`{id_col}` {key}, embedding array<float>")


def hashed_tokens(dims: int) -> TokenEncoder:
    """White-space tokens with stand-in vectors."""
    one = stand_in(dims)

    def encode(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, at = [], 0
        for word in text.split():
            start = text.index(word, at)
            at = start + len(word)
            spans.append((start, at))
        return spans, one([text[a:b] for a, b in spans])

    return encode


def pooled_spans(text: str, spans: list[tuple[int, int]], encoder: TokenEncoder, context: float = 0.0) -> np.ndarray:
    """Mean of the token vectors in each span, mixed with the whole text's mean by ``context``; empty spans take the latter."""
    offsets, matrix = encoder(text)
    if not len(matrix):
        return np.zeros((len(spans), matrix.shape[1] if matrix.ndim > 1 else 0))
    whole = matrix.mean(0)
    out = []
    for a, b in spans:
        inside = [k for k, (s, e) in enumerate(offsets) if s < b and e > a]
        out.append((1 - context) * matrix[inside].mean(0) + context * whole if inside else whole)
    return np.array(out).reshape(len(spans), -1)


def late_chunks(rows: DataFrame, id_col: str, text_col: str, spans_col: str, encoder: TokenEncoder, context: float = 0.35) -> DataFrame:
    """``id, chunk_index, embedding``: one encoding per text, pooled over its spans (array of struct a, b)."""
    key = dict(rows.dtypes)[id_col]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text, spans in zip(frame[id_col], frame[text_col].fillna(""), frame[spans_col]):
                made = pooled_spans(text, [(s["a"], s["b"]) for s in spans], encoder, context)
                out += [(i, n, v.astype(np.float32).tolist()) for n, v in enumerate(made)]
            yield pd.DataFrame(out, columns=[id_col, "chunk_index", "embedding"])

    return rows.select(id_col, text_col, spans_col).mapInPandas(work, f"`{id_col}` {key}, chunk_index int, embedding array<float>")
