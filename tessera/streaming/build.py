"""Incremental builds: a stream of documents kept as chunks with vectors, one row a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .append import Upserted, upsert_stream

#: A text's chunks as an array, and a chunk's vector.
Chunker = Callable[[Column], Column]
Embedder = Callable[[Column], Column]


def chunked(docs: DataFrame, id_col: str, text_col: str, order: str, chunker: Chunker, embedder: Embedder, gone: str | None = None) -> DataFrame:
    """``id, order, chunks`` (and ``gone``) of documents: a chunk has its id, text and vector, all made within the row.

    A document that comes again replaces all of its chunks, however many there were.
    """
    number = lambda i: F.lpad(i.cast("string"), 4, "0")
    chunk = lambda t, i: F.struct(F.concat_ws("-chunk-", F.col(id_col).cast("string"), number(i)).alias("chunk_id"), t.alias("text"), embedder(t).alias("embedding"))
    chunks = F.transform(chunker(F.coalesce(F.col(text_col), F.lit(""))), chunk)
    return docs.select(id_col, order, chunks.alias("chunks"), *([] if gone is None else [gone]))


def build_stream(docs: DataFrame, table: Upserted, checkpoint: str, text_col: str, chunker: Chunker, embedder: Embedder) -> StreamingQuery:
    """Keeps a table of chunked documents up to date with a stream of documents, whose last version by the table's order counts."""
    return upsert_stream(chunked(docs, table.key, text_col, table.order, chunker, embedder, table.gone), table, checkpoint)


def chunk_rows(current: DataFrame, id_col: str) -> DataFrame:
    """``id, chunk_id, text, embedding`` of every chunk."""
    return current.select(id_col, F.explode("chunks").alias("c")).select(id_col, "c.*")


def manifest(current: DataFrame, id_col: str) -> DataFrame:
    """``id, chunks, characters, dims``: what the table holds of each document."""
    lengths = F.transform("chunks", lambda c: F.length(c.text))
    dims = F.coalesce(F.array_max(F.transform("chunks", lambda c: F.size(c.embedding))), F.lit(0))
    return current.select(id_col, F.size("chunks").cast("long").alias("chunks"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n).alias("characters"), dims.alias("dims"))
