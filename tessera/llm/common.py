"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut, shared_folder  # noqa: F401  the operators of this subpackage use them from here

TEXTS_AT_ONCE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives back memory that a finished task no longer uses: the worker lives on, and its next task may need little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int | None = TEXTS_AT_ONCE) -> DataFrame:
    """``mapInArrow`` whose function sees one partition as a stream of batches of at most ``rows`` rows.

    Texts are long, and what is derived from a batch of them is held at once; ``None`` leaves Spark's batches as they are.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), rows):
                yield batch.slice(at, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches if rows is None else sliced(batches))
        finally:
            release()

    return df.mapInArrow(run, schema)


def bytes_of(text: Column | str) -> Column:
    """UTF-8 bytes of a text column; null is the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def bucket_of(key: Column, divisor: int) -> Column:
    """crc32 of a key's decimal text modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(divisor)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def to_batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A record batch of plain lists or numpy arrays."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in types.items()], names=list(types))


#: crc32 of a value's decimal or other ASCII text, as an unsigned number, in DuckDB's SQL; the value goes in place of ``{0}``.
CRC_SQL = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS UBIGINT))), "
    "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS UBIGINT))"
)
