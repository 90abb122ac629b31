"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_ROWS_BITS = 33  # monotonically_increasing_id() is the partition's number above so many bits, and the row's place below


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``_part``, the number of a range of the order, and ``_at``, each row's place from 0 in ascending order of ``by``.

    Nulls come first; strings order by their UTF-8 bytes.  Rows are dealt by
    ranges over all of ``by``, so that a frequent leading value is split.  What
    goes through the driver is one count for each range.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = cut(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", _ROWS_BITS).cast("int")))
    counts = sorted(dealt.groupBy("_part").count().collect())
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    if not starts:
        return dealt.withColumn("_at", F.col("_id")).drop("_id")
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _ROWS_BITS) - 1))
    return dealt.join(F.broadcast(offsets), "_part").withColumn("_at", place).drop("_id", "_before")
