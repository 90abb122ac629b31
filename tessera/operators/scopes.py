"""Search scopes: what a request may search, as partitions of the vector table.

The catalogue has one row a snapshot: ``snapshot, source, queryable, active, made_at``.
A scope is ``active_snapshot`` (the active one), ``all_sources`` (of each source the
latest that can be queried), ``source:<id>`` (that of one source) or a profile's id,
whose entries name snapshots, or sources whose latest is meant.  An unknown or
missing scope is the default one; a default that holds nothing gives way to the first
scope that does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut

ACTIVE, ALL = "active_snapshot", "all_sources"
#: Of a profile's entry one of both is given: a snapshot, or a source.
Profiles = Mapping[str, Sequence[tuple[str | None, str | None]]]


def members(catalogue: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """``scope, snapshot, place``: every scope's snapshots; ``place`` orders the scopes."""
    spark = catalogue.sparkSession
    latest = catalogue.filter("queryable").groupBy("source").agg(F.max(F.struct("made_at", "snapshot")).alias("l")).select("source", F.col("l.snapshot").alias("snapshot"))
    rows = [(scope, place + 3, snapshot, source) for place, (scope, entries) in enumerate((profiles or {}).items()) for snapshot, source in entries]
    asked = spark.createDataFrame(rows, "scope string, place int, snapshot string, source string")
    named = asked.filter("snapshot is not null").join(catalogue.select("snapshot"), "snapshot", "left_semi").select("scope", "snapshot", "place")
    by_source = asked.filter("snapshot is null").drop("snapshot").join(latest, "source").select("scope", "snapshot", "place")
    active = catalogue.filter("active").select(F.lit(ACTIVE).alias("scope"), "snapshot", F.lit(0).alias("place"))
    every = latest.select(F.lit(ALL).alias("scope"), "snapshot", F.lit(1).alias("place"))
    single = latest.select(F.concat(F.lit("source:"), "source").alias("scope"), "snapshot", F.lit(2).alias("place"))
    return active.unionByName(every).unionByName(single).unionByName(named).unionByName(by_source).distinct()


def resolve(catalogue: DataFrame, wanted: str | None, profiles: Profiles | None = None, default: str = ACTIVE) -> DataFrame:
    """``scope, snapshot`` of the scope that a request gets."""
    known = members(catalogue, profiles)
    rank = F.when(F.col("scope") == (wanted or ""), 0).when(F.col("scope") == default, 1).otherwise(F.col("place") + 2)
    first = known.agg(F.min(F.struct(rank.alias("r"), "scope")).alias("f")).select(F.col("f.scope").alias("scope"))
    return known.join(F.broadcast(first), "scope").select("scope", "snapshot")  # one row is broadcast


def write_vectors(rows: DataFrame, path: str) -> None:
    """The vector table with a folder for each snapshot."""
    rows.repartition(
        "snapshot", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "snapshot" and not dict(rows.dtypes)[c].startswith("array")]), F.lit(8))
    ).write.partitionBy("snapshot").parquet(path)


def scoped(spark: SparkSession, path: str, scope: DataFrame) -> DataFrame:
    """The vectors of a scope's snapshots; their folders are chosen when the scope is known, before any is listed for reading."""
    # no more rows than there are snapshots; Spark prunes a scan by a joined table that has a condition of its own
    named = cut(scope.select("scope", "snapshot").distinct()).filter("scope <> ''").select("snapshot")
    return spark.read.parquet(path).join(F.broadcast(named), "snapshot")
