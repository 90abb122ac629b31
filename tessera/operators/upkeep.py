"""Reconciling, upserting, versioning and cleaning document tables; every step is a plan, no row is looked up."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled


def change_actions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, action`` from (key, size, mtime, checksum): new, changed, maybe_changed, unchanged or removed.

    Another size, or another checksum where both are known, is a change; only another time is a maybe.
    """
    o = old.select(F.col(key).alias("_ok"), F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("checksum").alias("_c"))
    joined = new.join(o, new[key] == F.col("_ok"), "full")
    both_sums = F.col("checksum").isNotNull() & F.col("_c").isNotNull()
    action = (
        F.when(F.col("_ok").isNull(), "new")
        .when(F.col(key).isNull(), "removed")
        .when(F.col("size") != F.col("_s"), "changed")
        .when(both_sums, F.when(F.col("checksum") != F.col("_c"), "changed").otherwise("unchanged"))
        .when(F.col("mtime") != F.col("_m"), "maybe_changed")
        .otherwise("unchanged")
    )
    return joined.select(F.coalesce(F.col(key), F.col("_ok")).alias(key), action.alias("action"))


def reconcile(stored: DataFrame, listing: DataFrame, key: str, now: Column) -> DataFrame:
    """Stored rows against a fresh listing: new, changed, unchanged, restored and removed (soft, with time and reason)."""
    s = stored.select(F.col(key).alias("_k"), F.col("size").alias("_size"), F.col("removed_at").alias("_removed"))
    joined = listing.join(s, listing[key] == F.col("_k"), "full")
    action = (
        F.when(F.col("_k").isNull(), "new")
        .when(F.col(key).isNull() & F.col("_removed").isNull(), "removed")
        .when(F.col(key).isNull(), "still_removed")
        .when(F.col("_removed").isNotNull(), "restored")
        .when(F.col("size") != F.col("_size"), "changed")
        .otherwise("unchanged")
    )
    gone = F.when(action == "removed", now).when(action == "still_removed", F.col("_removed"))
    return joined.select(
        F.coalesce(F.col(key), F.col("_k")).alias(key), F.coalesce("size", "_size").alias("size"), action.alias("action"), gone.alias("removed_at"),
        F.when(action == "removed", "missing from listing").alias("reason")
    )


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the largest by ``order``, of equals the largest by the other columns; a null key is a key."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("_last")).select(*[F.col(c) if c == key else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Old rows whose key is not in ``new``, and the new ones; with ``order`` of repeated new keys only the last row."""
    if order is not None:
        new = last_per_key(new, key, order)
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def sync_actions(old: DataFrame, new: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """``action, n``: created, updated (only when overwriting) and skipped."""
    known = old.select(F.col(key).alias("_k")).distinct()
    joined = new.join(known, new[key] == F.col("_k"), "left")
    action = F.when(F.col("_k").isNull(), "created").otherwise("updated" if overwrite else "skipped")
    return joined.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def stale(jobs: DataFrame, job: str, ts: str, now: Column, minutes: int) -> DataFrame:
    """``job, last, state``: interrupted if the last activity is older than the limit."""
    last = jobs.groupBy(job).agg(F.max(ts).alias("last"))
    return last.withColumn("state", F.when(F.col("last") < now - F.expr(f"INTERVAL {minutes} MINUTES"), "interrupted").otherwise("running"))


def approve(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fills only empty ``final_`` fields from the base, then the recognised, then the scanned value, and marks the row reviewed."""
    out = rows
    for f in fields:
        out = out.withColumn(f"final_{f}", first_filled(F.col(f"final_{f}"), F.col(f), F.col(f"ocr_{f}"), F.col(f"scan_{f}")))
    return out.withColumn("status", F.lit("reviewed"))


def reject(rows: DataFrame, reason: str) -> DataFrame:
    return rows.withColumn("status", F.lit("rejected")).withColumn("reject_reason", F.lit(reason))


def purge(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows but those removed more than ``days`` ago."""
    return rows.filter(F.col("removed_at").isNull() | (F.col("removed_at") >= now - F.expr(f"INTERVAL {days} DAYS")))


def drop_orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def snapshot_id(day: date, source: str, taken: list[str]) -> str:
    """``snapshot_YYYYMMDD_{source}_V{n}`` with the next free n."""
    head = f"snapshot_{day:%Y%m%d}_{source}_V"
    return f"{head}{max((int(t[len(head):]) for t in taken if t.startswith(head) and t[len(head):].isdigit()), default=0) + 1}"


def chunk_ids(source: Column, document: Column, index: Column, scheme: str = "contract") -> Column:
    """``{doc}-chunk-{i:04d}``, or with ``scheme='source'`` ``{source}_{doc}_{i:04d}``."""
    number = F.lpad(index.cast("string"), 4, "0")
    return F.concat_ws("_", source, document.cast("string"), number) if scheme == "source" else F.concat(document.cast("string"), F.lit("-chunk-"), number)


class StageRunner:
    """Runs named stages in order, each written as Parquet below a folder; a finished stage is read, not repeated.

    Whether a stage is done is asked of the file system that Spark uses, so any store will do.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]) -> None:
        self.spark, self.folder, self.stages, self.events = spark, folder.rstrip("/"), stages, []

    def done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def run(self, first: str | None = None, last: str | None = None) -> DataFrame | None:
        """From ``first`` (which is repeated) to ``last``; earlier stages are read where they are done."""
        names = [n for n, _ in self.stages]
        begin, end = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
        now: DataFrame | None = None
        for k, (name, stage) in enumerate(self.stages[: end + 1]):
            path = f"{self.folder}/{name}"
            again = not self.done(name) or (first is not None and k >= begin)
            if again:
                stage(now).write.mode("overwrite").parquet(path)
            self.events.append(json.dumps({"stage": name, "state": "done" if again else "resumed"}))
            now = self.spark.read.parquet(path)
        return now
