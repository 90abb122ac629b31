"""Incremental builds as streams: new files are upserted, stale sessions are found by timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.upkeep import last_per_key


def follow(spark: SparkSession, source: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)


class Upserted:
    """A table of the last row per key, kept in a folder as buckets of keys in versions, with a log of commits.

    ``data/version=v/bucket=b`` holds rows, ``commits/version=v`` one row: for each
    bucket the versions that make it up.  A commit becomes visible with that one file,
    so a write that fails leaves nothing behind but folders that no commit names, and
    the next write of the version replaces them.  The next version follows from the
    table's own log, never from a stream's batch number: a new checkpoint on an old
    table goes on where the table is.

    A batch adds its rows as one more version of the buckets it touches; a bucket of
    more than ``most`` versions is merged into one.  Of a key the row that is largest
    by ``order`` (then by the other columns) counts, whichever came first, hence rows
    that are late or come again change nothing, and any division into batches gives
    the result of one.  A key whose largest row has ``gone`` true is not in the table.
    One writer at a time is assumed; readers of an earlier version are safe for
    ``keep`` commits, what is older is removed.

    A null key is a key; null orders come before all others.
    """

    def __init__(self, spark: SparkSession, target: str, key: str, order: str, buckets: int = 64, most: int = 8, keep: int = 3, gone: str | None = None) -> None:
        self.spark, self.target, self.key, self.order = spark, target.rstrip("/"), key, order
        self.buckets, self.most, self.keep, self.gone = buckets, most, keep, gone

    # -- the log

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.target, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        """Names of the folders in a folder."""
        files, path = self._path(*parts)
        return [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []

    def versions(self) -> list[int]:
        """Committed versions, the oldest first; a folder without its file is no commit."""
        found = []
        for name in self._names("commits"):
            files, path = self._path("commits", name)
            if name.startswith("version=") and any(s.getPath().getName().endswith(".parquet") for s in files.listStatus(path)):
                found.append(int(name.removeprefix("version=")))
        return sorted(found)

    def log(self, version: int) -> tuple[int, dict[int, list[int]]]:
        """Number of buckets, and each bucket's versions, as of a commit."""
        row = self.spark.read.parquet(f"{self.target}/commits/version={version}").head()
        return row.buckets, {b: list(v) for b, v in row.made_of.items()}

    def _commit(self, version: int, buckets: int, made_of: dict[int, list[int]]) -> None:
        row = self.spark.createDataFrame([(buckets, made_of)], "buckets int, made_of map<int, array<long>>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.target}/commits/version={version}")

    # -- reading

    def _read(self, made_of: dict[int, list[int]], only: Iterable[int] | None = None) -> DataFrame | None:
        paths = [f"{self.target}/data/version={v}/bucket={b}" for b, vs in made_of.items() if only is None or b in only for v in vs]
        return self.spark.read.parquet(*paths) if paths else None

    def current(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a commit, by default the last; None where nothing was ever written."""
        done = self.versions()
        if not done or (version is not None and version not in done):
            return None
        rows = self._read(self.log(done[-1] if version is None else version)[1])
        rows = last_per_key(rows, self.key, self.order)
        return rows if self.gone is None else rows.filter(~F.coalesce(self.gone, F.lit(False)))

    # -- writing

    def write(self, batch: DataFrame) -> int:
        """Adds the rows of a batch; gives the version that then holds."""
        done = self.versions()
        version = done[-1] + 1 if done else 0
        buckets, made_of = self.log(done[-1]) if done else (self.buckets, {})
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        self._put(version, last_per_key(batch, self.key, self.order).withColumn("bucket", bucket))
        touched = self._touched(version)
        if not touched:
            return version - 1
        made_of |= {b: [*made_of.get(b, []), version] for b in touched}
        self._commit(version, buckets, made_of)
        large = {b for b, vs in made_of.items() if len(vs) > self.most}
        if large:
            merged = last_per_key(self._read(made_of, large), self.key, self.order)
            version += 1
            self._put(version, merged.withColumn("bucket", bucket))
            self._commit(version, buckets, made_of | dict.fromkeys(self._touched(version), [version]))
        self._clean()
        return version

    def _put(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.target}/data/version={version}")

    def _touched(self, version: int) -> list[int]:
        return [int(n.removeprefix("bucket=")) for n in self._names("data", f"version={version}") if n.startswith("bucket=")]

    def _clean(self) -> None:
        """Removes commits but the last ``keep``, and folders that none of these names."""
        done = self.versions()
        for version in done[: -self.keep]:
            files, path = self._path("commits", f"version={version}")
            files.delete(path, True)
        needed = {(v, b) for c in done[-self.keep :] for b, vs in self.log(c)[1].items() for v in vs}
        kept = {v for v, _ in needed}
        for name in self._names("data"):
            version = int(name.removeprefix("version="))
            if version > done[-1]:
                continue
            gone = [name] if version not in kept else [f"{name}/bucket={b}" for b in self._touched(version) if (version, b) not in needed]
            for folder in gone:
                files, path = self._path("data", folder)
                files.delete(path, True)


def upsert_stream(rows: DataFrame, table: Upserted, checkpoint: str) -> StreamingQuery:
    """Keeps an upserted table up to date with a stream of rows.

    A batch that runs again, after a failure or under a new checkpoint, finds its
    rows there already: the result is that of every row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.write(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_streams(parts: Iterable[DataFrame], table: Upserted, checkpoints: str, within: int = 600) -> DataFrame:
    """The table after some streams one after another, each under a checkpoint of its own."""
    for rows in parts:
        query = upsert_stream(rows, table, f"{checkpoints}/{uuid.uuid4().hex}")
        if not query.awaitTermination(within):
            query.stop()
            raise TimeoutError(f"the stream has not ended within {within} s")
    return table.current()


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events per window and kind, with a watermark; the same plan in batch and in a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions per user: a job whose session has ended is stale."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(
        user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )
