"""Upserted tables: every way of dividing rows into batches gives the result of one batch."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.upkeep import last_per_key
from tessera.streaming import append


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def table(spark, tmp_path, **how):
    return append.Upserted(spark, str(tmp_path / "table"), "k", "at", **{"buckets": 5, **how})


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, at long, v string")


def test_a_new_checkpoint_on_an_old_target_loses_nothing(spark, tmp_path):
    source, own = str(tmp_path / "in"), table(spark, tmp_path)
    first = frame(spark, [(k, 0, "old") for k in range(200)])
    first.repartition(2).write.parquet(source)
    append.in_streams([append.follow(spark, source, first.schema, 1)], own, str(tmp_path / "cp"))
    assert own.current().count() == 200 and len(own.versions()) == 2
    more = frame(spark, [(k, 1, "new") for k in range(100, 300)])
    more.coalesce(1).write.parquet(str(tmp_path / "more"))
    now = append.in_streams([append.follow(spark, str(tmp_path / "more"), first.schema, 1)], own, str(tmp_path / "cp"))
    assert rows_of(now) == rows_of(last_per_key(first.union(more), "k", "at"))
    # the same files under one more checkpoint
    again = append.in_streams([append.follow(spark, source, first.schema, 1)], own, str(tmp_path / "cp"))
    assert rows_of(again) == rows_of(last_per_key(first.union(more), "k", "at"))


def test_a_failed_batch_leaves_nothing_and_runs_again(spark, tmp_path, monkeypatch):
    own = table(spark, tmp_path)
    own.write(frame(spark, [(1, 1, "a"), (2, 1, "a")]))
    with monkeypatch.context() as m:
        m.setattr(own, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            own.write(frame(spark, [(2, 2, "b"), (3, 1, "b"), (4, 1, "never")]))
    assert rows_of(own.current()) == [(1, 1, "a"), (2, 1, "a")]
    own.write(frame(spark, [(2, 2, "b"), (3, 1, "b")]))
    assert rows_of(own.current()) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "b")]


def test_late_and_repeated_rows_in_any_order(spark, tmp_path):
    rows = [(k % 7, at, f"{k} {at}") for k in range(20) for at in range(3)] + [(None, 1, "x"), (None, None, "y"), (3, None, None)]
    want = rows_of(last_per_key(frame(spark, rows), "k", "at"))
    for seed, batches in ((0, 2), (1, 4)):
        own = append.Upserted(spark, str(tmp_path / f"t{seed}"), "k", "at", buckets=3, most=2)
        dealt = [rows[(i * 7 + seed) % batches :: batches] for i in range(batches)]
        for some in [*dealt, dealt[0]]:
            own.write(frame(spark, some))
        assert rows_of(own.current()) == want


def test_buckets_are_merged_and_old_versions_removed(spark, tmp_path):
    own = table(spark, tmp_path, most=2, keep=2)
    for at in range(6):
        own.write(frame(spark, [(k, at, f"v{at}") for k in range(12)]))
    buckets, made_of = own.log(own.versions()[-1])
    assert buckets == 5 and max(map(len, made_of.values())) <= 2
    assert len(own.versions()) == 2
    needed = {v for c in own.versions() for vs in own.log(c)[1].values() for v in vs}
    assert {int(n.split("=")[1]) for n in os.listdir(tmp_path / "table" / "data")} == needed
    assert rows_of(own.current()) == [(k, 5, "v5") for k in sorted(range(12), key=str)]
    assert own.current(own.versions()[0]) is not None and own.current(0) is None


def test_only_touched_buckets_are_written(spark, tmp_path):
    own = table(spark, tmp_path)
    own.write(frame(spark, [(k, 0, "a") for k in range(50)]))
    version = own.write(frame(spark, [(7, 1, "b")]))
    assert len(own._touched(version)) == 1 and own.current().filter("v = 'b'").count() == 1
    # the number of buckets is the table's, whatever a later writer asks for
    other = append.Upserted(spark, own.target, "k", "at", buckets=64)
    other.write(frame(spark, [(8, 1, "c")]))
    assert other.log(other.versions()[-1])[0] == 5 and other.current().count() == 50


def test_gone_rows_and_empty_batches(spark, tmp_path):
    own = append.Upserted(spark, str(tmp_path / "t"), "k", "at", buckets=2, gone="gone")
    assert own.current() is None
    made = lambda rows: spark.createDataFrame(rows, "k long, at long, gone boolean")
    own.write(made([]))
    assert own.current() is None
    own.write(made([(1, 1, False), (2, 1, None)]))
    own.write(made([(1, 2, True), (2, 0, True)]))
    own.write(made([]))
    assert [r.k for r in own.current().collect()] == [2]
    own.write(made([(1, 3, False)]))
    assert sorted(r.k for r in own.current().collect()) == [1, 2]


def test_events_in_two_streams(spark):
    from tessera.plans import upkeep

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = last_per_key(events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts").select("user_id", "event_id", "event_type", "value")
    assert rows_of(upkeep.event_upserts(spark, sf)) == rows_of(want)
    assert events.filter(F.col("event_id") % 3 == 0).count() < events.count()


def test_a_document_that_comes_again_replaces_its_chunks(spark, tmp_path):
    from tessera.operators.builds import stand_in_vector
    from tessera.streaming import build

    docs = append.Upserted(spark, str(tmp_path / "t"), "k", "at", buckets=2)
    made = lambda rows: build.chunked(frame(spark, rows), "k", "v", "at", lambda t: F.filter(F.split(t, " "), lambda x: x != ""), lambda t: stand_in_vector(t, 3))
    docs.write(made([(1, 1, "a b c"), (2, 1, "x"), (3, 1, None)]))
    docs.write(made([(1, 2, "only")]))
    docs.write(made([(2, 0, "late and long")]))
    rows = sorted((r.chunk_id, r.text, len(r.embedding)) for r in build.chunk_rows(docs.current(), "k").collect())
    assert rows == [("1-chunk-0000", "only", 3), ("2-chunk-0000", "x", 3)]
    assert sorted(map(tuple, build.manifest(docs.current(), "k").collect())) == [(1, 1, 4, 3), (2, 1, 1, 3), (3, 0, 0, 0)]
