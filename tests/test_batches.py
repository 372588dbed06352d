"""Atomic imports and upserts: killed and repeated steps give the same table."""

import pytest
from pyspark.sql import functions as F

from quillon.sources.batches import Batches, Snapshot

SCHEMA = "user_id long, key string, amount double"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ONE = [(1, "a", 1.0), (1, "b", 2.0), (1, "b", 2.0), (2, "a", 3.0)]
TWO = [(1, "b", 9.0), (1, "c", 4.0), (2, None, 5.0)]


def test_two_steps(spark, tmp_path):
    table = Batches(str(tmp_path / "t"), ("user_id", "key"))
    assert table.read(spark) is None
    table.stage(frame(spark, ONE), "2024-01")
    assert table.read(spark) is None
    assert sorted(r.is_duplicate for r in table.staged(spark, "2024-01").collect()) == [False, False, False, True]
    table.confirm(spark, "2024-01")
    table.stage(frame(spark, TWO), "7")
    assert {r.key: r.is_duplicate for r in table.staged(spark, "7").collect()} == {"b": True, "c": False, None: False}
    assert rows_of(table.read(spark)) == sorted(set(ONE))
    for _ in range(2):
        table.confirm(spark, "7")
    want = sorted([*set(ONE), (1, "c", 4.0), (2, None, 5.0)], key=str)
    assert sorted(map(tuple, table.read(spark).collect()), key=str) == want
    table.stage(frame(spark, TWO), "8")
    table.confirm(spark, "8")  # nothing new
    table.stage(frame(spark, [(5, "z", 1.0)]), "9")  # never confirmed
    assert sorted(map(tuple, table.read(spark).collect()), key=str) == want
    table.discard(spark, "9")
    with pytest.raises(Exception, match="id-9"):
        table.confirm(spark, "9")


def test_killed_between_the_steps(spark, tmp_path, monkeypatch):
    """The rows are written, the marker is not: nothing is seen, and the next run gives the table of an undisturbed one."""
    table = Batches(str(tmp_path / "t"), ("user_id", "key"))
    table.stage(frame(spark, ONE), "1")
    table.confirm(spark, "1")
    table.stage(frame(spark, TWO), "2")

    def dies(self, spark, batch):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Batches, "_mark", dies)
        with pytest.raises(KeyboardInterrupt):
            table.confirm(spark, "2")
    assert (tmp_path / "t" / "rows" / "batch=id-2").exists()
    assert rows_of(table.read(spark)) == sorted(set(ONE)) and not table.committed(spark, "2")
    # a marker whose file was not yet in place
    (tmp_path / "t" / "commits" / "batch=id-2" / "_temporary").mkdir(parents=True)
    assert rows_of(table.read(spark)) == sorted(set(ONE))
    table.confirm(spark, "2")
    other = Batches(str(tmp_path / "u"), ("user_id", "key"))
    for name, rows in (("1", ONE), ("2", TWO)):
        other.stage(frame(spark, rows), name)
        other.confirm(spark, name)
    assert sorted(map(tuple, table.read(spark).collect()), key=str) == sorted(map(tuple, other.read(spark).collect()), key=str)


def test_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    table = Snapshot(str(tmp_path / "s"), ("user_id", "key"), buckets=16)
    first = [(u, k, float(u)) for u in range(40) for k in "ab"]
    table.create(frame(spark, first))
    assert rows_of(table.read(spark)) == sorted(first)
    changes = [(1, "a", 100.0), (99, "new", 1.0)]
    done = table.upsert(frame(spark, changes), gone=frame(spark, [(2, "b", 0.0), (77, "none", 0.0)]))
    want = {(u, k): x for u, k, x in first} | {(u, k): x for u, k, x in changes}
    del want[2, "b"]
    assert rows_of(table.read(spark)) == sorted((*k, x) for k, x in want.items())
    assert done.buckets <= 4 and 0 < done.bytes_read < done.bytes_before / 2
    plan = table.read(spark, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "IN (3,5)" in plan
    # a version without its marker is not seen, and the next one writes over it
    table.read(spark).limit(0).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "s" / "rows" / f"version={done.version + 1}"))
    assert rows_of(table.read(spark)) == sorted((*k, x) for k, x in want.items())
    for u in range(40):
        want[u, "b"] = 7.0
    table.upsert(frame(spark, [(u, "b", 7.0) for u in range(40)]))
    assert rows_of(table.read(spark)) == sorted((*k, x) for k, x in want.items())
    table.replace(spark, table.read(spark), list(range(16)))
    assert table.vacuum(spark) >= 1 and rows_of(table.read(spark)) == sorted((*k, x) for k, x in want.items())
