"""Positions from a stream of executions, what it leaves on disk, and versions that a table gives up."""

from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.trading import build_positions
from tidemark.session import SHUFFLE_CLEANUP, shared_folder, shuffles_released, staging
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming.positions import current_positions, position_deltas, position_stream

LOG = "trade_id bigint, order_id bigint, instrument_id bigint, quantity decimal(18,4), price decimal(18,4), executed_at timestamp, version int"
START = datetime(2026, 3, 2, 10)


def execution(number, version=1, quantity=1, hours=0):
    return (number, number % 5, number % 3, Decimal(quantity), Decimal(number + version), START + timedelta(hours=number + hours), version)


def files(spark, path, *batches):
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, LOG).coalesce(1).write.parquet(f"{path}/in/{number}")


def stored(path):
    return sum(1 for f in Path(path).rglob("*.parquet"))


def fold(spark, path, **options):
    orders = spark.range(4).select(F.col("id").alias("order_id"), (F.col("id") % 2).alias("account_id"), F.lit("BUY").alias("side"))
    orders.write.mode("ignore").parquet(f"{path}/orders")
    orders = spark.read.parquet(f"{path}/orders")

    def executions(log):
        return log.join(orders, "order_id").withColumn("position_date", F.to_date("executed_at"))

    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    state = VersionedTable(spark, f"{path}/state", bucket_keys=["trade_id"], buckets=4)
    positions = position_deltas(spark, f"{path}/positions", executions(spark.read.schema(LOG).parquet(f"{path}/in/*")), "year")
    stream = position_stream(log, state, positions, f"{path}/checkpoint", ["version"], transform=executions, available_now=True, **options)
    stream.awaitTermination()
    return state, current_positions(positions), orders


def batches():
    first = [execution(n) for n in range(40)]
    return first, [*first[:20], execution(3, 2, quantity=7), execution(8, 2, hours=30)], first[10:], [execution(3), execution(8, 3, hours=-2)]


def newest():
    found = {}
    for row in (r for batch in batches() for r in batch):
        found[row[0]] = max(found.get(row[0], row), row, key=lambda r: r[-1])
    return list(found.values())


def same(spark, found, orders):
    return rows(found) == rows(build_positions(spark.createDataFrame(newest(), LOG), orders))


def test_a_batch_leaves_neither_staged_rows_nor_shuffles_nor_old_versions(spark, path):
    files(spark, path, *batches())
    held = {p.name for p in Path(shared_folder(spark)).glob("tidemark/*")}
    before = spark.conf.get(SHUFFLE_CLEANUP)
    state, found, orders = fold(spark, path, versions=1)
    assert same(spark, found, orders)
    assert {p.name for p in Path(shared_folder(spark)).glob("tidemark/*")} == held
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    assert rows(state.read(), "trade_id") == sorted([(n,) for n in range(40) if n % 5 < 4], key=repr)
    live = {f.removeprefix("file://") for f in state.read().inputFiles()}
    assert {str(f) for f in Path(f"{path}/state/data").rglob("*.parquet")} == live
    with pytest.raises(ValueError, match="given up"):
        state.read_as_of(1)


def test_rows_delivered_again_are_not_rewritten_and_all_versions_stay_by_default(spark, path):
    files(spark, path, *batches())
    state, found, orders = fold(spark, path)
    assert same(spark, found, orders)
    assert rows(state.history(), "snapshot_id", "added_records", "total_records") == [(1, 32, 32), (2, 2, 32), (3, 1, 32)]
    assert state.last_batch("positions") == 3  # the third batch had nothing new
    assert rows(state.read_as_of(1).where("trade_id = 3"), "version") == [(1,)]


def test_images_and_measures_keep_only_what_is_read(spark, path):
    files(spark, path, batches()[0])
    fold(spark, path)
    images = spark.read.parquet(f"{path}/positions/images").columns
    assert not {"order_id", "version"} & set(images) and {"trade_id", "sign"} <= set(images)
    measures = spark.read.parquet(f"{path}/positions/measures").columns
    assert [c for c in measures if c.endswith("_place")] == ["last_price_place"]
    assert all("zstd" in f.name for f in Path(f"{path}/positions").rglob("*.parquet"))


def table(spark, path, *versions):
    found = VersionedTable(spark, path, bucket_keys=["k"], buckets=8)
    for number, keys in enumerate(versions):
        found.upsert(spark.createDataFrame([(k, number) for k in keys], "k int, v int"), ["v"])
    return found


def test_expire_keeps_what_newer_versions_use(spark, path):
    found = table(spark, path, range(30), [1], [2], [1, 2])
    whole = [rows(found.read_as_of(n)) for n in (3, 4)]
    found.expire(2)
    assert [rows(found.read_as_of(n)) for n in (3, 4)] == whole
    assert rows(found.read()) == whole[1]
    for version in (1, 2):
        with pytest.raises(ValueError, match="given up"):
            found.read_as_of(version)
    found.expire()
    found.expire()
    assert rows(found.read()) == whole[1]
    found.upsert(spark.createDataFrame([(77, 9)], "k int, v int"), ["v"])
    assert found.current() == 5 and rows(found.read()) == sorted([*whole[1], (77, 9)], key=repr)
    assert rows(found.history(), "total_records") == [(30,)] * 4 + [(31,)]


def test_expire_finishes_what_a_dead_run_began_and_leaves_uncommitted_folders(spark, path, monkeypatch):
    found = table(spark, path, range(30), range(30))
    with monkeypatch.context() as broken:
        broken.setattr("tidemark.sources.versioned.delete_folder", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            found.expire()
    spark.range(1).write.parquet(f"{path}/data/snapshot_id=3/bucket=0")
    assert stored(f"{path}/data/snapshot_id=1") and rows(found.read(), "v") == [(1,)] * 30
    found.expire()
    assert not Path(f"{path}/data/snapshot_id=1").exists() and Path(f"{path}/data/snapshot_id=3").exists()
    assert rows(found.read(), "v") == [(1,)] * 30


def test_expire_is_for_buckets(spark, path):
    with pytest.raises(ValueError):
        VersionedTable(spark, path).expire()
    with pytest.raises(ValueError):
        VersionedTable(spark, path, bucket_keys=["k"]).expire(0)


def test_shuffles_are_released_and_staged_rows_deleted(spark, path):
    def shuffles():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(local.apply(i).getName()) for i in range(local.length()) if str(local.apply(i).getName()).endswith(".data")}

    before = shuffles()
    with shuffles_released(spark), staging(spark.range(1000).groupBy((F.col("id") % 50).alias("g")).count(), "counted") as counted:
        assert counted.count() == 50
        folder = Path(counted.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.exists()
    for _ in range(50):
        if not shuffles() - before:
            break
        spark.sparkContext._jvm.Thread.sleep(100)
    assert not shuffles() - before
