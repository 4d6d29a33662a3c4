from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.history import compare_counts, row_changes
from tidemark.operators.quality import ObservedGate, QualityError, no_nulls, not_empty
from tidemark.operators.upsert import MergeSpec, union_rows
from tidemark.plans.incremental import Full, Range, Skip, plan_run, run_incremental
from tidemark.sources import catalog
from tidemark.sources.versioned import ConcurrentWriteError, VersionedTable

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROW = "k string, t int, v string"


def df(spark, *data):
    return spark.createDataFrame(list(data), ROW)


def test_append_time_travel_and_range(spark, path):
    table = VersionedTable(spark, path)
    assert not table.exists() and table.current() is None and table.watermark() is None
    for number in range(1, 4):
        assert table.append(df(spark, ("a", number, "x")), committed_at=T0 + timedelta(hours=number)) == number
    assert rows(table.read(), "t") == [(1,), (2,), (3,)]
    assert rows(table.read_as_of(2), "t") == [(1,), (2,)]
    assert rows(table.read_as_of(timestamp=T0 + timedelta(hours=2, minutes=59)), "t") == [(1,), (2,)]
    assert rows(table.read_between(1, 3), "t") == [(2,), (3,)]
    assert rows(table.read_between(None, 1), "t") == [(1,)]
    assert rows(table.history(), "snapshot_id", "added_records", "total_records") == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    assert rows(compare_counts(table)) == [("current", 3), ("previous", 2)]
    assert table.previous() == 2
    with pytest.raises(ValueError):
        table.read_as_of(9)
    with pytest.raises(ValueError):
        table.read_as_of(timestamp=T0)


def test_half_written_snapshot_stays_invisible_and_is_overwritten(spark, path):
    table = VersionedTable(spark, path)
    table.append(df(spark, ("a", 1, "x")))
    df(spark, ("lost", 9, "x")).write.parquet(f"{path}/data/snapshot_id=2")
    assert rows(table.read(), "k") == [("a",)]
    assert table.append(df(spark, ("b", 2, "y"))) == 2
    assert rows(table.read(), "k") == [("a",), ("b",)]


def files_read(found):
    """How many files the scan opened."""
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numFiles").value()


def test_range_read_opens_only_the_wanted_folders(spark, path):
    table = VersionedTable(spark, path)
    for number in range(4):
        table.append(df(spark, ("a", number, "x")).coalesce(1))
    assert files_read(table.read_between(1, 3)) == 2
    assert files_read(table.read()) == 4


def test_schema_evolution(spark, path):
    table = VersionedTable(spark, path)
    table.append(spark.createDataFrame([(1,)], "a int"))
    table.append(spark.createDataFrame([(2, "x")], "a int, b string"))
    table.append(spark.createDataFrame([(3,)], "a int"))
    assert rows(table.read()) == [(1, None), (2, "x"), (3, None)]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([("z",)], "a string"))


def test_replace_reads_its_own_old_version(spark, path):
    table = VersionedTable(spark, path)
    table.replace(df(spark, ("a", 1, "x")))
    table.replace(table.read().unionByName(df(spark, ("b", 2, "y"))))
    assert rows(table.read(), "k") == [("a",), ("b",)]
    assert rows(table.read_as_of(1), "k") == [("a",)]


def test_failing_gate_leaves_the_table_as_it_was(spark, path):
    gate = ObservedGate("t", no_nulls("k"))
    table = VersionedTable(spark, path, bucket_keys=["k"], buckets=4)
    table.replace(df(spark, ("a", 1, "x")), watermark=1, gate=gate)
    with pytest.raises(QualityError):
        table.replace(df(spark, (None, 2, "y")), watermark=2, gate=gate)
    with pytest.raises(QualityError):
        table.upsert(df(spark, (None, 2, "y")), ["t"], watermark=2, gate=gate)
    assert rows(table.read(), "k") == [("a",)]
    assert table.watermark() == 1


def test_gates_start_no_job_of_their_own(spark, path):
    data, context = df(spark, *[(f"k{i}", 1, "x") for i in range(20)]), spark.sparkContext

    def jobs(name, work):
        context.setJobGroup(name, name)
        work()
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(name))

    counts = {}
    for gated in (False, True):
        gate = ObservedGate("t", {**no_nulls("k"), **not_empty()}) if gated else None
        table = VersionedTable(spark, f"{path}/{gated}", bucket_keys=["k"], buckets=4)
        counts[gated] = [jobs(f"replace {gated}", lambda: table.replace(data, gate=gate)), jobs(f"upsert {gated}", lambda: table.upsert(data, ["t"], gate=gate))]
        assert gate is None or gate.metrics["row_count"] == 20
    assert counts[True] == counts[False]


def test_a_gate_on_no_rows(spark, path):
    table = VersionedTable(spark, path)
    for empty in (df(spark, ("a", 1, "x")).limit(0), spark.createDataFrame([], "k string, t int, v string")):
        with pytest.raises(QualityError, match="row_count=0"):
            table.replace(empty, gate=ObservedGate("t", not_empty()))
    assert not table.exists()


def test_upsert_rewrites_only_touched_buckets(spark, path):
    table = VersionedTable(spark, path, bucket_keys=["k"], buckets=8)
    table.replace(df(spark, *[(f"k{i}", 1, "old") for i in range(64)]), watermark=1)
    table.upsert(df(spark, ("k7", 2, "new"), ("k8", 0, "late"), ("extra", 1, "new")), ["t"], watermark=2)
    state = {r.k: r.v for r in table.read().collect()}
    assert len(state) == 65 and state["k7"] == "new" and state["k8"] == "old" and state["extra"] == "new"
    last = table.commits()[-1]
    assert len(last.buckets) <= 3 and last.watermark == 2
    assert last.summary["total-records"] == "65"
    assert rows(table.read_as_of(1).where("k = 'k7'"), "v") == [("old",)]


def test_bucket_files_are_sorted(spark, path):
    table = VersionedTable(spark, path, bucket_keys=["k"], buckets=2, sort_by=["t"])
    table.replace(df(spark, *[(f"k{i}", (i * 37) % 100, "x") for i in range(100)]))
    table.upsert(df(spark, *[(f"n{i}", (i * 37) % 100, "x") for i in range(100)]), ["t"])
    assert table.read().count() == 200
    for file in table.read().inputFiles():
        stored = [r.t for r in spark.read.parquet(file).collect()]
        assert stored == sorted(stored)


def test_empty_increment_moves_only_the_watermark(spark, path):
    table = VersionedTable(spark, path, bucket_keys=["k"], buckets=4)
    table.replace(df(spark, ("a", 1, "x")), watermark=1)
    assert table.upsert(df(spark, ("a", 1, "x")).where("false"), ["t"], watermark=5) is None
    assert table.watermark() == 5 and table.current() == 1


def test_repeated_stream_batch_is_skipped(spark, path):
    table = VersionedTable(spark, path)
    assert table.append(df(spark, ("a", 1, "x")), writer="w", batch_id=0) == 1
    assert table.append(df(spark, ("a", 1, "x")), writer="w", batch_id=0) is None
    assert table.append(df(spark, ("a", 1, "x")), writer="other", batch_id=0) == 2
    assert table.read().count() == 2 and table.last_batch("w") == 0


def test_second_writer_is_detected(spark, path):
    table = VersionedTable(spark, path)
    table.append(df(spark, ("a", 1, "x")))
    stale = table.commits()
    table.append(df(spark, ("b", 1, "x")))
    table._commit(stale, 2, "append", None, None, {}, df(spark, ("c", 1, "x")).schema, None)
    with pytest.raises(ConcurrentWriteError):
        table.commits()


def test_row_changes(spark):
    before = df(spark, ("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"))
    after = df(spark, ("a", 1, "x"), ("b", 2, "y"), ("d", 1, "x"))
    assert rows(row_changes(before, after, ["k"])) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_row_changes_sees_a_value_move_to_the_next_column(spark):
    columns = "k int, a string, b string"
    before = spark.createDataFrame([(1, None, "x")], columns)
    after = spark.createDataFrame([(1, "x", None)], columns)
    assert rows(row_changes(before, after, ["k"])) == [(1, "changed")]


def test_plan_run(spark, path):
    source = VersionedTable(spark, f"{path}/s")
    target = VersionedTable(spark, f"{path}/t", bucket_keys=["k"], buckets=2)
    assert isinstance(plan_run(source, target), Skip)
    source.append(df(spark, ("a", 1, "x")))
    assert plan_run(source, target) == Full(1, "first run")
    target.replace(source.read())  # a target without a watermark is rebuilt
    assert isinstance(plan_run(source, target), Full)
    target.mark(1)
    assert isinstance(plan_run(source, target), Skip)
    for number in range(3):
        source.append(df(spark, ("a", number, "x")))
    assert plan_run(source, target) == Range(1, 4)
    assert plan_run(source, target, max_snapshots=2) == Range(1, 3)
    assert isinstance(plan_run(source, target, full_refresh=True), Full)


def test_runs_are_repeatable_and_equal_a_full_refresh(spark, path):
    source = VersionedTable(spark, f"{path}/s")

    def transform(raw):
        from tidemark.operators.dedup import latest_by_key

        return latest_by_key(raw.where("k is not null"), ["k"], ["t"], ["v"])

    def run(target, **kwargs):
        return run_incremental("t", source, target, transform, ["t"], no_nulls("k"), **kwargs)

    folded = VersionedTable(spark, f"{path}/a", bucket_keys=["k"], buckets=4)
    batches = [
        [("a", 1, "1"), ("b", 1, "1")],
        [("a", 3, "3"), ("b", 0, "late")],
        [(None, 9, "tombstone")],
        [("a", 3, "3"), ("c", 1, "1")],
    ]
    modes = []
    for batch in batches:
        source.append(df(spark, *batch))
        modes.append(run(folded).mode)
        assert run(folded).mode == "skip"
    assert modes == ["full", "incremental", "incremental", "incremental"]
    assert folded.watermark() == 4
    whole = VersionedTable(spark, f"{path}/b", bucket_keys=["k"], buckets=4)
    assert run(whole, full_refresh=True).row_count == 3
    assert rows(folded.read()) == rows(whole.read()) == [("a", 3, "3"), ("b", 1, "1"), ("c", 1, "1")]


def test_catalog_watermark(spark):
    assert not catalog.table_exists(spark, "marked")
    spark.range(1).write.saveAsTable("marked")
    assert catalog.table_exists(spark, "marked")
    assert catalog.get_watermark(spark, "marked") is None
    catalog.set_watermark(spark, "marked", 42)
    assert catalog.get_watermark(spark, "marked") == 42
    spark.sql("DROP TABLE marked")


def test_create_table_as(spark, path):
    catalog.create_table_as(spark.range(3), "reported", f"{path}/reported")
    assert spark.table("reported").count() == 3
    assert spark.read.parquet(f"{path}/reported").count() == 3
    with pytest.raises(Exception, match="reported"):
        catalog.create_table_as(spark.range(3), "reported", f"{path}/reported")
    spark.sql("DROP TABLE reported")


def test_load_history(spark, path):
    table = VersionedTable(spark, path)
    data = spark.range(10).select("id", (F.col("id") % 2 + 1).alias("b"))
    assert table.load_history(data, "b") == [1, 2]
    assert table.read_between(1, 2).count() == 5
    with pytest.raises(ValueError):
        table.load_history(data, "b")


def test_history_of_few_batches_is_written_without_a_shuffle_of_its_rows(spark, path):
    data = spark.range(0, 40_000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") % 3 + 1).alias("b"))
    few, many = VersionedTable(spark, f"{path}/few"), VersionedTable(spark, f"{path}/many")
    setting = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
    few.load_history(data, "b")
    files = few.read().inputFiles()
    assert len(files) == 12  # a task and batch each: nothing was brought together
    many.load_history(data.withColumn("b", F.col("id") % 10 + 1), "b")
    assert len(many.read().inputFiles()) < 40
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == setting
    for table in (few, many):
        assert rows(table.read().agg(F.count("text"), F.sum("id"))) == [(40_000, 799_980_000)]
    assert [c.snapshot_id for c in few.commits()] == [1, 2, 3] and few.read_between(1, 2).count() == 13_333


def test_a_rewritten_bucket_is_shared_by_tasks(spark, path):
    table = VersionedTable(spark, path, bucket_keys=["k"], buckets=2)
    first = spark.range(20_000).selectExpr("cast(id as string) as k", "1 as t", "'old' as v")
    table.replace(first)
    both = table._clustered(union_rows(table.read().withColumn("bucket", F.lit(0)), first.withColumn("bucket", F.lit(0))), 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with rows enough for several tasks
    try:
        assert both.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    table.upsert(first.where("cast(k as int) % 2 = 0").selectExpr("k", "2 as t", "'new' as v"), ["t"])
    assert rows(table.read().groupBy("v").count()) == [("new", 10_000), ("old", 10_000)]
    assert table.read().columns == ["k", "t", "v"]


def test_entity_runs_merge_by_column_rules(spark, path):
    from tidemark.model import ORDERS
    from tidemark.plans.incremental import run_entity

    source = VersionedTable(spark, f"{path}/s")
    target = VersionedTable(spark, f"{path}/t", bucket_keys=["order_id"], buckets=4)
    fields = ", ".join(f"{n}: string" for n in ORDERS.columns)
    blank = dict.fromkeys(ORDERS.columns)

    def batch(*events):
        rows_ = [(op, {**blank, "order_id": key, "status": status}, ms) for op, key, status, ms in events]
        return spark.createDataFrame(rows_, f"op string, after struct<{fields}>, source_timestamp bigint")

    source.append(batch(("c", "1", "PENDING", 1000), ("c", "2", "PENDING", 1000)))
    assert run_entity(ORDERS, source, target).mode == "full"
    source.append(batch(("u", "1", "FILLED", 5000), ("c", "3", "PENDING", 6000), ("d", "2", None, 7000)))
    assert run_entity(ORDERS, source, target).mode == "incremental"
    found = target.read().select("order_id", "status", F.second("created_at"), F.second("updated_at"))
    assert rows(found) == [(1, "FILLED", 1, 5), (2, "PENDING", 1, 1), (3, "PENDING", 6, 6)]
    assert run_entity(ORDERS, source, target).mode == "skip"
    with pytest.raises(ValueError):
        target.merge(target.read(), MergeSpec(("status",)))


def test_late_events_do_not_overwrite_newer_rows(spark, path):
    from itertools import permutations

    from tidemark.model import ACCOUNTS
    from tidemark.plans.incremental import run_entity

    fields = ", ".join(f"{n}: string" for n in ACCOUNTS.columns)
    blank = dict.fromkeys(ACCOUNTS.columns)
    # (status, event time, offset): the third is as old as the second, but of a higher offset
    events = [("ACTIVE", 1000, 1), ("SUSPENDED", 5000, 2), ("CLOSED", 5000, 3)]
    for turn, order in enumerate(permutations(events)):
        source = VersionedTable(spark, f"{path}/s{turn}")
        target = VersionedTable(spark, f"{path}/t{turn}", bucket_keys=["account_id"], buckets=2)
        for status, at, offset in order:
            row = ("u", {**blank, "account_id": "7", "status": status}, at, offset)
            source.append(
                spark.createDataFrame([row], f"op string, after struct<{fields}>, source_timestamp bigint, offset bigint")
            )
            run_entity(ACCOUNTS, source, target, ("offset",))
        assert rows(target.read().select("account_id", "status")) == [(7, "CLOSED")]


def test_another_bucket_count_is_refused(spark, path):
    first = VersionedTable(spark, path, bucket_keys=["k"], buckets=4)
    data = spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("t"))
    first.upsert(data, ["t"])
    other = VersionedTable(spark, path, bucket_keys=["k"], buckets=8)
    with pytest.raises(ValueError, match="4 buckets"):
        other.upsert(data, ["t"])
    other.replace(first.read())
    other.upsert(data, ["t"])
    assert other.read().count() == 20
    with pytest.raises(ValueError, match="8 buckets"):
        first.upsert(data, ["t"])


def test_versions_are_filters_on_partitions(spark, path):
    table = VersionedTable(spark, path)
    for k in "abcd":
        table.append(df(spark, (k, 1, "x")))
    (df(spark, ("torn", 1, "x"))).write.parquet(f"{path}/data/snapshot_id=5")  # a write that was never committed
    assert rows(table.read(), "k") == [("a",), ("b",), ("c",), ("d",)]
    for found, ids in ((table.read_as_of(2), "ab"), (table.read_between(1, 3), "bc"), (table.read_between(None, 1), "a")):
        assert rows(found, "k") == [(k,) for k in ids]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(snapshot_id" in plan and "snapshot_id#" in plan
    table.replace(df(spark, ("e", 1, "x")))
    assert rows(table.read(), "k") == [("e",)] and rows(table.read_as_of(3), "k") == [("a",), ("b",), ("c",)]
