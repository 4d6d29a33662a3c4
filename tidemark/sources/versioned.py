"""Versioned Parquet datasets: append, replace, bucket-wise upsert and merge, time travel, watermarks.

Layout, all written by ordinary Spark jobs:

    <path>/data/snapshot_id=N/              rows of an append or replace commit
    <path>/data/snapshot_id=N/bucket=B/     rows of bucket B, for tables with buckets
    <path>/ledger/                          one JSON row per commit

Data is written first and becomes visible with its ledger row, which also carries the watermark:
a job that dies half way leaves nothing visible, and its next run overwrites the same folder.
There is one writer per table, as with one sink task per topic; a second one is detected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import ObservedGate
from tidemark.operators.upsert import MergeSpec, merge_union, newest_of_union, union_rows
from tidemark.session import COMPRESSION, delete_folder, hadoop_path, work_dir

SNAPSHOT = "snapshot_id"
BUCKET = "bucket"
LEDGER_SCHEMA = (
    "seq long, snapshot_id long, committed_at timestamp, operation string, buckets array<int>, "
    "watermark long, summary map<string,string>, schema string"
)
LEDGER_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
DATA_OPERATIONS = ("append", "replace", "upsert")
EXPIRE = "expire"
SLICE = "__slice"
#: Up to so many batches `load_history` writes from the tasks that read them, which hold a file of each open: no shuffle, no sort.
FEW_BATCHES = 4
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class ConcurrentWriteError(RuntimeError):
    """Two writers committed to one table at the same time."""


@dataclass(frozen=True)
class Commit:
    seq: int
    snapshot_id: int
    committed_at: datetime
    operation: str
    buckets: tuple[int, ...] | None = None
    watermark: int | None = None
    summary: dict = field(default_factory=dict)
    schema: str | None = None


class VersionedTable:
    """One dataset. With `bucket_keys`, rows are spread over `buckets` folders by key hash, and an
    upsert rewrites only the folders its keys fall into. Choose `buckets` so that one bucket is a
    few hundred MB: it is the unit that is rewritten. The ledger keeps the number; an upsert with another one
    is refused, and `replace` changes it. Files are sorted by `sort_by`, so that a filter on
    those columns, such as a time range, skips most row groups of every bucket.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        *,
        bucket_keys: Sequence[str] = (),
        buckets: int = 16,
        sort_by: Sequence[str] = (),
    ):
        self.spark = spark
        self.sort_by = tuple(sort_by)
        self.path = path.rstrip("/")
        self.bucket_keys = tuple(bucket_keys)
        self.buckets = buckets

    # ------------------------------------------------------------------ ledger

    def ledger(self) -> DataFrame:
        """The commits as a DataFrame; empty when the table does not exist yet."""
        if not self._ledger_present():
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        reader = self.spark.read.schema(LEDGER_SCHEMA).option("timestampFormat", LEDGER_TIME)
        return reader.json(f"{self.path}/ledger")

    def commits(self) -> list[Commit]:
        """The commits in order. Metadata only: one short row per commit."""
        rows = sorted(self.ledger().collect(), key=lambda r: r.seq)
        if len({r.seq for r in rows}) != len(rows):
            raise ConcurrentWriteError(f"{self.path} has two commits with the same number")
        return [
            Commit(
                r.seq,
                r.snapshot_id,
                r.committed_at,
                r.operation,
                tuple(r.buckets) if r.buckets is not None else None,
                r.watermark,
                dict(r.summary or {}),
                r.schema,
            )
            for r in rows
        ]

    def snapshots(self) -> DataFrame:
        """Snapshots, newest first."""
        return (
            self.ledger()
            .where(F.col("operation").isin(*DATA_OPERATIONS))
            .select(SNAPSHOT, "committed_at", "operation", "summary")
            .orderBy(F.desc(SNAPSHOT))
        )

    def history(self) -> DataFrame:
        """Rows added by, and held after, each snapshot; oldest first."""
        return (
            self.ledger()
            .where(F.col("operation").isin(*DATA_OPERATIONS))
            .select(
                SNAPSHOT,
                "committed_at",
                "operation",
                F.element_at("summary", "added-records").cast("bigint").alias("added_records"),
                F.element_at("summary", "total-records").cast("bigint").alias("total_records"),
            )
            .orderBy(SNAPSHOT)
        )

    def exists(self) -> bool:
        return bool(self._data_commits())

    def current(self) -> int | None:
        """Newest snapshot id, None for an empty or missing table."""
        commits = self._data_commits()
        return commits[-1].snapshot_id if commits else None

    def previous(self) -> int | None:
        commits = self._data_commits()
        return commits[-2].snapshot_id if len(commits) > 1 else None

    def snapshot_at(self, when: datetime) -> int | None:
        """Newest snapshot committed at or before `when`."""
        ids = [c.snapshot_id for c in self._data_commits() if c.committed_at <= _naive_local(when)]
        return ids[-1] if ids else None

    def watermark(self) -> int | None:
        """Last source snapshot folded into this table."""
        marks = [c.watermark for c in self.commits() if c.watermark is not None]
        return marks[-1] if marks else None

    def last_batch(self, writer: str) -> int | None:
        """Last streaming batch the named writer committed."""
        batches = [int(c.summary["batch-id"]) for c in self.commits() if c.summary.get("writer") == writer]
        return max(batches) if batches else None

    # ------------------------------------------------------------------- reads

    def read(self, *, with_snapshot: bool = False) -> DataFrame:
        return self.read_as_of(with_snapshot=with_snapshot)

    def read_as_of(
        self, version: int | None = None, timestamp: datetime | None = None, *, with_snapshot: bool = False
    ) -> DataFrame:
        """The table as of a snapshot id or a point in time; by default as of now."""
        if timestamp is not None:
            version = self.snapshot_at(timestamp)
            if version is None:
                raise ValueError(f"{self.path} has no snapshot at or before {timestamp}")
        everything = self.commits()
        commits = [c for c in everything if c.operation in DATA_OPERATIONS]
        if version is not None:
            self._known_schema(commits)
            if version not in {c.snapshot_id for c in commits}:
                raise ValueError(f"{self.path} has no snapshot {version}")
            if version < _oldest_kept(everything):
                raise ValueError(f"{self.path} has given up snapshot {version}")
            commits = [c for c in commits if c.snapshot_id <= version]
        if self.bucket_keys:
            return self._load(commits, _live_folders(commits), with_snapshot)
        replaced = [c.snapshot_id for c in commits if c.operation == "replace"]
        return self._snapshots(commits, max(replaced, default=0), max((c.snapshot_id for c in commits), default=0), with_snapshot)

    def read_between(self, start: int | None, end: int, *, with_snapshot: bool = False) -> DataFrame:
        """Rows appended after snapshot `start` up to and including `end`."""
        commits = [c for c in self._data_commits() if c.snapshot_id <= end]
        wanted = [c for c in commits if start is None or c.snapshot_id > start]
        if any(c.operation != "append" for c in wanted):
            raise ValueError("a range read needs append-only snapshots; read the whole table instead")
        return self._snapshots(commits, 0 if start is None else start + 1, end, with_snapshot)

    def _snapshots(self, commits: list[Commit], first: int, last: int, with_snapshot: bool) -> DataFrame:
        """The rows of snapshots `first` to `last`: the data is a plain table partitioned by snapshot, and this a filter on partitions.

        What a failed write has left behind has a later number than any commit.
        """
        schema = self._known_schema(commits)
        full = T.StructType([*schema.fields, T.StructField(SNAPSHOT, T.LongType())])
        rows = self.spark.read.schema(full).parquet(f"{self.path}/data").where(F.col(SNAPSHOT).between(first, last))
        return rows if with_snapshot else rows.drop(SNAPSHOT)

    def _known_schema(self, commits: list[Commit]) -> T.StructType:
        schema = self._schema(commits)
        if schema is None:
            raise ValueError(f"{self.path} does not exist")
        return schema

    # ------------------------------------------------------------------ writes

    def append(
        self,
        df: DataFrame,
        *,
        watermark: int | None = None,
        writer: str | None = None,
        batch_id: int | None = None,
        committed_at: datetime | None = None,
    ) -> int | None:
        """Append one snapshot. A streaming batch the writer already committed is skipped; a stream that
        starts over with a new checkpoint numbers its batches anew and needs a new writer name.

        New columns are added to the table's schema; rows without them read as NULL.
        """
        if self.bucket_keys:
            raise ValueError("append is for tables without buckets; use upsert")
        commits = self.commits()
        if writer is not None and _batch_done(commits, writer, batch_id):
            return None
        snapshot = _next_snapshot(commits)
        merged = _merge_schemas(self._schema(commits), df.schema)
        _writer(df).mode("overwrite").parquet(f"{self.path}/data/{_folder(snapshot)}")
        added = self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{_folder(snapshot)}").count()
        summary = _summary(added, _total(commits) + added, writer, batch_id)
        self._commit(commits, snapshot, "append", None, watermark, summary, merged, committed_at)
        return snapshot

    def load_history(self, df: DataFrame, batch: str, committed_at: str | None = None) -> list[int]:
        """Fill a new table with rows that already carry batch numbers: one job, one snapshot per number.

        `committed_at` names a column whose newest value per batch becomes the commit time. Rows of many batches are brought together
        by batch first, so that files stay few.
        """
        if self.commits():
            raise ValueError(f"{self.path} already has commits")
        rows = df.withColumnRenamed(batch, SNAPSHOT).withColumn(SNAPSHOT, F.col(SNAPSHOT).cast("bigint"))
        schema = T.StructType([f for f in rows.schema.fields if f.name != SNAPSHOT])
        target = f"{self.path}/data"
        few = rows.select(SNAPSHOT).distinct().limit(FEW_BATCHES + 1).count() <= FEW_BATCHES
        before = self.spark.conf.get(WRITERS, "0")
        try:
            if few:
                self.spark.conf.set(WRITERS, str(FEW_BATCHES))
            else:
                rows = rows.hint("rebalance", SNAPSHOT)
            _writer(rows).mode("overwrite").partitionBy(SNAPSHOT).parquet(target)
        finally:
            self.spark.conf.set(WRITERS, before)
        newest = F.max(committed_at) if committed_at else F.current_timestamp()
        loaded = (
            self.spark.read.schema(T.StructType([*schema.fields, T.StructField(SNAPSHOT, T.LongType())]))
            .parquet(target)
            .groupBy(SNAPSHOT)
            .agg(F.count(F.lit(1)).alias("n"), newest.cast("timestamp").alias("at"))
            .orderBy(SNAPSHOT)
            .collect()
        )
        entries, total = [], 0
        for seq, row in enumerate(loaded):
            total += row["n"]
            text = schema.json() if seq == 0 else None
            entries.append((seq, row[SNAPSHOT], row["at"], "append", None, None, _summary(row["n"], total), text))
        if entries:
            self._write_ledger(entries)
        return [row[SNAPSHOT] for row in loaded]

    def replace(
        self,
        df: DataFrame,
        *,
        watermark: int | None = None,
        gate: ObservedGate | None = None,
        committed_at: datetime | None = None,
    ) -> int:
        """Create or replace the whole content. `gate` watches the rows as they are written, before they are
        published; when it raises, readers keep the old version.
        """
        commits = self.commits()
        snapshot = _next_snapshot(commits)
        target = f"{self.path}/data/{_folder(snapshot)}"
        df = gate.watch(df) if gate is not None else df
        if self.bucket_keys:
            self._write_buckets(self._with_bucket(df).hint("rebalance", BUCKET), target)
            staged = self.spark.read.schema(_plus_bucket(df.schema)).parquet(target)
            counts = {r[BUCKET]: r["n"] for r in staged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
            added, buckets = sum(counts.values()), sorted(counts)
        else:
            _writer(df).mode("overwrite").parquet(target)
            staged = self.spark.read.schema(df.schema).parquet(target)
            added, buckets = staged.count(), None
        if gate is not None:
            gate.check()
        summary = _summary(added, added) | self._bucket_note()
        self._commit(commits, snapshot, "replace", buckets, watermark, summary, df.schema, committed_at)
        return snapshot

    def upsert(
        self,
        increment: DataFrame,
        order_by: Sequence[str],
        tie_breakers: Sequence[str] = (),
        **options,
    ) -> int | None:
        """Fold an increment in, newest row per key, rewriting only the buckets it touches.

        The increment must be unique by key. Options are those of `merge`.
        """
        keys = [BUCKET, SLICE, *self.bucket_keys]
        return self._rewrite(increment, lambda both, _: newest_of_union(both, keys, order_by, tie_breakers), **options)

    def merge(self, increment: DataFrame, spec: MergeSpec, **options) -> int | None:
        """MERGE an increment by the column rules of `spec`, rewriting only the buckets it touches.

        The increment must be unique by key, and the spec's keys must be the bucket keys.
        Options: `watermark`, `gate`, `writer` and `batch_id`, `committed_at`.
        """
        if tuple(spec.keys) != self.bucket_keys:
            raise ValueError(f"the merge key {spec.keys} is not the bucket key {self.bucket_keys}")
        return self._rewrite(increment, lambda both, schema: merge_union(both, schema, spec, [BUCKET, SLICE]), **options)

    def _rewrite(
        self,
        increment: DataFrame,
        combine: Callable[[DataFrame, T.StructType], DataFrame],
        *,
        watermark: int | None = None,
        gate: ObservedGate | None = None,
        writer: str | None = None,
        batch_id: int | None = None,
        committed_at: datetime | None = None,
    ) -> int | None:
        """Combine the stored rows of the touched buckets with the increment into new bucket folders.

        The increment is computed once: it is staged in the shared folder, and checked by `gate` on the way.
        Without rows nothing is written, but the watermark still moves.
        """
        if not self.bucket_keys:
            raise ValueError("this needs a table with bucket_keys")
        commits = self.commits()
        self._check_buckets(commits)
        if writer is not None and _batch_done(commits, writer, batch_id):
            return None
        staging = work_dir(self.spark, "staged")
        try:
            _writer(self._with_bucket(gate.watch(increment) if gate is not None else increment)).parquet(staging)
            staged = self.spark.read.schema(_plus_bucket(increment.schema)).parquet(staging)
            if gate is not None:
                gate.check()
            incoming = {r[BUCKET]: r["n"] for r in staged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
            if not incoming:
                self._commit_mark(commits, watermark, writer, batch_id, committed_at)
                return None
            snapshot = _next_snapshot(commits)
            target = f"{self.path}/data/{_folder(snapshot)}"
            touched = sorted(incoming)
            live = _live_folders([c for c in commits if c.operation in DATA_OPERATIONS])
            stored_folders = [f for f in live if int(f.rsplit("=", 1)[1]) in incoming]
            merged_schema = _merge_schemas(self._schema(commits), increment.schema)
            if stored_folders:
                stored = self._parquet(stored_folders, _plus_bucket(merged_schema))
            else:
                stored = self.spark.createDataFrame([], _plus_bucket(merged_schema))
            both = self._clustered(union_rows(stored, staged), len(touched))
            self._write_buckets(combine(both, merged_schema).drop(SLICE), target)
            before = stored.count()
            after = self.spark.read.schema(_plus_bucket(merged_schema)).parquet(target).count()
            summary = _summary(sum(incoming.values()), _total(commits) - before + after, writer, batch_id)
            summary |= self._bucket_note()
            self._commit(commits, snapshot, "upsert", touched, watermark, summary, merged_schema, committed_at)
            return snapshot
        finally:
            delete_folder(self.spark, staging)

    def mark(self, watermark: int) -> None:
        """Move the watermark without writing data."""
        self._commit_mark(self.commits(), watermark, None, None, None)

    def expire(self, keep: int = 1) -> None:
        """Give up all snapshots but the newest `keep`: the bucket folders that none of these uses are deleted.

        The ledger says so first, and reads as of older snapshots are refused from then on.
        What a run that died has left is deleted by the next one.
        """
        if not self.bucket_keys or keep < 1:
            raise ValueError("expire is for tables with bucket_keys, and keeps at least one snapshot")
        commits = self.commits()
        data = [c for c in commits if c.operation in DATA_OPERATIONS]
        if not data:
            return
        oldest = data[-keep:][0].snapshot_id
        if oldest > _oldest_kept(commits):
            self._write_ledger([(len(commits), oldest, datetime.now(timezone.utc), EXPIRE, None, None, _summary(0, _total(commits)), None)])
        live = {f for n in range(len(data)) if data[n].snapshot_id >= oldest for f in _live_folders(data[: n + 1])}
        for folder in self._folders():
            if folder.startswith(f"{SNAPSHOT}=") and int(folder.rsplit("=", 1)[1]) < oldest:
                inside = {f"{folder}/{bucket}" for bucket in self._folders(folder)}
                for unused in inside - live if inside & live else {folder}:
                    delete_folder(self.spark, f"{self.path}/data/{unused}")

    # ---------------------------------------------------------------- internal

    def _ledger_present(self) -> bool:
        storage, location = hadoop_path(self.spark, f"{self.path}/ledger")
        return storage.exists(location)

    def _folders(self, path: str = "") -> list[str]:
        """The names of the folders below a folder of the data."""
        storage, location = hadoop_path(self.spark, f"{self.path}/data/{path}")
        return [s.getPath().getName() for s in storage.listStatus(location) if s.isDirectory()] if storage.exists(location) else []

    def _data_commits(self) -> list[Commit]:
        return [c for c in self.commits() if c.operation in DATA_OPERATIONS]

    def _schema(self, commits: list[Commit]) -> T.StructType | None:
        known = [c.schema for c in commits if c.schema is not None]
        return T.StructType.fromJson(json.loads(known[-1])) if known else None

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.bucket_keys), F.lit(self.buckets)).cast("int"))

    def _clustered(self, rows: DataFrame, touched: int) -> DataFrame:
        """Rows by bucket: keys never leave theirs, so this one shuffle serves the merge and the file layout.

        Fewer buckets than the session's shuffle partitions are sliced by key, so that a task need not hold a whole one.
        """
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if touched >= partitions:
            return rows.withColumn(SLICE, F.lit(0)).repartition(touched, BUCKET)
        slices = F.lit(4 * -(-partitions // touched))
        return rows.withColumn(SLICE, F.pmod(F.xxhash64(*self.bucket_keys, F.lit(SLICE)), slices)).repartition(BUCKET, SLICE)

    def _bucket_note(self) -> dict[str, str]:
        return {"bucket-count": str(self.buckets)} if self.bucket_keys else {}

    def _check_buckets(self, commits: list[Commit]) -> None:
        """With another number of buckets, stored rows and the increment's would not meet."""
        noted = [int(c.summary["bucket-count"]) for c in commits if "bucket-count" in c.summary]
        if noted and noted[-1] != self.buckets:
            raise ValueError(f"{self.path} has {noted[-1]} buckets, not {self.buckets}; use replace to change that")

    def _write_buckets(self, rows: DataFrame, target: str) -> None:
        """The writer needs rows in bucket order anyway; the other sort columns ride along."""
        ordered = rows.sortWithinPartitions(BUCKET, *self.sort_by)
        _writer(ordered).mode("overwrite").partitionBy(BUCKET).parquet(target)

    def _parquet(self, folders: list[str], schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{folder}" for folder in folders])

    def _load(self, commits: list[Commit], folders: list[str], with_snapshot: bool) -> DataFrame:
        """Read exactly the committed folders of buckets. The schema comes from the ledger, so no file footer is
        opened for planning and columns added later read as NULL in older files."""
        schema = self._known_schema(commits)
        snapshot = [T.StructField(SNAPSHOT, T.LongType())] if with_snapshot else []
        wanted = [f.name for f in [*schema.fields, *snapshot]]
        full = T.StructType([*schema.fields, T.StructField(SNAPSHOT, T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], full).select(*wanted)
        return self._parquet(folders, _plus_bucket(full)).select(*wanted)

    def _commit(self, commits, snapshot, operation, buckets, watermark, summary, schema, committed_at) -> None:
        known = self._schema(commits)
        text = schema.json() if known is None or known != schema else None
        at = committed_at or datetime.now(timezone.utc)
        self._write_ledger([(len(commits), snapshot, at, operation, buckets, watermark, summary, text)])

    def _commit_mark(self, commits, watermark, writer, batch_id, committed_at) -> None:
        snapshot = commits[-1].snapshot_id if commits else None
        summary = _summary(0, _total(commits), writer, batch_id)
        at = committed_at or datetime.now(timezone.utc)
        self._write_ledger([(len(commits), snapshot, at, "watermark", None, watermark, summary, None)])

    def _write_ledger(self, rows: list[tuple]) -> None:
        """Append ledger lines as one small file, whose appearance is the commit."""
        names = T.StructType.fromDDL(LEDGER_SCHEMA).names
        lines = [json.dumps(dict(zip(names, row)), default=_utc_text) for row in rows]
        entries = self.spark.range(1, numPartitions=1).select(F.lit("\n".join(lines)).alias("value"))
        entries.write.mode("append").text(f"{self.path}/ledger")


def _writer(rows: DataFrame) -> DataFrameWriter:
    return rows.write.option("compression", COMPRESSION)


def _folder(snapshot: int) -> str:
    return f"{SNAPSHOT}={snapshot}"


def _live_folders(commits: list[Commit]) -> list[str]:
    """Folders that make up the table after the given data commits."""
    plain: list[str] = []
    by_bucket: dict[int, int] = {}
    for commit in commits:
        if commit.operation == "replace":
            plain, by_bucket = [], {}
        if commit.buckets is None:
            plain.append(_folder(commit.snapshot_id))
        else:
            by_bucket.update(dict.fromkeys(commit.buckets, commit.snapshot_id))
    return plain + [f"{_folder(s)}/{BUCKET}={b}" for b, s in sorted(by_bucket.items())]


def _oldest_kept(commits: list[Commit]) -> int:
    return max((c.snapshot_id for c in commits if c.operation == EXPIRE), default=0)


def _next_snapshot(commits: list[Commit]) -> int:
    ids = [c.snapshot_id for c in commits if c.snapshot_id is not None]
    return max(ids) + 1 if ids else 1


def _batch_done(commits: list[Commit], writer: str, batch_id: int | None) -> bool:
    done = [int(c.summary["batch-id"]) for c in commits if c.summary.get("writer") == writer]
    return batch_id is not None and bool(done) and batch_id <= max(done)


def _total(commits: list[Commit]) -> int:
    return int(commits[-1].summary.get("total-records", 0)) if commits else 0


def _summary(added: int, total: int, writer: str | None = None, batch_id: int | None = None) -> dict[str, str]:
    summary = {"added-records": str(added), "total-records": str(total)}
    if writer is not None:
        summary.update({"writer": writer, "batch-id": str(batch_id)})
    return summary


def _plus_bucket(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])


def _merge_schemas(known: T.StructType | None, new: T.StructType) -> T.StructType:
    """Known columns in their order, then new ones. A changed type is an error."""
    if known is None:
        return new
    types = {f.name: f.dataType for f in known.fields}
    for column in new.fields:
        if column.name in types and types[column.name] != column.dataType:
            raise ValueError(f"column {column.name} changes from {types[column.name]} to {column.dataType}")
    return T.StructType([*known.fields, *(f for f in new.fields if f.name not in types)])


def _utc_text(when: datetime) -> str:
    return when.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _naive_local(when: datetime) -> datetime:
    """Spark hands out timestamps as naive local datetimes; bring `when` to the same form."""
    return when.astimezone().replace(tzinfo=None) if when.tzinfo else when
