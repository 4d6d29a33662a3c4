"""Deciding what a curated run has to read, and running it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidemark.model import Entity
from tidemark.operators.quality import ObservedGate, no_nulls
from tidemark.plans.curated import curate_entity, event_order, merge_spec
from tidemark.sources.versioned import VersionedTable


@dataclass(frozen=True)
class Skip:
    reason: str


@dataclass(frozen=True)
class Full:
    end: int
    reason: str


@dataclass(frozen=True)
class Range:
    start: int
    end: int


@dataclass(frozen=True)
class RunResult:
    table: str
    mode: str
    snapshot: int | None
    watermark: int | None
    row_count: int


def plan_run(
    source: VersionedTable,
    target: VersionedTable,
    full_refresh: bool = False,
    max_snapshots: int | None = None,
) -> Skip | Full | Range:
    """What the next run of `target` has to read from `source`.

    A target without a watermark is rebuilt in full, like a missing one. `max_snapshots` bounds an
    incremental run, so that a long backlog is worked off in several.
    """
    current = source.current()
    if current is None:
        return Skip("source has no snapshots")
    if full_refresh:
        return Full(current, "full refresh requested")
    done = target.watermark()
    if done is None:
        return Full(current, "first run")
    if done == current:
        return Skip(f"snapshot {current} already processed")
    end = current if max_snapshots is None else min(current, done + max_snapshots)
    return Range(done, end)


def _run(
    name: str,
    source: VersionedTable,
    target: VersionedTable,
    transform: Callable[[DataFrame], DataFrame],
    write_increment: Callable[..., int | None],
    checks: Mapping[str, Column],
    full_refresh: bool,
    max_snapshots: int | None,
    with_snapshot: bool = False,
) -> RunResult:
    plan = plan_run(source, target, full_refresh, max_snapshots)
    if isinstance(plan, Skip):
        return RunResult(name, "skip", target.current(), target.watermark(), 0)
    gate = ObservedGate(name, checks)
    if isinstance(plan, Full):
        rows = transform(source.read_as_of(plan.end, with_snapshot=with_snapshot))
        snapshot = target.replace(rows, watermark=plan.end, gate=gate)
        mode = "full"
    else:
        rows = transform(source.read_between(plan.start, plan.end, with_snapshot=with_snapshot))
        snapshot = write_increment(rows, watermark=plan.end, gate=gate)
        mode = "incremental"
    return RunResult(name, mode, snapshot, plan.end, gate.metrics["row_count"])


def run_incremental(
    name: str,
    source: VersionedTable,
    target: VersionedTable,
    transform: Callable[[DataFrame], DataFrame],
    order_by: Sequence[str],
    checks: Mapping[str, Column],
    *,
    tie_breakers: Sequence[str] = (),
    full_refresh: bool = False,
    max_snapshots: int | None = None,
    with_snapshot: bool = False,
) -> RunResult:
    """One run: plan, read, transform, gate, write, move the watermark. The newest row per key wins.

    Data and watermark become visible together, so a run that fails anywhere is simply repeated. Runs give what
    one full refresh gives if `order_by` and `tie_breakers`, columns of the transformed rows, order the rows of a key
    totally; `with_snapshot` offers the raw snapshot's id to `transform` for that.
    """

    def write_increment(rows: DataFrame, **options) -> int | None:
        return target.upsert(rows, order_by, tie_breakers, **options)

    return _run(name, source, target, transform, write_increment, checks, full_refresh, max_snapshots, with_snapshot)


def run_entity(
    entity: Entity,
    source: VersionedTable,
    target: VersionedTable,
    tie_breakers: Sequence[str] = (),
    *,
    full_refresh: bool = False,
    max_snapshots: int | None = None,
) -> RunResult:
    """One run of a source table's current state, with the entity's MERGE column rules.

    Every stored row carries the columns of `event_order`: an older event that arrives late changes nothing, and batches
    in any order give the same rows, but for columns that take the event time of the first merge.
    """
    order = event_order(tie_breakers)
    return _run(
        entity.name,
        source,
        target,
        lambda raw: curate_entity(raw, entity, tie_breakers, keep_order=True),
        lambda rows, **options: target.merge(rows, merge_spec(entity, order), **options),
        no_nulls(entity.key),
        full_refresh,
        max_snapshots,
    )
