"""The index in buckets and the state of calls, over batches in and out of order."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from voxloom.sources import index as store
from voxloom.streaming import jobs

ROW = "call_id long, version int, status string, bucket int"


def _batches(count: int) -> list[list[tuple]]:
    return [[(k * k % 31, (k * 7 + n * 3) % 5, f"{n}-{k}", k) for k in range(n, n + 9)] for n in range(count)]


def _fold(batches: list[list[tuple]]) -> dict:
    best = {}
    for n, batch in enumerate(batches):
        for row in batch:
            order = (row[1], n, *row[2:])
            best[row[0]] = max(best.get(row[0], order), order)
    return {k: (v[0], *v[2:]) for k, v in best.items()}


def _read(spark, index: str) -> dict:
    rows = [tuple(r) for r in store.read(spark, index).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_index_equals_a_fold_after_each_batch(spark, tmp_path):
    index, batches = str(tmp_path / "index"), _batches(9)
    for n, batch in enumerate(batches):
        store.add(spark.createDataFrame(batch, ROW), index, n, every=2, buckets=3)
        assert _read(spark, index) == _fold(batches[: n + 1])
    manifest = store.newest(spark, index)
    assert max(p[1] for p in manifest["pieces"]) >= 3  # 8 batches by twos
    folders = {str(p) for p in (tmp_path / "index" / "pieces").glob("*/*/*/*") if p.is_dir()}
    named = {store._path(index, p) for m in store._manifests(spark, index) for p in store._manifest(spark, index, m)["pieces"]}
    replaced = {store._path(index, p) for p in manifest["replaced"]}
    assert named | replaced == folders and len(store._manifests(spark, index)) == 2


def test_only_buckets_with_changes_are_written_again(spark, tmp_path):
    index = str(tmp_path / "index")
    store.add(spark.range(4000).selectExpr("id as call_id", "1 as version", "'a' as status", "0 as bucket"), index, 0, every=4, buckets=8)
    for n in range(1, 9):
        store.add(spark.createDataFrame([(5, n, "b", 0)], ROW), index, n, every=4, buckets=99)
    pieces = store.newest(spark, index)["pieces"]
    assert len({p[0] for p in pieces}) == 8  # the number of the first batch stays
    assert sum(p[2] == 0 for p in pieces) == 7  # seven buckets lie where the first batch has put them
    found = _read(spark, index)
    assert len(found) == 4000 and found[5] == (8, "b", 0)


def test_crash_between_pieces_and_manifest(spark, tmp_path, monkeypatch):
    index, batches = str(tmp_path / "index"), _batches(4)
    for n in range(3):
        store.add(spark.createDataFrame(batches[n], ROW), index, n, every=2, buckets=3)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(spark.createDataFrame(batches[3], ROW), index, 3, every=2, buckets=3)
    assert _read(spark, index) == _fold(batches[:3])
    for _ in range(2):  # again, and again after it is done
        store.add(spark.createDataFrame(batches[3], ROW), index, 3, every=2, buckets=3)
        assert _read(spark, index) == _fold(batches)


def test_index_of_nulls_repeats_and_nothing(spark, tmp_path):
    index = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        store.read(spark, index)
    store.add(spark.createDataFrame([], ROW), index, 0)
    assert _read(spark, index) == {}
    store.add(spark.createDataFrame([(None, 1, "a", 1), (1, None, None, None), (1, None, "x", None), (2, 1, "a", 1), (2, 1, "b", 0), (2, 1, "b", 0)], ROW), index, 1)
    assert _read(spark, index) == {1: (None, "x", None), 2: (1, "b", 0)}
    with pytest.raises(ValueError, match="columns"):
        store.add(spark.createDataFrame([(1, 1)], "call_id long, version int"), index, 2)
    with pytest.raises(ValueError, match="can't be kept"):
        store.add(spark.createDataFrame([(1, 1, 1)], "call_id long, version int, _came int"), index, 2)


def test_stream_into_index_goes_on_and_refuses_a_second_checkpoint(spark, tmp_path):
    changes, index, state = (str(tmp_path / x) for x in ("changes", "index", "state"))
    batches = _batches(3)
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(changes)
        jobs.upsert_index(jobs.source(spark, changes), index, state, 2, 3)
        assert _read(spark, index) == _fold(batches[: n + 1])
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.upsert_index(jobs.source(spark, changes), index, str(tmp_path / "other"), 2, 3)


def _expected(arrivals: list[list[tuple]], limit: timedelta, delay: timedelta, keep: timedelta) -> set[tuple]:
    """What progress tells, event by event: watermarks move between batches."""
    state, told, seen, mark = {}, set(), datetime.min, datetime.min
    for batch in [b for arrived in arrivals for b in (arrived, [])]:  # a batch without rows moves the watermark on
        taken = {}
        for call, ts, status in batch:
            if ts is not None and status is not None and ts >= mark:
                taken.setdefault(call, []).append((ts, status))
        for call, rows in taken.items():
            best = max(rows + ([state[call]] if call in state else []))
            if best != state.get(call):
                state[call] = best
                told.add((call, *best))
        for call, (at, status) in list(state.items()):
            settled = status in jobs.SETTLED
            if at + (keep if settled else limit) < mark:
                if settled:
                    del state[call]
                else:
                    state[call] = (at + limit, "error")
                    told.add((call, at + limit, "error"))
        seen = max([seen, *[ts for _, ts, _ in batch if ts is not None]])
        mark = max(mark, seen - delay) if seen > datetime.min else mark
    return told


@pytest.mark.parametrize("delay", ["0 seconds", "20 minutes"])
def test_progress_equals_a_fold_over_late_rows(spark, tmp_path, delay):
    start, minute = datetime(2024, 1, 1), timedelta(minutes=1)
    at = lambda m: start + m * minute
    arrivals = [
        [(1, at(0), "running"), (2, at(1), "running"), (3, at(2), "complete"), (None, at(3), "running"), (4, None, "running"), (5, at(1), None)],
        [(1, at(40), "running"), (2, at(30), "complete"), (3, at(1), "running"), (6, at(39), "running")],
        [(1, at(25), "complete"), (6, at(90), "running"), (7, at(130), "running")],  # the first is late
        [(1, at(131), "running"), (3, at(400), "running"), (2, at(15), "error")],
        [(8, at(2000), "complete"), (3, at(1990), "complete")],
    ]
    events, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))
    for batch in arrivals:
        spark.createDataFrame(batch, "call_id long, ts timestamp, status string").coalesce(1).write.mode("append").parquet(events)
        jobs.progress(jobs.source(spark, events), out, state, "1 hour", delay, "1 day")
    found = {(r["call_id"], start + timedelta(microseconds=r["at"] - 1704067200000000), r["status"]) for r in spark.read.parquet(out).collect()}
    assert found == _expected(arrivals, timedelta(hours=1), timedelta(minutes=int(delay.split()[0])), timedelta(days=1))
