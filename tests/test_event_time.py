"""Windows and sessions over deliveries out of order: restarts, late rows, bounded state, failures."""

from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from crossgrid.session import scratch_path
from crossgrid.streaming import event_time, jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, user string, ts timestamp, value double"


class Deliveries:
    """A folder to which deliveries are added."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, scratch_path(spark, "deliveries"), 0

    def add(self, rows):
        rows = [(i, u, None if h is None else START + timedelta(hours=h), v) for i, u, h, v in rows]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.path}/d={self.n}")
        self.n += 1
        return jobs.read_stream(self.spark, f"{self.path}/*")


def random_deliveries(seed, n_deliveries, rows=60, reach=60):
    """Hours that grow by a day with each delivery, some of them far behind; a few without a time or user."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n_deliveries):
        hours = 24.0 * k + rng.integers(0, 24, rows) + rng.integers(0, 60, rows) / 60 - np.where(rng.random(rows) < 0.3, rng.integers(0, reach, rows), 0)
        out.append([
            (k * rows + j, None if rng.random() < 0.03 else f"u{rng.integers(4)}", None if rng.random() < 0.03 else round(float(h) * 60) / 60, float(rng.integers(9)))
            for j, h in enumerate(hours)])
    return out


def plain_split(deliveries, delay, is_late):
    """Rows in time and late ones; the watermark counts what earlier deliveries held."""
    mark, fresh, late = None, [], []
    for rows in deliveries:
        for r in rows:
            (late if r[2] is None or mark is not None and is_late(r, mark) else fresh).append(r)
        last = max([r[2] for r in rows if r[2] is not None] + ([mark + delay] if mark is not None else []))
        mark = last - delay
    return fresh, late


def plain_days(rows):
    out = defaultdict(lambda: [0, 0.0])
    for _, user, hour, value in rows:
        got = out[user, int(hour // 24)]
        got[0] += 1
        got[1] += value
    return {k: tuple(v) for k, v in out.items()}


def days_of(result):
    return {(r.user, (r.window_start.replace(tzinfo=timezone.utc) - START).days): (r.n, r.total) for r in result.rows.collect()}


def run_days(stream, work, **more):
    return event_time.windows(stream, "ts", ["user"], "value", work, "1 day", delay="24 hours", partitions=2, **more)


def day_is_late(row, mark):
    return (row[2] // 24 + 1) * 24 <= mark


def test_windows_over_restarts(spark):
    """The job starts anew for each delivery; what comes too late is kept apart, nothing vanishes, the state stays small."""
    parts = random_deliveries(1, 4)
    box, work, held = Deliveries(spark), scratch_path(spark, "work"), []
    for rows in parts:
        out = run_days(box.add(rows), work)
        held.append(out.state_rows)
    fresh, late = plain_split(parts, 24.0, day_is_late)
    assert days_of(out) == plain_days(fresh) and late
    got = out.late.collect()
    assert len(got) == len(late) and sum(r.value for r in got) == sum(r[3] for r in late)
    assert sum(r.ts is None for r in got) == sum(r[2] is None for r in late)
    assert out.rows.agg({"n": "sum"}).first()[0] + len(got) == sum(map(len, parts))
    assert max(held) <= 5 * 5  # users and the unknown one, times the days that are open


def test_windows_in_many_batches_of_one_run(spark):
    parts = random_deliveries(2, 3)
    box = Deliveries(spark)
    for rows in parts:
        box.add(rows)
    stream = jobs.read_stream(spark, f"{box.path}/*", max_files=1)
    out = run_days(stream, scratch_path(spark, "work"))
    fresh, late = plain_split(parts, 24.0, day_is_late)
    assert days_of(out) == plain_days(fresh) and out.late.count() == len(late)


def test_sliding_windows_are_late_one_by_one(spark):
    box, work = Deliveries(spark), scratch_path(spark, "work")
    args = ("ts", ["user"], "value", work, "2 days", "1 day")
    event_time.windows(box.add([(1, "u", 60.0, 1.0)]), *args, delay="12 hours", partitions=2)
    out = event_time.windows(box.add([(2, "u", 30.0, 2.0)]), *args, delay="12 hours", partitions=2)
    got = {((r.window_start.replace(tzinfo=timezone.utc) - START).days, r.n) for r in out.rows.collect()}
    assert got == {(1, 2), (2, 1)}  # hour 30 still counts for days 1 and 2
    assert [(r.window_start.replace(tzinfo=timezone.utc) - START).days for r in out.late.collect()] == [0]


@pytest.mark.parametrize("step", ["router", "state"])
def test_a_failed_run_is_taken_up(spark, monkeypatch, step):
    parts = random_deliveries(3, 3)
    box, work = Deliveries(spark), scratch_path(spark, "work")
    run_days(box.add(parts[0]), work)
    stream = box.add(parts[1])
    if step == "router":
        def broken(df, *more):  # the sums are written, the mark is not
            raise RuntimeError("lost")

        monkeypatch.setattr(event_time, "attach_params", broken)
    else:
        monkeypatch.setattr(event_time, "_fold", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run_days(stream, work)
    monkeypatch.undo()
    out = run_days(box.add(parts[2]), work)
    fresh, late = plain_split(parts, 24.0, day_is_late)
    assert days_of(out) == plain_days(fresh) and out.late.count() == len(late)


def plain_sessions(rows, gap):
    out = []
    for user in {r[1] for r in rows}:
        mine = sorted((r[2], r[3]) for r in rows if r[1] == user)
        for k, (hour, value) in enumerate(mine):
            if k == 0 or hour >= mine[k - 1][0] + gap:
                out.append([user, hour, hour + gap, 0, 0.0])
            out[-1][2] = hour + gap
            out[-1][3] += 1
            out[-1][4] += value
    return sorted(map(tuple, out))


def test_sessions_over_restarts(spark):
    parts = random_deliveries(4, 5, rows=25)
    box, work, held = Deliveries(spark), scratch_path(spark, "work"), []
    for rows in parts:
        out = event_time.sessions(box.add(rows), "ts", "user", "value", "3 hours", work, delay="24 hours", partitions=2)
        held.append(out.state_rows)
    fresh, late = plain_split(parts, 24.0, lambda r, mark: r[2] < mark)
    late += [r for r in fresh if r[1] is None]
    fresh = [r for r in fresh if r[1] is not None]

    def hour(t):
        return round((t.replace(tzinfo=timezone.utc) - START).total_seconds() / 60) / 60

    got = out.rows.collect()
    want = [(u, round(a * 60) / 60, round(b * 60) / 60, n, v) for u, a, b, n, v in plain_sessions(fresh, 3.0)]
    assert sorted((r.user, hour(r.session_start), hour(r.session_end), r.n, r.total) for r in got) == want
    last = max(r[2] for p in parts for r in p if r[2] is not None)
    assert all(r.is_open == (hour(r.session_end) > last + 1e-9) for r in got)
    assert out.late.count() == len(late) and late
    assert max(held) <= 4  # one group of open sessions a user


def test_sessions_of_many_keys(spark):
    """Keys share groups of the state: there are never more than buckets, and each key has its own sessions."""
    users = 2 * event_time.BUCKETS
    parts = [[(d * users + u, f"u{u}", 24.0 * d + u % 20 + h, None if u % 7 == 0 else float(u)) for u in range(users) for h in (0.0, 0.5, 3.0 + u % 2)] for d in (0, 1)]
    box, work = Deliveries(spark), scratch_path(spark, "work")
    for rows in parts:
        out = event_time.sessions(box.add(rows), "ts", "user", "value", "3 hours", work, delay="48 hours", partitions=2)
    want = [(u, n, v if int(u[1:]) % 7 else None) for u, _, _, n, v in plain_sessions([(i, u, h, v or 0.0) for p in parts for i, u, h, v in p if int(u[1:]) < 300], 3.0)]
    got = [(r.user, r.n, r.total) for r in out.rows.collect()]
    assert sorted((x for x in got if int(x[0][1:]) < 300), key=str) == sorted(want, key=str)
    assert len(got) == 3 * users and sum(n for _, n, _ in got) == 6 * users
    assert out.state_rows <= event_time.BUCKETS


def test_streams_without_rows(spark):
    box, work = Deliveries(spark), scratch_path(spark, "work")
    out = run_days(box.add([]), work)
    assert out.rows.count() == 0 and out.late.count() == 0
    out = event_time.sessions(box.add([(1, "u", 1.0, None)]), "ts", "user", "value", "3 hours", scratch_path(spark, "work"), partitions=2)
    assert [(r.n, r.total, r.is_open) for r in out.rows.collect()] == [(1, None, True)]
