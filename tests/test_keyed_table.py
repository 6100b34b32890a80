"""Appends with a key index: many batches, repeats, failures between data and commit."""

import numpy as np
import pytest

from crossgrid.session import scratch_path
from crossgrid.sources.keyed_table import ROW_KEYS, KeyedTable

SCHEMA = "a long, b string, v double"


def batch(spark, keys, v=0.0):
    return spark.createDataFrame([(k, f"k{k % 7}", v) for k in keys], SCHEMA)


def table(spark, **more):
    return KeyedTable(spark, scratch_path(spark, "table"), ["a", "b"], **more)


def keys_of(t):
    return sorted(r.a for r in t.read().collect())


def test_twenty_batches_read_no_more_each_time(spark):
    t = table(spark, buckets=4)
    read = []
    for k in range(20):
        fresh = range(60 * k, 60 * k + 60)
        old = range(0, 60 * k, max(1, 60 * k // 5)) if k in (7, 13) else []
        filters = t.commits()[-1].filters if k else []
        rows = t._held(filters).count() if filters else 0
        got = t.append(batch(spark, [*fresh, *fresh[:9], *old]))
        assert got.offered == 60 + len(old) and got.added == 60 and got.maybe - len(old) <= 3
        read.append((rows, got.maybe - len(old)))
    assert keys_of(t) == list(range(1200))
    assert max(r for r, _ in read) <= 2 * 4 * 3 and sum(m for _, m in read) <= 12  # 1140 keys were looked up
    assert len(t.commits()) == 20


def test_filters_follow_the_number_of_keys(spark):
    t = table(spark, buckets=2)
    for k in range(3):
        t.append(batch(spark, range(3 * ROW_KEYS * k, 3 * ROW_KEYS * (k + 1))))
    sizes = [(f.size, f.keys) for f in t.commits()[-1].filters]
    assert [s for s, _ in sizes] == sorted({s for s, _ in sizes}) and sum(n for _, n in sizes) == 9 * ROW_KEYS
    assert all(n <= s * 2 * ROW_KEYS for s, n in sizes)
    got = t.append(batch(spark, range(100_000, 102_000)))
    assert got.added == 2000 and got.maybe < 60  # a false alarm is rare


@pytest.mark.parametrize("step", ["_write_index", "_commit"])
def test_a_run_that_dies_before_its_commit_leaves_nothing(spark, monkeypatch, step):
    t = table(spark)
    t.append(batch(spark, range(50)))

    def lost(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, step, lost)
    with pytest.raises(RuntimeError, match="lost"):
        t.append(batch(spark, range(30, 90)))
    monkeypatch.undo()
    assert keys_of(t) == list(range(50))
    got = t.append(batch(spark, range(30, 90)))
    assert (got.offered, got.added) == (60, 40) and keys_of(t) == list(range(90))


def test_a_second_writer_fails(spark, monkeypatch):
    t = table(spark)
    t.append(batch(spark, range(5)))
    before = t.commits()
    t.append(batch(spark, range(5, 10)))
    monkeypatch.setattr(KeyedTable, "commits", lambda self: before)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        t.append(batch(spark, range(20, 25)))
    monkeypatch.undo()
    assert keys_of(t) == list(range(10))


def test_null_keys_empty_batches_and_repeats(spark):
    t = table(spark, buckets=3)
    assert t.read() is None and t.append(batch(spark, [])).added == 0 and t.read() is None
    rows = spark.createDataFrame([(None, "x", 1.0), (None, "x", 1.0), (1, None, 2.0), (None, None, 3.0)], SCHEMA)
    assert t.append(rows).added == 3
    got = t.append(rows)
    assert (got.offered, got.maybe, got.added) == (3, 3, 0)
    assert t.append(batch(spark, [])).offered == 0 and t.read().count() == 3 and len(t.commits()) == 1


def test_false_alarms_lose_no_row(spark, monkeypatch):
    """With a filter that holds everything, the table itself decides."""
    from crossgrid.sources import keyed_table

    monkeypatch.setattr(keyed_table, "ROW_KEYS", 10**6)
    t, rng = table(spark, buckets=2), np.random.default_rng(1)
    want = set()
    for _ in range(3):
        keys = set(rng.integers(0, 9000, 2500).tolist())
        got = t.append(batch(spark, keys))
        assert got.added == len(keys - want)
        want |= keys
    assert keys_of(t) == sorted(want) and got.maybe > got.offered - got.added
