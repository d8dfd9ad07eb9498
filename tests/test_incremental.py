import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliary.operators import incremental as I

RUNS = "run_id long, started_at timestamp, finished_at timestamp, run_status string"
SCANS = "scan_id long, run_id long, source_path string, size_bytes long, modified_time_secs long, scanned_at timestamp, run_status string"


def at(run, minute):
    return dt.datetime(2031, 1, run, 0, minute)


def brute(scans, runs):
    seen, out = {}, set()
    for run_id, _, end, status in sorted(runs):
        if status != "succeeded":
            continue
        state = {}
        for r in scans:
            if r[1] == run_id and r[2] is not None and r[5] is not None and (end is None or r[5] <= end):
                k = (r[5], -r[0])
                if r[2] not in state or k > state[r[2]][0]:
                    state[r[2]] = (k, r)
        for p, (_, r) in state.items():
            if seen.get(p) != (r[3], r[4]):
                out.add(r[0])
            seen[p] = (r[3], r[4])
    return out


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    runs = [(k, at(k, 0), at(k, 30) if k != 3 else None, "failed" if k in (3, 4) else "succeeded") for k in range(1, 7)]
    scans = [(i, rng.randint(1, 6), rng.choice([None, *(f"/p/{j}" for j in range(40))]), rng.randint(1, 2), rng.choice([None, 1, 2]), None, "x") for i in range(1, 400)]
    scans = [(*r[:5], rng.choice([None, at(r[1], rng.randint(0, 33))]) if rng.random() < 0.1 else at(r[1], rng.randint(0, 33)), "x") for r in scans]
    scans += scans[:20]  # repeated rows
    got = I.changed_scans(spark.createDataFrame(scans, SCANS), spark.createDataFrame(runs, RUNS), str(tmp_path / "s"))
    assert sorted(r[0] for r in got.collect()) == sorted(brute(scans, runs))


def test_nothing(spark, tmp_path):
    got = I.changed_scans(spark.createDataFrame([], SCANS), spark.createDataFrame([], RUNS), str(tmp_path / "s"))
    assert got.count() == 0


def test_failure_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = I.Store(spark, str(tmp_path / "s"), ["v"], "scan_id")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, v long, scan_id long")
    assert store.process("1", rows(("a", 1, 1), ("b", 1, 2))).count() == 2
    put = store._put
    monkeypatch.setattr(store, "_put", lambda p, t: (_ for _ in ()).throw(OSError("lost")) if "/commits/" in p else put(p, t))
    with pytest.raises(OSError):
        store.process("2", rows(("a", 2, 3), ("c", 1, 4)))
    monkeypatch.undo()
    assert sorted(r["scan_id"] for r in store.process("2", rows(("a", 2, 3), ("c", 1, 4))).collect()) == [3, 4]
    assert store.process("2", rows(("z", 9, 9))).count() == 2  # committed already
    assert store.process("3", rows(("a", 2, 5), ("b", 1, 6))).count() == 0


def test_only_touched_ranges_are_read(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "s"), ["v"], "scan_id", capacity=20)
    rows = lambda ks, v: spark.createDataFrame([(f"/c/{k % 50}/{k}", v(k), k) for k in ks], "key string, v long, scan_id long")
    assert store.process("1", rows(range(1000), lambda k: 1)).count() == 1000 and store.read_keys == 0
    assert store.process("2", rows(range(1000), lambda k: 1)).count() == 0 and store.read_keys == 0
    assert store.process("3", rows(range(1000), lambda k: 2 if k == 7 else 1)).count() == 1 and 0 < store.read_keys <= 60
    assert store.process("4", rows(range(1000), lambda k: 2 if k % 50 < 5 or k == 7 else 1)).count() == 100 and 100 <= store.read_keys <= 300
    assert store.process("5", rows(range(1200), lambda k: 2 if k % 50 < 5 or k == 7 else 1)).count() == 200


def test_hot_folders_are_split(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "s"), ["v"], "scan_id", capacity=20)
    rows = lambda n, v: spark.createDataFrame([(f"/one/{k}", v(k), k) for k in range(n)], "key string, v long, scan_id long")
    assert store.process("1", rows(40, lambda k: 1)).count() == 40
    assert store.process("2", rows(900, lambda k: 1)).count() == 860  # ranges that overflow are split
    assert store.process("3", rows(900, lambda k: int(k == 5))).count() == 899
    assert store.process("4", rows(900, lambda k: int(k in (5, 6)))).count() == 1 and store.read_keys <= 80


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 1, 1)], "key string, v long, scan_id long")
    one, two = (I.Store(spark, str(tmp_path / "s"), ["v"], "scan_id") for _ in range(2))
    stale = two.commits()
    one.process("1", rows)
    monkeypatch.setattr(two, "commits", lambda: stale)
    with pytest.raises(Exception, match="already exists"):
        two.process("2", rows)


def test_descent_enters_only_what_differs():
    old = {n: ["x", "y", 1] for n in (4, 5, 6, 7)}
    new = old | {6: ["z", "y", 1]}
    up = I.digests_above
    assert I.descend(up(old), up(old), set(old)) == [] and I.descend(up(old), up(new), set(new)) == [6] and I.descend({}, up(new), set(new)) == [4, 5, 6, 7]


@given(st.dictionaries(st.integers(0, (1 << I.FOLDER_BITS) - 1), st.integers(1, 500), max_size=40), st.integers(1, 300))
@settings(max_examples=100, deadline=None)
def test_ranges_cover_all_places_once(counts, capacity):
    got = sorted((I.bottom(n), n.bit_length() - 1) for n in I.ranges(counts, capacity))
    assert got[0][0] == 0 and all(low + (1 << (63 - d)) == nxt for (low, d), (nxt, _) in zip(got, [*got[1:], (1 << 63, 0)], strict=True))
