import random
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession

from shelfwright.streaming import changes

LISTED = "series_id long, title string, unit string, volume_from int, volume_to int, completed boolean, baseline boolean"


def plain(state: dict, batch: list[tuple], first_completed: bool) -> list[tuple]:
    out = []
    for s in {r[0] for r in batch}:
        rows = [r for r in batch if r[0] == s]
        known = s in state
        volumes, was = state.get(s, (set(), False))
        listed = {r[2:5] for r in rows if r[3] is not None and r[4] is not None and r[3] <= r[4]}
        held = {(u, n) for u, lo, hi in volumes for n in range(lo, hi + 1)}
        added = sorted((v for v in listed - volumes if not all((v[0], n) in held for n in range(v[1], v[2] + 1))), key=lambda v: (v[1], v[2], v[0]))
        done, title, told = any(r[5] for r in rows), min(r[1] for r in rows), []
        if not known:
            told.append(("series_added", title))
        elif added:
            told.append(("volume_added", " / ".join(f"第{lo}{u}" if lo == hi else f"第{lo}-{hi}{u}" for u, lo, hi in added) + " が増えました"))
        if done and not was and (known or first_completed):
            told.append(("series_completed", title))
        state[s] = (volumes | listed, was or done)
        if not any(r[6] for r in rows):
            out += [(s, *x) for x in told]
    return sorted(out, key=repr)


def test_steps_of_a_bucket():
    rng = random.Random(9)
    for first_completed in (False, True):
        for _ in range(60):
            state, series, volumes = {}, changes._SERIES.empty_table(), changes._VOLUMES.empty_table()
            for _ in range(5):
                batch = [(rng.choice([None, 0, 1, -(1 << 63), (1 << 63) - 1]), rng.choice(["", "A", "あ", "Z"]), rng.choice("巻話"), *rng.choice([(None, 1), (3, None), (-2, -2), (lo := rng.randrange(-3, 12), lo + rng.randrange(-1, 5))]), rng.random() < 0.1, rng.random() < 0.1) for _ in range(rng.randrange(1, 12))]
                listed = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), changes._ROWS)], schema=changes._ROWS)
                series, volumes, events = changes.step(series, volumes, listed, first_completed)
                assert sorted(zip(*(c.to_pylist() for c in events.columns)), key=repr) == plain(state, batch, first_completed)
                assert {(s, c) for s, c in zip(series["series_id"].to_pylist(), series["completed"].to_pylist())} == {(s, x[1]) for s, x in state.items()}
                assert sorted(zip(*(volumes[c].to_pylist() for c in changes._VOLUMES.names[:4])), key=repr) == sorted(((s, *v) for s, x in state.items() for v in x[0]), key=repr)


def test_the_first_batch_tells_what_is_complete(spark: SparkSession, tmp_path):
    """a series that is complete when it is first seen."""
    rows = [(None, "N", "巻", 1, 1, True, False), (1, "A", "巻", 1, 2, True, False), (1, "A", None, 3, 3, False, False), (2, "B", "巻", 1, 1, False, False), (3, "C", "話", None, None, True, True), ((1 << 63) - 1, "D", "巻", 2, 2, True, False)]
    parts = [spark.createDataFrame(rows, LISTED), spark.createDataFrame([(1, "A", "巻", 3, 3, True, False), (2, "B", None, 2, 2, True, False), (3, "C", "話", 1, 1, True, False)], LISTED)]
    got = lambda make, at: sorted(map(tuple, changes.drain_in_turns(parts, make, str(tmp_path / at)).select("turn", "series_id", "kind", "message").collect()), key=repr)
    first = [(1, s, "series_added", t) for s, t in ((None, "N"), (1, "A"), (2, "B"), ((1 << 63) - 1, "D"))]
    done = [(1, s, "series_completed", t) for s, t in ((None, "N"), (1, "A"), ((1 << 63) - 1, "D"))]
    later = [(2, 2, "volume_added", "第2巻 が増えました"), (2, 2, "series_completed", "B"), (2, 3, "volume_added", "第1話 が増えました")]
    assert got(partial(changes.change_events, first_completed=True), "a") == sorted(first + done + later, key=repr)
    assert got(changes.change_events, "b") == sorted(first + later, key=repr)


def test_what_no_batch_brings_is_forgotten():
    one = lambda *rows: pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), changes._ROWS)], schema=changes._ROWS)
    a, b = (1, "A", "巻", 1, 1, False, False), (1, "A", "巻", 2, 2, False, False)
    series, volumes, _ = changes.step(changes._SERIES.empty_table(), changes._VOLUMES.empty_table(), one(a, b), now=5)
    series, volumes, events = changes.step(series, volumes, one(a), now=9)
    assert events.num_rows == 0 and series["seen"].to_pylist() == [9] and sorted(volumes["seen"].to_pylist()) == [5, 9]
