"""Ends of everything, decided chunk by chunk, against a walk through the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import labels as L
from fleetlens.operators import refusals as R


def walk(log):
    """Windows (id, start, end) and effective ends of (seq, action, ts, id), one command after the other."""
    windows, taken = {}, []
    for seq, action, ts, id_ in log:
        if action == "start":
            windows[id_] = [ts, None]
            continue
        meant = [i for i, w in windows.items() if w[1] is None and id_ in (None, i)]
        if any(windows[i][0] > ts for i in meant):
            continue
        if id_ is None:
            taken.append(seq)
        for i in meant:
            windows[i][1] = ts
    return sorted((i, *w) for i, w in windows.items()), taken


def random_log(seed, n):
    rng = random.Random(seed)
    clock, log, started = 1000, [], []
    for seq in range(n):
        clock += rng.randrange(10)
        ts = clock + rng.choice([0, 0, 0, -15, 60, 400])
        kind = rng.random()
        if kind < 0.45 or not started:
            log.append((seq, "start", ts, seq + 1))
            started.append(seq + 1)
        elif kind < 0.75:
            log.append((seq, "end", ts, rng.choice(started[-12:])))
        else:
            log.append((seq, "end", ts, None))
    return log


def as_events(log):
    until = {}
    for seq, action, ts, id_ in log:
        if action == "end" and id_ is not None:
            start = next(c for c in log if c[1] == "start" and c[3] == id_)
            if seq > start[0] and ts >= start[2]:
                until.setdefault(id_, seq)
    events = [(s, R.START, t, until.get(i, R.NEVER)) for s, a, t, i in log if a == "start"]
    events += [(s, R.END, t, 0) for s, a, t, i in log if a == "end" and i is None]
    return sorted(events + [(s, R.CLOSED, 0, 0) for s in until.values()])


@pytest.mark.parametrize("seed", range(150))
@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_chunks_decide_what_a_walk_decides(seed, size):
    log = random_log(seed, 90)
    events = as_events(log)
    chunks = [events[i : i + size] for i in range(0, len(events), size)]
    held = R.carried((n, c[-1][0], *R.summary(c)) for n, c in enumerate(chunks))
    found = [s for n, before in held for s in R.effective(chunks[n], before)]
    assert found == walk(log)[1]


COMMANDS = "host_id string, seq bigint, action string, ts bigint, id bigint, label string, notes string"


@pytest.mark.parametrize("rows", [7, R.ROWS])
def test_fold_against_a_walk(spark, rows):
    logs = {f"h{s}": random_log(s, 200) for s in range(5)}
    commands = [(h, *c, "x", None) for h, log in logs.items() for c in log]
    random.Random(0).shuffle(commands)
    found = L.fold_commands(spark.createDataFrame(commands, COMMANDS), width=16, rows=rows)
    expected = sorted((h, *w) for h, log in logs.items() for w in walk(log)[0])
    key = lambda r: r[:2]
    assert sorted((tuple(r) for r in found.select("host_id", "id", "ts_start", "ts_end").collect()), key=key) == expected


def test_one_start_dated_far_ahead(spark):
    """It refuses every later end of a long log; no task sees more than a chunk of it."""
    n, ahead = 200_000, 4_102_444_800_000
    log = spark.range(n).select(
        F.lit("h").alias("host_id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 2, "end").otherwise("start").alias("action"),
        F.when(F.col("id") == 0, F.lit(ahead)).otherwise(F.col("id") * 1000).alias("ts"),
        F.when(F.col("id") % 3 != 2, F.col("id") + 1).alias("id"), F.lit("x").alias("label"), F.lit(None).cast("string").alias("notes"),
    )
    last = [("h", n, "end", ahead + 5, 1, "", None), ("h", n + 1, "end", n * 1000, None, "", None)]
    whole = log.unionByName(spark.createDataFrame(last, COMMANDS))
    found = L.fold_commands(whole, rows=4096)
    ends = {r.ts_end: r["count"] for r in found.groupBy("ts_end").count().collect()}
    assert ends == {ahead + 5: 1, n * 1000: found.count() - 1}
    assert found.count() == sum(1 for i in range(n) if i % 3 != 2)
