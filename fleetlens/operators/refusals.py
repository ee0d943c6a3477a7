"""Which ends of everything take effect in a log of commands, decided chunk by chunk.

An end of everything is refused while a window is open that starts after it. What is open
depends on the ends before, so the log is a sequential process; but what a chunk of it does
can be summed up without knowing what came before:

* for an end, the latest start in its chunk that would refuse it, if still open, is known
  (`_blockers`). After an end took effect nothing is open, so the next one that takes effect
  is the first whose blocker lies before it (`_chain`): the rest of the chunk follows from the
  first effective end alone.
* Which end is the first depends on the windows that are open when the chunk begins. Only
  ends without a blocker of the chunk's own come into question, and of those only the ones
  later in time than all before them since a window was last closed by its id.
* The windows a chunk leaves open matter as far as no later one hides them by starting
  no earlier in time and staying as long.

`carried` merges the summaries in order, one row per chunk; with what it hands to each
chunk all chunks are decided side by side. No task holds more than a chunk of commands.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordered import measured_width, numbered
from fleetlens.session import settle

#: Commands of a chunk.
ROWS = 1 << 14
START, END, CLOSED = 0, 1, 2
#: `until` of a window that no command closes by its id.
NEVER = (1 << 63) - 1

Event = tuple[int, int, int, int]  # seq, kind, ts, until


def _blockers(events: Sequence[Event]) -> dict[int, int | None]:
    """For every end the latest start of the chunk that refuses it while open."""
    waiting: list[tuple[int, int, int]] = []
    out: dict[int, int | None] = {}
    for seq, kind, ts, until in events:
        if kind == START:
            while waiting and waiting[-1][1] <= ts and waiting[-1][2] <= until:
                waiting.pop()
            waiting.append((seq, ts, until))
        elif kind == END:
            while waiting and waiting[-1][2] < seq:
                waiting.pop()
            out[seq] = next((s for s, t, u in reversed(waiting) if t > ts and u > seq), None)
    return out


def _chain(blockers: dict[int, int | None]) -> dict[int, int]:
    """The next end that takes effect after each end that does."""
    after: dict[int, int] = {}
    open_: list[int] = []
    for seq, blocker in blockers.items():
        while open_ and (blocker is None or open_[-1] > blocker):
            after[open_.pop()] = seq
        open_.append(seq)
    return after


def _hidden(windows: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """(ts, until) without those that another one hides."""
    out: list[tuple[int, int]] = []
    for ts, until in sorted(windows, reverse=True):
        if not out or until > out[-1][1]:
            out.append((ts, until))
    return out


def summary(events: Sequence[Event]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(candidates, windows) of a chunk.

    A candidate (seq, ts, last) may be the chunk's first effective end; `last` is then its
    last one. A window (seq, ts, until) is open beyond the chunk if no end closes it.
    """
    blockers = _blockers(events)
    after = _chain(blockers)
    last: dict[int, int] = {}
    for seq in reversed(blockers):
        last[seq] = last[after[seq]] if seq in after else seq
    candidates, top = [], None
    for seq, kind, ts, _ in events:
        if kind == CLOSED:
            top = None
        elif kind == END and blockers[seq] is None and (top is None or ts > top):
            candidates.append((seq, ts, last[seq]))
            top = ts
    end, windows, longest = events[-1][0], [], []
    for seq, kind, ts, until in reversed(events):
        if kind == START and until > end and not any(t >= ts and u >= until for t, u in longest):
            windows.append((seq, ts, until))
            longest = _hidden([*longest, (ts, until)])
    return candidates, windows


def _first(ends: Sequence[tuple], held: Sequence[tuple[int, int]]) -> tuple | None:
    """The first (seq, ts, ...) that no held window refuses."""
    return next((e for e in ends if all(t <= e[1] for t, u in held if u > e[0])), None)


def carried(chunks: Iterator[tuple[int, int, list, list]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(chunk, windows open at its begin) from (chunk, last seq, candidates, windows) in order."""
    held: list[tuple[int, int]] = []
    for chunk, end, candidates, windows in chunks:
        yield chunk, held
        first = _first(candidates, held)
        if first is not None:
            held = _hidden([(t, u) for s, t, u in windows if s > first[2]])
        else:
            held = _hidden([(t, u) for t, u in held if u > end] + [(t, u) for _, t, u in windows])


def effective(events: Sequence[Event], held: Sequence[tuple[int, int]]) -> list[int]:
    """The ends of a chunk that take effect, given the windows open at its begin."""
    blockers = _blockers(events)
    after = _chain(blockers)
    first = _first([(s, t) for s, kind, t, _ in events if kind == END and blockers[s] is None], held)
    out, seq = [], first[0] if first else None
    while seq is not None:
        out.append(seq)
        seq = after.get(seq)
    return out


def _events(group: pd.DataFrame) -> list[Event]:
    rows = group.sort_values("seq", kind="stable")
    return list(zip(rows["seq"].tolist(), rows["kind"].tolist(), rows["ts"].tolist(), rows["until"].tolist()))


def effective_ends(log: DataFrame, keys: Sequence[str], rows: int = ROWS) -> DataFrame:
    """(keys, seq) of the ends of everything that take effect.

    `log` has (keys, seq, action, ts, id), a whole history per key: starts, ends of one window
    by its id, and ends of everything with a NULL id.
    """
    names = list(keys)
    log = log.where("ts IS NOT NULL")
    start = log.where("action = 'start'").select(*names, "id", "seq", "ts")
    by_id = log.where("action = 'end' AND id IS NOT NULL").select(
        *names, "id", F.col("seq").alias("__seq"), F.col("ts").alias("__ts")
    )
    # the first end by id that is not refused, whatever ends of everything do
    closed = start.join(by_id, [*names, "id"]).where("__seq > seq AND __ts >= ts").groupBy(*names, "seq").agg(
        F.min("__seq").alias("__until")
    )
    starts = start.join(closed, [*names, "seq"], "left").select(
        *names, "seq", F.lit(START).alias("kind"), "ts", F.coalesce("__until", F.lit(NEVER)).alias("until")
    )
    ends = log.where("action = 'end' AND id IS NULL").select(
        *names, "seq", F.lit(END).alias("kind"), "ts", F.lit(0).cast("bigint").alias("until")
    )
    gone = closed.select(
        *names, F.col("__until").alias("seq"), F.lit(CLOSED).alias("kind"), F.lit(0).cast("bigint").alias("ts"),
        F.lit(0).cast("bigint").alias("until"),
    )
    events = settle(starts.unionByName(ends).unionByName(gone), "commands")
    width = measured_width(events, names, "seq", rows)
    placed = numbered(events, names, ["seq"], into="__n", width=width)
    chunks = settle(placed.withColumn("chunk", F.expr(f"__n div {rows}")).drop("__n"), "chunks")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields if f.name in names)
    order = [f.name for f in log.schema.fields if f.name in names]
    window = "array<struct<seq:bigint,ts:bigint,until:bigint>>"

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        found = _events(group)
        candidates, windows = summary(found)
        pack = lambda rows, names: [dict(zip(names, r)) for r in rows]
        return pd.DataFrame([[
            *group.iloc[0][order], int(group["chunk"].iloc[0]), found[-1][0],
            pack(candidates, ("seq", "ts", "until")), pack(windows, ("seq", "ts", "until")),
        ]], columns=[*order, "chunk", "last", "candidates", "windows"])

    summed = chunks.groupBy(*names, "chunk").applyInPandas(
        summarise, f"{schema}, chunk bigint, last bigint, candidates {window}, windows {window}"
    )

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        unpack = lambda rows: [(r["seq"], r["ts"], r["until"]) for r in rows]
        ordered = group.sort_values("chunk")
        found = carried(
            (c, end, unpack(cs), unpack(ws)) for c, end, cs, ws in
            zip(ordered["chunk"], ordered["last"], ordered["candidates"], ordered["windows"])
        )
        rows = [[*group.iloc[0][order], c, [{"ts": t, "until": u} for t, u in held]] for c, held in found]
        return pd.DataFrame(rows, columns=[*order, "chunk", "held"])

    held = summed.groupBy(*names).applyInPandas(
        carry, f"{schema}, chunk bigint, held array<struct<ts:bigint,until:bigint>>"
    )

    def decide(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        open_ = [(w["ts"], w["until"]) for row in before["held"] for w in row]
        seqs = effective(_events(group), open_) if len(group) else []
        return pd.DataFrame([[*group.iloc[0][order], s] for s in seqs], columns=[*order, "seq"])

    on = [*names, "chunk"]
    return chunks.groupBy(*on).cogroup(held.groupBy(*on)).applyInPandas(decide, f"{schema}, seq bigint")
