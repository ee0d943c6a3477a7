"""Experiment windows: folding the command log, listing, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import rules as R
from fleetlens.functions.text import strip
from fleetlens.session import settle
from fleetlens.operators.ordered import WIDTH, last_known, running_max, running_total
from fleetlens.operators.refusals import ROWS, effective_ends

COMMANDS = T.StructType([
    T.StructField("host_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("notes", T.StringType()),
])

_OUT = ("host_id", "id", "ts_start", "ts_end", "label", "notes")


def valid_commands(commands: DataFrame) -> DataFrame:
    """Strip labels; drop blank starts and ends that name an id below 1."""
    bare = commands.withColumn("label", strip(F.col("label")))
    start = (F.col("action") == "start") & (F.coalesce(F.col("label"), F.lit("")) != "")
    end = (F.col("action") == "end") & (F.col("id").isNull() | (F.col("id") > 0))
    return bare.where(start | end)


def as_commands(windows: DataFrame) -> DataFrame:
    """Commands that leave the given windows, before any command with a sequence from 0 on."""
    seq = F.lit(-(1 << 62)).cast("bigint") + F.col("id") * 2
    start = F.struct(seq.alias("seq"), F.lit("start").alias("action"), F.col("ts_start").alias("ts"))
    end = F.struct((seq + 1).alias("seq"), F.lit("end").alias("action"), F.col("ts_end").alias("ts"))
    each = F.when(F.col("ts_end").isNull(), F.array(start)).otherwise(F.array(start, end))
    return windows.select("host_id", "id", "label", "notes", F.inline(each))


def fold_commands(commands: DataFrame, *, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """Windows left by a log of `start` and `end` commands of many hosts.

    A start opens window `id`. An end closes window `id`, or with a NULL id all
    open windows of the host; it is refused as a whole when one of them starts
    after the end.

    An end of everything that is not before any start so far cannot be refused,
    so nothing before it matters to what follows: the log falls apart there into
    stretches that are independent of each other. Where the clock went back, a
    stretch has ends that may be refused; which of them are is found out chunk by
    chunk (`refusals`). Once the ends that take effect are known, a window closes at
    the first of them or at its own end by id, and both are joins.
    """
    log = valid_commands(commands)
    is_start = F.col("action") == "start"
    closes_all = (F.col("action") == "end") & F.col("id").isNull()
    latest = running_max(
        log, ["host_id"], ["seq"], F.when(is_start, F.col("ts")), into="__latest", width=width
    )
    cut = closes_all & (F.col("__latest").isNull() | (F.col("ts") >= F.col("__latest")))
    marked = latest.withColumn("__cut", cut)
    # The stretch number counts the cuts strictly before a row.
    staged = running_total(
        marked, ["host_id"], ["seq"], F.col("__cut").cast("int"), into="__upto", width=width
    ).withColumn("__stretch", F.col("__upto") - F.col("__cut").cast("int"))
    staged = settle(staged, "commands")
    on = ["host_id", "__stretch"]
    doubt = staged.where(closes_all & ~F.col("__cut")).select(*on).distinct()
    decided = effective_ends(staged.join(doubt, on, "left_semi"), on, rows)
    taken = settle(decided.select("host_id", "seq", F.lit(True).alias("__taken")), "effective-ends")
    known = staged.join(taken, ["host_id", "seq"], "left").withColumn(
        "__cut", F.col("__cut") | F.coalesce("__taken", F.lit(False))
    )
    return _by_joins(known, width).select(*_OUT)


def _by_joins(log: DataFrame, width: int) -> DataFrame:
    """Windows of a log whose effective ends of everything are marked."""
    starts = log.where(F.col("action") == "start")
    # The next end of everything, carried back to every start before it.
    turned = log.where((F.col("action") == "start") | F.col("__cut")).withColumn(
        "__back", -F.col("seq")
    )
    closed = _next_cut(turned, width).where(F.col("action") == "start")
    by_id = log.where((F.col("action") == "end") & F.col("id").isNotNull()).select(
        "host_id", "id", F.col("seq").alias("__end_seq"), F.col("ts").alias("__end_ts")
    )
    own = (
        starts.select("host_id", "id", "seq", "ts")
        .join(by_id, ["host_id", "id"])
        .where((F.col("__end_seq") > F.col("seq")) & (F.col("__end_ts") >= F.col("ts")))
        .groupBy("host_id", "id")
        .agg(F.min(F.struct("__end_seq", "__end_ts")).alias("__own"))
    )
    joined = closed.join(own, ["host_id", "id"], "left")
    end = F.least(F.col("__own"), F.col("__all"))
    return joined.select(
        "host_id", "id", F.col("ts").alias("ts_start"), end["__end_ts"].alias("ts_end"),
        "label", "notes",
    )


def _next_cut(turned: DataFrame, width: int) -> DataFrame:
    cut = F.when(
        F.col("__cut"), F.struct(F.col("seq").alias("__end_seq"), F.col("ts").alias("__end_ts"))
    )
    return last_known(turned, ["host_id"], ["__back"], cut, into="__all", width=width)


def with_advice(labels: DataFrame, known: Sequence[str] = R.KNOWN_LABELS) -> DataFrame:
    """Labels outside the usual list are accepted and carry a note."""
    return labels.withColumn(
        "advice",
        F.when(~F.col("label").isin(*known), F.concat(F.lit("not a usual label: "), F.col("label"))),
    )


def list_labels(labels: DataFrame, include_closed: bool = False) -> DataFrame:
    shown = labels if include_closed else labels.where(F.col("ts_end").isNull())
    return shown.orderBy("ts_start", "id")
