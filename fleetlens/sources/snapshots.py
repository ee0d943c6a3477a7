"""Jobs over landed file snapshots (boot_id, tick, mono_us, path, content).

Each job reads the rows of its own files, so the path filter and the column
selection reach the scan. A NULL content is a file that could not be read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.functions import text as X
from fleetlens.operators.spine import at_start, on_spine, ticks_of

TICK = ("boot_id", "tick")


def of_path(snapshots: DataFrame, path: str) -> DataFrame:
    return snapshots.where(F.col("path") == path)


# A CPU line whose first 8 counters (5 at least) are whole numbers.
_CPU_LINE = (
    r"(?m)^[ \t]*(cpu\d*)((?:[ \t]+\+?\d+){8}(?=[ \t]|$)|(?:[ \t]+\+?\d+){5,7}(?=[ \t]*$))"
)


def cpu_stat(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    """One row per snapshot with `cpus`: name to time counters; the last line wins.

    Guest time is part of user and nice already, so 8 counters are enough.
    """
    content = F.coalesce("content", F.lit(""))
    found = X.compute(
        of_path(snapshots, "/proc/stat").select(*keys, "content"),
        __names=F.regexp_extract_all(content, F.lit(_CPU_LINE), F.lit(1)),
        __values=F.transform(
            F.regexp_extract_all(content, F.lit(_CPU_LINE), F.lit(2)),
            lambda numbers: F.transform(X.tokens(numbers), lambda n: n.try_cast("bigint")),
        ),
    )
    # Reversed, so that the last line of a name is found first.
    names, values = F.reverse("__names"), F.reverse("__values")
    turned = X.compute(found.select(*keys, names.alias("n"), values.alias("v")),
                       cpus=F.map_from_arrays(
                           F.array_distinct("n"),
                           F.transform(F.array_distinct("n"),
                                       lambda name: F.element_at("v", F.array_position("n", name).cast("int"))),
                       ))
    return turned.select(*keys, "cpus")


def cpu_stat_rows(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    return cpu_stat(snapshots, keys).select(*keys, F.explode("cpus").alias("cpu", "counters"))


def _last_number(content: Column, key: str) -> Column:
    """The number on the last `key: number` line."""
    found = F.regexp_extract_all(content, F.lit(rf"(?m)^{key}:[ \t]*(\d+)(?!\S)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("bigint")


def memory_used(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    """Used memory and swap in MB; NULL when either part is missing."""
    def used(total: str, free: str) -> Column:
        gap = _last_number(F.col("content"), total) - _last_number(F.col("content"), free)
        return gap.cast("double") / 1024.0

    return of_path(snapshots, "/proc/meminfo").select(
        *keys,
        used("MemTotal", "MemAvailable").alias("mem_used_mb"),
        used("SwapTotal", "SwapFree").alias("swap_used_mb"),
    )


def first_number(
    snapshots: DataFrame, path: str, column: str, keys: Sequence[str] = TICK
) -> DataFrame:
    """The first word of a file as a number."""
    word = F.get(X.tokens(F.col("content")), F.lit(0))
    return of_path(snapshots, path).select(*keys, word.try_cast("double").alias(column))


def load_average(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    return first_number(snapshots, "/proc/loadavg", "load1", keys)


def uptime(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    return first_number(snapshots, "/proc/uptime", "uptime_s", keys)


# Frequency files, the preferred one first.
FREQUENCY_FILES = ("cpuinfo_avg_freq", "scaling_cur_freq")


def cpu_frequency(snapshots: DataFrame, keys: Sequence[str] = ("boot_id",)) -> DataFrame:
    """Mean frequency in MHz per tick, from the one kind of file chosen per boot.

    The files readable at a boot's first tick decide: cores with the preferred
    file if there is any, else the other kind. Later ticks average what can
    still be read of those very files.
    """
    pattern = r"cpufreq/(" + "|".join(FREQUENCY_FILES) + ")$"
    file = F.regexp_extract("path", pattern, 1)
    rank = F.array_position(F.array(*[F.lit(f) for f in FREQUENCY_FILES]), F.col("file"))
    readings = snapshots.where(F.col("path").rlike(pattern)).select(
        *keys, "tick", "path", file.alias("file"), X.whole_number(F.col("content")).alias("khz")
    ).withColumn("rank", rank)
    # the files of the boot's first tick, found without reading any other tick's content
    usable = at_start(readings, ticks_of(snapshots, boots=keys), keys).where("khz IS NOT NULL")
    best = usable.groupBy(*keys).agg(F.min("rank").alias("rank"))
    chosen = usable.join(best, [*keys, "rank"], "left_semi").select(*keys, "path")
    used = readings.join(chosen, [*keys, "path"], "left_semi")
    return used.groupBy(*keys, "tick").agg((F.avg("khz") / 1000.0).alias("cpu_freq_avg"))


def pressure(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    """The five avg10 pressure columns per tick, from one grouping."""
    def avg10(line: str) -> Column:
        pattern = rf"(?m)^[ \t]*{line}[ \t](?:[^\r\n]*?[ \t])?avg10=(\S+)"
        found = F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(1))
        values = F.filter(F.transform(found, lambda w: w.try_cast("double")), lambda v: v.isNotNull())
        return F.try_element_at(values, F.lit(-1))

    files = [f"/proc/pressure/{name}" for name in dict.fromkeys(p[0] for p in R.PRESSURE)]
    read = snapshots.where(F.col("path").isin(*files)).select(
        *keys, "path", avg10("some").alias("some"), avg10("full").alias("full")
    )
    return read.groupBy(*keys).agg(*[
        F.max(F.when(F.col("path") == f"/proc/pressure/{file}", F.col(line))).alias(column)
        for file, line, column in R.PRESSURE
    ])


def interrupt_totals(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    """(label, total) of the symbolic interrupt rows, summed over processors.

    Numbers are added up to the first word that is none; that is where the
    description starts. A label that occurs twice keeps its last row. The labels of
    the boot's first tick have a row at every tick, NULL where the file or the label
    could not be read.
    """
    label = X.strip(F.substring_index("line", ":", 1))
    rest = F.substring(F.col("line"), F.locate(":", F.col("line")) + 1, F.length("line"))
    rows = (
        of_path(snapshots, "/proc/interrupts")
        .select(*keys, F.posexplode(X.lines(F.col("content"))).alias("__at", "line"))
        .where(F.col("line").contains(":"))
        .select(*keys, "__at", label.alias("label"), rest.alias("__rest"))
        .where((F.col("label") != "") & ~F.col("label").rlike(r"^\d+$") & (F.col("__rest") != ""))
    )
    numbers = F.regexp_extract("__rest", r"(?U)^((?:\s*-*\d+(?=\s|$))*)", 1)
    total = F.aggregate(
        F.transform(X.tokens(numbers), lambda t: t.try_cast("bigint")),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x,
    )
    totals = rows.groupBy(*keys, "label").agg(F.max_by(total, "__at").alias("total"))
    return on_spine(totals, ticks_of(snapshots), [*keys[:-1], "label"], boots=keys[:-1])


def interrupt_counters(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    """Interrupt totals that feed counter columns, in the long counter layout."""
    pairs = [F.lit(x) for item in R.INTERRUPT_FIELDS.items() for x in item]
    field = F.try_element_at(F.create_map(*pairs), F.col("label"))
    found = interrupt_totals(snapshots, keys).withColumn("field", field)
    return found.where(F.col("field").isNotNull()).select(*keys, "field", F.col("total").alias("raw"))


def oom_kills(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    """The kernel's count of killed processes."""
    found = F.regexp_extract_all(F.col("content"), F.lit(r"(?m)^oom_kill[ \t]+(-*\d+)[ \t]*$"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1)).try_cast("bigint")
    return of_path(snapshots, "/proc/vmstat").select(
        *keys, F.lit("err_oom_kill").alias("field"), last.alias("raw")
    )


def named_counter(content: Column, skip_totals: bool) -> Column:
    """Sum of the last word of each line; NULL for a bad line or an empty file."""
    split = F.transform(X.lines(content), lambda x: X.tokens(F.regexp_replace(x, ":", " ")))
    kept = F.filter(split, lambda w: F.size(w) > 0)
    if skip_totals:
        kept = F.filter(kept, lambda w: ~F.get(w, F.lit(0)).startswith("TOTAL_ERR_"))
    values = F.transform(
        kept, lambda w: F.when(F.size(w) >= 2, X.digits(F.element_at(w, -1)))
    )
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total)


def _summed_files(each: DataFrame, snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field, raw): the sum over the files a field had at the boot's first tick.

    `each` has (keys, field, path, __v). A file that is missing or unreadable, or a
    negative value, makes the sum NULL; so does a tick without any of them.
    """
    boots = list(keys[:-1])
    filled = on_spine(each, ticks_of(snapshots, boots=boots), [*boots, "field", "path"], boots=boots)
    good = F.col("__v") >= 0
    return filled.groupBy(*keys, "field").agg(
        F.when(F.count_if(good) == F.count("*"), F.sum("__v")).alias("raw")
    )


def named_counters(
    snapshots: DataFrame, field: str, pattern: str, *, skip_totals: bool, keys: Sequence[str] = TICK
) -> DataFrame:
    """A counter summed over the files of all devices; one bad or vanished file spoils the sum."""
    each = snapshots.where(F.col("path").rlike(pattern)).select(
        *keys, F.lit(field).alias("field"), "path", named_counter(F.col("content"), skip_totals).alias("__v")
    )
    return _summed_files(each, snapshots, keys)


# Counter columns kept as `name value` lines; AER files repeat a total.
NAMED_COUNTERS = (
    ("err_aer_corr", r"/aer_dev_correctable$", True),
    ("err_aer_nonfatal", r"/aer_dev_nonfatal$", True),
    ("err_aer_fatal", r"/aer_dev_fatal$", True),
    ("err_gpu_ras", r"/ras/[^/]*_err_count$", False),
)

# Counter columns kept as one integer per device file.
INTEGER_COUNTERS = (
    ("err_ecc_ce", r"/edac/mc/mc[^/]*/ce_count$"),
    ("err_ecc_ue", r"/edac/mc/mc[^/]*/ue_count$"),
    ("err_cpu_throttle", r"/thermal_throttle/core_throttle_count$"),
    ("err_pkg_throttle", r"/thermal_throttle/package_throttle_count$"),
    ("err_disk_io", r"/device/ioerr_cnt$"),
)


def integer_counters(
    snapshots: DataFrame,
    keys: Sequence[str] = TICK,
    files: Sequence[tuple[str, str]] = INTEGER_COUNTERS,
) -> DataFrame:
    """Counters summed over device files; a missing or negative one gives NULL."""
    field = F.lit(None).cast("string")
    for name, pattern in files:
        field = F.when(F.col("path").rlike(pattern), F.lit(name)).otherwise(field)
    each = snapshots.select(*keys, field.alias("field"), "path", X.whole_number(F.col("content")).alias("__v"))
    return _summed_files(each.where("field IS NOT NULL"), snapshots, keys)


def processes(snapshots: DataFrame, keys: Sequence[str] = TICK) -> DataFrame:
    """One row per process file: pid, comm, jiffies, start time.

    The command sits between the first `(` and the last `)`. Files that cannot
    be used keep their row with NULLs, since they still count as a process.
    """
    pid = F.regexp_extract("path", r"^/proc/(\d+)/stat$", 1)
    body = F.col("content")
    rest = X.tokens(F.regexp_extract(body, r"(?s)^[^(]*\(.*\).?([^)]*)$", 1))
    comm = F.regexp_extract(body, r"(?s)^[^(]*\((.*)\)", 1)
    parsed = snapshots.where(pid != "").select(
        *keys, "mono_us", pid.cast("bigint").alias("pid"), comm.alias("comm"), rest.alias("__rest"),
        body.rlike(r"(?s)\(.*\)").alias("__framed"),
    )
    whole = F.col("__framed") & (F.size("__rest") >= 20)

    def field(n: int) -> Column:
        return X.whole_number(F.get("__rest", F.lit(n)))

    jiffies, start = field(11) + field(12), field(19)
    usable = whole & jiffies.isNotNull() & start.isNotNull()
    return parsed.select(
        *keys, "mono_us", "pid",
        F.when(usable, F.col("comm")).alias("comm"),
        F.when(usable, jiffies).alias("jiffies"),
        F.when(usable, start).alias("starttime"),
    )


def active_window(reply: Column) -> Column:
    """`class|title` of a compositor reply, '' for no window, NULL when unknown."""
    entry = F.try_parse_json(reply)
    kind = F.schema_of_variant(entry)

    def text(name: str) -> Column:
        member = F.try_variant_get(entry, f"$.{name}", "variant")
        return F.when(
            F.schema_of_variant(member) == "STRING", F.try_variant_get(entry, f"$.{name}", "string")
        )

    return F.when(kind == "OBJECT<>", F.lit("")).when(
        kind.startswith("OBJECT<"), F.concat(text("class"), F.lit("|"), text("title"))
    )
