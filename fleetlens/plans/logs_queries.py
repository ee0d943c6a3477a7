"""Registered queries: log parsing, classification, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import faults, rules as R
from fleetlens.operators import derive
from fleetlens.operators import events as E
from fleetlens.plans import fixtures as fx
from fleetlens.plans.fixtures import sql
from fleetlens.plans.registry import query
from fleetlens.session import settle
from fleetlens.sources.logs import parse_journal, parse_kmsg

DAY = 86_400_000
MIDDLE = fx.EPOCH_MS + 15 * DAY


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_case(column: str, text: str = "body", level: str = "level") -> str:
    """The rule list as a CASE for another SQL engine."""
    at = {"kind": lambda r: r.kind, "severity": lambda r: r.severity}[column]
    lines = [f"WHEN regexp_matches({text}, {_quoted('|'.join(R.BENIGN))}, 'i') THEN NULL"]
    lines += [
        f"WHEN regexp_matches({text}, {_quoted(r.pattern)}, 'i') THEN '{at(r)}'" for r in R.RULES
    ]
    rest = (R.CATCH_ALL, R.CATCH_ALL) if column == "kind" else (R.CRITICAL, R.ERROR)
    lines += [f"WHEN {level} <= 2 THEN '{rest[0]}'", f"WHEN {level} <= 3 THEN '{rest[1]}'"]
    return "CASE " + "\n".join(lines) + " END"


_MEANINGS = " ".join(f"WHEN '{c}' THEN {_quoted(m)}" for c, m in R.XID_MEANINGS.items())
_CODE = f"regexp_extract(body, {_quoted(R.XID_PATTERN)}, 1, 'i')"
XID_SQL = f"concat('Xid ', {_CODE}, ': ', CASE {_CODE} {_MEANINGS} ELSE 'unlisted code' END)"
_MESSAGE = f"CASE WHEN kind = 'gpu_xid' AND {_CODE} <> '' THEN concat({XID_SQL}, ' — ', body) ELSE body END"

RECORDS_SQL = {
    "rec": """
SELECT boot_id, tick, event_id AS seq, ts_ms AS ts, level, body,
       concat(boot_id, ':', CAST(event_id AS VARCHAR)) AS dedup
FROM fx_kmsg_raw WHERE k % 31 <> 0""",
    "cls": f"SELECT *, {rule_case('kind')} AS kind, {rule_case('severity')} AS severity FROM rec",
}
EVENTS_SQL = {
    **RECORDS_SQL,
    "placed": """
SELECT *, row_number() OVER (PARTITION BY boot_id, tick ORDER BY seq) AS n
FROM cls WHERE kind IS NOT NULL""",
    "ev": f"""
SELECT boot_id, tick, ts, 'kmsg' AS source, kind, severity, left({_MESSAGE}, 4000) AS message, dedup
FROM placed WHERE n <= 50
UNION ALL
SELECT boot_id, tick, max(ts), 'kmsg', 'event_storm', 'warning',
       concat(CAST(count(*) AS VARCHAR), ' more fault messages not listed'), NULL
FROM placed WHERE n > 50 GROUP BY boot_id, tick""",
}


def records(spark, sf_dir):
    return parse_kmsg(fx.kmsg_raw(spark, sf_dir).drop("event_id", "ts_ms"))


def classified(spark, sf_dir):
    return E.classify(records(spark, sf_dir))


def stored_events(spark, sf_dir):
    return E.log_events(classified(spark, sf_dir))


@query("q_kmsg_parse", sql("""
SELECT boot_id, tick, seq, ts, level, body AS text, dedup FROM rec
""", "fx_kmsg_raw", extra=RECORDS_SQL))
def kmsg_parse(spark, sf_dir):
    return records(spark, sf_dir)


def journal_line():
    """Entries of many shapes; five in nine shapes are broken."""
    k, case = F.col("k").cast("string"), F.col("k") % 9
    time = F.col("ts_us").cast("string")
    message = fx.pick(case, {
        0: "[256]", 1: "[true]", 2: '"  "', 3: "[112,97,110,105,99]",
    })
    plain = F.concat(F.lit('" message '), k, F.lit('\\n"'))
    level = F.when(case == 4, F.lit("")).when(case == 5, F.lit(',"PRIORITY":9')).when(
        case == 8, F.concat(F.lit(',"PRIORITY":"'), (F.col("k") % 8).cast("string"), F.lit('"'))
    ).otherwise(F.concat(F.lit(',"PRIORITY":'), (F.col("k") % 8).cast("string")))
    cursor = F.when(F.col("k") % 2 == 0, F.concat(
        F.lit(',"__CURSOR":"s='), F.col("event_id").cast("string"), F.lit('"')
    )).otherwise("")
    return F.concat(
        F.lit('{"MESSAGE":'), F.coalesce(message, plain), F.lit(',"__REALTIME_TIMESTAMP":'),
        F.when(case == 6, F.lit("true")).when(case == 7, time).otherwise(
            F.concat(F.lit('"'), time, F.lit('"'))
        ),
        level, cursor, F.lit("}"),
    )


@query("q_journal_parse", sql("""
SELECT event_id, ts_us // 1000 AS ts, CASE WHEN k % 9 = 4 THEN 6 ELSE CAST(k % 8 AS INTEGER) END AS level,
       CASE WHEN k % 9 = 3 THEN 'panic' ELSE concat('message ', CAST(k AS VARCHAR)) END AS text,
       CASE WHEN k % 2 = 0 THEN concat('s=', CAST(event_id AS VARCHAR)) END AS dedup
FROM fx_base WHERE k % 9 NOT IN (0, 1, 2, 5, 6)
"""))
def journal_parse(spark, sf_dir):
    return parse_journal(fx.base(spark, sf_dir).select("event_id", journal_line().alias("line")))


@query("q_classify", sql("""
SELECT boot_id, seq, kind, severity FROM cls
""", "fx_kmsg_raw", extra=RECORDS_SQL))
def classify(spark, sf_dir):
    return classified(spark, sf_dir).select("boot_id", "seq", "kind", "severity")


@query("q_xid", sql(f"""
SELECT event_id, CAST({_CODE} AS INTEGER) AS code, {XID_SQL} AS detail
FROM (SELECT event_id, concat('NVRM: Xid (PCI:0000:0', CAST(user_id % 10 AS VARCHAR), ':00): ',
        CAST(k AS VARCHAR), ', channel ', CAST(user_id AS VARCHAR)) AS body FROM fx_base) x
"""))
def xid(spark, sf_dir):
    text = F.concat(
        F.lit("NVRM: Xid (PCI:0000:0"), (F.col("user_id") % 10).cast("string"), F.lit(":00): "),
        F.col("k").cast("string"), F.lit(", channel "), F.col("user_id").cast("string"),
    )
    return fx.base(spark, sf_dir).select(
        "event_id", faults.xid_code(text).cast("int").alias("code"), faults.xid_detail(text).alias("detail")
    )


@query("q_kmsg_tick_counts", sql("""
SELECT t.boot_id, t.tick, count(c.seq)::DOUBLE AS kmsg_messages,
       count(c.seq) FILTER (c.severity = 'critical')::DOUBLE AS kmsg_criticals,
       count(c.seq) FILTER (c.severity <> 'critical')::DOUBLE AS kmsg_errors
FROM (SELECT DISTINCT boot_id, ts_ms // 3600000 AS tick FROM fx_base) t
LEFT JOIN cls c ON c.boot_id = t.boot_id AND c.ts // 3600000 = t.tick
GROUP BY t.boot_id, t.tick
""", "fx_kmsg_raw", extra=RECORDS_SQL))
def kmsg_tick_counts(spark, sf_dir):
    """Hourly ticks; an hour with nothing but broken lines counts 0.0."""
    hour = F.expr("ts_ms div 3600000").alias("tick")
    ticks = fx.base(spark, sf_dir).select("boot_id", hour)
    found = classified(spark, sf_dir).withColumn("tick", F.expr("ts div 3600000"))
    return E.tick_counts(found, ticks)


@query("q_rule_catalogue", sql(f"""
SELECT r.position, r.kind, r.severity, coalesce(c.n, 0) AS n
FROM (VALUES {', '.join(f"({i}, '{r.kind}', '{r.severity}')" for i, r in enumerate(R.RULES, 1))})
     r(position, kind, severity)
LEFT JOIN (SELECT kind, count(*) AS n FROM cls GROUP BY kind) c USING (kind)
""", "fx_kmsg_raw", extra=RECORDS_SQL))
def rule_catalogue(spark, sf_dir):
    """Every kind the rules know, with how often the logs show it."""
    counted = E.only_faults(classified(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))
    return E.rule_catalogue(spark).join(counted, "kind", "left").select(
        "position", "kind", "severity", F.coalesce("n", F.lit(0)).alias("n")
    )


@query("q_event_dedup", sql(f"""
SELECT event_id, ts, dedup FROM (
  SELECT event_id, ts_ms AS ts, key AS dedup,
         row_number() OVER (PARTITION BY key ORDER BY event_id) AS nth
  FROM (SELECT *, CASE WHEN k % 5 > 0 THEN concat(boot_id, ':', CAST(user_id * 10 + k % 10 AS VARCHAR)) END AS key
        FROM fx_base) b) d
WHERE dedup IS NULL OR (nth = 1 AND dedup NOT IN (
  SELECT concat(boot_id, ':', CAST(user_id * 10 + k % 10 AS VARCHAR)) FROM fx_base
  WHERE ts_ms < {fx.EPOCH_MS + DAY}))
"""))
def event_dedup(spark, sf_dir):
    """Keys seen on the first day are stored already; rows without a key all stay."""
    key = F.concat("boot_id", F.lit(":"), (F.col("user_id") * 10 + F.col("k") % 10).cast("string"))
    rows = fx.base(spark, sf_dir).select(
        "event_id", F.col("ts_ms").alias("ts"), F.when(F.col("k") % 5 > 0, key).alias("dedup"), key.alias("key")
    )
    known = rows.where(F.col("ts") < fx.EPOCH_MS + DAY).select(F.col("key").alias("dedup"))
    return E.new_only(rows.drop("key"), known, ["event_id"])


@query("q_event_storm", sql("""
SELECT boot_id, tick, ts, message, severity FROM ev WHERE kind = 'event_storm'
""", "fx_kmsg_raw", extra=EVENTS_SQL))
def event_storm(spark, sf_dir):
    _, suppressed = E.cap_events(settle(E.only_faults(classified(spark, sf_dir)), "faults"))
    return E.storm_events(suppressed).select("boot_id", "tick", "ts", "message", "severity")


_REPLAY_SQL = {
    **RECORDS_SQL,
    "old": f"""
SELECT *, row_number() OVER (PARTITION BY boot_id ORDER BY seq) AS n
FROM cls WHERE kind IS NOT NULL AND ts < {MIDDLE}""",
    "live": f"""
SELECT *, sum(fresh) OVER (PARTITION BY boot_id, day ORDER BY seq) AS n
FROM (SELECT *, ts // 86400000 AS day,
             CASE WHEN dedup IN (SELECT dedup FROM old WHERE n <= 50) THEN 0 ELSE 1 END AS fresh
      FROM cls WHERE kind IS NOT NULL AND ts >= {MIDDLE - DAY}) x""",
}
_STORM = "concat(CAST(count(*) AS VARCHAR), ' more fault messages not listed')"


@query("q_kmsg_events", sql(f"""
SELECT boot_id, ts, kind, severity, {_MESSAGE} AS message, dedup, TRUE AS replayed FROM old WHERE n <= 50
UNION ALL SELECT boot_id, max(ts), 'event_storm', 'warning', {_STORM}, NULL, TRUE
FROM old WHERE n > 50 GROUP BY boot_id
UNION ALL SELECT boot_id, ts, kind, severity, {_MESSAGE}, dedup, FALSE FROM live WHERE fresh = 1 AND n <= 50
UNION ALL SELECT boot_id, max(ts), 'event_storm', 'warning', {_STORM}, NULL, FALSE
FROM live WHERE n >= 50 AND NOT (fresh = 1 AND n <= 50) GROUP BY boot_id, day
""", "fx_kmsg_raw", extra=_REPLAY_SQL))
def kmsg_events(spark, sf_dir):
    """The replay of a boot is one capped batch; following it starts a day back."""
    found = classified(spark, sf_dir)
    replay = E.log_events(found.where(F.col("ts") < MIDDLE), keys=["boot_id"])
    live = found.where(F.col("ts") >= MIDDLE - DAY).withColumn("tick", F.expr("ts div 86400000"))
    followed = E.log_events(live, replay)
    out = replay.withColumn("replayed", F.lit(True)).unionByName(
        followed.drop("tick").withColumn("replayed", F.lit(False))
    )
    return out.drop("source")


@query("q_recent_events", sql("""
SELECT seq AS id, ts, kind, severity, body AS message FROM cls
WHERE kind IS NOT NULL ORDER BY ts DESC, seq DESC LIMIT 20
""", "fx_kmsg_raw", extra=RECORDS_SQL))
def recent_events(spark, sf_dir):
    rows = E.only_faults(classified(spark, sf_dir)).select(
        F.col("seq").alias("id"), "ts", "kind", "severity", F.col("text").alias("message")
    )
    return E.recent_events(rows)


@query("q_events_by_kind", sql("""
SELECT source, kind, count(*) AS n FROM ev GROUP BY source, kind ORDER BY n DESC, source, kind
""", "fx_kmsg_raw", extra=EVENTS_SQL))
def events_by_kind(spark, sf_dir):
    return E.events_by_kind(stored_events(spark, sf_dir))


@query("q_fault_scan", sql(f"""
SELECT boot_id, kind, arg_min(severity, place) AS severity, count(*) AS n,
       count(*) FILTER (severity = 'critical') AS criticals,
       string_agg(message, ' | ' ORDER BY place) FILTER (nth <= 6) AS examples,
       greatest(count(*) - 6, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY boot_id, kind ORDER BY place) AS nth FROM (
  SELECT boot_id, kind, severity, {_MESSAGE} AS message, seq AS place FROM one WHERE n <= 50
  UNION ALL SELECT boot_id, 'event_storm', 'warning', {_STORM}, 2000000000000 FROM one WHERE n > 50 GROUP BY boot_id
  UNION ALL SELECT boot_id, CASE field WHEN 'err_nmi' THEN 'nmi' ELSE 'mce' END, 'warning',
    concat(field, '=', CAST(raw AS VARCHAR), ' when collection started'), 3000000000000
  FROM fx_counters JOIN (SELECT boot_id, min(event_id) AS tick FROM fx_base GROUP BY boot_id) b USING (boot_id, tick)
  WHERE raw > 0) e) p
GROUP BY boot_id, kind
""", "fx_kmsg_raw", "fx_counters", extra={**RECORDS_SQL, "one": """
SELECT *, row_number() OVER (PARTITION BY boot_id ORDER BY seq) AS n FROM cls WHERE kind IS NOT NULL"""}))
def fault_scan(spark, sf_dir):
    """Everything found on a boot: capped replay, storm note, counters above zero."""
    found = settle(E.only_faults(classified(spark, sf_dir)), "faults")
    kept, suppressed = E.cap_events(found, keys=["boot_id"])
    parts = [
        E.as_events(kept, "kmsg", "boot_id", "seq").withColumn("stage", F.lit(0)),
        E.storm_events(suppressed).withColumns({"stage": F.lit(1), "seq": F.lit(0).cast("bigint")}),
        derive.baseline_events(fx.counters(spark, sf_dir), ticks=fx.ticks(spark, sf_dir)).withColumns(
            {"stage": F.lit(2), "seq": F.col("tick")}
        ),
    ]
    shown = ["boot_id", "stage", "seq", "kind", "severity", "message"]
    everything = parts[0].select(*shown).unionByName(parts[1].select(*shown)).unionByName(
        parts[2].select(*shown)
    )
    scan = E.fault_scan(everything, order=["stage", "seq"])
    return scan.withColumn("examples", F.array_join("examples", " | ")).drop("severity_rank")
