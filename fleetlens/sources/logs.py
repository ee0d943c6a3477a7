"""Kernel log lines and journal entries turned into records.

A record is (ts, level, text, dedup) plus whatever identifies the line's origin.
Broken lines are dropped. Both jobs are plain projections, so they run the same
on a batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as X


def parse_kmsg(raw: DataFrame, line: str = "line", boot_epoch_ms: str = "boot_epoch_ms") -> DataFrame:
    """Lines `priority,sequence,microseconds,flags;text` with a boot_id and boot time.

    Adds ts, level, text, seq and dedup (`boot:sequence`) and drops `line`.
    """
    body = F.col(line)
    at = F.locate(";", body)
    cut = X.compute(
        X.compute(raw, __at=at),
        __head=F.when(F.col("__at") > 0, F.split(F.left(body, F.col("__at") - 1), ",")),
        __rest=F.substring(body, F.col("__at") + 1, F.length(body)),
    )
    read = X.compute(
        cut,
        __priority=X.whole_number(F.get("__head", F.lit(0)), "decimal(38,0)"),
        __sequence=X.whole_number(F.get("__head", F.lit(1)), "decimal(38,0)"),
        __us=X.whole_number(F.get("__head", F.lit(2)), "bigint"),
    )
    good = read.where(
        (F.col("__priority") >= 0) & (F.col("__sequence") >= 0) & (F.col("__us") >= 0)
    )
    return good.withColumns({
        "ts": (F.col(boot_epoch_ms).cast("double") + F.col("__us") / F.lit(1000.0)).cast("bigint"),
        "level": F.pmod(F.col("__priority"), F.lit(8)).cast("int"),
        "text": X.strip(F.substring_index("__rest", "\n", 1)),
        "seq": F.col("__sequence").try_cast("bigint"),
        "dedup": F.concat(F.col("boot_id"), F.lit(":"), F.col("__sequence").cast("string")),
    }).drop(line, boot_epoch_ms, "__at", "__head", "__rest", "__priority", "__sequence", "__us")


def parse_journal(raw: DataFrame, line: str = "line") -> DataFrame:
    """JSON journal entries. Adds ts, level, text, dedup and drops `line`.

    Types are checked on the parsed value before anything is read from it, since
    casts would accept booleans, fractions and lists printed as text.
    """
    def member(name: str):
        return F.expr(f"try_variant_get(__entry, '$.{name}', 'variant')")

    def kind(name: str):
        return F.coalesce(F.schema_of_variant(F.col(name)), F.lit("MISSING"))

    # A lone half of a surrogate pair is no text; the JSON reader lets it pass.
    lone = r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"
    # The reader stops after the first value. Inside an array and an object, anything that
    # follows the entry is an error or a second element.
    framed = X.compute(
        raw.where(~(F.lower(line).contains("\\ud") & F.col(line).rlike(lone))),
        __framed=F.expr(f"""try_parse_json(concat('[{{"a":[', `{line}`, ']}}]'))"""),
    ).where(F.expr("try_variant_get(__framed, '$[0].a[1]', 'variant') IS NULL"))
    parsed = X.compute(framed, __entry=F.expr("try_variant_get(__framed, '$[0].a[0]', 'variant')"))
    entry = parsed.where(F.schema_of_variant("__entry").startswith("OBJECT")).withColumns({
        "__message": member("MESSAGE"),
        "__time": member("__REALTIME_TIMESTAMP"),
        "__priority": member("PRIORITY"),
        "__cursor": member("__CURSOR"),
    }).withColumns({
        "__message_kind": kind("__message"),
        "__time_kind": kind("__time"),
        "__priority_kind": kind("__priority"),
        "__cursor_kind": kind("__cursor"),
    })
    data = F.expr("try_variant_get(__message, '$', 'array<bigint>')")
    in_byte = F.forall(data, lambda b: (b >= 0) & (b <= 255))
    octets = F.unhex(F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    message = (
        F.when(F.col("__message_kind") == "STRING",
               F.expr("try_variant_get(__message, '$', 'string')"))
        .when((F.col("__message_kind") == "ARRAY<BIGINT>") & in_byte,
              F.make_valid_utf8(octets.cast("string")))
    )

    def integer(name: str):
        return F.when(
            F.col(f"{name}_kind") == "STRING",
            X.whole_number(F.expr(f"try_variant_get({name}, '$', 'string')"), "decimal(38,0)"),
        ).when(
            F.col(f"{name}_kind") == "BIGINT",
            F.expr(f"try_variant_get({name}, '$', 'bigint')").cast("decimal(38,0)"),
        )

    read = X.compute(
        entry,
        text=X.strip(message),
        __us=integer("__time"),
        __level=F.when(F.col("__priority_kind") == "MISSING", F.lit(6).cast("decimal(38,0)"))
        .otherwise(integer("__priority")),
        dedup=F.when(F.col("__cursor_kind") == "STRING",
                     F.expr("try_variant_get(__cursor, '$', 'string')")),
    )
    checked = read.withColumn("ts", F.floor(F.col("__us") / 1000).try_cast("bigint"))
    good = checked.where(
        (F.col("text") != "")
        & (F.col("__us") >= 0) & F.col("ts").isNotNull()
        & F.col("__level").between(0, 7)
        & (F.col("__cursor_kind").isin("MISSING", "VOID") | (F.col("dedup") != ""))
    )
    staged = [name for name in checked.columns if name.startswith("__")]
    return good.withColumn("level", F.col("__level").cast("int")).drop(line, *staged)
