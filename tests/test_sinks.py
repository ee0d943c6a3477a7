"""Row identity on append, updated label tables, exclusive copies, isolated sources."""

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import dataset as D, export
from fleetlens.sources.registry import MetricSource, SourceRegistry

COMMAND = "host_id string, seq bigint, action string, ts bigint, id bigint, label string, notes string"


def test_samples_are_numbered_by_arrival(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = "ts bigint, boot_id string, a double"
    D.append_samples(spark.createDataFrame([(9, "x", 1.0), (9, "x", 2.0), (3, "x", 3.0)], rows).coalesce(1), path)
    D.append_samples(spark.createDataFrame([(1, "x", float(n)) for n in range(4, 40)], rows).repartition(5), path)
    stored = spark.read.parquet(path).orderBy("sample_id").collect()
    assert [r.sample_id for r in stored] == list(range(1, 40))
    assert [r.a for r in stored[:3]] == [1.0, 2.0, 3.0] and {r.ts for r in stored[3:]} == {1}
    kept = export.export_rows(spark.read.parquet(path), spark.createDataFrame(
        [], "id bigint, ts_start bigint, ts_end bigint, label string, notes string"))
    assert "sample_id" in kept.columns  # equal timestamps stay apart


def test_events_get_ids_and_short_messages(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = "ts bigint, source string, kind string, message string, dedup string"
    D.append_events(spark.createDataFrame([(1, "s", "k", "é" * 5000, "a"), (2, "s", "k", None, None)], schema), path)
    D.append_events(spark.createDataFrame([(3, "s", "k", "m", "a"), (4, "s", "k", "m", "b")], schema), path)
    stored = spark.read.parquet(path).orderBy("id").collect()
    assert [r.id for r in stored] == [1, 2, 3] and sorted(r.ts for r in stored) == [1, 2, 4]
    assert max(len(r.message or "") for r in stored) == 4000


def test_label_table_is_continued(spark, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    D.write_labels(spark.createDataFrame([
        ("h", 0, "start", 100, 1, "normal", None), ("h", 1, "start", 120, 2, "gaming", "n"), ("h", 2, "end", 150, 2, None, None),
        ("g", 0, "start", 500, 3, "late", None),
    ], COMMAND), first)
    D.write_labels(spark.createDataFrame([
        ("h", 0, "end", 90, None, None, None),  # refused: window 1 starts later
        ("h", 1, "start", 200, 4, "stress_ng", None), ("h", 2, "end", 300, None, None, None),
        ("g", 0, "end", 400, 3, None, None),  # refused as well
    ], COMMAND), second, stored=first)
    rows = sorted((r.host_id, r.id, r.ts_start, r.ts_end, r.label, r.notes) for r in spark.read.parquet(second).collect())
    assert rows == [
        ("g", 3, 500, None, "late", None), ("h", 1, 100, 300, "normal", None), ("h", 2, 120, 150, "gaming", "n"),
        ("h", 4, 200, 300, "stress_ng", None),
    ]


def dataset(spark, root):
    samples = spark.createDataFrame([(1, "x", 1.0), (86_400_001, "x", 2.0)], "ts bigint, boot_id string, a double")
    D.append_samples(samples, f"{root}/samples", by_day=True)
    one = spark.createDataFrame([(1,)], "id bigint")
    for name in ("boots", "events", "labels"):
        one.write.parquet(f"{root}/{name}")


def test_copy_keeps_days_and_is_exclusive(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    dataset(spark, source)
    done = {r.table: r.rows for r in D.verified_copy(spark, source, target).collect()}
    assert done == {"samples": 2, "boots": 1, "events": 1, "labels": 1}
    assert {p.name for p in (tmp_path / "b" / "samples").glob("day=*")} == {"day=0", "day=1"}
    assert not (tmp_path / "b" / "_copying").exists()
    with pytest.raises(FileExistsError):
        D.verified_copy(spark, source, target)
    assert spark.read.parquet(f"{target}/samples").count() == 2


def test_a_copy_that_comes_second_touches_nothing(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "a"), tmp_path / "b"
    dataset(spark, source)
    real = D._path

    def late(session, name):
        """The other copy creates the target right after this one has looked."""
        if name.endswith("_copying"):
            target.mkdir(exist_ok=True)
            (target / "_copying").write_text("theirs")
        return real(session, name)

    monkeypatch.setattr(D, "_path", late)
    with pytest.raises(FileExistsError):
        D.verified_copy(spark, source, str(target))
    assert (target / "_copying").read_text() == "theirs"


def test_csv_tells_its_rows(spark, tmp_path):
    samples = spark.createDataFrame([(n, n % 7, "x", 1.0) for n in range(50)], "sample_id bigint, ts bigint, boot_id string, a double")
    labels = spark.createDataFrame([(1, 2, 5, "normal", None)], "id bigint, ts_start bigint, ts_end bigint, label string, notes string")
    assert export.write_csv(samples, labels, str(tmp_path / "c"), since=3, columns=["ts", "a"]) == 28
    parts = [p.read_text().splitlines()[1:] for p in sorted((tmp_path / "c").glob("part-*"))]
    ts = [int(line.split(",")[0]) for part in parts for line in part]
    assert ts == sorted(ts) and len(ts) == 28


def test_a_broken_source_is_isolated_and_a_failing_one_masked(spark):
    raw = spark.createDataFrame([("b", t, float(t)) for t in range(6)], "boot_id string, tick bigint, v double")
    polls = spark.createDataFrame([("b", "x", t, t not in (1, 2, 3)) for t in range(6)], "boot_id string, source string, tick bigint, ok boolean")
    registry = SourceRegistry()
    registry.register(MetricSource("x", ["load1"], lambda r: r.select("boot_id", "tick", F.col("v").alias("load1"))))
    registry.register(MetricSource("y", ["fan_rpm"], lambda r: r.select("nowhere")))
    registry.register(MetricSource("z", ["volts"], lambda r: r.select("boot_id", "tick", F.col("v").alias("volts"))))
    wide = registry.assemble(raw, raw.select("boot_id", "tick"), polls=polls).orderBy("tick").collect()
    assert [r.load1 for r in wide] == [0.0, 1.0, 2.0, 3.0, None, None]
    assert {r.fan_rpm for r in wide} == {None} and [r.volts for r in wide] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert set(registry.failed) == {"y"}
