"""Versions of a dataset and tables clustered by boot."""

import threading

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import dataset as D
from fleetlens.plans.versions import Versions, write_clustered

SAMPLES = "ts bigint, boot_id string, cpu_util double"


def samples(spark, ticks, boot="a"):
    return spark.createDataFrame([(t, boot, t / 2) for t in ticks], SAMPLES)


def test_a_version_names_files_of_all_tables(spark, tmp_path, rows):
    root = str(tmp_path / "data set+1%")
    versions = Versions(spark, root)
    assert versions.latest() is None
    with pytest.raises(FileNotFoundError):
        versions.read()
    D.append_samples(samples(spark, [1, 2]), f"{root}/samples")
    assert versions.publish(["samples", "boots"]) == 0
    D.append_samples(samples(spark, [3]).withColumn("fan", F.lit(7)), f"{root}/samples")
    spark.createDataFrame([("a", 1)], "boot_id string, ts_first bigint").write.parquet(f"{root}/boots")
    assert list(versions.read()) == ["samples"]
    assert rows(versions.read()["samples"], "ts", "cpu_util") == [(1, 0.5), (2, 1.0)]
    assert versions.publish(["samples", "boots"]) == 1
    assert rows(versions.read()["samples"], "ts", "fan") == [(1, None), (2, None), (3, 7)]
    assert rows(versions.read()["boots"]) == [("a", 1)]
    assert "fan" not in versions.read(0)["samples"].columns
    assert versions.publish(["samples", "boots"]) == 2  # nothing new
    assert rows(versions.files(2)) == rows(versions.files(1))


def test_schema_comes_from_the_version(spark, tmp_path):
    """Resolving a version starts jobs over its list of files alone, none over footers."""
    root = str(tmp_path)
    D.append_samples(samples(spark, range(5)), f"{root}/samples")
    versions = Versions(spark, root)
    versions.publish(["samples"])
    for file in [r["file"] for r in versions.files(0).collect()]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()
    assert versions.read()["samples"].columns == ["sample_id", "ts", "boot_id", "cpu_util"]


@pytest.mark.parametrize("folder", ["_temporary", "_staged/one"])
def test_an_append_under_way_is_waited_for(spark, tmp_path, folder):
    root = str(tmp_path)
    D.append_samples(samples(spark, [1]), f"{root}/samples")
    job = tmp_path / "samples" / folder
    job.mkdir(parents=True)
    versions = Versions(spark, root)
    with pytest.raises(RuntimeError, match="under way"):
        versions.publish(["samples"], patience=0.3)
    assert versions.latest() is None
    timer = threading.Timer(0.5, job.rmdir)
    timer.start()
    assert versions.publish(["samples"]) == 0
    timer.join()


def test_publishers_at_once(spark, tmp_path, rows):
    root, found = str(tmp_path), []
    D.append_samples(samples(spark, [1, 2, 3]), f"{root}/samples")
    work = [
        threading.Thread(target=lambda: found.append(Versions(spark, root).publish(["samples"])))
        for _ in range(3)
    ]
    [w.start() for w in work], [w.join() for w in work]
    assert sorted(found) == [0, 1, 2]
    for number in found:
        assert rows(Versions(spark, root).read(number)["samples"], "ts") == [(1,), (2,), (3,)]


def test_days_stay_partitions(spark, tmp_path, rows):
    root, day = str(tmp_path), 86_400_000
    D.append_samples(samples(spark, [1, day + 1, 2 * day + 1]), f"{root}/samples", by_day=True)
    versions = Versions(spark, root)
    versions.publish(["samples"])
    assert rows(versions.read()["samples"], "ts", "day") == [(1, 0), (day + 1, 1), (2 * day + 1, 2)]
    assert rows(versions.read_table("samples", since=day, until=2 * day), "ts") == [(day + 1,)]
    assert versions.opened("samples", since=day, until=2 * day).count() == 1


def test_a_boot_opens_few_files(spark, tmp_path, rows):
    """Forty boots in twenty files: a boot is in at most three; without clustering in all."""
    made = spark.range(20_000).select(
        F.col("id").alias("sample_id"), (F.col("id") * 10).alias("ts"),
        F.format_string("boot-%02d", F.col("id") % 40).alias("boot_id"),
    )
    made.repartition(20).write.parquet(f"{tmp_path}/plain/samples")
    write_clustered(made, f"{tmp_path}/sorted/samples", partitions=20)
    found = {}
    for name in ("plain", "sorted"):
        versions = Versions(spark, f"{tmp_path}/{name}")
        versions.publish(["samples"])
        found[name] = rows(versions.read_table("samples", boot_id="boot-07"))
        opened = versions.opened("samples", boot_id="boot-07").count()
        assert opened == 20 if name == "plain" else 1 <= opened <= 3
        assert versions.read_table("samples", boot_id="none").count() == 0
    assert found["plain"] == found["sorted"] and len(found["plain"]) == 500


def test_a_hot_boot_is_cut(spark, tmp_path):
    hot = spark.range(10_000).select(F.col("id").alias("sample_id"), F.lit("a").alias("boot_id"), F.lit(1).alias("ts"))
    write_clustered(hot, f"{tmp_path}/samples", partitions=8)
    versions = Versions(spark, str(tmp_path))
    versions.publish(["samples"])
    assert max(r["rows"] for r in versions.files(0).collect()) < 3000


def test_rows_without_bounds(spark, tmp_path, rows):
    """Tables without boot_id or ts are never left out; a file without rows is in no version."""
    spark.createDataFrame([(1, "x")], "id bigint, label string").write.parquet(f"{tmp_path}/labels")
    empty = spark.createDataFrame([], SAMPLES)
    empty.write.parquet(f"{tmp_path}/samples")
    versions = Versions(spark, str(tmp_path))
    versions.publish(["labels", "samples"])
    assert versions.opened("labels", boot_id="q", since=5).count() == 1
    assert versions.read()["samples"].count() == 0
    assert versions.read()["samples"].columns == ["ts", "boot_id", "cpu_util"]
