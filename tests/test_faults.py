import pytest
from pyspark.sql import functions as F

from fleetlens.functions import faults, rules as R
from fleetlens.operators import events as E

# One line for every kind, in the order of the rules.
KINDS = [
    ("core 4: processor context corrupt, giving up on bank 2", "mce_uncorrected"),
    ("machine check events logged by the poller", "mce"),
    ("GHES: firmware reports an error in block 7", "whea"),
    ("EDAC skx MC2: UE row 11 channel 0 lost", "ecc_ue"),
    ("EDAC skx MC2: CE row 11 channel 0 repaired", "ecc_ce"),
    ("microcode: revision mismatch on socket 1", "microcode"),
    ("System halted after the last resort", "panic"),
    ("Oops: 0002 in worker", "oops"),
    ("traps: double fault in interrupt entry", "gpf"),
    ("NMI watchdog: CPU 12 locked up", "hard_lockup"),
    ("soft lockup - CPU#9 stuck in copy loop", "soft_lockup"),
    ("rcu_sched detected stalls on processors", "rcu_stall"),
    ("task mover:88 blocked for more than 240 seconds", "hung_task"),
    ("Dazed and confused, but going on", "nmi"),
    ("viewer[55]: segfault at 8 ip 0 sp 0", "segfault"),
    ("batchjob invoked oom-killer: order=2", "oom"),
    ("page allocation failure: order:9", "alloc_failure"),
    ("NVRM: Xid (PCI:0000:41:00): 48, pid=77", "gpu_xid"),
    ("i915: GPU hang on the render engine", "gpu_reset"),
    ("render ring gfx_0 timeout, signaled seq 5", "gpu_fault"),
    ("GPU ECC error counted in bank 3", "gpu_ecc"),
    ("gpu 2 thermal throttling engaged", "gpu_thermal"),
    ("atomic update failed on pipe B", "drm_error"),
    ("nvme3: controller is down", "nvme_error"),
    ("ata7: hard resetting link", "ata_error"),
    ("critical medium error near sector 4096", "block_error"),
    ("F2FS: checkpoint error in segment 12", "fs_error"),
    ("SMART attribute 197 above threshold", "smart_warning"),
    ("AER: uncorrected error on root port", "pcie_fatal"),
    ("PCIe bus error: severity=corrected", "pcie_corrected"),
    ("pcieport 0000:80:03.0: link is down", "pcie_link"),
    ("usb 4-2: unable to enumerate the device", "usb_error"),
    ("package temperature above threshold on node 1", "thermal_trip"),
    ("Undervoltage detected on rail 5V", "power_error"),
    ("ACPI exception in method _Q11", "acpi_error"),
    ("failed to load firmware blob rev 3", "firmware_error"),
    ("freezing of tasks failed after 20 s", "suspend_error"),
    ("netdev watchdog: port 2: transmit queue 4 timed out", "netdev_error"),
    # harmless at error level, by the list of benign texts
    ("x86: TDX: TDX not supported here", None),
    ("ACPI: 3 tables acquired and loaded", None),
    ("SGX disabled by BIOS", None),
    ("EDAC amd64: probe of node 1", None),
    # nothing known
    ("sprocket 3 lost its chain", "kernel_error"),
    # beyond ASCII and with control characters
    ("Oops: größer als gedacht", "oops"),
    ("mce:\v[Hardware Error]: y", "mce"),
    ("ß: nobody knows", "kernel_error"),
]


def test_every_kind_has_a_line():
    assert [k for _, k in KINDS[:38]] == [r.kind for r in R.RULES]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(t, 3, k) for t, k in KINDS], "text string, level int, expected string")


def test_kinds(lines):
    for r in E.classify(lines).collect():
        assert r.kind == r.expected, r.text


def test_quick_finder_agrees_with_the_case(lines):
    both = E.classify(lines).withColumn("n", faults.rule_number("text", "level"))
    both = both.withColumns({f"x_{k}": v for k, v in faults.rule_fields("n").items()})
    for r in both.collect():
        assert (r.kind, r.severity) == (r.x_kind, r.x_severity), r.text


def test_levels(spark, rows):
    df = spark.createDataFrame(
        [("odd thing", 1), ("odd thing", 2), ("odd thing", 3), ("odd thing", 4), ("odd thing", None),
         ("Kernel panic - not syncing", None), (None, 3)],
        "text string, level int",
    )
    found = {(r.text, r.level): (r.kind, r.severity) for r in E.classify(df).collect()}
    assert found["odd thing", 1] == found["odd thing", 2] == ("kernel_error", "critical")
    assert found["odd thing", 3] == ("kernel_error", "error")
    assert found["odd thing", 4] == found["odd thing", None] == (None, None)
    assert found["Kernel panic - not syncing", None] == ("panic", "critical")


def test_own_rules_and_patterns_arrow_cannot_run(spark):
    own = (R.Rule("custom", R.ERROR, r"(?<=widget )broken", "own"), *R.RULES)
    assert faults.quick_finder(own, R.BENIGN) is None
    df = spark.createDataFrame([("widget broken", 6), ("Kernel panic", 6), ("fine", 6)], "text string, level int")
    assert [r.kind for r in E.classify(df, own).collect()] == ["custom", "panic", None]
    quiet = E.classify(df, R.RULES, [*R.BENIGN, "kernel panic"]).collect()
    assert [r.kind for r in quiet] == [None, None, None]


def test_catalogue(spark):
    assert len(R.RULES) == 38
    by_severity = [r.severity for r in R.RULES]
    assert [by_severity.count(s) for s in (R.CRITICAL, R.ERROR, R.WARNING)] == [12, 15, 11]
    twice = (*R.RULES, R.Rule("panic", R.WARNING, "x", "later"))
    listed = {r.kind: r.severity for r in E.rule_catalogue(spark, twice).collect()}
    assert len(listed) == 38 and listed["panic"] == "critical"


def test_xid(spark):
    df = spark.createDataFrame([
        ("NVRM: Xid (PCI:0000:01:00): 79, blah",), ("NVRM: Xid (PCI:0): 250, ?",),
        ("NVRM: Xid 79, pid=123",), ("nothing",), ("xid 99999999999999999999",),
    ], "t string").coalesce(1)
    got = [r[0] for r in df.select(faults.xid_detail(F.col("t"))).collect()]
    assert got == [
        "Xid 79: card fell off the bus (power or PCIe)", "Xid 250: unlisted code",
        "Xid 3: unlisted code", None, "Xid 9: unlisted code",
    ]
    message = df.select(faults.event_message(F.lit("gpu_xid"), F.col("t"))).first()[0]
    assert message.startswith("Xid 79: ") and message.endswith(" — NVRM: Xid (PCI:0000:01:00): 79, blah")
    assert df.select(faults.truncated(F.repeat(F.lit("é"), F.lit(5000)))).first()[0] == "é" * 4000
