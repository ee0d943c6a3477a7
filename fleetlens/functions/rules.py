"""The fault rules, benign texts, Xid codes, counters and sensor tables, kept as data.

Add an entry here, or pass another list to the operators, to change what is
recognised. Notes are free text and never take part in matching.
"""

from __future__ import annotations

from typing import NamedTuple

CRITICAL, ERROR, WARNING, INFO = "critical", "error", "warning", "info"


class Rule(NamedTuple):
    kind: str
    severity: str
    pattern: str
    note: str


# Kinds, severities and patterns, in match order (first match wins).
RULES: tuple[Rule, ...] = (
    # processor and memory
    Rule("mce_uncorrected", CRITICAL,
         r"machine check exception|mce:.*uncorrect|hardware error.*uncorrect|processor context corrupt",
         "The processor reports a result it could not repair."),
    Rule("mce", ERROR,
         r"\bmce:\s*\[hardware error\]|machine check events logged|\bmce:\s*\[hardware error\].*corrected",
         "The processor repaired an error by itself; worrying when it repeats."),
    Rule("whea", CRITICAL,
         r"hardware error from apei|\bghes\b.*error|apei.*hardware error|hardware error device",
         "Firmware hands over a hardware error (APEI/GHES)."),
    Rule("ecc_ue", CRITICAL,
         r"edac.*\bue\b|uncorrected error.*memory|ue memory read error|uncorrectable.*(dimm|memory)",
         "Memory lost data that ECC could not restore."),
    Rule("ecc_ce", WARNING,
         r"edac.*\bce\b|corrected error.*memory|ce memory read error|corrected.*(dimm|memory)",
         "ECC restored a memory word."),
    Rule("microcode", WARNING,
         r"\bmicrocode: .*(fail|error|mismatch)|microcode update.*fail",
         "The kernel could not load processor microcode."),
    # kernel stability
    Rule("panic", CRITICAL,
         r"kernel panic|fatal exception|system halted",
         "The kernel gave up."),
    Rule("oops", CRITICAL,
         r"\boops:|kernel bug at|bug: unable to handle|invalid opcode:|unable to handle kernel (paging|null)",
         "The kernel hit a bug or a corrupted instruction."),
    Rule("gpf", ERROR,
         r"general protection fault|stack segment:|double fault",
         "Protection fault, an early sign of too low a voltage."),
    Rule("hard_lockup", CRITICAL,
         r"watchdog.*hard lockup|nmi watchdog.*cpu\s*#?\d+ (hard )?locked up",
         "A core stopped answering interrupts."),
    Rule("soft_lockup", ERROR,
         r"watchdog.*bug: soft lockup|soft lockup - cpu#\d+ stuck",
         "A core never left kernel code."),
    Rule("rcu_stall", ERROR,
         r"rcu.*(self-detected stall|detected stalls|stall ended)",
         "A core made no progress for seconds."),
    Rule("hung_task", ERROR,
         r"task .*blocked for more than \d+ seconds|hung_task",
         "A task waits without end, often for storage."),
    Rule("nmi", ERROR,
         r"uhhuh\. nmi received|nmi: (pci system|iock) error|dazed and confused",
         "Unexpected non-maskable interrupt."),
    Rule("segfault", WARNING,
         r"segfault at |traps: .*trap (int3|divide|invalid)",
         "A program crashed; many different ones point at hardware."),
    # memory pressure
    Rule("oom", ERROR,
         r"out of memory: kill|oom-kill:|invoked oom-killer|oom_reaper",
         "The kernel killed a process to free memory."),
    Rule("alloc_failure", WARNING,
         r"page allocation (failure|stalls)|slab out of memory",
         "Memory could not be allocated."),
    # graphics
    Rule("gpu_xid", CRITICAL,
         r"nvrm:\s*xid|nvrm: gpu at pci|nvrm:.*rmini",
         "NVIDIA driver error; the Xid number names the cause."),
    Rule("gpu_reset", CRITICAL,
         r"gpu reset|amdgpu.*(reset|recover)|drm.*resetting|gpu recovery|failed to reset|gpu hang",
         "The driver had to restart the graphics card."),
    Rule("gpu_fault", ERROR,
         r"gpu fault detected|vm_l2_protection_fault|page fault \(src_id|\[gfxhub\]|\[mmhub\]|ring .*timeout|fence.*timeout|job timed out",
         "Graphics memory fault or a job that never finished."),
    Rule("gpu_ecc", CRITICAL,
         r"ras.*(ue|uncorrectable)|gpu ecc error|sram ecc|xgmi.*error",
         "Graphics memory lost data."),
    Rule("gpu_thermal", ERROR,
         r"gpu.*(over ?temp|thermal.*(trip|shutdown|throttl))|amdgpu.*temperature.*(high|critical)",
         "The graphics card reached its temperature limit."),
    Rule("drm_error", WARNING,
         r"\[drm:[^\]]+\] \*error\*|drm_kms_helper.*error|atomic update failed",
         "Display driver trouble."),
    # storage
    Rule("nvme_error", ERROR,
         r"nvme\d*[a-z]*\d*: .*(i/o|timeout|abort|reset|controller is down|failed to set apst|not ready|disabling device)",
         "NVMe timeout, reset or lost request."),
    Rule("ata_error", ERROR,
         r"ata\d+(\.\d+)?: (exception|failed command|serror|hard resetting)|link is slow to respond",
         "SATA cable, power or disk trouble."),
    Rule("block_error", ERROR,
         r"blk_update_request|buffer i/o error|critical (medium|target|nexus) error|i/o error, dev \w+",
         "A block request failed."),
    Rule("fs_error", CRITICAL,
         r"ext4-fs error|btrfs.*(error|checksum)|xfs.*(internal error|corruption)|remounting filesystem read-only|f2fs.*error",
         "The file system on disk is damaged."),
    Rule("smart_warning", WARNING,
         r"smart.*(fail|threshold|warning)|critical warning.*0x",
         "The disk predicts its own failure."),
    # buses, power, firmware
    Rule("pcie_fatal", CRITICAL,
         r"aer:.*(fatal|uncorrected)|pcie bus error.*(fatal|uncorrected)",
         "PCIe link error that could not be repaired."),
    Rule("pcie_corrected", WARNING,
         r"aer:.*corrected|pcie bus error.*corrected|badtlp|baddllp|rxerr",
         "PCIe packet sent again; the link holds."),
    Rule("pcie_link", ERROR,
         r"pcieport.*link (down|is down|retrain)|card not present|link training|downgraded.*link|bandwidth.*limited",
         "PCIe link lost or slowed down."),
    Rule("usb_error", WARNING,
         r"usb.*(device descriptor read.*error|unable to enumerate|cannot enable|over-?current)",
         "USB device trouble, often power."),
    Rule("thermal_trip", CRITICAL,
         r"core temperature above threshold|package temperature above threshold|critical temperature reached|thermal.*(shutdown|trip point)|temperature above threshold, cpu clock throttled",
         "A temperature limit was crossed and the clock was cut."),
    Rule("power_error", ERROR,
         r"undervoltage detected|power supply.*(fail|error)|battery.*(critical|fail)|acpi.*power.*error",
         "Firmware reports a power problem."),
    Rule("acpi_error", WARNING,
         r"acpi (bios )?error|acpi.*(aml error|_osc failed|namespace lookup failure|exception|ignoring invalid)",
         "Mainboard firmware tables are faulty."),
    Rule("firmware_error", WARNING,
         r"direct firmware load.*fail|firmware: failed to load|failed to load firmware|microcode sw error|firmware crash",
         "Device firmware missing or crashed."),
    Rule("suspend_error", ERROR,
         r"pm: suspend.*(fail|abort)|freezing of tasks failed|resume.*fail|acpi.*(sleep|wakeup).*error",
         "Sleep or wake-up failed."),
    Rule("netdev_error", WARNING,
         r"netdev watchdog.*transmit.*timed out|nic link is down|tx hang",
         "The network card hung."),
)

# Texts that look like errors but describe a normal state.
BENIGN: tuple[str, ...] = (
    r"tdx: tdx not supported",
    r"sgx: there are zero epc sections",
    r"sgx disabled by bios",
    r"acpi:.*(successfully|acquired and loaded)",
    r"ras: correctable errors collector initialized",
    r"edac (mc|amd64):.*(ver:|not present|probe|drivers are available)",
    r"thermal_sys: failed to find",
    r"failed to get (bios|ec) ",
    r"no (irq |)handler for vector",
    r"reservation of .* failed",
    r"error parsing pcc subspaces",
    r"check_flush_dependency",
)

# The kind and levels of the catch-all.
CATCH_ALL = "kernel_error"
CATCH_ALL_LEVEL = 3
CATCH_ALL_CRITICAL_LEVEL = 2

# The kind whose text carries an Xid, the pattern, the known codes.
XID_KIND = "gpu_xid"
XID_PATTERN = r"xid\s*\(?[^)]*\)?\s*:?\s*(\d+)"
XID_MEANINGS: dict[int, str] = {
    13: "graphics engine exception",
    31: "illegal access to graphics memory",
    43: "channel stopped by the driver",
    48: "double-bit ECC error",
    61: "internal microcontroller halted",
    62: "uncontained double-bit error",
    63: "ECC page retired",
    64: "ECC page retirement failed",
    69: "graphics engine class error",
    79: "card fell off the bus (power or PCIe)",
    93: "non-fatal engine error",
    109: "channel context error",
}


class Counter(NamedTuple):
    field: str
    kind: str
    severity: str
    note: str


# Counter columns with the kind and severity of their events.
COUNTERS: tuple[Counter, ...] = (
    Counter("err_mce", "mce", CRITICAL, "machine check exceptions counted by the processor"),
    Counter("err_thermal_irq", "thermal_trip", ERROR, "thermal event interrupts"),
    Counter("err_threshold_irq", "mce", WARNING, "corrected errors crossed their threshold"),
    Counter("err_deferred_irq", "mce", ERROR, "deferred errors found outside the faulty code"),
    Counter("err_nmi", "nmi", ERROR, "non-maskable interrupts"),
    Counter("err_apic", "kernel_error", WARNING, "interrupt controller errors"),
    Counter("err_oom_kill", "oom", ERROR, "processes killed to free memory"),
    Counter("err_ecc_ce", "ecc_ce", WARNING, "memory errors corrected by ECC"),
    Counter("err_ecc_ue", "ecc_ue", CRITICAL, "memory errors beyond ECC"),
    Counter("err_aer_corr", "pcie_corrected", WARNING, "PCIe errors repaired by sending again"),
    Counter("err_aer_nonfatal", "pcie_fatal", ERROR, "PCIe errors not repaired, link kept"),
    Counter("err_aer_fatal", "pcie_fatal", CRITICAL, "PCIe errors that lost the link"),
    Counter("err_cpu_throttle", "thermal_trip", ERROR, "cores slowed down by heat"),
    Counter("err_pkg_throttle", "thermal_trip", ERROR, "packages slowed down by heat"),
    Counter("err_gpu_ras", "gpu_ecc", CRITICAL, "graphics memory errors"),
    Counter("err_disk_io", "block_error", ERROR, "disk requests that failed"),
)

# Interrupt rows that feed a counter column.
INTERRUPT_FIELDS: dict[str, str] = {
    "MCE": "err_mce",
    "TRM": "err_thermal_irq",
    "THR": "err_threshold_irq",
    "DFR": "err_deferred_irq",
    "NMI": "err_nmi",
    "ERR": "err_apic",
}


class Channel(NamedTuple):
    channel: str
    suffixes: tuple[str, ...]
    scale: float
    unit: str


# Sensor channels with value files by preference, factor and unit suffix.
CHANNELS: tuple[Channel, ...] = (
    Channel("temp", ("input",), 1e-3, ""),
    Channel("in", ("input",), 1e-3, "_v"),
    Channel("fan", ("input",), 1.0, "_rpm"),
    Channel("power", ("average", "input"), 1e-6, "_w"),
    Channel("freq", ("input",), 1e-6, "_mhz"),
)


class Preset(NamedTuple):
    device: str
    prefix: str
    channels: tuple[str, ...]
    ignore_labels: bool
    every_instance: bool


# Devices whose sensors become columns.
PRESETS: tuple[Preset, ...] = (
    Preset("k10temp", "k10temp", ("temp",), False, False),
    Preset("gigabyte_wmi", "gigabyte", ("temp",), True, False),
    Preset("nvme", "nvme", ("temp",), False, True),
    Preset("amdgpu", "amdgpu", ("temp", "power", "fan", "freq", "in"), False, False),
)

# NVIDIA readings, their column and the divisor to its unit.
GPU_METRICS: tuple[tuple[str, str, float], ...] = (
    ("temperature", "gpu_temp", 1.0),
    ("power_mw", "gpu_power_w", 1000.0),
    ("clock_sm", "gpu_clock_sm", 1.0),
    ("clock_mem", "gpu_clock_mem", 1.0),
    ("util_gpu", "gpu_util", 1.0),
    ("util_memory", "gpu_mem_util", 1.0),
    ("fan_pct", "gpu_fan_pct", 1.0),
    ("memory_used_bytes", "gpu_mem_used_mb", 1024.0 * 1024.0),
    ("throttle_mask", "gpu_throttle_mask", 1.0),
)

# Window texts that mean a game is running.
GAMING_HINTS: tuple[str, ...] = (
    "steam_app", "gamescope", "lutris", "heroic", "bottles",
    "wine", "proton", "minecraft", "stalker",
)

# The usual experiment labels.
KNOWN_LABELS: tuple[str, ...] = (
    "normal", "fan_curve_low", "airflow_blocked", "oc_unstable", "stress_ng", "gaming",
)

# Pressure files, the line read and the column it fills.
PRESSURE: tuple[tuple[str, str, str], ...] = (
    ("cpu", "some", "psi_cpu_some"),
    ("io", "some", "psi_io_some"),
    ("io", "full", "psi_io_full"),
    ("memory", "some", "psi_mem_some"),
    ("memory", "full", "psi_mem_full"),
)

# Limits of the collection.
EVENTS_PER_TICK = 50
MESSAGE_MAX = 4000
FAILURE_LIMIT = 3
MAX_WATTS = 1000.0
CLOCK_TICKS = 100
UNKNOWN_BOOT = "unknown-boot"
