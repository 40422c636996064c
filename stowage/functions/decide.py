"""Decisions by table or priority, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions.costs import quotient

# State bits of an installed app, and those of work in progress in the order in which they are named.
INSTALLED, NOT_INSTALLED, UPDATE, RUNNING, MISSING, CORRUPT = 4, 1, 2, 64, 32, 128
WORKING = {
    256: "updating", 512: "update paused", 1024: "update starting", 8388608: "update stopping", 2048: "uninstalling", 4096: "backing up", 65536: "reconfiguring",
    131072: "validating", 262144: "adding files", 524288: "preallocating", 1048576: "downloading", 2097152: "staging", 4194304: "committing", 16: "locked",
}
ACTIVE = ("queued", "analyzing", "running", "pausing", "paused", "cancelling")
IN_FLIGHT = ("analyzing", "running", "pausing", "cancelling")
# Programs that are no games, by id and by name.
TOOL_IDS = (228980, 1070560, 1391110, 1628350, 1493710, 2180100, 1826330, 1887720, 2348590, 2805730)
TOOL_NAMES = ("Proton Experimental", "Proton Hotfix", "Proton EasyAntiCheat Runtime", "Proton BattlEye Runtime", "Steamworks Common Redistributables")
NATIVE, PACKED = ("btrfs", "bcachefs"), ("ext2", "ext3", "ext4", "xfs", "f2fs", "zfs")
#: Levels of each preset: the floor and the ceiling of what a file gets.
PRESETS = {"fast": (3, 3), "balanced": (9, 9), "max": (9, 15)}


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def working(flags: Column) -> Column:
    """The first work in progress that the flags name, null if none."""
    out = F.lit(None).cast("string")
    for bit, name in reversed(WORKING.items()):
        out = F.when(has(flags, bit), name).otherwise(out)
    return out


def settled(flags: Column, pending: Column) -> Column:
    """Installed, nothing in progress and nothing left to transfer."""
    return has(flags, INSTALLED) & working(flags).isNull() & (F.coalesce(pending, F.lit(0)) <= 0)


def install_state(flags: Column, pending: Column, running: Column) -> Column:
    """(state, reason) by the first rule that fits: the running app, work in progress, a transfer, missing or corrupt files, a waiting update, not installed, a stale run, idle."""
    work = working(flags)
    rules = [
        (running, "busy", F.lit("running")),
        (work.isNotNull(), "busy", work),
        (F.coalesce(pending, F.lit(0)) > 0, "busy", F.lit("transfer")),
        (has(flags, MISSING), "broken", F.lit("files missing")),
        (has(flags, CORRUPT), "broken", F.lit("files corrupt")),
        (has(flags, UPDATE), "update pending", F.lit(None).cast("string")),
        (~has(flags, INSTALLED), "broken", F.lit("not installed")),
        (has(flags, RUNNING), "busy", F.lit("stale running")),
    ]
    out = F.struct(F.lit("idle").alias("state"), F.lit(None).cast("string").alias("reason"))
    for test, state, reason in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(state).alias("state"), reason.alias("reason"))).otherwise(out)
    return out


def is_tool(app: Column, name: Column) -> Column:
    """Programs that are no games: by id, by exact name, and the numbered runtimes (a longer word is none)."""
    return F.coalesce(app.isin(*TOOL_IDS), F.lit(False)) | F.coalesce(name.isin(*TOOL_NAMES) | name.rlike(r"^Proton \d") | name.rlike(r"^Steam Linux Runtime \d"), F.lit(False))


def storage_tier(kind: Column, read_only: Column) -> Column:
    """native, pack or unsupported, by file system."""
    return F.when(read_only, "unsupported").when(kind.isin(*NATIVE), "native").when(kind.isin(*PACKED), "pack").otherwise("unsupported")


def preset_levels(preset: Column, explicit: Column) -> Column:
    """(low, high) levels of a preset; an explicit level is both, an unknown preset has none."""
    out = F.lit(None).cast("struct<low:int,high:int>")
    for name, (low, high) in PRESETS.items():
        out = F.when(preset == name, F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))).otherwise(out)
    return F.when(explicit.isNotNull(), F.struct(explicit.alias("low"), explicit.alias("high"))).otherwise(out)


def coverage(sampled: Column, installed: Column) -> Column:
    """Sampled bytes in hundredths of a percent, null for nothing."""
    return quotient(sampled * 10_000, installed)


def confidence(inspected: Column, considered: Column, sampled: Column, installed: Column) -> Column:
    """low, medium or high, by how many files and bytes an estimate has seen."""
    share = F.coalesce(coverage(sampled, installed), F.lit(0))
    return F.when((inspected == 0) | (sampled < 4 * 1024 * 1024) | (share < 5), "low").when(((considered > 0) & (inspected * 4 < considered)) | (share < 50), "medium").otherwise("high")


def headroom(need: Column) -> Column:
    """A twentieth, but 64 MiB at least."""
    return F.greatest(quotient(need, F.lit(20)), F.lit(64 * 1024 * 1024).cast("long"))


def store_bound(size: Column, metadata: Column) -> Column:
    """Room that a store of so many bytes can take at most."""
    return size + quotient(size, F.lit(32)) + metadata + 16 * 1024 * 1024


def backoff(tries: Column) -> Column:
    """Seconds until the next try: doubled each time, 300 at most."""
    return F.least(F.pow(F.lit(2.0), F.least(tries, F.lit(9))).cast("long"), F.lit(300).cast("long"))
