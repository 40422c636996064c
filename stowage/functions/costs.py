"""What files cost on sectored storage, and where to sample them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the storage model: sector, block and sampling sizes in bytes.
SECTOR = 4096
NATIVE_BLOCK, STORE_BLOCK = 128 * 1024, 4 * 1024 * 1024
NATIVE_CAP, STORE_CAP = 4 * 1024 * 1024, 16 * 1024 * 1024
FULL_SAMPLES, CHEAP_SAMPLES = 32, 8
LARGEST = 2**63 - 1


def whole_sectors(size: Column) -> Column:
    """Bytes rounded up to sectors."""
    return quotient(size + (SECTOR - 1), F.lit(SECTOR)) * SECTOR


def disk_cost(compressed: Column, raw: Column, store: bool = False) -> Column:
    """Sectors of the compressed form if it saves more than one (a store: at least one), else of the raw form."""
    with_gain = compressed + SECTOR
    keep_raw = with_gain >= raw if store else with_gain > raw
    return F.when(keep_raw, whole_sectors(raw)).otherwise(whole_sectors(compressed))


def quotient(a: Column, b: Column) -> Column:
    """Whole quotient of 64-bit numbers towards zero, null for a zero divisor."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def blocks_of(size: Column, block: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), quotient(size + (block - 1), F.lit(block)))


def samples_of(size: Column, store: bool = False, cheap: bool = False) -> Column:
    """How many blocks of a file are read."""
    block, cap = (STORE_BLOCK, STORE_CAP) if store else (NATIVE_BLOCK, NATIVE_CAP)
    return F.least(blocks_of(size, block), F.lit(max(1, -(-cap // block))).cast("long"), F.lit(CHEAP_SAMPLES if cheap else FULL_SAMPLES).cast("long"))


def sample_block(index: Column, samples: Column, blocks: Column) -> Column:
    """Block read by sample `index` of `samples`: the middle one if alone, else spread from the first to the last."""
    spread = quotient(index * (blocks - 1), F.greatest(samples - 1, F.lit(1).cast("long")))
    return F.when(samples <= 1, quotient(blocks - 1, F.lit(2))).otherwise(spread)


def stratum_offset(index: Column, samples: Column, size: Column, window: Column) -> Column:
    """First byte of window `index`: centred in its share of the file."""
    share = quotient(size, samples)
    zero = F.lit(0).cast("long")
    centred = index * share + quotient(F.greatest(share - window, zero), F.lit(2))
    return F.least(centred, F.greatest(size - window, zero))


def saturating_sum(column: Column) -> Column:
    """A sum of sizes that stops at the largest 64-bit number instead of failing."""
    return F.least(F.coalesce(F.sum(column.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def carried_saving(earlier: Column, installed: Column, rewritten: Column, now: Column) -> Column:
    """An earlier saving's share of what wasn't rewritten, and what this pass saved."""
    rest = F.greatest(installed - rewritten, F.lit(0).cast("long")).cast("decimal(20,0)")
    share = F.floor(earlier.cast("decimal(18,0)") * rest / F.nullif(installed.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))).cast("long")
    return F.coalesce(share, F.lit(0).cast("long")) + now
