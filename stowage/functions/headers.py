"""What the first bytes of a file say about it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte marks at the start of files, by what they announce.
MIXED = {"gzip": "1F8B", "7z": "377ABCAF271C", "rar": "526172211A07", "xz": "FD377A585A00", "bzip2": "425A68", "zstd": "28B52FFD", "lz4": "04224D18", "unity": "556E6974794653", "pdf": "25504446"}
PROGRAM = {"exe": "4D5A", "elf": "7F454C46"}
ENCODED = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "ogg": "4F676753", "flac": "664C6143", "mp3": "494433", "matroska": "1A45DFA3", "bink": "42494B", "ktx2": "AB4B5458203230BB"}


def starts(head: Column, mark: str) -> Column:
    """Whether bytes begin with the mark, in hex digits."""
    return F.startswith(head, F.unhex(F.lit(mark)))


def little(head: Column, at: int, size: int) -> Column:
    """The little-endian number of `size` bytes at an offset, null if the bytes end before."""
    digits = F.hex(F.substring(head, at + 1, size))
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.octet_length(head) >= at + size, F.conv(turned, 16, 10).cast("long"))


def family(head: Column) -> Column:
    """texture, archive, audio, mixed, program, encoded, movie or unknown; the first that fits, in this order. Null is unknown."""
    found = F.when(starts(head, "44445320"), "texture").when(starts(head, "504B0304"), "archive").when(starts(head, "52494646"), "audio")
    for name, marks in (("mixed", MIXED), ("program", PROGRAM), ("encoded", ENCODED)):
        for mark in marks.values():
            found = found.when(starts(head, mark), name)
    movie = F.substring(head, 5, 4) == F.unhex(F.lit("66747970"))
    return F.when(head.isNull(), "unknown").otherwise(found.when(movie, "movie").otherwise("unknown"))


def archive_member(head: Column) -> Column:
    """Offset of a stored archive's first member, null for other files, encrypted or compressed members."""
    whole = starts(head, "504B0304") & (F.octet_length(head) >= 30)
    plain = whole & (little(head, 6, 2).bitwiseAND(1) == 0) & (little(head, 8, 2) == 0)
    return F.when(plain, little(head, 26, 2) + little(head, 28, 2) + 30)


def cheap(kind: Column) -> Column:
    """Whether few samples do: formats that are compressed already."""
    return kind.isin("encoded", "texture", "movie")
