"""Texts and paths as people and programs write them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def printable(text: Column) -> Column:
    """Control characters as spaces."""
    return F.regexp_replace(text, r"\p{Cntrl}", " ")


def octal_undone(text: Column) -> Column:
    """A text with backslash and three octal digits undone, of any ASCII code; other backslashes stay."""
    parts = F.split(text, r"\\(?=[0-3]?[0-7][0-7]{2}|[0-7]{3})")
    code = lambda p: F.conv(F.substring(p, 1, 3), 8, 10).cast("int")
    undone = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.chr(code(p)), F.substring(p, 4, 1_000_000)))
    return F.when(text.isNotNull(), F.concat(F.get(parts, F.lit(0)), F.array_join(undone, "")))


def typed_location(text: Column, home: Column) -> Column:
    """A folder as typed: white space and one pair of quotes around it gone, `~` for the home, `\\ ` for a space."""
    bare = F.trim(text)
    bare = F.regexp_replace(bare, r"""^(["'])(.*)\1$""", "$2")
    bare = F.when((bare == "~") | F.startswith(bare, F.lit("~/")), F.concat(home, F.substring(bare, 2, 1_000_000))).otherwise(bare)
    return F.regexp_replace(bare, r"\\ ", " ")


def counted(n: Column, one: str, many: str) -> Column:
    """`1 file`, `3 files`."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def duration(seconds: Column) -> Column:
    """`42s`, `3m 5s`, `2h 4m`."""
    s = seconds.cast("long")
    part = lambda unit: F.call_function("div", s, F.lit(unit).cast("long"))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(part(60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(
        F.concat(part(3600).cast("string"), F.lit("h "), F.call_function("div", s % 3600, F.lit(60).cast("long")).cast("string"), F.lit("m"))
    )


def byte_size(n: Column) -> Column:
    """`512 B`, `3.4 MiB`: one digit behind the point, cut, not rounded."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        tenths = F.call_function("div", n.cast("decimal(20,0)") * 10, F.lit(1024**power).cast("decimal(20,0)"))
        text = F.concat(F.call_function("div", tenths, F.lit(10).cast("long")).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1024**power, text).otherwise(out)
    return out


def is_hex(text: Column, digits: int) -> Column:
    return text.rlike(f"^[0-9a-fA-F]{{{digits}}}$")


def index_like(key: Column) -> Column:
    """A key of one to four digits, which is a place in a list and no lasting name."""
    return key.rlike("^[0-9]{1,4}$")


def manifest_app(name: Column) -> Column:
    """The app's number in the name of its manifest, null for other names and numbers beyond 32 bits."""
    number = F.regexp_extract(name, r"(?i)^appmanifest_(\d{1,10})\.acf$", 1)
    value = F.nullif(number, F.lit("")).cast("long")
    return F.when(value < 2**32, value)


def refused_folder(path: Column, home: Column) -> Column:
    """Why a normal path can't be an install's folder, null if it can: relative, climbing, the root, or the home or above it."""
    parts = F.split(path, "/")
    above_home = F.startswith(F.concat(home, F.lit("/")), F.concat(path, F.lit("/")))
    drive = path.rlike("^[A-Za-z]:")
    return (
        F.when(path.isNull() | ~(F.startswith(path, F.lit("/")) | drive), "relative")
        .when(F.exists(parts, lambda p: p == ".."), "climbing")
        .when((path == "/") | path.rlike("^[A-Za-z]:/?$"), "root")
        .when(above_home, "home")
        .when(path.rlike("^(/home|/Users|[A-Za-z]:/Users)(/[^/]*)?$"), "home")
    )
