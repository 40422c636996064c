"""Readers of nested key-value texts, JSON lists and mount tables."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import quoted
from stowage.functions.texts import octal_undone

#: Nested deeper, a text is refused.
MOST_DEPTH = 128
TOKEN = regex.compile(r'\s+|//[^\r\n]*|\[[^\]\r\n]*\]|"((?:[^"\\]|\\.)*)"|([{}])|([^\s{}"\[]+)', regex.S)
ESCAPE = regex.compile(r"\\(.)", regex.S)
ESCAPED = {"n": "\n", "t": "\t", "\\": "\\", '"': '"'}


class KeyValueError(ValueError):
    """A text that can't be read, with its line."""


def parse_key_values(text: str) -> list[tuple[str, int, str, str | None]]:
    """(path, order, key, value) of every entry in order; an object has a null value. Repeated keys are kept.

    path: keys above, joined by `/` in lower case. Comments and conditions in brackets are passed over, `\\x` of an unknown x
    stays. Raises KeyValueError with a line number.
    """
    text = text.removeprefix("﻿")
    out: list[tuple[str, int, str, str | None]] = []
    above: list[str] = []
    key: str | None = None
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise KeyValueError(f"line {text.count(chr(10), 0, at) + 1}: a quotation isn't closed")
        brace = m.group(2)
        word = ESCAPE.sub(lambda e: ESCAPED.get(e.group(1), e.group(0)), m.group(1)) if m.group(1) is not None else m.group(3)
        if brace == "{":
            if key is None:
                raise KeyValueError(f"line {text.count(chr(10), 0, at) + 1}: an object without a key")
            if len(above) >= MOST_DEPTH:
                raise KeyValueError(f"line {text.count(chr(10), 0, at) + 1}: nested too deep")
            out.append(("/".join(above), len(out), key, None))
            above.append(key.lower())
            key = None
        elif brace == "}":
            if not above or key is not None:
                raise KeyValueError(f"line {text.count(chr(10), 0, at) + 1}: a brace too many or a key without a value")
            above.pop()
        elif word is not None:
            if key is None:
                key = word
            else:
                out.append(("/".join(above), len(out), key, word))
                key = None
        at = m.end()
    if above or key is not None:
        raise KeyValueError(f"line {text.count(chr(10)) + 1}: the text ends too early")
    return out


def key_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, ord, name, value, error): entries of each text; one that can't be read gives one row with its error."""
    entry = pa.struct([("path", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("error", pa.string())])

    def parse(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append([] if t is None else [{"path": p, "ord": o, "name": k, "value": v, "error": None} for p, o, k, v in parse_key_values(t)])
            except KeyValueError as e:
                out.append([{"path": None, "ord": None, "name": None, "value": None, "error": str(e)}])
        return pa.array(out, pa.list_(entry))

    udf = F.arrow_udf(parse, "array<struct<path:string,ord:int,name:string,value:string,error:string>>")
    return df.select(F.col(quoted(key)).alias(key), F.explode(udf(F.col(quoted(text)))).alias("e")).select(key, "e.*")


def first_values(entries: DataFrame, key: str, path: str, names: list[str]) -> DataFrame:
    """One row per key with the first value of each name (case aside) directly under `path`."""
    own = entries.where((F.col("path") == path.lower()) & F.col("value").isNotNull())
    return own.groupBy(key).agg(*[F.min_by(F.when(F.lower("name") == n.lower(), F.col("value")), F.when(F.lower("name") == n.lower(), F.col("ord"))).alias(n) for n in names])


def json_fields(raw: Column, names: dict[str, list[str]]) -> dict[str, Column]:
    """The first of several names (case aside) that a JSON object has, as text."""
    pairs = F.from_json(raw, "map<string,string>")
    low = F.map_from_entries(F.transform(F.map_entries(pairs), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return {to: F.coalesce(*[F.try_element_at(low, F.lit(n.lower())) for n in several]) for to, several in names.items()}


def mount_table(lines: DataFrame, line: str) -> DataFrame:
    """Mount point, file system, source and options of each well-formed line; octal escapes are undone, others left out."""
    parts = F.split(F.col(quoted(line)), " - ")
    left, right = F.split(parts[0], " +"), F.split(F.get(parts, F.lit(1)), " +")
    whole = (F.size(parts) == 2) & (F.size(left) >= 6) & (F.size(right) >= 2)
    undone = octal_undone(F.get(left, F.lit(4)))
    return lines.where(whole).select(undone.alias("mountpoint"), F.get(right, F.lit(0)).alias("fstype"), F.get(right, F.lit(1)).alias("source"), F.split(F.get(left, F.lit(5)), ",").alias("options"), F.split(F.coalesce(F.get(right, F.lit(2)), F.lit("")), ",").alias("super_options"))


def compression_option(options: Column) -> Column:
    """Algorithm and level of a compress option (`compress=zstd:3`), null if there is none."""
    one = F.get(F.filter(options, lambda o: o.rlike("^compress(-force)?(=|$)")), F.lit(0))
    value = F.regexp_extract(one, r"=([^:]+)", 1)
    level = F.regexp_extract(one, r":(\d+)$", 1)
    return F.when(one.isNotNull(), F.struct(F.when(value == "", "default").otherwise(value).alias("algorithm"), F.when(level != "", level.cast("int")).alias("level")))
