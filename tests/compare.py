"""Every query with SQL, run in Spark and in DuckDB over the same tables. python tests/compare.py [directory] [query...]"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def of_spark(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def of_duckdb(directory: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for p in Path(directory).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(names), sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)


def main() -> int:
    import __spark_entry__ as entry
    from stowage.session import session

    args = sys.argv[1:]
    directory = args[0] if args else "/root/testdata/sf0.01"
    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        began = time.time()
        try:
            df = queries[name](spark, directory)
            got = of_spark(df)
            if name not in sqls:
                print(f"{name}: {len(got)} rows, no SQL, {time.time() - began:.1f} s", flush=True)
                continue
            took = time.time() - began
            names, want = of_duckdb(directory, sqls[name])
            same = sorted(df.columns) == names and got == want
            print(f"{name}: {'same' if same else 'DIFFERENT'} {len(got)} rows, {took:.1f} s", flush=True)
            if not same:
                bad += 1
                print("  columns", sorted(df.columns), names, "rows", len(got), len(want))
                a, b = set(got), set(want)
                for x in list(a - b)[:3]:
                    print("  only Spark", x)
                for x in list(b - a)[:3]:
                    print("  only SQL  ", x)
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:800]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
