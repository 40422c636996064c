import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from compare import of_duckdb, of_spark

from stowage.plans import reference as R

FILES = "/root/testdata/sf0.01/files.parquet"
NAMES = [n for n, f in R.QUERIES.items() if f"{n}_by_snapshot" in R.QUERIES]
COMPARING = {"changed_since", "changed_since_floor", "recorded_levels", "receipt_skip", "outcome_merge", "rejected_skip", "tree_diff", "replace_fingerprints", "really_changed", "publish_missing", "overlay_view"}


def renumbered(files, numbers):
    """The rows of some snapshots under other numbers."""
    kept = files.filter(pc.is_in(files["snap_no"], pa.array(list(numbers), files.schema.field("snap_no").type)))
    new = pa.array([numbers[n] for n in kept["snap_no"].to_pylist()], files.schema.field("snap_no").type)
    return kept.set_column(kept.schema.get_field_index("snap_no"), files.schema.field("snap_no"), new)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """All snapshots, and for the SQL, which names 16 and 18, each snapshot as 18 with the one before it as 16."""
    files = pq.read_table(FILES)
    numbers = sorted(set(files["snap_no"].to_pylist()))
    made = {}
    for before, now in zip([None, *numbers], numbers):
        made[now] = tmp_path_factory.mktemp(f"snap{now}")
        pq.write_table(renumbered(files, {now: 18} | ({before: 16} if before is not None else {})), made[now] / "files.parquet")
    later = tmp_path_factory.mktemp("later")
    pq.write_table(renumbered(files, {n: n * 3 + 7 for n in numbers}), later / "files.parquet")
    return numbers, made, later


@pytest.mark.parametrize("name", NAMES)
def test_every_snapshot_is_its_sql(spark, tables, name):
    numbers, made, _ = tables
    df = R.QUERIES[f"{name}_by_snapshot"](spark, "/root/testdata/sf0.01")
    got, at = of_spark(df), sorted(df.columns).index("snap_no")
    assert {row[at] for row in got} == set(numbers[1:] if name in COMPARING else numbers)
    if name in R.SQL:
        for number in numbers[1:] if name in COMPARING else numbers:
            assert [row[:at] + row[at + 1 :] for row in got if row[at] == number] == of_duckdb(str(made[number]), R.SQL[name])[1], number


@pytest.mark.parametrize("name", NAMES)
def test_newest_numbers_come_from_the_table(spark, tables, name):
    want = of_spark(R.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert want and of_spark(R.QUERIES[name](spark, str(tables[2]))) == want
