"""Every registered query with SQL gives the SQL's rows, here at the smallest size."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loadlens.plans import queries, studies  # noqa: F401
from loadlens.plans.base import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, con, name):
    df, sql = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    want = sorted(tuple(shown(dict(zip(sql.columns, r))[c]) for c in cols) for r in sql.fetchall())
    assert sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == want


def test_entry_is_imported_without_a_session():
    """Nothing at import needs Spark to run."""
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "True"], said.stderr


@pytest.mark.parametrize("name", ["repaired_cells", "table_comparison", "hourly_meter"])
def test_sums_are_taken_in_the_order_of_rows(spark, tmp_path, name):
    """Every hour's mean lies at a tie of its rounding, so the order in which doubles are added decides; users come more than once in an hour."""
    c = duckdb.connect()
    c.sql("""create table e as select row_number() over (order by h, i) - 1 as event_id, timestamp '2024-01-01' + h * interval 1 hour + i * interval 20 second as ts,
        (i * 7 + h) % 40 as user_id, 'view' as event_type, (1 + (i * 7919 + h * 104729) % 9973) as cents, '{"k": 3}' as props from range(48) a(h), range(160) b(i)""")
    # The last event of each hour and site brings the sum to 2.00 beyond a multiple of 4.00.
    c.sql("""create table x as select *, date_trunc('hour', ts) as t, user_id % 4 as s, row_number() over (partition by date_trunc('hour', ts), user_id % 4 order by ts desc) as r from e""")
    c.sql("""create table events as select event_id, ts, user_id, event_type, (cents + CASE WHEN r = 1 THEN (600 - n % 400) % 400 ELSE 0 END) / 100.0::DOUBLE as value, props
        from (select *, sum(cents) over (partition by t, s) as n from x) order by event_id""")
    c.sql(f"copy (from events order by event_id) to '{tmp_path}/events.parquet'")
    df, sql = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    want = sorted(tuple(shown(dict(zip(sql.columns, r))[c]) for c in cols) for r in sql.fetchall())
    assert len(want) > 10 and sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["table_comparison", "hourly_meter"])
@pytest.mark.parametrize("files", [1, 3])
def test_sums_are_taken_in_the_order_of_rows_over_partitions(spark, tmp_path, name, files):
    """Every hour's rows lie all over the file, or in several files of growing size, and its mean at a tie; SQL of one thread adds them in the order of rows."""
    c = duckdb.connect()
    c.sql("set threads = 1")
    c.sql("""create table e as select row_number() over (order by j, h, i) - 1 as event_id, timestamp '2024-01-01' + h * interval 1 hour + i * interval 40 second as ts,
        (i * 7 + h) % 40 as user_id, 'view' as event_type, (1 + (i * 7919 + h * 104729 + j * 31) % 9973) as cents, '{"k": ' || (i % 7) / 10 || '}' as props from range(12) r(j), range(48) a(h), range(80) b(i)""")
    c.sql("""create table x as select *, date_trunc('hour', ts) as t, user_id % 4 as s, row_number() over (partition by date_trunc('hour', ts), user_id % 4 order by event_id desc) as r from e""")
    c.sql("""create table made as select event_id, ts, user_id, event_type, (cents + CASE WHEN r = 1 THEN (600 - n % 400) % 400 ELSE 0 END) / 100.0::DOUBLE as value, props
        from (select *, sum(cents) over (partition by t, s) as n from x) order by event_id""")
    path = tmp_path / "events.parquet"
    if files == 1:
        c.sql(f"copy (from made order by event_id) to '{path}' (row_group_size 2048)")
    else:
        path.mkdir()
        for i, (a, b) in enumerate(((0, 6000), (6000, 18000), (18000, 50000))):
            c.sql(f"copy (from made where event_id >= {a} and event_id < {b} order by event_id) to '{path}/part-{i}.parquet' (row_group_size 2048)")
    c.sql(f"create view events as from '{path if files == 1 else path / '*.parquet'}'")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        got = sorted(tuple(shown(r[x]) for x in cols) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    sql = c.sql(ORACLE_SQL[name])
    want = sorted(tuple(shown(dict(zip(sql.columns, r))[x]) for x in cols) for r in sql.fetchall())
    assert len(want) > 10 and got == want
