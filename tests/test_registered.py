"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tickloom.plans import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_sql_but_the_learners():
    assert {n for n in QUERIES if n not in ORACLE} == {n for n in QUERIES if n.startswith("m0")}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] - want[1] == Counter() and want[1] - got[1] == Counter()


def test_entry_gives_the_flagship(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns[:3] == ["symbol", "date", "pos"] and df.filter("pos > 5").isEmpty() and not df.isEmpty()


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    """HotSpot interprets methods of more than 8,000 bytes; plans are taken as they stand before they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, query in QUERIES.items():
            if name.startswith(("t0", "m0")):                    # run while they are built
                continue
            stages = query(spark, SF)._jdf.queryExecution().debug().codegenToSeq()
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
            assert max(sizes, default=0) <= 8_000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
