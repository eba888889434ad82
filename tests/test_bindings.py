import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from skeinlog.operators import kernels, selection
from skeinlog.plans import bindings

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(frame):
    cell = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    columns = sorted(frame.columns)
    return columns, sorted(frame[columns].map(cell).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(bindings.QUERIES))
def test_matches_sql(spark, duck, name):
    assert plain(bindings.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(bindings.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_selection_of_all_orders(spark, duck):
    order, width = bindings.micros("o_orderdate"), 3 * bindings.DAY
    windows = bindings.table(spark, DATA, "orders").select(order.alias("start"), (order + width).alias("end"))
    windows = windows.where("start % 7 < 2").unionByName(windows.selectExpr("start", "start - 1 as end"))  # some never hold a row
    rows = bindings.table(spark, DATA, "lineitem").withColumn("ts", bindings.micros("l_shipdate")).select("l_orderkey", "l_linenumber", "ts")
    duck.register("w", windows.toPandas())
    want = duck.sql("SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS ts FROM lineitem WHERE EXISTS (SELECT 1 FROM w WHERE epoch_us(l_shipdate) BETWEEN start AND w.end)").df()
    assert 0 < len(want) < rows.count() and plain(selection.in_windows(rows, windows, [], width).toPandas()) == plain(want)


def test_windows_merge_before_the_join(spark):
    windows = spark.range(20_000).selectExpr("id % 5 as k", "id * 0.1 as start", "id * 0.1 + 50 as end")
    merged = selection.merged_windows(windows, ["k"], 600.0)
    assert merged.groupBy("k", "_bucket").count().where("count > 1").count() == 0
    short = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (3.0, 4.0), (599.0, 601.0)], "start double, end double")
    got = sorted(map(tuple, selection.merged_windows(short, [], 600.0).select("_bucket", "start", "end").collect()))
    assert got == [(0, 0.0, 2.0), (0, 3.0, 4.0), (0, 599.0, 601.0), (1, 599.0, 601.0)]


def test_folds_and_ranks_hold_no_whole_key(spark):
    r = random.Random(3)
    steps = [(k, i, r.choice([-3, -1, 1, 2])) for k in (1, None) for i in range(700)]
    df = spark.createDataFrame(steps, "k int, i int, d int")
    want, level = {}, {}
    for k, i, d in steps:
        level[k] = want[k, i] = max(0, min(9, level.get(k, 4) + d))
    got = {(x.k, x.i): x.level for x in kernels.clamped_fold(df, ["k"], ["i"], "d", 0, 9, 4, block=16).collect()}
    assert got == want

    ranked = kernels.ranked_within(df, [], ["i", "k"], "pos", 4)
    assert [x.pos for x in ranked.orderBy("i", "k").collect()] == list(range(1, 1401))
    assert max(x["count"] for x in ranked.groupBy("_part").count().collect()) < 700
