"""The catalogue's datasets as a data source."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewarp.series import SeriesSpec
from tidewarp.sources import series_format
from tidewarp.sources.catalogue import KNOWN, Dataset, SeriesCatalogue

GIVEN = Dataset("counts", "id long, day date, at timestamp, y double, name string", SeriesSpec((), "day", "y"), format="parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("given")
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i // 10) for i in range(1000)]
    at = pa.array([dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(1000)], pa.timestamp("us", "UTC"))
    table = pa.table({"name": [f"n{i % 7}" for i in range(1000)], "id": range(1000), "day": days, "at": at, "y": [None if i % 50 == 0 else float(i) for i in range(1000)], "more": range(1000)})
    pq.write_table(table, path / "counts.parquet", row_group_size=100)
    (path / "Messages_Sent_Hour.csv").write_text("date,ta,tb,tc\n2024-01-01 05:00:00,1,2,3\n2024-01-01 06:00:00,4,,6\n")
    series_format.register(spark, {**KNOWN, "counts": GIVEN})
    return str(path)


def load(spark, folder, name):
    return spark.read.format("tidewarp").option("dataset", name).load(folder)


def test_reads_what_the_catalogue_reads(spark, folder):
    df = load(spark, folder, "counts")
    own = SeriesCatalogue(spark, folder, {"counts": GIVEN})["counts"]
    assert df.columns == ["id", "day", "at", "y", "name"] and df.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, df.where("y IS NOT NULL").collect())) == sorted(map(tuple, own.where("y IS NOT NULL").collect()))
    assert df.where("y IS NULL").count() == 20


def test_filters_are_pushed_and_leave_out_row_groups(spark, folder):
    df = load(spark, folder, "counts").where((F.col("id") >= 250) & (F.col("id") < 420) & (F.col("day") > F.lit("2024-01-26").cast("date")) & F.col("name").isin("n1", "n2") & (F.col("y") * 2 > 0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # What Spark still looks at itself is the one filter that the source can't take.
    assert plan.count("Filter ") == 1 and "* 2.0" in plan and "250" not in plan and "n1" not in plan
    want = [i for i in range(250, 420) if i // 10 > 25 and i % 7 in (1, 2) and i % 50]
    assert sorted(r["id"] for r in df.collect()) == want and df.rdd.getNumPartitions() == 3
    assert load(spark, folder, "counts").where("id > 5000").count() == 0
    for kind in ("timestamp", "timestamp_ntz"):
        assert load(spark, folder, "counts").where(F.col("at") >= F.lit("2024-02-01").cast(kind)).count() == 1000 - 31 * 24
    assert load(spark, folder, "counts").where("name = 'n3' OR id = 7").count() == 144


def test_csv_times_and_errors(spark, folder):
    rows = load(spark, folder, "Messages_Sent_Hour").orderBy("date").collect()
    assert [(r["date"], r["ta"], r["tb"], r["tc"]) for r in rows] == [(dt.datetime(2024, 1, 1, 5), 1, 2, 3), (dt.datetime(2024, 1, 1, 6), 4, None, 6)]
    for name, where in (("nothing", folder), ("Web_Sales", folder), ("counts", "hdfs://x/y")):
        with pytest.raises(Exception, match="no dataset|there is no|no path"):
            load(spark, where, name).collect()
