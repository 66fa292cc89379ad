"""State of a stream with timers: late rows, expiry, restarts."""

import datetime as dt

import pytest

from tidewarp.streaming import recent


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


@pytest.fixture
def run(spark, tmp_path):
    """Feed one batch of rows and return what the query gives for it; each call restarts the query from its checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    recent.stateful_session(spark)
    told = tmp_path / "told"

    def feed(number, rows):
        spark.createDataFrame(rows, "k string, ds timestamp, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("k string, ds timestamp, y double").parquet(str(tmp_path / "in"))
        found = recent.recent_values(source, "k", 3, late="1 day", expire_days=5)

        def keep(batch, i):
            batch.write.mode("overwrite").json(f"{told}/{number}-{i}")

        q = found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.read.schema("k string, at timestamp, x array<double>, expired boolean").json(f"{told}/{number}-*")
        return sorted((r["k"], r["x"], r["expired"]) for r in out.collect())

    yield feed
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_state_lives_through_restarts_and_expires(run):
    assert run(0, [("a", at(0), 1.0), ("a", at(2), 3.0), ("a", at(1), 2.0), ("b", at(0), 10.0), ("n", None, 1.0)]) == [("a", [1.0, 2.0, 3.0], False), ("b", [10.0], False)]
    # A restart: the oldest value goes. The watermark is at day 1 now, so a row of day 0 is too late and one of day 1.5 is not.
    got = run(1, [("a", at(3), 4.0), ("a", at(1, 12), 2.5), ("b", at(0, 1), 11.0)])
    assert got[0] == ("a", [2.5, 3.0, 4.0], False) and ("b", [10.0, 11.0], False) not in got
    # Day 8: b has been silent since day 0, a since day 3; the watermark passes b's end at day 5, not a's at day 8.
    got = run(2, [("c", at(8), 1.0)])
    assert ("c", [1.0], False) in got and ("b", [10.0], True) in got and not any(k == "a" for k, _, _ in got)
    # b starts anew; of two rows of one time the last counts; nulls are left out.
    got = run(3, [("b", at(9), 5.0), ("c", at(9), None), ("a", at(8), 7.0)])
    assert ("b", [5.0], False) in got and ("a", [3.0, 4.0, 7.0], False) in got


def test_parameters(spark):
    with pytest.raises(ValueError, match="positive"):
        recent.recent_values(spark.range(1), "id", 0)
