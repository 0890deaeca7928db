"""Runs that fall silent: stalled and dead come out of the stream while nothing comes in."""

import datetime as dt

from pyspark.sql import functions as F

from stancelake.operators import filters
from stancelake.streaming import runs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run string, ts timestamp, tie long, status string"


def put(spark, folder, rows):
    spark.createDataFrame([(r, T0 + dt.timedelta(seconds=s), i, status) for i, (r, s, status) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def states(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.at_us, r.status == "dead")):
        out.setdefault(r.run, []).append(r.status)
    return out


def test_silence_is_told(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(spark, folder, [("a", 0, "running"), ("b", 0, "running"), ("b", 5, "done"), ("c", 0, "running"), ("c", 100, "running"), ("d", 110, "running")])
    stream = lambda: runs.liveness(spark.readStream.schema(SCHEMA).parquet(folder), 30, 90, "10 seconds")
    first = states(runs.run_through(stream(), "update", state).collect())
    # by the watermark of 100 s: a is silent for 100, b has ended, c and d are alive
    assert first == {"a": ["running", "stalled", "dead"], "b": ["done"], "c": ["running"], "d": ["running"]}
    put(spark, folder, [("e", 150, "running")])  # nothing of c or d comes
    second = states(runs.run_through(stream(), "update", state).collect())
    assert second["c"] == ["running", "stalled"] and second["d"] == ["running"] and second["a"] == first["a"]
    put(spark, folder, [("c", 151, "running"), ("a", 152, "running"), ("e", 250, "failed")])
    third = states(runs.run_through(stream(), "update", state).collect())
    assert third["c"][:3] == ["running", "stalled", "running"] and third["c"][-1] in ("stalled", "dead")
    assert third["a"][3:] == ["running", "stalled"] and third["e"][-1] == "failed" and third["d"][-1] == "dead"


def test_classes_of_a_stored_row(spark):
    rows = [("running", 0, True, "running"), ("running", 31, True, "stalled"), ("running", 0, False, "dead"), ("running", 31, False, "dead"), ("running", 31, None, "stalled"), ("done", 99, False, "done")]
    df = spark.createDataFrame([(s, T0 - dt.timedelta(seconds=late), alive, want) for s, late, alive, want in rows], "status string, hb timestamp, alive boolean, want string")
    got = df.select("want", filters.run_state(F.col("status"), F.col("hb"), F.lit(T0), 30, F.col("alive")).alias("got")).collect()
    assert [r.want for r in got] == [r.got for r in got]
