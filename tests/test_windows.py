"""Windows with two lifetimes: a failed one is handled again, a repeat is ignored until its completion has ended."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import jobs


def test_two_lifetimes(spark, tmp_path):
    source, claims, handled = tmp_path / "in", str(tmp_path / "claims"), []
    source.mkdir()

    def announce(name, *rows):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"window_key": k, "end_time": t}) for k, t in rows), encoding="utf-8")

    def go(fails=False):
        def handle(batch, _):
            keys = sorted(r.window_key for r in batch.collect())
            if fails:
                raise RuntimeError("no")
            handled.append(keys)

        df = spark.readStream.schema("window_key string, end_time timestamp").json(str(source))
        jobs.handle_windows(df, claims, str(tmp_path / "cp"), handle).awaitTermination()

    announce("1", ("a", "2024-01-01 05:00:00"), ("a", "2024-01-01 05:10:00"), ("b", "2024-01-01 05:00:00"))
    with pytest.raises(Exception, match="no"):
        go(fails=True)
    go()
    assert handled == [["a", "b"]]
    # Two hours later a repeat is ignored, another window is not; a day later it may come again.
    announce("2", ("a", "2024-01-01 07:00:00"), ("c", "2024-01-01 07:00:00"), (None, "2024-01-01 07:00:00"))
    go()
    announce("3", ("a", "2024-01-02 05:00:01"), ("c", "2024-01-02 05:00:01"))
    go()
    assert handled == [["a", "b"], ["c"], ["a"]]


def test_claims_end(spark):
    claims = spark.createDataFrame(
        [("claimed", "claimed", "05:00", 1, 0), ("released", "claimed", "05:00", 1, 0), ("released", "released", "05:00", 2, 1), ("done", "claimed", "05:00", 1, 0), ("done", "completed", "05:00", 1, 2)],
        "window_key string, state string, h string, n int, phase int",
    ).select("window_key", "state", F.concat(F.lit("2024-01-01 "), "h").cast("timestamp").alias("at"), F.timestamp_seconds("n").alias("noted"), "phase")

    def free(at):
        rows = spark.createDataFrame([(k,) for k in ("claimed", "released", "done", "new")], "window_key string").withColumn("end_time", F.lit(at).cast("timestamp"))
        return sorted(r.window_key for r in jobs.open_windows(rows, claims).collect())

    assert free("2024-01-01 05:30:00") == ["new", "released"]
    assert free("2024-01-01 06:30:00") == ["claimed", "new", "released"]
    assert free("2024-01-02 05:30:00") == ["claimed", "done", "new", "released"]
