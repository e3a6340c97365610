"""Bloom filters of a stored table's files: no key is missed, a small batch opens few files, foreign files are opened."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from newsloom.session import new_path
from newsloom.sources import key_index, sinks


def test_filters_miss_nothing():
    pick = np.random.default_rng(3)
    inside, outside = pick.integers(-(2**63), 2**63 - 1, 5000), pick.integers(-(2**63), 2**63 - 1, 5000)
    bits = key_index.filter_of(inside)
    assert all(key_index.may_hold(bits, inside[i : i + 1]) for i in range(0, 5000, 50))
    assert sum(key_index.may_hold(bits, outside[i : i + 1]) for i in range(5000)) < 25
    assert not key_index.may_hold(key_index.filter_of(inside[:0]), outside)


def rows(spark, ids, value, fmt="long"):
    df = spark.createDataFrame([(i, f"d{i % 4}", value) for i in ids], f"id {fmt}, day string, v string")
    return df


def files(spark, path):
    return key_index.file_names(sinks.read_like(spark, path, ["day"], rows(spark, [1], "x")))


def test_a_small_batch_opens_few_files(spark):
    path = new_path(spark, "test-keys")
    sinks.merge_into(spark, path, rows(spark, range(4000), "old"), ["id"], ["day"], max_records=100)
    target = spark.read.parquet(path)
    assert len(files(spark, path)) >= 40
    batch = rows(spark, [5, 9], "new", "int")  # another type of the key
    opened = key_index.files_to_open(spark, path, target, batch, ["id"])
    assert 1 <= len(opened) <= 3
    plan = target.where(F.col("_metadata.file_path").isin(opened))
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and plan.select(F.input_file_name()).distinct().count() == len(opened)
    holding = {r[0] for r in target.where("id IN (5, 9)").select(F.col("_metadata.file_path")).distinct().collect()}
    assert holding <= set(opened)
    sinks.merge_into(spark, path, rows(spark, [5, 9, 70_001], "new"), ["id"], ["day"], max_records=100)
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 4001 and {i for i, v in got.items() if v == "new"} == {5, 9, 70_001}
    # Rewritten files have filters of their own.
    known = {r.file for r in key_index.indexed_files(spark, path).collect()}
    assert set(files(spark, path)) <= known
    sinks.merge_into(spark, path, rows(spark, [9, 80_002], "third"), ["id"], ["day"], mode="insert_new")
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert got[9] == "new" and got[80_002] == "third" and len(got) == 4002


def test_files_written_past_the_index_are_opened(spark):
    path = new_path(spark, "test-keys")
    sinks.merge_into(spark, path, rows(spark, range(100), "old"), ["id"], ["day"])
    sinks.write_partitioned(rows(spark, [500], "foreign"), path, ["day"])
    sinks.merge_into(spark, path, rows(spark, [500], "new"), ["id"], ["day"], mode="insert_new")
    assert spark.read.parquet(path).where("id = 500").select("v").collect()[0].v == "foreign"
    sinks.merge_into(spark, path, rows(spark, [500], "new"), ["id"], ["day"])
    assert [r.v for r in spark.read.parquet(path).where("id = 500").collect()] == ["new"]


def test_a_large_batch_opens_everything(spark, monkeypatch):
    path = new_path(spark, "test-keys")
    sinks.merge_into(spark, path, rows(spark, range(400), "old"), ["id"], ["day"], max_records=20)
    monkeypatch.setattr(key_index, "MOST_KEYS", 1)
    assert sorted(files(spark, path)) == key_index.files_to_open(spark, path, spark.read.parquet(path), rows(spark, [1, 2], "x"), ["id"])
