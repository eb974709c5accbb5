"""Steps whose cost must grow no faster than their input."""

import time

import pytest
from pyspark.sql import functions as F

from symloom.functions import text as tx
from symloom.operators import graph
from symloom.operators.rewrite import pseudonymize_by_table
from symloom.queries import QUERIES, derived
from symloom.session import cut_lineage, hold
from tests.conftest import SF


def test_squeeze_takes_linear_time(spark):
    lines = F.repeat(F.lit("ab \t\n\n \n\nc\n"), 30_000)
    blanks = F.concat(F.repeat(F.lit(" \t"), 300_000), F.lit("x"))
    start = time.time()
    got = spark.range(1).select(tx.squeeze(lines).alias("a"), tx.squeeze(blanks).alias("b")).first()
    assert time.time() - start < 20
    assert got.a == "\n".join(["ab\n\nc"] * 30_000) and got.b == " \t" * 300_000 + "x"


def test_rendered_files_are_dealt_to_all_parts(spark):
    for files in (derived.swift_files(spark, SF), derived.second_files(spark, SF)):
        assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nested_calls_are_dealt_before_they_are_rendered(spark):
    assert "REPARTITION_BY_NUM" in QUERIES["nested_call_reasons"](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("walk", [graph.closure, graph.reachable])
def test_walks_read_the_edges_once_and_repeat_no_path(spark, tmp_path, monkeypatch, walk):
    plans = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut_lineage(df))
    edges = [("a", f"b{i}") for i in range(40)] + [(f"b{i}", "c") for i in range(40)] + [("c", "d"), ("d", "a"), ("c", None), (None, "x")]
    spark.createDataFrame(edges * 2, "upper_end string, lower_end string").write.parquet(f"{tmp_path}/edges")
    starts = spark.createDataFrame([("a",), (None,)], "node string")
    got = walk(spark.read.parquet(f"{tmp_path}/edges"), starts, "upper_end", "lower_end")
    counts = {(r.node, r.depth): r.n for r in got.groupBy("node", "depth").agg(F.count("*").alias("n")).collect()}
    times = 40 if walk is graph.closure else 1
    nulls = {} if walk is graph.closure else {(None, 3): 1}
    assert counts == {**nulls, (None, 0): 1, ("a", 0): 1, **{(f"b{i}", 1): 1 for i in range(40)}, ("c", 2): times, ("d", 3): times}
    assert sum("upper_end" in p for p in plans) == 1
    assert not any("_salt" in p for p in plans)


def test_python_gets_small_batches(spark):
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(n) for n in names]
    texts = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    try:
        for step in (lambda: pseudonymize_by_table(texts, {"x": "y"}), lambda: hold(texts, "parts", F.split("text", " "))):
            spark.conf.set(names[0], "10000")
            spark.conf.set(names[1], str(256 << 20))
            step()
            assert int(spark.conf.get(names[0])) <= 500 and int(spark.conf.get(names[1])) <= 4 << 20
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
