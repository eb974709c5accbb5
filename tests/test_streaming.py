"""One definition on tables and streams, over several micro-batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from symloom import schemas
from symloom.streaming import steps as st

LINES = [
    ("r1", "mapping: start"), ("r1", "mapping: done"), ("r1", "  ID-OBF : Skip "), ("r1", ""), ("r2", "nothing known"), ("r1", "mapping: start"),
    ("r2", "control flow flattening begins"), ("r2", "cff: done"), ("r2", "cff: done"), ("r2", "unknown: done"),
] + [("r3", f"{k}: done") for k, _ in st.STEPS] + [("r3", f"line {i}") for i in range(15)]
START = datetime(2024, 1, 1)


def table(spark):
    return spark.createDataFrame([(run, START + timedelta(seconds=i), line) for i, (run, line) in enumerate(LINES)], schemas.LOG_LINES)


def test_states(spark):
    got = {r["run_id"]: r for r in st.step_state(table(spark)).collect()}
    assert got["r1"]["actions"] == "mapping=start,id-obf=skip" and got["r1"]["n_seen"] == 2 and got["r1"]["current"] == "Control flow flattening"
    assert got["r2"]["actions"] == "cff=done" and got["r2"]["n_seen"] == 1 and got["r2"]["current"] == "Identifier mapping"
    assert got["r3"]["n_seen"] == 8 and got["r3"]["progress"] == 1.0 and got["r3"]["current"] == "Debug symbol removal"
    assert {r["run_id"]: r["n_seen"] for r in st.progress(table(spark)).collect()} == {"r1": 3, "r2": 2, "r3": 9}


def test_stream_equals_table(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        rows = table(spark).where(F.pmod(F.second("ts"), F.lit(3)) == i).coalesce(1)
        rows.write.mode("append").parquet(source)
    stream = spark.readStream.schema(schemas.LOG_LINES).option("maxFilesPerTrigger", 1).parquet(source)
    for name, build, batch in (("state", st.step_state, st.step_state(table(spark))), ("progress", st.progress, st.progress(table(spark)))):
        st.keep_latest(build(stream), str(tmp_path / name), str(tmp_path / f"{name}-mark")).awaitTermination()
        got = st.latest(spark.read.parquet(str(tmp_path / name)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    st.keep_latest(st.tail_stream(stream, 10), str(tmp_path / "tail"), str(tmp_path / "tail-mark")).awaitTermination()
    got = {r["run_id"]: r["lines"] for r in st.latest(spark.read.parquet(str(tmp_path / "tail"))).collect()}
    want = {}
    for r in st.tail(table(spark)).orderBy("run_id", F.desc("rn")).collect():
        want.setdefault(r["run_id"], []).append(r["line"])
    assert got == want and len(got["r3"]) == 10


def test_detectors(spark):
    lines = ["[mapping] go", "identifier mapping", "id_obf x", "CFF", "opaque  predicate", "DeadCode", "string encryption", "cfg:", "a debug b", "encryption: x", "plain", "remapping"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string").orderBy("i").select(st.detect_step("line")).collect()]
    assert got == ["mapping", "mapping", "id-obf", "cff", "opaq", "deadcode", "encryption", "cfg", "debug", "encryption", None, None]
