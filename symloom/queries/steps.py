"""Queries over step progress, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.queries.derived import LOG_LINE, log_lines, table
from symloom.queries.registry import query
from symloom.session import new_folder
from symloom.streaming import steps as st

_LINES = f"""lines AS (SELECT CAST(user_id AS STRING) AS run_id, ts, event_id, {LOG_LINE} AS line, split_part(split_part({LOG_LINE}, ':', 1), ' ', 1) AS step,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'start' WHEN event_id % 3 = 1 THEN 'done' ELSE 'skip' END AS action FROM events)"""
_DETECTED = "CASE WHEN action IS NOT NULL OR step IN ('id-obf', 'cff', 'opaq', 'deadcode') THEN step END"


@query("step_markers", f"WITH {_LINES} SELECT event_id, {_DETECTED} AS step, action, action IS NOT NULL AS marked FROM lines")
def step_markers(spark, sf):
    return st.parse_markers(log_lines(spark, sf)).select("event_id", "step", "action", "marked")


_NOISE = ("CASE event_id % 8 WHEN 0 THEN 'identifier  mapping now' WHEN 1 THEN 'Identifier Obfuscation' WHEN 2 THEN 'control-flow' WHEN 3 THEN 'Opaque predicate x' WHEN 4 THEN 'dead code ' "
          "WHEN 5 THEN 'string encryption' WHEN 6 THEN 'dynamic function' ELSE event_type END")


@query("detected_steps", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'mapping' WHEN 1 THEN 'id-obf' WHEN 2 THEN 'cff' WHEN 3 THEN 'opaq' WHEN 4 THEN 'deadcode' WHEN 5 THEN 'encryption' WHEN 6 THEN 'cfg' END AS step FROM events")
def detected_steps(spark, sf):
    return table(spark, sf, "events").select("event_id", st.detect_step(F.expr(_NOISE)).alias("step"))


_STATE = f"""WITH {_LINES}, s AS (SELECT run_id, step, arg_max(action, {{'ts': ts, 'line': line}}) FILTER (action IS NOT NULL) AS last, coalesce(bool_or(action IN ('done', 'skip')), false) OR bool_or(action IS NULL AND {_DETECTED} IS NOT NULL) AS seen FROM lines GROUP BY ALL),
    o AS (SELECT * FROM (VALUES ('mapping', 1), ('id-obf', 2), ('cff', 3), ('opaq', 4), ('deadcode', 5)) t(step, pos)),
    r AS (SELECT run_id, string_agg(step || '=' || last, ',' ORDER BY pos) FILTER (last IS NOT NULL) AS actions, count(*) FILTER (seen) AS n_seen,
      list(step) FILTER (seen) AS seen_steps FROM s JOIN o USING (step) GROUP BY run_id)
    SELECT run_id, coalesce(actions, '') AS actions, n_seen, CASE WHEN NOT coalesce(list_contains(seen_steps, 'mapping'), false) THEN 'Identifier mapping' WHEN NOT list_contains(seen_steps, 'id-obf') THEN 'Identifier obfuscation'
      WHEN NOT list_contains(seen_steps, 'cff') THEN 'Control flow flattening' WHEN NOT list_contains(seen_steps, 'opaq') THEN 'Opaque predicate' WHEN NOT list_contains(seen_steps, 'deadcode') THEN 'Dead code'
      ELSE 'String encryption' END AS current, round((n_seen + 1) / 9.0, 4) AS progress FROM r"""


@query("step_states", _STATE)
def step_states(spark, sf):
    return st.step_state(log_lines(spark, sf))


def _stream(spark, sf):
    """The events file read as a stream of log lines."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(F.col("user_id").cast("string").alias("run_id"), "ts", F.expr(LOG_LINE.replace("\n", " ")).alias("line"))


@query("step_states_streamed", _STATE)
def step_states_streamed(spark, sf):
    path, mark = new_folder(spark, "steps"), new_folder(spark, "steps-mark")
    st.keep_latest(st.step_state(_stream(spark, sf)), path, mark).awaitTermination()
    return st.latest(spark.read.parquet(path))


@query("step_progress", f"{_STATE.split('SELECT run_id, coalesce')[0]} SELECT run_id, n_seen + 1 AS n_seen, round((n_seen + 1) / 9.0, 4) AS progress FROM r")
def step_progress(spark, sf):
    return st.progress(log_lines(spark, sf)).select("run_id", F.col("n_seen").cast("long").alias("n_seen"), "progress")


_TAIL = f"WITH {_LINES} SELECT run_id, string_agg(line, '|' ORDER BY ts DESC, line DESC) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, line DESC) AS rn FROM lines) WHERE rn <= 10 GROUP BY run_id"


@query("last_lines", _TAIL)
def last_lines(spark, sf):
    rows = st.tail(log_lines(spark, sf))
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("x")).select("run_id", F.array_join(F.transform("x", lambda r: r["line"]), "|").alias("lines"))


@query("last_lines_streamed", _TAIL)
def last_lines_streamed(spark, sf):
    path, mark = new_folder(spark, "tail"), new_folder(spark, "tail-mark")
    st.keep_latest(st.tail_stream(_stream(spark, sf)), path, mark).awaitTermination()
    return st.latest(spark.read.parquet(path)).select("run_id", F.array_join(F.reverse("lines"), "|").alias("lines"))
