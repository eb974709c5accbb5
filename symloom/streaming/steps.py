"""Step progress from log lines. One definition serves streams and tables.

Progress is a plain grouped aggregate with one pair of columns per step, so it
runs as a native streaming aggregation with partial sums before the shuffle; a
run that holds most of the lines costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symloom.functions.names import ColumnLike, as_col
from symloom.functions.scan import last_n

# The steps in order, their labels, and how unmarked lines name them.
STEPS = [("mapping", "Identifier mapping"), ("id-obf", "Identifier obfuscation"), ("cff", "Control flow flattening"),
         ("opaq", "Opaque predicate"), ("deadcode", "Dead code"), ("encryption", "String encryption"),
         ("cfg", "Dynamic function"), ("debug", "Debug symbol removal")]
TOTAL_STEPS = len(STEPS) + 1  # the bootstrap step counts as seen from the start
DETECTORS = {
    "mapping": r"\bmapping\b.*?:|\[mapping\]|\bmapping\b.*\bstart\b|identifier\s+mapping",
    "id-obf": r"id[-_ ]?obf|identifier\s+obfuscation",
    "cff": r"\bcff\b|control\s*flow\s*flattening|control[- ]?flow",
    "opaq": r"\bopaq\b|opaque\s+predicate",
    "deadcode": r"dead\s*code|\bdeadcode\b",
    "encryption": r"string\s+encryption|encryption\s+start",
    "cfg": r"\bcfg\b|dynamic\s*function|cfg:",
    "debug": r"delete\s+debug\s+symbols|debug:|\bdebug\b",
}
_MARKER = r"(?i)^\s*(" + "|".join(k for k, _ in STEPS) + r")\s*:\s*(start|done|skip)\s*$"


def marker_step(line: ColumnLike) -> Column:
    return F.nullif(F.lower(F.regexp_extract(as_col(line), _MARKER, 1)), F.lit(""))


def marker_action(line: ColumnLike) -> Column:
    return F.nullif(F.lower(F.regexp_extract(as_col(line), _MARKER, 2)), F.lit(""))


def detect_step(line: ColumnLike) -> Column:
    """Step named by an unmarked line: the first detector that matches, else a generic form."""
    c, low = as_col(line), F.lower(as_col(line))
    out = None
    for key, pattern in DETECTORS.items():
        hit = c.rlike("(?i)" + pattern)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    for key, _ in STEPS:
        out = out.when(low.startswith(f"{key}:") | low.contains(f" {key}:") | low.contains(f"[{key}]") | low.startswith(f"{key} start"), key)
    return out


def parse_markers(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with ``step``, ``action`` and ``marked``; unmarked lines get a detected step."""
    step = marker_step(line)
    return (lines.withColumn("marked", step.isNotNull()).withColumn("step", F.coalesce(step, detect_step(line)))
            .withColumn("action", marker_action(line)))


def step_state(lines: DataFrame, run: str = "run_id", order: str = "ts") -> DataFrame:
    """Per run: latest action and seen flag of every step, share seen, current step."""
    rows = parse_markers(lines)
    aggs = []
    for key, _ in STEPS:
        on = F.col("step") == key
        aggs.append(F.max_by(F.when(on, F.col("action")), F.when(on & F.col("marked"), F.struct(order, "line"))).alias(f"a_{key}"))
        aggs.append(F.coalesce(F.max(on & (~F.col("marked") | F.col("action").isin("done", "skip"))), F.lit(False)).alias(f"s_{key}"))
    state = rows.groupBy(run).agg(*aggs)
    seen = [F.col(f"`s_{k}`") for k, _ in STEPS]
    n_seen = sum((s.cast("int") for s in seen[1:]), seen[0].cast("int"))
    unseen = F.coalesce(*[F.when(~F.col(f"`s_{k}`"), F.lit(label)) for k, label in STEPS])
    last_done = F.coalesce(*[F.when(F.col(f"`a_{k}`") == "done", F.lit(label)) for k, label in reversed(STEPS)])
    actions = F.concat_ws(",", *[F.when(F.col(f"`a_{k}`").isNotNull(), F.concat(F.lit(f"{k}="), F.col(f"`a_{k}`"))) for k, _ in STEPS])
    return state.select(run, actions.alias("actions"), n_seen.alias("n_seen"),
                        F.coalesce(unseen, last_done, F.lit(STEPS[-1][1])).alias("current"),
                        F.round((n_seen + 1) / F.lit(float(TOTAL_STEPS)), 4).alias("progress"))


def progress(lines: DataFrame, run: str = "run_id") -> DataFrame:
    """Share of known steps seen, the bootstrap step included."""
    rows = parse_markers(lines)
    seen = F.when(~F.col("marked") | F.col("action").isin("done", "skip"), F.col("step"))
    flags = [F.coalesce(F.max((seen == k).cast("int")), F.lit(0)) for k, _ in STEPS]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return rows.groupBy(run).agg((total + 1).alias("n_seen")).withColumn("progress", F.round(F.col("n_seen") / F.lit(float(TOTAL_STEPS)), 4))


def tail(lines: DataFrame, n: int = 10, run: str = "run_id", order: str = "ts") -> DataFrame:
    """Last ``n`` non-blank lines per run of a table."""
    rows = lines.where(F.trim("line") != "")
    return last_n(rows, [run], [F.desc(order), F.desc("line")], n, F.col(order))


_TAIL_OUT = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))])
_TAIL_STATE = T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("lines", T.ArrayType(T.StringType()))])


def tail_stream(lines: DataFrame, n: int = 10) -> DataFrame:
    """The same for a stream: a list of ``n`` lines per run is all the state there is.

    Before the shuffle every batch of rows is cut to its own last ``n`` per run,
    so a run that fills the stream sends only a few rows to its task.
    """
    def shorten(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part[part["line"].str.strip() != ""].sort_values(["ts", "line"])
            yield part.groupby("run_id", sort=False).tail(n)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, kept = ([], []) if not state.exists else map(list, state.get)
        rows = list(zip(ts, kept))
        for part in parts:
            part = part[part["line"].str.strip() != ""]
            stamps = part["ts"].astype("datetime64[us]").astype("int64")
            rows = sorted(rows + list(zip(stamps.tolist(), part["line"].tolist())))[-n:]
        state.update(([int(t) for t, _ in rows], [line for _, line in rows]))
        yield pd.DataFrame({"run_id": [key[0]], "lines": [[line for _, line in rows]]})

    short = lines.select("run_id", "ts", "line").mapInPandas(shorten, "run_id string, ts timestamp, line string")
    return short.groupBy("run_id").applyInPandasWithState(update, _TAIL_OUT, _TAIL_STATE, "update", GroupStateTimeout.NoTimeout)


def keep_latest(stream: DataFrame, path: str, checkpoint: str):
    """Run an update-mode stream once over what is there, appending each batch's updates under ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(updates: DataFrame, key: str = "run_id") -> DataFrame:
    """The last update of every key."""
    others = [c for c in updates.columns if c not in (key, "batch_id")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*others), F.col("batch_id")).alias("u")).select(key, "u.*")
