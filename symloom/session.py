"""Session settings, lineage cuts and joins with hot keys."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text work is heavy per byte: small shuffles still use every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_session(app: str = "symloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a plain local session, where driver and tasks are one process, gets a
    folder of its own when nothing is set; it goes when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = _own_folder()
    return shared


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="symloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/symloom-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columns can be pruned, and a lost executor costs nothing done before."""
    folder = new_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scope(*tables: DataFrame) -> list[str]:
    """``["project"]`` if all tables name the project of their rows, else nothing.

    Names mean something within their project only, so joins and groups by
    name take this along wherever it is there; it also splits common names.
    """
    return ["project"] if all("project" in t.columns for t in tables) else []


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join side that grows with the input: both sides are shuffled and merged, whatever their size is thought to be.

    The optimizer knows a derived table only by the compressed files below it.
    Rendered texts, unnested arrays and salts hold a hundred times that and
    more, so it would collect tables of any size on the driver to send them out.
    """
    return df.hint("merge")


def parts_for(spark: SparkSession, rows: int, per: int = 200_000) -> int:
    """Partitions for so many rows: those of any shuffle, and more once a task would get over ``per`` of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


def salted_join(big: DataFrame, small: DataFrame, key: str | list[str], spread: Column,
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join where single keys of ``big`` may hold a large share of its rows.

    Rows of ``big`` are spread over ``salts`` by a hash of ``spread``; ``small``
    must have at most one row per key, so repeating it costs ``salts`` times
    its own size, whatever the skew. Both sides get an exchange of their own
    (``shuffled``), so what is still too large after that Spark splits by the sizes it measures.
    With one salt, for a ``small`` that has about as many rows as ``big``, nothing is repeated and only that splitting is left.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if salts == 1:
        return big.join(shuffled(small), key, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(shuffled(right), [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession, records: int = 500, megabytes: int = 4) -> None:
    """Bound what a Python worker gets at once, by rows and by bytes, whatever the session sets: texts and their arrays may be of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    The optimizer would copy the expression into every place that reads it,
    and inside a lambda that means once per element. A one-element generator
    keeps it in a stage of its own. Such columns are arrays of a text's parts,
    which Python functions read, so batches are bounded here.
    """
    small_batches(df.sparkSession)
    return df.select("*", F.explode(F.array(value)).alias(name))
