"""Session helpers: build a session for tests and bench, durable intermediate
tables in the folder that ``spark.checkpoint.dir`` names, and shipping of the
package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "skillscope") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, from ``spark.checkpoint.dir``.

    Without that setting a single-JVM session (tests, local bench) gets a
    folder of its own; a cluster session is refused, because its executors
    could not read each other's files."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_roots.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="skillscope-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused intermediate once as a table in the shared folder and
    read it back: later plans start from the files, and a lost executor never
    repeats the work behind them.  Eager: the write runs at once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, column: str) -> DataFrame:
    """Like :func:`materialize`, with one folder for each value of ``column``: a
    filter on it reads its folder only.

    Rows are dealt by the column first, so a value's rows are in few files;
    adaptive execution splits a value with very many rows among tasks.  The
    columns keep their order and types; an empty string comes back as null."""
    path = f"{shared_folder(df.sparkSession)}/store-{uuid.uuid4().hex}"
    df.hint("rebalance", column).write.partitionBy(column).parquet(path)
    schema = type(df.schema)([f for f in df.schema if f.name != column] + [df.schema[column]])
    return df.sparkSession.read.schema(schema).parquet(path).select(*df.columns)


def store_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Like :func:`materialize`, with one folder for each combination of the values of ``columns`` (few, none null),
    written by the tasks that hold the rows: what a filter on them reads, and its size, is known when a plan is made."""
    path = f"{shared_folder(df.sparkSession)}/parts-{uuid.uuid4().hex}"
    df.write.partitionBy(*columns).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def ship_package(spark: SparkSession) -> None:
    """Add this package to the executors' Python path, once per application
    (for operators with Python work inside tasks)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="skillscope-code-"), "skillscope")
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(root), os.path.basename(root)))
    _shipped.add(sc.applicationId)
