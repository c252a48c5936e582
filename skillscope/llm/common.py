"""Helpers shared by the corpus operators: durable intermediate tables and
word-level hashing inside tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one named by ``spark.checkpoint.dir``.

    Only a single-JVM session (tests) without that setting gets a folder of
    its own; on a cluster a missing setting is an error, because executors
    could not read each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_roots.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="corpus-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage durably: a lost executor never causes the work behind
    the table to run again."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`stored` that no later
    plan reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column_as(df: DataFrame, name: str, alias: str) -> Column:
    """A column under another name; left alone where it has that name already,
    so that two uses of one scan stay equal plans and can share a shuffle."""
    return df[f"`{name}`"] if name == alias else df[f"`{name}`"].alias(alias)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def slices(batches, rows: int):
    """Arrow batches cut into (zero-copy) slices of at most ``rows`` rows, so
    that what a task holds per step does not follow the reader's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text (bytes.split() without
    arguments splits on exactly these six bytes)."""
    return text.split()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


#: Odd multipliers of the window hashes (fixed values, from the fractions of the golden ratio and of the root of 3).
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_2 = np.uint64(0xBB67AE8584CAA73B)


def window_hashes(hashes: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes.

    A run of twice the length is made from two runs of half the length, so the
    cost is logarithmic in ``length``."""
    if len(hashes) < length:
        return np.empty(0, np.uint64)
    out, done, power = None, 0, hashes
    size, left = 1, length
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = power[done:len(hashes) - length + done + 1]
                out = part if out is None else mixed(out * base ^ part)
                done += size
            left >>= 1
            if left:
                power = mixed(power[:-size] * base ^ power[size:])
                size *= 2
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
