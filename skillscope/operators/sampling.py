"""Deterministic sampling, capping and splitting by key hash.

The reference samples with a seeded Bernoulli draw, caps with ``limit`` and
splits unseeded; none is reproducible across engines or partitionings.  Here
each row's fate is a function of its key only: ``u = md5(key)`` read as a
60-bit integer, so any engine (and any re-execution after a lost executor)
makes the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SPACE = float(1 << 60)
LEVEL_BITS = 20     # of the 60 bits of a hash, for one level of the selection


def key_hash(key) -> Column:
    """md5 of the key's string form, first 15 hex digits as a long."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 15), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Bernoulli-like sample without replacement: keep a row iff its key
    hash falls below ``fraction`` of the hash space."""
    return df.filter(key_hash(key) < F.lit(int(fraction * HASH_SPACE)))


def _digit_of_kth(hashes: DataFrame, shift: int, state: Column | None, limit: Column) -> Column:
    """One level of the selection, as a lazy struct (prefix, rest): the prefix down to ``shift`` bits of the hash with
    the wanted place, and its place among the hashes of that prefix (null once there are too few)."""
    named = hashes.select("h", (F.struct(F.lit(0).cast("long").alias("prefix"), limit.cast("long").alias("rest"))
                                if state is None else state).alias("s"))
    digits = named.filter(f"shiftright(h, {shift + LEVEL_BITS}) = s.prefix").groupBy(
        F.expr(f"shiftright(h, {shift})").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.first("s.rest").alias("rest"))
    listed = digits.agg(F.sort_array(F.collect_list(F.struct("prefix", "n"))).alias("a"), F.first("rest").alias("rest"))
    return listed.selectExpr("""aggregate(a, named_struct('prefix', CAST(NULL AS bigint), 'rest', rest), (acc, x) ->
        if(acc.prefix IS NOT NULL, acc, if(acc.rest <= x.n, named_struct('prefix', x.prefix, 'rest', acc.rest),
           named_struct('prefix', CAST(NULL AS bigint), 'rest', acc.rest - x.n)))) AS s""").scalar()


def kth_hash(df: DataFrame, key: str, limit: Column) -> Column:
    """The ``limit``-th smallest key hash as a lazy column; null if ``df`` has
    fewer keys.

    Radix selection: a histogram over the first LEVEL_BITS bits finds the prefix
    that holds the wanted place, a histogram of the next bits inside that prefix
    goes on, until all 60 bits are known.  Each level is one aggregate of at most
    2^LEVEL_BITS rows whatever the input's size; rows are neither sorted nor moved."""
    hashes = df.select(key_hash(key).alias("h"))
    state = None
    for shift in range(60 - LEVEL_BITS, -1, -LEVEL_BITS):
        state = _digit_of_kth(hashes, shift, state, limit)
    return state["prefix"]


def cap_by_hash(df: DataFrame, key: str, limit: Column) -> DataFrame:
    """Keep the ``limit`` rows with the smallest key hash (rows that share the
    last hash stay together; null keys never do).  ``limit`` is a column
    expression (e.g. a scalar subquery), so the cap stays lazy; one filter with
    the exact threshold of :func:`kth_hash`."""
    last = kth_hash(df, key, limit)
    marked = df.withColumn("_hk", key_hash(key)).withColumn("_last", last).withColumn("_limit", limit)
    return marked.filter("_limit > 0 AND _hk IS NOT NULL AND coalesce(_hk <= _last, true)").drop("_hk", "_last", "_limit")


def downsample(df: DataFrame, key: str, target: DataFrame) -> DataFrame:
    """Keep as many rows of ``df`` as ``target`` has, those with the
    smallest key hash (all rows if ``df`` has fewer)."""
    return cap_by_hash(df, key, target.select(F.count(F.lit(1))).scalar())


def hash_split(df: DataFrame, key: str, holdout_fraction: float, col: str = "is_holdout") -> DataFrame:
    """Mark a ``holdout_fraction`` share of keys as holdout (1), others 0.
    Uses the hash's low bits so it is independent of :func:`hash_sample`."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 17, 8), 16, 10).cast("long")
    return df.withColumn(col, F.when(h < F.lit(int(holdout_fraction * (1 << 32))), 1).otherwise(0))
