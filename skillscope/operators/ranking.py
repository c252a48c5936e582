"""Exact rank statistics without a single-partition window.

``F.percent_rank().over(Window.orderBy(v))`` (no partitionBy) sends every row
to one task.  The functions here compute the same numbers at any size with one
plan for every type, by a histogram of values:

1. The rows are counted by (column, key, value), so that a value weighs one row
   from here on, however many rows hold it.  All ranked columns of one type go
   through the histogram together.
2. Cut points come from a bounded sample of the distinct values (those with
   the smallest hashes; a lazy subquery).  They set balance only; any cuts give
   exact ranks.  The values between two cuts are a bucket.
3. Bucket totals (one row for each column, key and bucket) give each bucket the
   number of rows that sort before it, and a window inside the bucket does the
   rest.
4. The ranks of the distinct values join the rows, each column's apart.  Hot
   values (more than one row in HOT holds them, so there are HOT at most) are
   broadcast, and their rows are dealt by a hash of the row where the others are
   dealt by value: no task gets all rows of a value.

Nothing is ranked by a window over all rows, no job runs while the plan is
built, and the input is read by two branches (the histogram and the last join):
hand in a stored table (``session.materialize``) if the plan behind it is dear.
With :func:`rank_stored` the ranks are stored too, so a column of few values is
known to be small and its rows are not shuffled at all.
Keys and values match null-safely (inside structs).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, store_parts

CUTS = 255      # largest number of cut values (one less than a power of two: they are found by halving)
SAMPLE = 4096   # distinct values sampled for cuts
HOT = 1024      # a value that more than one row in HOT holds is hot


@dataclass(frozen=True)
class RankSpec:
    value: str
    out: str
    kind: str = "percent"          # "percent" | "average_pct" | "ordinal"
    descending: bool = False
    nulls_first: bool | None = None  # default: Spark's (first asc, last desc)

    def __post_init__(self):
        if self.kind not in ("percent", "average_pct", "ordinal"):
            raise ValueError(self.kind)

    @property
    def nulls_lead(self) -> bool:
        return (not self.descending) if self.nulls_first is None else self.nulls_first


def _shared_type(data_type: T.DataType) -> str:
    """The type in which columns are counted together; the cast keeps values and their order."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, T.FloatType | T.DoubleType):
        return "double"
    return data_type.simpleString()


def _place(number: int, keys: list[str], value: str, shared: str) -> str:
    """A struct that names a ranked column, the key and the value: equal for equal places, ordered by value inside."""
    return f"struct({', '.join([f'{number} AS c', *[f'`{k}` AS k{j}' for j, k in enumerate(keys)]])}, CAST(`{value}` AS {shared}) AS v)"


def value_histogram(df: DataFrame, values: list[str], keys: list[str], shared: str) -> DataFrame:
    """(p, n): every place (column number, key, value) with the number of its rows."""
    places = ", ".join(_place(i, keys, v, shared) for i, v in enumerate(values))
    return df.selectExpr(f"explode(array({places})) AS p").groupBy("p").agg(F.expr("count(1) AS n"))


def cut_places(histogram: DataFrame):
    """At most CUTS sorted places that part the distinct values evenly, as a lazily evaluated array."""
    sample = histogram.select("p").orderBy(F.expr("xxhash64(p)"), "p").limit(SAMPLE)
    return sample.agg(F.expr("sort_array(collect_list(p)) AS a")).selectExpr(
        f"filter(a, (x, i) -> i % cast(ceil(size(a) / {CUTS}) AS int) = 0) AS cuts").scalar()


def bucketed(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram with the group ``g`` (column number and key) and the number ``b`` of cuts below each place."""
    group = f"struct({', '.join(['p.c AS c', *[f'p.k{j} AS k{j}' for j in range(len(keys))]])}) AS g"
    halves = ", ".join(str((CUTS + 1) >> i) for i in range(1, CUTS.bit_length() + 1))
    return histogram.withColumn("cuts", cut_places(histogram)).selectExpr(
        # not nullable by coalesce: a null check inferred from the joins would be pushed down to every input row
        "p", "n", group, f"coalesce(aggregate(array({halves}), 0, (lo, s) -> if(get(cuts, lo + s - 1) < p, lo + s, lo)), 0) AS b")


def _formula(s: RankSpec) -> str:
    """The rank of a value from ``before`` (rows of its group that sort before it, ascending, nulls first), ``n``
    (rows that hold it), ``total`` and ``nulls`` (rows and null rows of the group)."""
    ahead = "total - before - n" if s.descending else "before - nulls"      # rows with a value that come before
    if s.kind == "average_pct":
        return f"if(p.v IS NULL, NULL, ({ahead} + (n + 1) / 2.0D) / (total - nulls))"
    if s.kind == "ordinal":
        return f"if(p.v IS NULL, NULL, CAST({ahead} + 1 AS double))"
    at = f"if(p.v IS NULL, 0, {ahead} + nulls)" if s.nulls_lead else f"if(p.v IS NULL, total - nulls, {ahead})"
    return f"if(total > 1, ({at}) / (total - 1), 0.0D)"


def value_ranks(df: DataFrame, specs: list[RankSpec], keys: list[str], shared: str) -> DataFrame:
    """(place, rank, column number, hot): the rank of every distinct place; ordinals as doubles."""
    counted = value_histogram(df, [s.value for s in specs], keys, shared)
    hist = bucketed(counted, keys)
    totals = hist.groupBy("g", "b").agg(F.expr("sum(n) AS s"), F.expr("sum(if(p.v IS NULL, n, 0)) AS z")).selectExpr(
        "g", "b", "coalesce(sum(s) OVER (PARTITION BY g ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base",
        "sum(s) OVER (PARTITION BY g) AS total", "sum(z) OVER (PARTITION BY g) AS nulls")
    placed = hist.join(totals, ["g", "b"]).selectExpr(
        "p", "n", "total", "nulls", "base + sum(n) OVER (PARTITION BY g, b ORDER BY p) - n AS before")
    formulas = [_formula(s) for s in specs]
    rank = formulas[0] if len(set(formulas)) == 1 else (
        "CASE p.c " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(formulas)) + " END")
    rows = counted.groupBy(F.col("p.c").alias("_column")).agg(F.sum("n").alias("_rows"))     # one row for each column
    return placed.join(F.broadcast(rows), F.expr("p.c = _column")).selectExpr(
        "p AS _rk_place", f"{rank} AS _rk_rank", "p.c AS _rk_column", f"n * {HOT} > _rows AS _rk_hot")


def _lazy_parts(ranks: DataFrame):
    """The ranks of a column number, hot or not, as a function."""
    return lambda i, hot: ranks.filter(f"_rk_column = {i} AND {'' if hot else 'NOT '}_rk_hot")


def _stored_parts(ranks: DataFrame):
    """Like :func:`_lazy_parts` of ranks that are written now, a folder for each part; None for a part without rows."""
    stored = store_parts(ranks, ["_rk_column", "_rk_hot"])
    held = {tuple(r) for r in stored.select("_rk_column", "_rk_hot").distinct().collect()}   # two for each column at most
    parts = _lazy_parts(stored)
    return lambda i, hot: parts(i, hot) if (i, hot) in held else None


def _with_rank(df: DataFrame, number: int, keys: list[str], spec: RankSpec, shared: str, parts) -> DataFrame:
    """``df`` with the rank of one column: hot values by a broadcast join, the others by value.  A row of a hot value
    needs no other rank; there it carries a place that no value has, made from the row's hash."""
    hot, cold = parts(number, True), parts(number, False)
    kept = [f"`{c}`" for c in df.columns]
    place, rank = _place(number, keys, spec.value, shared), "CAST(NULL AS double)"
    if hot is not None:
        df = df.join(F.broadcast(hot.selectExpr("_rk_place AS _rk_hot_place", "_rk_rank AS _rk_hot_rank")),
                     F.expr(f"{place} = _rk_hot_place"), "left")
        rank = "_rk_hot_rank"
    if cold is not None:
        if hot is not None:
            salt = f"CAST(-1 - pmod(xxhash64({', '.join(kept)}), {1 << 30}) AS int)"
            fields = [("c", salt, str(number)), *[(f"k{j}", "NULL", f"`{k}`") for j, k in enumerate(keys)],
                      ("v", "NULL", f"CAST(`{spec.value}` AS {shared})")]
            place = f"struct({', '.join(f'if(_rk_hot_place IS NULL, {own}, {other}) AS {name}' for name, other, own in fields)})"
            rank = "if(_rk_hot_place IS NULL, _rk_cold_rank, _rk_hot_rank)"
        else:
            rank = "_rk_cold_rank"
        df = df.join(cold.selectExpr("_rk_place AS _rk_cold_place", "_rk_rank AS _rk_cold_rank"),
                     F.expr(f"{place} = _rk_cold_place"), "left")
    return df.selectExpr(*kept, f"CAST({rank} AS {'bigint' if spec.kind == 'ordinal' else 'double'}) AS `{spec.out}`")


def rank_columns(df: DataFrame, specs: list[RankSpec], partition_by: tuple | list = (),
                 split=_lazy_parts) -> DataFrame:
    """Add one exact rank column per spec, all ranked within ``partition_by``.

    percent:     ``percent_rank()`` over ``partitionBy(keys).orderBy(value)``
    average_pct: pandas ``groupby(keys)[value].rank(pct=True)`` (ties get
                 their mean rank, divided by the non-null count; nulls null)
    ordinal:     ``rank()`` (1-based; = ``row_number()`` for distinct values; nulls null)
    """
    keys = list(partition_by)
    families: dict[str, list[RankSpec]] = {}
    for s in specs:
        families.setdefault(_shared_type(df.schema[s.value].dataType), []).append(s)
    out = df
    for shared, members in families.items():
        parts = split(value_ranks(df, members, keys, shared))
        for i, s in enumerate(members):
            out = _with_rank(out, i, keys, s, shared, parts)
    return out.select(*df.columns, *[s.out for s in specs])


def rank_stored(df: DataFrame, specs: list[RankSpec], partition_by: tuple | list = ()) -> DataFrame:
    """:func:`rank_columns` of a stored copy of ``df``: the plan behind ``df`` runs once (now), and both branches of
    the ranks read the copy, also after an executor is lost.  The ranks of the distinct values are stored too."""
    return rank_columns(materialize(df), specs, partition_by, _stored_parts)


def percent_rank(df: DataFrame, value: str, out: str, *, descending: bool = False,
                 nulls_first: bool | None = None, partition_by: tuple | list = ()) -> DataFrame:
    """Exact ``percent_rank()`` of one column (see :func:`rank_columns`)."""
    return rank_columns(df, [RankSpec(value, out, "percent", descending, nulls_first)], partition_by)


def average_rank_pct(df: DataFrame, value: str, out: str, *, partition_by: tuple | list = (),
                     descending: bool = False) -> DataFrame:
    """pandas ``rank(pct=True)`` of one column within ``partition_by``."""
    return rank_columns(df, [RankSpec(value, out, "average_pct", descending)], partition_by)


def ordinal(df: DataFrame, value: str, out: str, *, partition_by: tuple | list = (),
            descending: bool = False) -> DataFrame:
    """1-based ``rank()`` by ``value`` as a long column."""
    return rank_columns(df, [RankSpec(value, out, "ordinal", descending)], partition_by)
