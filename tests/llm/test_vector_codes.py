import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillscope.llm import vector_codes as vc


def brute(rows):
    """The contract with Python integers: rows of (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = len(kept[0][1]) // 4
    parts = [[v[p * w:(p + 1) * w] for p in range(4)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: kept[i][0])[:256]
    books = [[parts[i][p] for i in first] for p in range(4)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            at = {}
            for x in parts:
                at.setdefault(near(p, x[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(at[e]) for c in zip(*at[e])] if e in at else b for e, b in enumerate(books[p])]
    found = [[near(p, x[p]) for p in range(4)] for x in parts]
    error = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, y), e in zip(kept, error):
        sums[y] = sums.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, "".join("%02x" % e for _, e in f), e, sums[y], digest) for (i, _, y), f, e in zip(kept, found, error))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 5), st.sampled_from([3, 100, 2 ** 29]), st.integers(0, 2 ** 32 - 1))
def test_masks_find_the_nearest_entry_and_the_first_of_ties(k, width, spread, seed):
    rng = np.random.default_rng(seed)
    entries, x = (rng.integers(-spread, spread + 1, (n, width)) for n in (k, 50))
    entry, error = vc.SlicedBook(entries).nearest(x)
    squares = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert entry.tolist() == [min(range(k), key=lambda e: (row[e], e)) for row in squares]
    assert error.tolist() == [min(row) for row in squares]


def test_candidates_are_the_entries_in_the_box():
    rng = np.random.default_rng(1)
    entries, x, r = rng.integers(-50, 50, (130, 3)), rng.integers(-50, 50, (40, 3)), rng.integers(0, 60, 40)
    masks = vc.SlicedBook(entries).candidates(x, r)
    got = [[e for e in range(130) if int(m[e // 64]) >> (e % 64) & 1] for m in masks]
    assert got == [[e for e in range(130) if (abs(entries[e] - x[i]) <= r[i]).all()] for i in range(40)]


@pytest.mark.parametrize("n", [40, 400])
def test_query_equals_the_contract(spark, tmp_path, n):
    from skillscope.llm import queries
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)], None if i % 7 == 0 else int(i % 3))
            for i in rng.permutation(n)]
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 1), (-5, None, 1), (-4, [float("nan")] * 8, 1),
             (-3, [1.0, None] * 4, 1), (-2, [float("inf")] * 8, 2)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, code int")
    frame.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op11_vector_codes(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_odd_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, error string"
    assert vc.compressed(spark.createDataFrame([], schema)).count() == 0
    assert vc.compressed(spark.createDataFrame([(1, None, 1, "x")], schema)).count() == 0
    rows = [(1, [1.0] * 5, 1, "x"), (1, [1.0] * 5, 1, "x"), (None, [3e38] * 5, None, "x"), (2, [1.0], 1, "other length"),
            (None, [2.0] * 5, None, "x"), (3, [], 1, "x")]
    got = vc.compressed(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.code) for r in got if r.vec_id) == [(False, 1, "00000000")] * 2
    assert len(got) == 4 and all(r.error == 0 and r.label_error == 0 for r in got)
    only_empty = vc.compressed(spark.createDataFrame([(3, [], 1, "x"), (4, [], None, "x")], schema)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in only_empty) == [(3, "00000000", 0), (4, "00000000", 0)]
