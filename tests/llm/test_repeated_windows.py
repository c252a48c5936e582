import hashlib
import re
from collections import Counter

import numpy as np
from corpus_rows import ODD, documents

from skillscope.llm import common, queries
from skillscope.llm import repeated_windows as rw


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow(rows, length):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p:p + length]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p:p + length])] < i:
                gone[p:p + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def got(spark, rows, length):
    return Counter(tuple(r) for r in rw.without_repeats(documents(spark, rows).repartition(4), min_words=length).select(
        "doc_id", "n_words", "n_removed", "kept_text").collect())


def test_contract_on_real_and_odd_rows(spark, small):
    rows = [(r[0], r[1]) for r in ODD] + [(i + 100, t) for i, t in small]
    want = slow(rows, 50)
    assert got(spark, rows, 50) == Counter(want)
    assert sum(r[2] for r in want) > 1000


def test_short_windows_and_small_alphabets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("abc"), int(rng.integers(0, 60))))) for i in range(60)]
    for length in (6, 7):
        assert got(spark, rows, length) == Counter(slow(rows, length))


def test_exactly_fifty_words_count_and_forty_nine_do_not(spark):
    passage = [f"p{i}" for i in range(50)]
    rows = [(1, " ".join(["x"] * 3 + passage)), (2, "a " + " ".join(passage) + " b"), (3, "c " + " ".join(passage[:49]) + " d")]
    found = {r[0]: r for r in got(spark, rows, 50)}
    assert found[2] == (2, 52, 50, "a b") and found[3][2] == 0 and found[1][2] == 0


def test_query_digest(spark):
    rows = queries.op5_repeated_windows(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in slow([(r.doc_id, r.text) for r in texts], 50)}
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want


def test_doubling_goes_on_until_nothing_is_left(spark, none):
    run = [f"r{i}" for i in range(45)]
    rows = [(1, " ".join(run)), (2, "z " + " ".join(run)), (3, " ".join(run[:12])), (4, "nothing shared at all " * 5)]
    found = {r.doc_id: r.longest for r in rw.longest_repeats(documents(spark, rows), min_words=10).collect()}
    assert found == {1: 40, 2: 40, 3: 10}
    assert rw.without_repeats(none).count() == 0 and rw.longest_repeats(none).count() == 0


def test_window_hashes_are_equal_only_for_equal_windows():
    h = np.random.default_rng(1).integers(0, 2 ** 63, 40, dtype=np.uint64)
    h = np.concatenate([h, h])
    for length in (1, 2, 3, 25, 40, 50):
        w = common.window_hashes(h, length)
        assert len(w) == 81 - length
        assert (w[:41 - length] == w[40:81 - length]).all() if length <= 40 else True
        assert len(set(w.tolist())) == min(40, 81 - length)
    assert len(common.window_hashes(h, 81)) == 0
