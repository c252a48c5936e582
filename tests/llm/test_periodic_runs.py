import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_rows import ODD, documents
from skillscope.llm import periodic_runs as pr


def brute(words, exponent=4, least=6):
    """Runs straight from the definition: for each period the maximal equal stretches, then the smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    """The query's row from the contract."""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=12),
       st.sampled_from([(2, 2), (2, 5), (3, 6), (4, 6)]), st.integers(1, 7))
def test_any_slicing_gives_the_runs_of_the_definition(parts, limits, step):
    words = [w for part, times in parts for w in part * times]
    want = brute(words, *limits)
    assert pr.runs_of([b"%d" % w for w in words], *limits) == want
    online = pr.SquareCatchers(*limits)
    for at in range(0, len(words), step):
        online.append(words[at:at + step])
        assert online.n == min(at + step, len(words))
    assert online.runs() == want


def test_runs_so_far_are_known_after_every_word():
    words = [0, 1, 2, 1, 2, 1, 2, 1, 2, 3, 3, 3, 3, 3, 3, 0]
    online = pr.SquareCatchers()
    for i, w in enumerate(words):
        online.append([w])
        assert online.runs() == brute(words[:i + 1])


@pytest.mark.parametrize("slice_words", [1 << 16, 300])
def test_long_periods_and_long_runs(monkeypatch, slice_words):
    monkeypatch.setattr(pr, "SLICE", slice_words)
    rng = np.random.default_rng(5)
    unit = [b"u%d" % i for i in rng.integers(0, 50, 700)]
    words = [b"x"] * 3000 + unit * 5 + unit[:123] + [b"y", b"z"] * 900 + [b"w%d" % i for i in rng.integers(0, 9, 2000)]
    assert pr.runs_of(words) == brute(words)


def test_strongest_is_exact_and_ties_go_to_the_first():
    assert pr.strongest([]) is None
    assert pr.strongest([(0, 9, 2), (20, 18, 4), (50, 10, 2), (70, 5, 1)]) == (50, 10, 2)


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_words, r.collapsed_text) for r in pr.periodic_runs(odd).collect()}
    assert (None, 0, "") in got and (3, 0, "") in got and (5, 0, "") in got and (8, 1, "one") in got
    assert pr.periodic_runs(odd).count() == len(ODD) and pr.periodic_runs(none).count() == 0
    assert odd.columns[2] == "id" and pr.periodic_runs(odd).columns == [
        "doc_id", "n_words", "runs", "strongest", "collapsed_text"]


def test_query_equals_the_contract(spark, tmp_path):
    from skillscope.llm import queries
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text[:3000]) for r in source] + [(i, "a b " * i + "c") for i in range(500, 560)]
    rows += [(None, "a " * 30), (7, None), (8, ""), (9, " \n\t "), (9, " \n\t "), (10 ** 12, "é é é é é é é")]
    documents(spark, [(*r, 0) for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, (tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, (brute_row(*r) for r in rows)))
