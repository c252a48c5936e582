import hashlib
import re
from collections import Counter

from corpus_rows import ODD, documents

from skillscope.llm import line_chunks



WORD = re.compile(r"[^\x20\x09-\x0D]")


def cut(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    last = len(lines) - 1
    at = [i for i in range(len(lines)) if i in (0, last) or (
        WORD.search(lines[i]) and (h[i - 1] * line_chunks.ROLL + h[i]) % line_chunks.DIVISOR)]
    return [(a, lines[a:b + 1]) for a, b in zip(at, at[1:])]


def slow(rows):
    def counts(c):
        return sum(bool(WORD.search(x)) for x in c) > 1

    first = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for at, c in cut(t):
            if counts(c):
                first.setdefault(tuple(c), (i, t, at))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        gone = {at + k for at, c in cut(t) if counts(c) and first[tuple(c)] != (i, t, at) for k in range(len(c))}
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)))
    return out


def run(spark, rows):
    got = line_chunks.deduplicated(documents(spark, rows).repartition(4), removed_col="gone").collect()
    return Counter((r.doc_id, r.text, r.gone) for r in got)


def test_equals_brute_force(spark, small):
    rows = [(r[0], r[1]) for r in ODD] + [(i + 100, t) for i, t in small]
    want = slow(rows)
    assert run(spark, rows) == Counter(want)
    assert sum(g for *_, g in want) > 0


def test_shared_block_goes_wherever_it_stands(spark):
    block = [f"boilerplate line {i} with words" for i in range(12)]
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(i % 5 + 1)] + block + [f"tail {i}"])) for i in range(20)]
    got = {i: (t, g) for i, t, g in run(spark, rows)}
    assert got[0][1] == 0
    assert all(got[i][1] >= 4 for i in range(1, 20))          # at most the chunks at both ends differ
    assert all(f"tail {i}" in got[i][0] and f"own {i} 0" in got[i][0] for i in range(20))


def test_recall_by_length_of_the_shared_block(spark):
    """Pairs of texts with ten own lines on both sides of a block that both hold."""
    def own(*key):
        return [f"own line {j} of " + " ".join(map(str, key)) for j in range(10)]

    for size, least in ((2, 0.7), (3, 0.8), (4, 0.9), (6, 0.9), (12, 0.95)):
        rows = []
        for pair in range(150):
            block = [f"shared line {j} of block {pair} in {size}" for j in range(size)]
            rows += [(2 * pair + k, "\n".join(own(pair, k, "a") + block + own(pair, k, "z"))) for k in (0, 1)]
        got = {i: (t, g) for i, t, g in run(spark, rows)}
        assert all(got[2 * p] == (dict(rows)[2 * p], 0) for p in range(150))
        assert all(line in got[2 * p + 1][0].split("\n") for p in range(150) for side in "az" for line in own(p, 1, side))
        share = sum(got[2 * p + 1][1] for p in range(150)) / (150 * size)
        print(f"block of {size} lines: {share:.3f} removed")
        assert share >= least


def test_blocks_with_blank_lines_and_first_occurrences(spark):
    """Blank lines separate the lines of a block; one repeated line among blank ones is no block; every line keeps
    its first occurrence, with chunks that overlap and repeat inside a text."""
    block = "\n\n".join(f"paragraph {i} of the block" for i in range(8))
    rows = [(1, f"head\n\n{block}\n\ntail"), (2, f"other head\n\n{block}\n\nother tail"),
            (3, "a line\n\nown three"), (4, "a line\n\nown four"), (5, "\n".join(["same"] * 9 + ["x", "y"] * 5)),
            (6, "\n".join(["x", "y", "p", "q"])), (7, "\n".join(["p", "q", "r"])), (8, "\n".join(["q", "r", "same", "same"]))]
    got = {i: (t, g) for i, t, g in run(spark, rows)}
    assert got[2][1] >= 11 and got[2][0].startswith("other head") and got[2][0].endswith("other tail")
    assert [got[i] for i in (1, 3, 4)] == [(rows[0][1], 0), (rows[2][1], 0), (rows[3][1], 0)]
    assert Counter((i, *v) for i, v in got.items()) == Counter(slow(rows))
    left = {x for t, _ in got.values() for x in t.split("\n")}
    assert left >= {x for _, t in rows for x in t.split("\n")}


def test_columns_empty_table_and_no_python(spark, odd, none):
    out = line_chunks.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_chunks.deduplicated(none).count() == 0
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", out._jdf.queryExecution().executedPlan().toString())
