import random

import numpy as np
from corpus_rows import ODD, documents

from skillscope.llm import decontamination as dc
from skillscope.llm import queries


def slow_align(a, b):
    """Best local alignment as (score, matches), cell by cell."""
    best = (0, 0)
    above = [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b, 1):
            d = above[j - 1]
            d = (d[0] + 2, d[1] + 1) if x == y else (d[0] - 1, d[1])
            cell = max(d, (above[j][0] - 1, above[j][1]), (row[-1][0] - 1, row[-1][1]))
            row.append(cell if cell[0] >= 0 else (0, 0))
        best = max(best, *row)
        above = row
    return best


def test_alignment_equals_cell_by_cell():
    rng = random.Random(4)
    pairs = [([rng.randint(0, 5) for _ in range(rng.randint(1, 20))], [rng.randint(0, 5) for _ in range(rng.randint(1, 30))])
             for _ in range(200)]
    got = dc.aligned([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    for (a, b), (m, first, end) in zip(pairs, got):
        assert m == slow_align(a, b)[1]
        assert 0 <= first <= end <= len(b)


def edited(words, share, rng):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append("swapped%d" % rng.randint(0, 99) if x < 2 * share / 3 else w)
        if 2 * share / 3 <= x < share:
            out.append("added%d" % rng.randint(0, 99))
    return out


def test_edited_copies_are_caught_and_clean_documents_left_alone(spark, small):
    rng = random.Random(8)
    items = [(k, " ".join("t%dq%d" % (k, rng.randint(0, 10 ** 6)) for _ in range(40))) for k in range(30)]
    clean = [(i + 1000, t) for i, t in small]
    rows, want = list(clean), set()
    for k, text in items:
        for n, share in enumerate((0, 0.1, 0.15)):
            host = "before , words. " * rng.randint(0, 30)
            rows.append((10 * k + n, host + "!! ".join(edited(text.upper().split(), share, rng)) + " and after"))
            want.add((10 * k + n, k))
    items.append((99, "too short"))
    frame = spark.createDataFrame(items + [(None, None)], "item_id long, text string")
    got = dc.contaminated(documents(spark, rows), frame).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity >= 0.8 and r.end_word - r.first_word >= 32 for r in got)
    kept = dc.clean_documents(documents(spark, rows), frame)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in clean}


def test_query_finds_every_embedded_item(spark):
    sf = "/root/testdata/sf0.01"
    tidy = lambda t: " ".join((t or "").lower().translate(str.maketrans({c: " " for c in __import__("string").punctuation})).split())
    docs = [(r.doc_id, f" {tidy(r.text)} ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, f" {tidy(r.text)} ") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op4_rare_seed_alignment(spark, sf).collect()}
    assert exact and exact <= {k for k, s in got.items() if s == 1.0}


def test_an_item_in_a_third_of_all_documents_keeps_its_seeds(spark):
    passage = " ".join(f"hot{i}" for i in range(30))
    rows = [(i, f"d{i} " * 20 + (passage if i % 3 == 0 else "")) for i in range(300)]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = dc.contaminated(documents(spark, rows), items).collect()
    assert {r.doc_id for r in got} == set(range(0, 300, 3))


def test_odd_rows_and_empty_tables(spark, odd, none):
    text = ODD[0][1]
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, "é ü 漢字 😀 tab")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(odd, items).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (10, None)}
    kept = dc.clean_documents(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert dc.contaminated(none, items).count() == 0
    assert dc.contaminated(odd, items.limit(0)).count() == 0


def test_equally_edited_copies_beside_an_exact_one_are_all_found(spark):
    passage = [f"p{i}" for i in range(40)]
    swapped = " ".join(f"other{i}" if i % 5 == 4 else w for i, w in enumerate(passage))
    longer = " ".join(w + " added" if i % 3 == 2 else w for i, w in enumerate(passage))
    rows = [(0, " ".join(passage))] + [(i, f"d{i} {swapped}") for i in range(1, 7)] + [(i, f"d{i} {longer}") for i in range(7, 13)]
    rows += [(i, f"d{i} " * 20) for i in range(13, 60)]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in dc.contaminated(documents(spark, rows), items).collect()}
    assert got == {0: 1.0, **{i: 0.8 for i in range(1, 7)}, **{i: 1.0 for i in range(7, 13)}}


def test_items_without_an_id_and_items_that_share_one_are_matched(spark):
    texts = [" ".join(f"i{k}w{j}" for j in range(20)) for k in range(4)]
    rows = [(k, f"before {t} after") for k, t in enumerate(texts)] + [(9, "nothing of it")]
    items = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in dc.contaminated(documents(spark, rows), items).collect())
    assert got == [(0, None, 1.0), (1, None, 1.0), (2, 7, 1.0), (3, 7, 1.0)]
    assert [r.doc_id for r in dc.clean_documents(documents(spark, rows), items).collect()] == [9]


def test_copies_without_an_intact_ngram_are_found(spark):
    passage = [f"p{i}" for i in range(40)]
    spread = " ".join(w + (f" foreign{i}" if i % 2 else "") for i, w in enumerate(passage))
    five = [f"q{i}" for i in range(5)]
    third = " ".join("other" if i == 2 else w for i, w in enumerate(five))
    rows = [(1, f"own words {spread} and more"), (2, f"own words {third} and more"), (3, "own words and more")]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(five))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(documents(spark, rows), items).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 0.8}


def test_no_copy_can_lack_all_seeds():
    for n in range(2, 3000):
        for similarity in (0.8, 0.85, 0.9, 1.0):
            assert dc.bad_pairs(n, similarity) + dc.needed_seeds(n, similarity) <= n - 1


def test_equals_whole_text_alignment(spark):
    """Few distinct words, so seeds are anything but rare, and all kinds of edits."""
    rng = random.Random(11)
    word = lambda: f"v{min(rng.randint(0, 60), rng.randint(0, 60))}"
    items = [(k, [word() for _ in range(rng.choice((3, 4, 5, 6, 7, 9, 12, 20, 33)))]) for k in range(40)]
    rows = []
    for k, words in items:
        for n, share in enumerate((0, 0.1, 0.2, 0.3, 0.5)):
            copy = edited(words, share, rng) if n < 4 else [x for w in words for x in [w, *["foreign"] * rng.randint(0, 2)]]
            rows.append((10 * k + n, [word() for _ in range(rng.randint(0, 80))] + copy + [word() for _ in range(rng.randint(0, 80))]))
    want = {(i, k) for i, t in rows for k, words in items if slow_align(words, t)[1] >= 0.8 * len(words)}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = dc.contaminated(documents(spark, [(i, " ".join(t)) for i, t in rows]), frame).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got} and len(want) > 150
    texts, known = dict(rows), dict(items)
    for r in got:                                         # what else is found is an alignment inside the document, too
        part = texts[r.doc_id][r.first_word:r.end_word]
        assert slow_align(known[r.item_id], part)[1] >= 0.8 * len(known[r.item_id])


def test_a_pair_that_all_items_and_documents_share_is_no_seed(spark):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(15)) + " common phrase " +
                                    " ".join(f"i{k}v{j}" for j in range(15))) for k in range(200)], "item_id long, text string")
    docs = documents(spark, [(i, f"d{i} says a common phrase again") for i in range(300)])
    pairs = dc.item_pairs(dc.item_rows(dc.keyed(items, "item_id", "text"), 3), 0.8)
    rows = dc.keyed(docs, "doc_id", "text")
    seeds = dc.rare_seeds(pairs, dc.pair_counts(rows, dc.bitmap_of(pairs)))
    hits = dc.seeded_documents(rows, dc.levels_of(seeds)).selectExpr("inline(seeds)")
    assert hits.join(seeds, "key").count() == 0           # (the table of levels may report a few accidental keys)
    assert dc.contaminated(docs, items).count() == 0
