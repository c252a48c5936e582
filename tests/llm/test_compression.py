import os
import random
import re
import string
from collections import Counter

import zstandard
from corpus_rows import ODD, documents

from skillscope.llm import compression


def slow(text):
    """The counts, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def test_counts_match_a_word_by_word_version(spark, odd, small):
    rows = [(r[0], r[1]) for r in ODD] + small + [(100, "a b c a b c"), (101, "x x x x"), (102, "a | b # <c>\na | b # <c>\n\n ")]
    got = compression.quality_rows(documents(spark, rows)).collect()
    want = Counter((i, *slow(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_bands_reject_repetition_and_noise_but_keep_prose(spark, small):
    prose = next(t for _, t in small if t and 3000 < len(t) < 6000 and "|" not in t and "$" not in t
                 and "!!" not in t and len(set(t.split())) > 300)
    noise = " ".join(os.urandom(24).hex().translate(str.maketrans("012345", "ghijkl")) + "%c" % (33 + i % 90)
                     for i in range(200))
    rounds = "\n".join("the same sentence comes again and again with number %d" % (i % 7) for i in range(200))
    rows = {r.doc_id: r for r in compression.quality_rows(documents(spark, [(1, prose), (2, rounds), (3, noise)])).collect()}
    assert rows[1].kept
    assert not rows[2].kept and rows[2].whole_ratio < 0.1
    assert not rows[3].kept


def test_filter_keeps_columns_and_agrees_with_rows(odd, none):
    kept = compression.good_documents(odd)
    assert kept.columns == odd.columns
    want = Counter(r.doc_id for r in compression.quality_rows(odd).filter("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert compression.good_documents(none).count() == 0 and compression.quality_rows(none).count() == 0


def slow_verdict(text):
    """The bands, rule by rule, from the fixed values."""
    data = text.encode()
    ratio = lambda part: len(zstandard.ZstdCompressor(level=compression.LEVEL).compress(part)) / len(part)

    def in_band(limits, amount, value):
        fitting = [b for b in limits if b[0] <= amount]
        return not fitting or fitting[-1][1] <= value <= fitting[-1][2]

    if slow(text)[-1] or not in_band(compression.WHOLE_BANDS, len(data), ratio(data)):
        return False
    for length, limits in compression.CHUNKS.items():
        parts = [data[i:i + length] for i in range(0, len(data), length)]
        full = [ratio(p) for p in parts if len(p) == length]
        if full and not in_band(limits, len(full), sum(full) / len(full)):
            return False
        if full and length == 1024 and not all(in_band(compression.WHOLE_BANDS, len(p), ratio(p)) for p in parts):
            return False
    return True


def test_verdict_equals_the_bands_rule_by_rule(spark, small):
    rows = [(i, t) for i, t in small if t]
    got = {r.doc_id: r.kept for r in compression.quality_rows(documents(spark, rows)).collect()}
    assert got == {i: slow_verdict(t) for i, t in rows}
    assert 0 < sum(got.values()) < len(got)


def test_a_block_of_junk_rejects_a_text_of_any_length(spark, small):
    rng = random.Random(3)
    good = [t for _, t in small if t and len(t) > 1000 and t.isascii() and slow_verdict(t)]
    noise = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(3000))
    same = "the same line comes again and again\n" * 90
    rows, size = [], {}
    for k, length in enumerate((8_000, 20_000, 50_000, 100_000)):
        prose = ""
        while len(prose) < length:
            prose += good[rng.randrange(len(good))] + "\n"
        where = rng.randrange(length)
        rows += [(10 * k, prose), (10 * k + 1, prose[:where] + noise + prose[where:]), (10 * k + 2, prose + noise),
                 (10 * k + 3, prose[:where] + same + prose[where:])]
    got = {r.doc_id: r.kept for r in compression.quality_rows(documents(spark, rows)).collect()}
    assert not any(kept for i, kept in got.items() if i % 10) and any(kept for i, kept in got.items() if i % 10 == 0)
