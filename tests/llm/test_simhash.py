import re
from collections import Counter

import numpy as np
import xxhash
from corpus_rows import ODD, documents

from skillscope.llm import queries, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fp, max_bits=4):
    label = list(range(len(fp)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= max_bits:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fp))]


def test_contract_on_real_and_odd_rows(spark, small):
    rows = [(r[0], r[1]) for r in ODD] + [(i + 100, t) for i, t in small]
    fp = [slow_fingerprint(t) for _, t in rows]
    group = slow_components(fp)
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f, least.get(g)) for (i, _), f, g in zip(rows, fp, group))
    got = simhash.near_duplicates(documents(spark, rows).repartition(3)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len({r.component_id for r in got}) < len({i for i, _ in rows})


def clusters(rng, n):
    base = rng.integers(0, 2 ** 63, max(1, n // 40), dtype=np.uint64)
    fp = base[rng.integers(0, len(base), n)]
    for _ in range(int(rng.integers(1, 9))):
        fp = fp ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(fp.astype(np.uint64))


def same_partition(a, b):
    return {frozenset(np.flatnonzero(a == x)) for x in set(a.tolist())} == {
        frozenset(np.flatnonzero(b == x)) for x in set(b.tolist())}


def test_index_finds_every_link_of_a_group():
    rng = np.random.default_rng(3)
    for _ in range(40):
        fp = clusters(rng, int(rng.integers(2, 700)))
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1))
        want = simhash.union(np.arange(len(fp)), i, j)
        assert same_partition(simhash.linked_labels(fp, 4), want)


def test_gray_rank_orders_by_gray_code():
    ranks = np.arange(256, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_split_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 16)
    fp = clusters(np.random.default_rng(5), 500)
    entries = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(4)
    found = simhash.links(entries).collect()
    index = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    got = simhash.union(np.arange(len(fp)), np.array([index[r.a] for r in found], int), np.array([index[r.b] for r in found], int))
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1))
    assert same_partition(got, simhash.union(np.arange(len(fp)), i, j))
    assert len(found) < 30 * len(fp)


def test_long_chains_are_one_component(spark):
    from skillscope.llm.components import components
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives_and_empty_table(spark, odd, none):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 2 not in ids                 # COPY under ids 1, 2, 2 and null
    assert ids[3] == 2 and 4 not in ids and 5 not in ids  # texts without words are near copies of each other
    assert simhash.near_duplicates(none).count() == 0


def test_query_renders_hex(spark):
    rows = queries.op8_simhash_gray(spark, "/root/testdata/sf0.001").collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in rows)


def test_one_document_of_each_group_stays_under_null_and_shared_ids(spark):
    texts = ["\n".join(" ".join(f"g{k}r{i}d{j}" for j in range(40)) for i in range(20)) for k in range(4)]
    near = [t + " another end" for t in texts]
    rows = [(1, texts[0]), (None, near[0]),                          # a null-id copy of a document with an id
            (None, texts[1]), (None, texts[1]), (None, near[1]),     # copies that all have no id
            (7, texts[0]), (7, texts[2]), (7, near[2]),              # id 7: a copy of 1, and two copies of each other
            (5, texts[3]), (6, near[3])]
    group = slow_components([slow_fingerprint(t) for _, t in rows])
    assert group == [0, 0, 2, 2, 2, 0, 6, 6, 8, 8]
    kept = sorted(((r.doc_id, texts.index(r.text) if r.text in texts else near.index(r.text))
                   for r in simhash.representatives(documents(spark, rows).repartition(3)).collect()), key=str)
    assert kept == [(1, 0), (5, 3), (7, 2), (None, 1)]
