from collections import Counter

import pytest

from skillscope.llm import sharding

NAMES = [f"s{i}" for i in range(9)]


def slow_table(names, size):
    """The published filling rule, slot lists written out in full."""
    import xxhash
    prefer = {}
    for n in names:
        offset, skip = xxhash.xxh64_intdigest(n, 1) % size, xxhash.xxh64_intdigest(n, 2) % (size - 1) + 1
        prefer[n] = [(offset + k * skip) % size for k in range(size)]
    owner = {}
    while len(owner) < size:
        for n in sorted(names):
            if len(owner) < size:
                slot = next(s for s in prefer[n] if s not in owner)
                owner[slot] = n
    return [owner[s] for s in range(size)]


def test_table_follows_the_rule_and_is_even():
    assert [NAMES[i] for i in sharding.lookup_table(NAMES, 131)] == slow_table(NAMES, 131)
    counts = Counter(sharding.lookup_table(NAMES, 1009))
    assert max(counts.values()) - min(counts.values()) <= 1
    # the order of the list does not matter
    assert [NAMES[::-1][i] for i in sharding.lookup_table(NAMES[::-1], 131)] == slow_table(NAMES, 131)


def test_weights_and_bad_input():
    counts = Counter(sharding.lookup_table(["a", "b"], 1009, {"a": 3.0, "b": 1.0}))
    assert abs(counts[0] / 1009 - 0.75) < 0.01
    for names, size, weights in ((["a", "a"], 11, None), ([], 11, None), (["a"], 12, None), (["a"], 11, {"a": 0})):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, size, weights)


def test_removing_a_shard_moves_little():
    before, after = sharding.lookup_table(NAMES, 10007), sharding.lookup_table(NAMES[:-1], 10007)
    moved = sum(a != b for a, b in zip(before, after) if b != 8 and a != 8)
    assert moved < 0.12 * 10007


def test_rows_are_placed_once_and_equal_keys_meet(odd, none, tmp_path):
    rows = sharding.assign(odd, ["doc_id"], NAMES, 1009).select("row.doc_id", "slot", "shard").collect()
    assert len(rows) == odd.count()
    place = {}
    for r in rows:
        assert place.setdefault(r.doc_id, (r.slot, r.shard)) == (r.slot, r.shard)
    table = sharding.lookup_table(NAMES, 1009)
    assert all(NAMES[table[r.slot]] == r.shard for r in rows)
    assert sharding.assign(none, ["doc_id"], NAMES, 1009).count() == 0
    path = str(tmp_path / "sharded")
    sharding.write_shards(sharding.assign(odd, ["doc_id"], NAMES, 1009), path)
    back = odd.sparkSession.read.parquet(path)
    assert back.count() == odd.count()
    assert {(r.doc_id, r._shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in rows}
