"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. The n-grams of an item are its pairs of adjacent words; a document holds a
   pair where the two words follow each other within REACH words, so a foreign
   word between them hides nothing.  One pass over the corpus counts in how many
   documents each pair of the benchmark occurs (a bitmap of bounded size first
   says which pairs may be the benchmark's).
2. Each item keeps its rarest pairs as seeds, just so many that no copy can miss
   them (see ``bad_pairs``): an alignment that matches the asked share of the
   words leaves all but ``bad_pairs`` of the pairs in place.  A few more seeds
   than that are kept, and as many must be found, before a document and an item
   count as a candidate pair.  So common pairs seed only items that have nothing
   rarer, and no copy is lost.
3. A second pass reports the seeds of each document and the words around them,
   as far as an alignment of positive score can stretch for an item of that
   length.  Seeds and item texts are joined by ids and positions alone; an item's
   words are attached to the regions of the pairs that are left.  Equal items are
   one item until the end, when their ids are joined.
4. A region that holds fewer of the item's words than the similarity asks for
   goes before any alignment (this bound is exact).  Smith-Waterman alignment of
   words (match +2, mismatch and gap -1) scores the others: similarity is the
   share of the item's words that the best local alignment matches.

Words are lower-cased, with ASCII punctuation as white space.  A document may
match many items and an item any number of documents; no list is cut.

Defined results: null and empty texts and items with fewer than ``min_words``
words match nothing; rows and items are known by (id, text), so repeated rows
count as one, a null id is an id like any other, and items that share an id are
matched one by one; empty tables give no rows.  A similarity under 0.8 is
refused, because short items would have no pair that every copy keeps.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BASE_2, drop_stored, mixed, signed, slices, stored

MIN_WORDS = 3
SIMILARITY = 0.8
REACH = 8               # the second word of a pair stands at most so many words behind the first
BITMAP_BITS = 25        # the bitmap of the benchmark's pairs has 2 ** 25 bits: 4 MB, whatever the benchmark
LEVEL_BITS = 22         # the two tables of seed lengths have 2 ** 22 bytes each
LEVELS = 15             # seeds of items over 2 ** 14 words have the last level, which takes the whole document
CHUNK = 1 << 17          # bytes hashed, and words paired, at a time
#: A 64-bit value for every byte of a word; 0 for ASCII punctuation and white space, which part words.
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE_2)
_VALUES[list(string.punctuation.encode() + b"\x20\x09\x0a\x0b\x0c\x0d")] = 0
_UNIT = np.int64(1 << 20)                                   # score unit; matches are counted below it
_MATCH, _MISS, _GAP = 2 * _UNIT + 1, _UNIT, _UNIT


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x))]) for x in (BASE, inverse))


def text_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all texts, one after another, and each
    text's number of words.

    The hash of a word is a polynomial in BASE over its bytes' values, taken
    from running sums over a chunk, so no step runs word by word."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    up, down = powers(min(len(data), CHUNK))
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and _VALUES[data[end]]:         # a chunk ends where a word does
            parting = np.flatnonzero(_VALUES[data[end:end + CHUNK]] == 0)
            end = min(end + (int(parting[0]) if len(parting) else CHUNK), len(data))
        if end - at > len(up) - 1:
            up, down = powers(end - at)
        value = _VALUES[data[at:end]]
        inside = np.concatenate([[False], value != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, after = edges[::2], edges[1::2]
        value *= up[:len(value)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        hashes.append(mixed((sums[after] - sums[first]) * down[first]))
        starts.append(first + at)
        at = end
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def normal_hashes(text: str | None) -> np.ndarray:
    """Hashes of the normalised words of a text."""
    return text_words([text])[0]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text) with one row for each distinct document."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"),
                       F.col(f"`{text_col}`").alias("text"))


# ---- alignment -------------------------------------------------------------------------------
def align(items: list[np.ndarray], regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the matched words of the best local alignment, and the
    position in the region just after it.  Pairs are aligned side by side."""
    rows, cols = max(map(len, items)), max(map(len, regions))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.zeros((len(items), cols), np.uint64)
    real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, regions)):
        a[k, :len(x)], real_a[k, :len(x)] = x, True
        b[k, :len(y)], real_b[k, :len(y)] = y, True
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    above = np.zeros((len(items), cols + 1), np.int64)
    slope = np.arange(cols, dtype=np.int64) * _GAP
    for i in range(rows):
        same = (b == a[:, i:i + 1]) & real_b & real_a[:, i:i + 1]
        here = np.maximum(above[:, :-1] + np.where(same, _MATCH, -_MISS), above[:, 1:] - _GAP)
        np.maximum(here, 0, out=here)
        here = np.maximum(here, np.maximum.accumulate(here + slope, axis=1) - slope)
        at = here.argmax(1)
        top = here[np.arange(len(items)), at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
        above[:, 1:] = here
    return best % _UNIT, end


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of each (item, region), in bounded batches."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(pairs[order[at + n]][1]) <= 200_000:
            n += 1
        chosen = order[at:at + n]
        items, regions = [pairs[k][0] for k in chosen], [pairs[k][1] for k in chosen]
        matched, end = align(items, regions)
        # the same alignment read backwards from its end tells where it begins
        back = [r[:max(e, 1)][::-1] for r, e in zip(regions, end)]
        _, length = align([i[::-1] for i in items], back)
        for k, m, e, n_back in zip(chosen, matched.tolist(), end.tolist(), length.tolist()):
            out[k] = (m, e - n_back, e)
        at += n
    return out


# ---- seeds and regions -----------------------------------------------------------------------
def bad_pairs(words: int, similarity: float) -> int:
    """The most of an item's ``words - 1`` pairs that a copy may lack.

    Let the best alignment match m words.  Each of the other words breaks two
    pairs.  A pair that is whole but wider than REACH has at least REACH foreign
    words inside it, and a positive score bears at most 2 m - 1 of them."""
    least = math.ceil(similarity * words - 1e-9)
    return 2 * (words - least) + (2 * least - 1) // REACH


def needed_seeds(words: int, similarity: float) -> int:
    """How many of its seeds a copy must show; ``bad_pairs`` more are kept."""
    return max(1, (words - 1 - bad_pairs(words, similarity)) // 2)


def pair_hits(hashes: np.ndarray, n_words: np.ndarray, test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, texts, first positions) of the pairs that pass ``test``, by text, for
    texts of ``n_words`` words that stand one after another."""
    text = np.repeat(np.arange(len(n_words)), n_words)
    keys, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for begin in range(0, len(hashes), CHUNK):
        first = hashes[begin:begin + CHUNK] * BASE
        for apart in range(1, REACH + 1):
            second = hashes[begin + apart:begin + apart + CHUNK]
            key = first[:len(second)] + second
            found = np.flatnonzero(test(key))
            found = found[text[found + begin] == text[found + begin + apart]]
            keys.append(key[found])
            at.append(found + begin)
    keys, at = np.concatenate(keys), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    keys, at = keys[order], at[order]
    return keys, text[at], at - (np.cumsum(n_words) - n_words)[text[at]]


def regions_of(blocks: np.ndarray, item_words: int) -> list[tuple[int, int]]:
    """Word ranges of a document (before its bounds are applied) that hold every
    alignment of positive score through the seeds.  A block is a seed's diagonal
    (document position minus item position) divided by the item's words."""
    b = np.sort(blocks)
    groups = np.split(b, np.flatnonzero(np.diff(b) > 6) + 1)
    return [(int(g[0] - 2) * item_words, int(g[-1] + 4) * item_words) for g in groups]


def surroundings(at: np.ndarray, level: np.ndarray, doc_words: int) -> list[tuple[int, int]]:
    """Disjoint word ranges around seeds: every region of an item of at most
    ``2 ** level`` words lies in the range of its seeds."""
    reach = np.where(level >= LEVELS, doc_words, 4 * 2 ** level.astype(np.int64) + 2)
    order = np.argsort(at - reach, kind="stable")
    first, end = (at - reach)[order], np.maximum.accumulate((at + reach)[order])
    cut = np.flatnonzero(first[1:] > end[:-1]) + 1
    return [(max(0, int(first[a])), min(doc_words, int(end[b - 1]))) for a, b in zip([0, *cut], [*cut, len(at)])]


# ---- the join --------------------------------------------------------------------------------
def item_rows(items: DataFrame, min_words: int) -> DataFrame:
    """(item_mark, words) of the distinct items that are long enough, words as hashes."""
    def run(batches):
        for batch in slices(batches, 1000):
            words = [normal_hashes(t) for t in batch.column(1).to_pylist()]
            keep = np.array([len(w) >= min_words for w in words], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)),
                 pa.array([signed(w) for w, k in zip(words, keep) if k], pa.list_(pa.int64()))], ["item_mark", "words"])

    return items.select("mark", "text").distinct().mapInArrow(run, "item_mark bigint, words array<bigint>")


def item_pairs(items: DataFrame, similarity: float) -> DataFrame:
    """(item_mark, item_words, bad, need, key, item_at) of every pair of adjacent words."""
    def run(batches):
        for batch in slices(batches, 1000):
            for i, words in enumerate(batch.column(1)):
                w = words.values.to_numpy().view(np.uint64)
                with np.errstate(over="ignore"):
                    keys = w[:-1] * BASE + w[1:]
                n = len(keys)
                same = [pa.array(np.full(n, v, np.int32)) for v in
                        (len(w), bad_pairs(len(w), similarity), needed_seeds(len(w), similarity))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(n, i))), *same, pa.array(signed(keys)),
                     pa.array(np.arange(n), pa.int32())], ["item_mark", "item_words", "bad", "need", "key", "item_at"])

    return items.mapInArrow(run, "item_mark bigint, item_words int, bad int, need int, key bigint, item_at int")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bitmap of the keys' low bits; at most 2 ** BITMAP_BITS / 64 small rows reach the driver."""
    low = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = (keys.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
             .groupBy("w").agg(F.bit_or("bit").alias("bits"))).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def bits_set(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    low = (keys & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
    return bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1


def levels_of(seeds: DataFrame) -> list[np.ndarray]:
    """One table by the low bits of a key and one by bits of its upper half."""
    return [level_table(seeds, shift) for shift in (0, 32)]


def level_table(seeds: DataFrame, shift: int) -> np.ndarray:
    """For some bits of a key the highest level (binary logarithm of the item's words, rounded up) of the
    seeds with these bits, 0 for none.  Sixteen levels are packed to a row, so at most 2 ** LEVEL_BITS / 16 small rows
    reach the driver."""
    slot = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).alias("slot")
    level = F.least(F.ceil(F.log2("item_words")), F.lit(LEVELS)).cast("bigint").alias("level")
    packed = (seeds.select(slot, level).groupBy("slot").agg(F.max("level").alias("level"))
              .select(F.shiftright("slot", 4).alias("w"), F.expr("shiftleft(level, cast(4 * (slot & 15) as int))").alias("v"))
              .groupBy("w").agg(F.bit_or("v").alias("v"))).toPandas()
    out = np.zeros((1 << (LEVEL_BITS - 4), 16), np.uint8)
    values = packed["v"].to_numpy(np.int64).view(np.uint64)
    for k in range(16):
        out[packed["w"].to_numpy(np.int64), k] = values >> np.uint64(4 * k) & np.uint64(15)
    return out.ravel()


def level_at(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The level of each key, 0 where one of the tables shows that it is no seed."""
    mask = np.uint64((1 << LEVEL_BITS) - 1)
    out = levels[0][(keys & mask).astype(np.int64)]
    found = np.flatnonzero(out)
    out[found] = np.minimum(out[found], levels[1][(keys[found] >> np.uint64(32) & mask).astype(np.int64)])
    return out


def pair_counts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(key, n): in how many documents a pair whose bit is set occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in slices(batches, 256):
            keys, text, _ = pair_hits(*text_words(batch.column(0).to_pylist()), lambda k: bits_set(k, shared.value))
            by_text = np.lexsort((text, keys))
            keys, text = keys[by_text], text[by_text]
            again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (text[1:] == text[:-1])])[:len(keys)]
            keys, n = np.unique(keys[~again], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n, pa.int64())], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def rare_seeds(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The ``bad + need`` rarest pairs of each item, ties by hash and position."""
    order = Window.partitionBy("item_mark").orderBy(F.coalesce("n", F.lit(0)), F.xxhash64("key"), "item_at")
    return (pairs.join(counts, "key", "left").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= F.col("bad") + F.col("need")).select("item_mark", "item_words", "need", "key", "item_at"))


def seeded_documents(docs: DataFrame, levels: list[np.ndarray]) -> DataFrame:
    """(id, mark, seeds, parts) of documents with seeds: the seeds as (key,
    position), and the word hashes around them as (first word, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    seed = pa.struct([("key", pa.int64()), ("at", pa.int32())])
    part = pa.struct([("first", pa.int32()), ("words", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, 64):
            hashes, n_words = text_words(batch.column(2).to_pylist())
            keys, text, at = pair_hits(hashes, n_words, lambda k: level_at(k, shared.value))
            row, cuts = np.unique(text, return_index=True)
            seeds, parts, before = [], [], np.cumsum(n_words) - n_words
            for i, a, b in zip(row, cuts, [*cuts[1:], len(text)]):
                h, level = hashes[before[i]:before[i] + n_words[i]], level_at(keys[a:b], shared.value)
                seeds.append([{"key": k, "at": p} for k, p in zip(signed(keys[a:b]).tolist(), at[a:b].tolist())])
                parts.append([{"first": p, "words": signed(h[p:q])} for p, q in surroundings(at[a:b], level, len(h))])
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(seeds, pa.list_(seed)),
                 pa.array(parts, pa.list_(part))], ["id", "mark", "seeds", "parts"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, mark bigint, seeds array<struct<key: bigint, at: int>>, "
                                "parts array<struct<first: int, words: array<bigint>>>")


def region_rows(both: DataFrame) -> DataFrame:
    """(id, mark, item_mark, first, region) from rows of (id, mark, candidates, parts)."""
    def run(batches):
        for batch in slices(batches, 64):
            row, item, first, regions = [], [], [], []
            for i in range(batch.num_rows):
                near = [(p["first"].as_py(), p["words"].values.to_numpy()) for p in batch.column(3)[i]]
                starts = np.array([at for at, _ in near])
                for x in batch.column(2)[i]:
                    for a, b in regions_of(x["blocks"].values.to_numpy(), x["item_words"].as_py()):
                        at, h = near[int(np.searchsorted(starts, max(a, 0), "right")) - 1]
                        row.append(i)
                        item.append(x["item_mark"].as_py())
                        first.append(max(a, 0))
                        regions.append(h[max(a, 0) - at:b - at])
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(item, pa.int64()),
                 pa.array(first, pa.int32()), pa.array(regions, pa.list_(pa.int64()))],
                ["id", "mark", "item_mark", "first", "region"])

    return both.mapInArrow(run, f"id {dict(both.dtypes)['id']}, mark bigint, item_mark bigint, first int, region array<bigint>")


def scores(rows: DataFrame, similarity: float) -> DataFrame:
    """(id, mark, item_mark, similarity, first_word, end_word) from rows of
    (id, mark, item_mark, first, region, words)."""
    def run(batches):
        for batch in slices(batches, 256):
            row, pairs = [], []
            for i, (region, words) in enumerate(zip(batch.column(4), batch.column(5))):
                region, words = (x.values.to_numpy().view(np.uint64) for x in (region, words))
                # an alignment cannot match more of the item's words than occur in the region at all
                if np.isin(words, region).sum() >= similarity * len(words):
                    row.append(i)
                    pairs.append((words, region))
            if not pairs:
                continue
            m, a, e = (np.array(v) for v in zip(*aligned(pairs)))
            row = pa.array(row)
            first = batch.column(3).take(row).to_numpy()
            share = m / np.array([len(words) for words, _ in pairs])
            yield pa.RecordBatch.from_arrays(
                [*[c.take(row) for c in batch.columns[:3]], pa.array(share), pa.array(first + a, pa.int32()),
                 pa.array(first + e, pa.int32())], ["id", "mark", "item_mark", "similarity", "first_word", "end_word"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, mark bigint, item_mark bigint, similarity double, "
                                "first_word int, end_word int").filter(F.col("similarity") >= similarity)


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS,
                 similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, mark, item_id, similarity, first_word, end_word): the documents
    (mark is the hash of the text) and items whose best alignment matches at
    least ``similarity`` of the item's words, with the best region's place."""
    if similarity < 0.8 or min_words < 2:
        raise ValueError("similarity must be 0.8 or more, and items must have two words or more")
    rows, item_ids = keyed(docs, doc_id, doc_text), keyed(items, item_id, item_text)
    known = stored(item_rows(item_ids, min_words), "items")
    pairs = stored(item_pairs(known, similarity), "pairs")
    seeds = stored(rare_seeds(pairs, pair_counts(rows, bitmap_of(pairs))), "seeds")
    drop_stored(pairs)
    seeded = stored(seeded_documents(rows, levels_of(seeds)), "seeded")
    # ids, positions and counts only; a block stands for all diagonals of one item length
    block = F.floor((F.col("at") - F.col("item_at")) / F.col("item_words")).alias("block")
    candidates = (seeded.select("id", "mark", F.inline("seeds")).join(seeds, "key")
                  .groupBy("id", "mark", "item_mark", "item_words", "need")
                  .agg(F.collect_set(block).alias("blocks"), F.collect_set("item_at").alias("shown"))
                  .filter(F.size("shown") >= F.col("need")))
    wanted = stored(candidates.groupBy("id", "mark").agg(
        F.collect_list(F.struct("item_mark", "item_words", "blocks")).alias("candidates")), "wanted")
    # both sides grow with the corpus, so neither is ever broadcast
    same = seeded["id"].eqNullSafe(wanted["id"]) & (seeded["mark"] == wanted["mark"])
    both = seeded.join(wanted.hint("merge"), same).select(seeded["id"], seeded["mark"], "candidates", "parts")
    regions = region_rows(both).join(known, "item_mark").select("id", "mark", "item_mark", "first", "region", "words")
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("f"), "end_word"))
    found = scores(regions, similarity).groupBy("id", "mark", "item_mark").agg(best.alias("b"))
    ids = item_ids.select(F.col("id").alias("item_id"), F.col("mark").alias("item_mark")).distinct()
    return found.join(ids, "item_mark").select(F.col("id").alias("doc_id"), "mark", "item_id", "b.similarity",
                                               (-F.col("b.f")).alias("first_word"), "b.end_word")


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no item, unchanged."""
    leaks = stored(contaminated(docs, items, doc_id, doc_text, **options).select(
        F.col("doc_id").alias("_leak_id"), F.col("mark").alias("_leak_mark")).distinct(), "leaks")
    same = docs[f"`{doc_id}`"].eqNullSafe(leaks["_leak_id"]) & (F.xxhash64(docs[f"`{doc_text}`"]) == leaks["_leak_mark"])
    return docs.join(leaks, same, "left_anti")
