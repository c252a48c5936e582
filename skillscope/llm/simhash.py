"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints have 64 bits, the majority bits of the hashes of a text's word
shingles.  Two texts are linked when their fingerprints differ in at most
``max_bits`` bits; linked texts form components.

Search.  Equal fingerprints are one entry from the start.  With the bits cut
into ``max_bits + 2`` blocks, any two linked fingerprints agree in at least two
blocks, so entries meet in groups that share a pair of blocks (15 pairs with
the defaults, about 21 shared bits).  Inside a group the entries are sorted by
Gray rank, where neighbours differ in few bits, and indexed hierarchically: a
node keeps the bits that all entries below it share (as mask and pattern).  Two
nodes are compared on the bits both have shared; when these already differ in
more than ``max_bits`` places, everything below is pruned.  Differences
accumulate on the way down, because lower nodes share more bits.  Nodes whose
entries are all in one component already are not compared either, so a dense
group of near copies costs little and yields one link for each entry, never all
pairs.

Hot groups.  A group with more than ``SPLIT`` entries is dealt into parts, and
each pair of parts is a task of its own, so no task holds more than about
``2 * SPLIT`` entries.  Components are found by :mod:`.components`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8, words_of
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SPLIT = 4096    # entries of a group that one task compares with each other
FAN_OUT = 16    # children of an index node
SMALL = 32      # groups up to this size are compared directly, many at once


# ---- fingerprints -----------------------------------------------------------------------------
def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 values of the word shingles (repeats
    count); a text with fewer words is one shingle, one without words is 0."""
    words = words_of(text.lower())  # bytes.lower() changes A-Z only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = (end - length)[:n - shingle + 1].tolist()
    end = end[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(start), 65536):
        part = zip(start[at:at + 65536], end[at:at + 65536])
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 marked: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit
    number.  ``marked`` adds mark, the hash of the text."""
    mark = [F.xxhash64(F.col(f"`{text_col}`")).alias("mark")] * marked

    def run(batches):
        for batch in slices(batches, 512):
            fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]],
                                             ["doc_id", "fp", "mark"][:2 + marked])

    return docs.select(id_col, text_col, *mark).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, fp bigint" + ", mark bigint" * marked)


# ---- the index of one group ------------------------------------------------------------------
def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray code sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least index) after linking a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label = above


def index_levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first entry, AND, OR) of the nodes of each level, leaves' parents first."""
    levels, ones, any_, first = [], fp, fp, np.arange(len(fp))
    while len(first) > FAN_OUT or not levels:
        at = np.arange(0, len(first), FAN_OUT)
        ones, any_ = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at)
        first = first[at]
        levels.append((first, ones, any_))
    return levels


def linked_labels(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Component label of each fingerprint of one group (any order, distinct)."""
    order = np.argsort(gray_rank(fp), kind="stable")
    s = fp[order]
    label = np.arange(len(s))
    near = np.flatnonzero(np.bitwise_count(s[1:] ^ s[:-1]) <= max_bits)
    label = union(label, near, near + 1)
    levels = index_levels(s)
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        first, ones, any_ = levels[depth]
        below = len(levels[depth - 1][0]) if depth else len(s)
        kept = []
        for at in range(0, len(a), 1 << 14):
            x, y = a[at:at + (1 << 14)], b[at:at + (1 << 14)]
            shared = ~(ones[x] ^ any_[x]) & ~(ones[y] ^ any_[y])
            lo, hi = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
            joined = (lo[x] == hi[x]) & (lo[y] == hi[y]) & (lo[x] == lo[y])
            go = (np.bitwise_count((ones[x] ^ ones[y]) & shared) <= max_bits) & ~joined
            x, y = x[go], y[go]
            if not len(x):
                continue
            step = np.arange(FAN_OUT)
            shape = (len(x), FAN_OUT, FAN_OUT)
            p = np.broadcast_to((x[:, None] * FAN_OUT + step)[:, :, None], shape).ravel()
            q = np.broadcast_to((y[:, None] * FAN_OUT + step)[:, None, :], shape).ravel()
            ok = (p < below) & (q < below) & (p < q if not depth else p <= q)
            p, q = p[ok], q[ok]
            if depth:
                kept.append((p, q))
            else:
                hit = np.bitwise_count(s[p] ^ s[q]) <= max_bits
                label = union(label, p[hit], q[hit])
        if depth:
            a = np.concatenate([p for p, _ in kept]) if kept else np.empty(0, np.int64)
            b = np.concatenate([q for _, q in kept]) if kept else np.empty(0, np.int64)
    out = np.empty(len(s), np.int64)
    out[order] = order[label]
    return out


def group_links(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of all groups of a sorted run of rows (group number, fp)."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    label = np.arange(len(fp))
    small = np.repeat(size <= SMALL, size)
    for shift in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero(small[:-shift] & (group[:-shift] == group[shift:]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= max_bits]
        label = union(label, i, i + shift)
    for k in np.flatnonzero(size > SMALL):
        rows = slice(start[k], start[k] + size[k])
        label[rows] = start[k] + linked_labels(fp[rows], max_bits)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


# ---- all groups ------------------------------------------------------------------------------
def block_masks(max_bits: int) -> list[int]:
    """Masks (as signed numbers) of every pair of max_bits + 2 blocks of the 64 bits."""
    blocks = max_bits + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(block, 2))]


def links(entries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fp`` that join all pairs
    within ``max_bits`` bits into components (a spanning forest of each group)."""
    masks = block_masks(max_bits)
    keyed = entries.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared"))
        for i, m in enumerate(masks)])).alias("k")).select("k.t", "k.shared", "fp")
    # written first: mostly a handful of rows, and a plain shuffle whose hot groups can be split where there are many
    heavy = stored(keyed.groupBy("t", "shared").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT)
                   .select("t", "shared", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "heavy")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.least(part, other).alias("p"), F.greatest(part, other).alias("q")))
    whole = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    dealt = (keyed.join(heavy, ["t", "shared"], "left")
             .select("t", "shared", "fp", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(cells)).alias("c"))
             .select("t", "shared", "c.p", "c.q", "fp"))
    key = ["t", "shared", "p", "q"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table):
            columns = [rows.column(c).to_numpy() for c in key]
            change = np.zeros(rows.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            a, b = group_links(np.cumsum(change), rows.column("fp").to_numpy().view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def last_group(batch):
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in key:
                v = batch.column(c).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            return int(np.flatnonzero(change)[-1])

        for batch in batches:  # rows are sorted by group: the last group of a batch may go on in the next
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            cut = last_group(table.combine_chunks())
            if cut:
                yield done(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return (dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint").distinct())


def rooted(entries: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, root): the entries with the root of their component."""
    roots = components(links(entries.select("fp"), max_bits))
    return entries.join(roots, entries["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest
    id in the row's component.

    Null and empty texts have fingerprint 0 and are linked like any other;
    null ids take part but never name a component (a component of null ids
    alone has a null component_id); repeated rows give repeated results."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    entries = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    placed = rooted(entries, max_bits)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, unchanged: the one with the smallest id
    (null last), and of those that share it the one with the smallest text hash.

    A document is known by (id, text), so its repeated rows all stay; rows
    without an id are not known to be one document, so one of equal texts stays."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle, marked=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
    entries = stored(rows.groupBy("fp").agg(first.alias("least")), "entries")
    stay = stored(rooted(entries, max_bits).groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.doc_id").alias("_stays"), F.col("least.mark").alias("_mark")), "stay")
    mark = F.xxhash64(docs[f"`{text_col}`"])
    named, unnamed = stay.filter("_stays is not null"), stay.filter("_stays is null")
    kept = docs.join(named, (docs[f"`{id_col}`"] == named["_stays"]) & (mark == named["_mark"]), "left_semi")
    alone = docs.filter(docs[f"`{id_col}`"].isNull()).join(unnamed, mark == unnamed["_mark"], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    one = alone.groupBy(F.xxhash64(F.col(f"`{text_col}`"))).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
