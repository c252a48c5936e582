"""Substring dedup by level-wise doubling of repeated word windows.

A window is a run of consecutive words of one document.  Only windows that are
repeated at one length are extended to twice that length, so each level looks
at what the level before left over:

* Level 1, half windows.  Of every run of ``min_words`` words the half window
  with the least hash is its seed (neighbouring runs share seeds, so about one
  position in fourteen is one).  Equal runs have equal seeds at equal offsets,
  so a seed found in one document only rules out all runs it stands for.
* Level 2, windows of ``min_words`` words around surviving seeds, known by 128
  hash bits.  Grouped by hash with partial aggregation, each yields the smallest
  document id it starts in; every other document loses the words it covers.
* For removal that is all: longer windows cover no further word.
  :func:`longest_repeats` goes on doubling until no candidate survives.

What travels is hashes and positions; the groups of a window that a third of
all documents share are pre-aggregated to one row for each task, and what goes
back to a document is the list of windows it holds first, never a row for each
pair of documents.

Defined results: null and empty texts have no words; a document without id
neither removes nor loses words; repeated rows (same id) do not remove from each
other, because neither id is smaller; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_2, column_as, drop_stored, signed, slices, stored, utf8, window_hashes, word_hashes, words_of

MIN_WORDS = 50


def seed_positions(half_hashes: np.ndarray, length: int, half: int) -> np.ndarray:
    """For each window of ``length`` words, the start of its seed: the half
    window inside it with the least hash, the leftmost of equals."""
    inside = length - half + 1
    view = np.lib.stride_tricks.sliding_window_view(half_hashes, inside)
    return view.argmin(1) + np.arange(len(view))


def candidates(hashes: np.ndarray, length: int, seeds: np.ndarray) -> np.ndarray:
    """Starts of the windows whose seed is in ``seeds``."""
    if len(hashes) < length:
        return np.empty(0, np.int64)
    half = length // 2
    return np.flatnonzero(np.isin(seed_positions(window_hashes(hashes, half), length, half), seeds))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column_as(docs, id_col, "doc_id"), column_as(docs, text_col, "text"))


def repeated_seeds(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, seeds): for each document the starts of the half windows that
    another document has too."""
    half = length // 2

    def run(batches):
        for batch in slices(batches, 256):
            ids, at, keys = [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                h = word_hashes(words_of(text))
                if len(h) < length:
                    continue
                w = window_hashes(h, half)
                seeds = np.unique(seed_positions(w, length, half))
                ids.append(np.full(len(seeds), i))
                at.append(seeds)
                keys.append(w[seeds])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(at), pa.int32()),
                     pa.array(signed(np.concatenate(keys)))], ["doc_id", "at", "key"])

    seeds = stored(rows.filter("doc_id is not null").mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, at int, key bigint"), "seeds")
    # written first, so that the join sees two plain shuffles and can split a seed that very many documents share
    shared = stored(seeds.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                    .filter("least <> most").select("key"), "shared")
    found = stored(seeds.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("seeds")),
                   "seeds")
    drop_stored(seeds)
    drop_stored(shared)
    return found


def window_rows(seeded: DataFrame, length: int) -> DataFrame:
    """(doc_id, k1, k2) of the candidate windows of (doc_id, text, seeds)."""
    def run(batches):
        for batch in slices(batches, 256):
            ids, k1, k2 = [], [], []
            for i, (text, seeds) in enumerate(zip(utf8(batch.column(1)), batch.column(2))):
                h = word_hashes(words_of(text))
                at = candidates(h, length, seeds.values.to_numpy())
                if not len(at):
                    continue
                both = np.unique(np.stack([window_hashes(h, length)[at], window_hashes(h, length, BASE_2)[at]]), axis=1)
                ids.append(np.full(both.shape[1], i))
                k1.append(both[0])
                k2.append(both[1])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(signed(np.concatenate(k1))),
                     pa.array(signed(np.concatenate(k2)))], ["doc_id", "k1", "k2"])

    return seeded.mapInArrow(run, f"doc_id {dict(seeded.dtypes)['doc_id']}, k1 bigint, k2 bigint")


def spans_of(covered: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return edge.reshape(-1, 2)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) of every row.

    ``spans`` lists the removed runs as (first word, end word), counted from 0
    in the input text; ``kept_text`` joins the other words by one space."""
    rows = texts(docs, id_col, text_col)
    known = rows.filter("doc_id is not null")
    seeds = repeated_seeds(rows, min_words)
    # the same join feeds the window rows and the result, so its shuffle of the texts is made once
    seeded = known.join(seeds, "doc_id", "left")
    first = (window_rows(seeded.filter("seeds is not null"), min_words).groupBy("k1", "k2")
             .agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("k1").alias("first")))
    parts = seeded.join(first, "doc_id", "left").unionByName(
        rows.filter("doc_id is null").select("*", F.lit(None).cast("array<int>").alias("seeds"),
                                             F.lit(None).cast("array<bigint>").alias("first")))

    def run(batches):
        for batch in slices(batches, 256):
            out = []
            for text, seeds, first in zip(utf8(batch.column(1)), batch.column(2), batch.column(3)):
                words = words_of(text)
                spans = np.empty((0, 2), np.int64)
                if seeds.is_valid:
                    h = word_hashes(words)
                    at = candidates(h, min_words, seeds.values.to_numpy())
                    held = first.values.to_numpy() if first.is_valid else np.empty(0, np.int64)
                    gone = at[~np.isin(signed(window_hashes(h, min_words)[at]), held)] if len(at) else at
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, gone, 1)
                    np.add.at(change, gone + min_words, -1)
                    spans = spans_of(np.cumsum(change[:-1]) > 0)
                kept, end = [], 0
                for a, b in spans.tolist():
                    kept += words[end:a]
                    end = b
                kept += words[end:]
                out.append((len(words), len(words) - len(kept), spans.tolist(), b" ".join(kept).decode("utf-8", "replace")))
            n, removed, spans, text = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(text, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return parts.select("doc_id", "text", "seeds", "first").mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_removed bigint, spans array<array<int>>, "
             "kept_text string")


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, longest): for each document that shares a window of
    ``min_words`` words with another, the longest length of the series
    min_words, 2 * min_words, 4 * min_words ... at which it still does.

    A window of twice the length is a candidate only if both its halves are
    repeated, so each level starts from the survivors of the one before and
    the loop ends when none are left."""
    rows = texts(docs, id_col, text_col).filter("doc_id is not null")
    id_type = dict(rows.dtypes)["doc_id"]
    length, result = min_words, None
    left = repeated_seeds(rows, min_words).withColumnRenamed("seeds", "at")
    while True:
        def run(batches, length=length, first=length == min_words):
            for batch in slices(batches, 256):
                for i, (text, at) in enumerate(zip(utf8(batch.column(1)), batch.column(2))):
                    h, at = word_hashes(words_of(text)), at.values.to_numpy()
                    at = candidates(h, length, at) if first else at[np.isin(at + length // 2, at)]
                    at = at[at + length <= len(h)]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(at, pa.int32()),
                             pa.array(signed(window_hashes(h, length)[at])),
                             pa.array(signed(window_hashes(h, length, BASE_2)[at]))], ["doc_id", "at", "k1", "k2"])

        windows = stored(rows.join(left, "doc_id").select("doc_id", "text", "at").mapInArrow(
            run, f"doc_id {id_type}, at int, k1 bigint, k2 bigint"), "windows")
        shared = (windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                  .filter("least <> most").select("k1", "k2"))
        left = stored(windows.join(shared, ["k1", "k2"], "left_semi").groupBy("doc_id")
                      .agg(F.collect_set("at").alias("at")), "windows")
        drop_stored(windows)
        level = left.select("doc_id", F.lit(length).alias("longest"))
        result = level if result is None else result.unionByName(level)
        if left.isEmpty():
            return result.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        length *= 2
