"""Quality rules with compression bands.

Each text is compressed with zstandard as a whole and in fixed chunks.  A
ratio (compressed bytes by raw bytes) far below what prose of that length
reaches means repetition; far above means random or encoded material.  Short
texts compress worse, so every length has its own limits.  Of the fixed chunks
the mean ratio has a narrow band, and each chunk by itself, the last part chunk
included, must lie in the band of a whole text of its length: a block of junk
that fills a chunk rejects a text of any length.

Beside the verdict the operator returns counts over words and lines, with the
base rules on them (too short, or mostly repeated three-word windows).
Work is one narrow pass over the texts in Arrow batches: no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, words_of

#: Fixed values: (least number of bytes, lowest ratio, highest ratio) of a whole text.  Below 64 bytes the
#: ratio is mostly frame overhead and says nothing.  The limits stand a few hundredths outside of what
#: labelled good prose in four languages reaches at that length.
WHOLE_BANDS = [(64, 0.60, 1.20), (128, 0.50, 0.98), (256, 0.48, 0.85), (512, 0.47, 0.76), (1024, 0.44, 0.68),
               (2048, 0.42, 0.62), (4096, 0.39, 0.58), (8192, 0.37, 0.56), (16384, 0.35, 0.55), (65536, 0.33, 0.55)]
#: Chunk length in bytes, then (least number of full chunks, lowest mean ratio, highest mean ratio).
#: A mean over more chunks varies less, so its band is narrower.
CHUNKS = {1024: [(1, 0.485, 0.68)], 2048: [(1, 0.455, 0.62), (2, 0.465, 0.60), (4, 0.472, 0.59)]}
#: Length in bytes of the chunks that are also judged one by one.
SINGLE = 1024
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = re.compile(rb"[#*$%&|<>]")

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("whole_ratio", pa.float64()), ("chunk_ratio", pa.float64()),
          ("base_failed", pa.bool_()), ("kept", pa.bool_())]
TYPE = ("struct<n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "whole_ratio double, chunk_ratio double, base_failed boolean, kept boolean>")


def code_points(text: bytes) -> int:
    """Code points of a UTF-8 text: bytes that do not continue a character."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, at, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(np.count_nonzero(covered))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def within(limits: list[tuple], amount: int, ratio: float) -> bool:
    """Whether the ratio lies in the band of the longest entry that applies."""
    band = next((b for b in reversed(limits) if amount >= b[0]), None)
    return band is None or band[1] <= ratio <= band[2]


def measure(text: bytes, press: zstandard.ZstdCompressor) -> tuple:
    words = words_of(text)
    n, size = len(words), len(text)
    repeated = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    whole = len(press.compress(text)) / size if size else None
    good, mean = whole is None or within(WHOLE_BANDS, size, whole), None
    for length, limits in CHUNKS.items():
        full = size // length
        if full:
            packed = [len(press.compress(text[at:at + length])) for at in range(0, full * length, length)]
            mean = sum(packed) / (full * length)
            good = good and within(limits, full, mean)
            if length == SINGLE:
                rest = text[full * length:]
                good = good and all(within(WHOLE_BANDS, length, n / length) for n in (min(packed), max(packed))) and (
                    not rest or within(WHOLE_BANDS, len(rest), len(press.compress(rest)) / len(rest)))
    return (n, code_points(b"".join(words)), len(SYMBOLS.findall(text)), duplicate_lines(text), repeated, whole, mean,
            base_failed, good and not base_failed)


def measured(column: pa.Array) -> pa.StructArray:
    press = zstandard.ZstdCompressor(level=LEVEL)
    rows = [measure(t, press) for at in range(0, len(column), 256) for t in utf8(column.slice(at, 256))]
    columns = list(zip(*rows)) if rows else [[] for _ in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)],
                                      [n for n, _ in FIELDS])


def quality(text: Column) -> Column:
    """Struct of counts, ratios and verdicts for a text column.

    Null and empty texts have no words, null ratios, and fail the base rules.
    ``chunk_ratio`` is the mean over full chunks of the longest length that
    fits (null if none fits)."""
    def run(column: pa.Array) -> pa.Array:
        return measured(column)

    return F.arrow_udf(run, TYPE)(text)


def quality_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id as ``doc_id`` and the measures.

    Repeated rows give repeated rows; an empty table gives no rows."""
    def run(batches):
        for batch in slices(batches, 512):
            out = measured(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.flatten()], ["doc_id", *[n for n, _ in FIELDS]])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, {TYPE[7:-1].replace(':', ' ')}")


def good_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the bands, unchanged."""
    return docs.filter(quality(F.col(f"`{text_col}`")).getField("kept"))
