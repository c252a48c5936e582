"""Runs of periodically repeated words, by online dyadic square catching.

Words are appended in order.  Whenever a block of ``2^k`` words that begins at a
multiple of ``2^k`` is complete, it becomes a catcher: for the periods of its
level it waits for its own words to come again.  Every appended word completes
one suffix of ``2^k`` words on each level, and that suffix is compared (by hash)
with the catchers that stand a period of the level before it.  A hit is a
candidate period; words are then compared one by one to the left of the catcher
and to the right of the suffix, which yields the whole stretch that keeps the
period.  A stretch that reaches the newest word stays open, and its comparison
goes on with the next words.  Squares of one period that overlap are thus one
stretch, and hits inside a known stretch of a divisor period are no news.

Level ``k`` serves the periods ``q`` whose least equal stretch, ``(e - 1) q``
words for a least exponent ``e``, holds a whole aligned block of ``2^k`` words
but not always one of ``2^(k+1)``.  So every run meets a catcher, each word is
compared with a few catchers on ``log2(n)`` levels, and hashes only nominate:
what is reported was compared word by word.

Work is one narrow pass over the texts; a text is held by one task, with hashes
for one slice of it and the tails that longer periods need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASE, mixed, slices, utf8, words_of

MIN_EXPONENT = 4
MIN_LENGTH = 6
SLICE = 1 << 16     # words appended at a time; any slicing gives the same runs

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = "struct<start: bigint, length: bigint, period: bigint>"


class _Level:
    """One level: its block length and periods, and the newest suffix hashes."""

    def __init__(self, k: int, factor: int):
        self.size = 1 << k
        self.low = -(-(2 * self.size - 1) // factor)
        self.high = -(-(4 * self.size - 1) // factor) - 1
        self.hashes = np.empty(0, np.uint64)    # of the blocks that begin at ``first`` and after
        self.first = 0

    def grow(self, fresh: np.ndarray) -> None:
        tail = 4 * self.size + self.high
        cut = max(len(self.hashes) - tail, 0)
        self.hashes = np.concatenate([self.hashes[cut:], fresh]) if len(self.hashes) else fresh
        self.first += cut

    def hits(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(catcher, suffix) begins of equal hashes, for suffixes that begin in [begin, end)."""
        if self.high < self.low or end <= max(begin, self.low):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(max(begin, self.low), end)
        nearest = (at - self.low) // self.size * self.size
        found = []
        for back in range(0, self.high - self.low + self.size, self.size):
            catcher = nearest - back
            ok = (catcher >= 0) & (at - catcher <= self.high)
            ok[ok] = self.hashes[at[ok] - self.first] == self.hashes[catcher[ok] - self.first]
            if ok.any():
                found.append((catcher[ok], at[ok]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([c for c, _ in found]), np.concatenate([a for _, a in found])


class SquareCatchers:
    """Online detection: ``append`` words (as integers), ask ``runs`` at any time."""

    def __init__(self, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH):
        if min_exponent < 2:
            raise ValueError("a run has at least exponent 2")
        self.min_exponent, self.min_length = min_exponent, min_length
        self.words = np.empty(16, np.int64)
        self.n = 0
        self.levels: list[_Level] = []
        self.stretches: list[tuple[int, int, int]] = []     # (start, end, period) of closed squares
        self.open: list[tuple[int, int, int]] = []          # those that reach the newest word

    def append(self, words) -> None:
        words = np.asarray(words, np.int64)
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:old], np.empty(self.n, np.int64)])
        self.words[old:self.n] = words
        waiting, self.open = self.open, []
        for start, end, period in waiting:
            self._keep(start, self._right(end, period), period)
        with np.errstate(over="ignore"):
            fresh = mixed((words.astype(np.uint64) + np.uint64(1)) * BASE)
        k = 0
        while True:
            if k == len(self.levels):
                self.levels.append(_Level(k, self.min_exponent - 1))
            level = self.levels[k]
            level.grow(fresh)
            begin, end = max(0, old - level.size + 1), self.n - level.size + 1
            self._catch(level, *level.hits(begin, end))
            # hashes of the next level for the blocks of twice the length that the new words complete
            wide = 2 * level.size
            if self.n < wide:
                return
            at = max(0, old - wide + 1) - level.first
            left, right = level.hashes[at:len(level.hashes) - level.size], level.hashes[at + level.size:]
            with np.errstate(over="ignore"):
                fresh = mixed(left * BASE ^ right)
            k += 1

    def _catch(self, level: _Level, catcher: np.ndarray, suffix: np.ndarray) -> None:
        if not len(catcher):
            return
        period = suffix - catcher
        order = np.lexsort((catcher, period))
        catcher, suffix, period = catcher[order], suffix[order], period[order]
        news = np.ones(len(period), bool)
        by_start = None
        for start, end, known in self.stretches + self.open:
            if end - start < level.low + level.size or end <= suffix.min():
                continue
            if by_start is None:
                by_start = np.argsort(catcher, kind="stable")
                begins = catcher[by_start]
            inside = by_start[np.searchsorted(begins, start):np.searchsorted(begins, end)]
            news[inside[(suffix[inside] + level.size <= end) & (period[inside] % known == 0)]] = False
        catcher, period = catcher[news], period[news]
        edges = np.flatnonzero(np.diff(period)) + 1
        for a, b in zip([0, *edges], [*edges, len(period)]):
            if a == b:
                continue
            q, at = int(period[a]), catcher[a:b]
            i = 0
            while i < len(at):
                end = self._right(int(at[i]) + q, q)
                if end - q < at[i] + level.size:      # equal hashes of different blocks
                    i += 1
                    continue
                self._keep(self._left(int(at[i]), q), end, q)
                i = int(np.searchsorted(at, end - q - level.size, "right"))

    def _keep(self, start: int, end: int, period: int) -> None:
        if end == self.n:
            self.open.append((start, end, period))
        elif end - start >= 2 * period:
            self.stretches.append((start, end, period))

    def _right(self, end: int, period: int) -> int:
        """Where the words stop to equal those a period before, from ``end`` on."""
        step = 16
        while end < self.n:
            upto = min(end + step, self.n)
            differs = self.words[end:upto] != self.words[end - period:upto - period]
            first = int(differs.argmax())
            if differs[first]:
                return end + first
            end, step = upto, step * 4
        return end

    def _left(self, start: int, period: int) -> int:
        """Begin of the words before ``start`` that equal those a period after."""
        step = 16
        while start > 0:
            downto = max(start - step, 0)
            differs = (self.words[downto:start] != self.words[downto + period:start + period])[::-1]
            first = int(differs.argmax())
            if differs[first]:
                return start - first
            start, step = downto, step * 4
        return start

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of the runs in all words so far, by start, then period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, period in self.stretches + self.open:
            if end - start >= max(self.min_length, self.min_exponent * period):
                least[start, end] = min(period, least.get((start, end), period))
        return sorted((s, e - s, q) for (s, e), q in least.items())


def runs_of(words: list[bytes], min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """The runs of one sequence of words."""
    if len(words) < max(min_length, min_exponent):
        return []
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return []
    caught = SquareCatchers(min_exponent, min_length)
    for at in range(0, len(ids), SLICE):
        caught.append(ids[at:at + SLICE])
    return caught.runs()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, compared exactly; ties go to the first in order."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of every run only its first period (words in two runs go if either drops them)."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def _run_array(rows: list) -> pa.Array:
    return pa.array([None if r is None else dict(zip(("start", "length", "period"), r)) for r in rows], RUN)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT,
                  min_length: int = MIN_LENGTH) -> DataFrame:
    """For each row: the id as ``doc_id``, ``n_words``, its ``runs`` (word
    numbers from 0, ordered by start, then period), the ``strongest`` run (null
    without any) and ``collapsed_text``.

    A run is a stretch of at least ``min_length`` words and ``min_exponent``
    times its smallest period that no neighbouring word extends.  Null, empty
    and blank texts have no words, no runs and an empty collapsed text; repeated
    rows give repeated rows; an empty table gives no rows; other columns are
    left out."""
    def run(batches):
        for batch in slices(batches, 64):
            texts = [words_of(t) for t in utf8(batch.column(1))]
            found = [runs_of(w, min_exponent, min_length) for w in texts]
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            out = [batch.column(0), pa.array(list(map(len, texts)), pa.int64()),
                   pa.ListArray.from_arrays(pa.array(sizes), _run_array([r for rs in found for r in rs])),
                   _run_array(list(map(strongest, found))),
                   pa.array(list(map(collapsed, texts, found)), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "strongest", "collapsed_text"])

    id_type = docs.select(f"`{id_col}`").dtypes[0][1]
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, runs array<{RUN_TYPE}>, strongest {RUN_TYPE}, collapsed_text string")
