"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct pre-tokens of a batch of texts are concatenated into one code
point array.  A suffix array over its first ``longest piece`` characters is
built by prefix doubling; binary search then finds, for all pieces of the
vocabulary at once, the range of suffixes that begin with each piece, that is
every occurrence of every piece.  These edges are put in order of position (and
length), and relaxation merges symbols along them: in every pre-token the best
piece (by score, then leftmost) that joins two neighbouring symbols is applied,
until none is left.  This gives the ids of the model's own encoder.

Pre-tokens end where no piece can cross: at a space run after a word and at
line ends - checked against the vocabulary when it is loaded.  Ids of pre-tokens
already met by a task are kept in a table of bounded size, so frequent words
are matched once.  Texts are whole; batches bound what is held at a time.

The model (vocabulary, scores, byte pieces) is read once on the driver from its
public file and broadcast; its size is that of the vocabulary.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
SEPARATOR = 0x110000        # not a code point, so no text contains it
CHUNK = 200_000             # code points in one suffix array
TABLE_UNITS = 200_000       # pre-tokens a task remembers before it starts afresh
ROWS = 350                  # texts encoded at a time
LONG = 256                  # pre-tokens longer than this are relaxed with a heap
NONE = np.iinfo(np.int64).max


@dataclass
class PieceModel:
    """Vocabulary of a BPE model with byte fallback and identity normalisation."""

    chars: np.ndarray           # code points that are pieces by themselves, sorted
    char_ids: np.ndarray
    pieces: np.ndarray          # (n, longest) code points of longer pieces, 0-padded
    lengths: np.ndarray
    piece_ids: np.ndarray
    order: np.ndarray           # merge order of each longer piece: 0 is applied first
    byte_ids: np.ndarray        # id of each byte piece
    outputs: list[bytes]        # text of every id
    separable: bool             # no piece crosses a pre-token boundary
    dummy_prefix: bool


def load(path: str) -> PieceModel:
    """Read a SentencePiece model file (BPE, identity normaliser, byte fallback)."""
    from sentencepiece import sentencepiece_model_pb2 as format_
    proto = format_.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
    if trainer.model_type != 2 or not trainer.byte_fallback or normalizer.precompiled_charsmap or (
            normalizer.remove_extra_whitespaces):
        raise ValueError("only BPE models with byte fallback and an identity normaliser are supported")
    normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
    single = sorted((ord(p), i) for i, p, _ in normal if len(p) == 1)
    longer = [x for x in normal if len(x[1]) > 1]
    longest = max(len(p) for _, p, _ in longer)
    table = np.zeros((len(longer), longest), np.int64)
    for k, (_, p, _) in enumerate(longer):
        table[k, :len(p)] = [ord(c) for c in p]
    scores = -np.array([s for *_, s in longer])
    outputs, byte_ids = [], np.zeros(256, np.int32)
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            outputs.append(bytes([int(p.piece[3:5], 16)]))
        else:
            outputs.append(b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode())
    crosses = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n", re.S)
    return PieceModel(np.array([c for c, _ in single]), np.array([i for _, i in single], np.int32), table,
                      np.array([len(p) for _, p, _ in longer]), np.array([i for i, *_ in longer], np.int32),
                      np.unique(scores, return_inverse=True)[1], byte_ids, outputs,
                      not any(crosses.search(p) for _, p, _ in normal), normalizer.add_dummy_prefix)


# ---- matching --------------------------------------------------------------------------------
def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` with suffixes compared on their first ``depth`` (or more) entries."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    bits = int(rank.max()).bit_length()
    done = 62 // bits                       # entries that fit into one number are compared at once
    padded = np.concatenate([rank, np.zeros(done, np.int64)])
    key = np.zeros(len(rank), np.int64)
    for k in range(done):
        key = (key << bits) | padded[k:k + len(rank)]
    while True:
        order = np.argsort(key)
        if done >= min(depth, len(rank)):
            return order
        sorted_ = key[order]
        rank[order] = np.cumsum(np.r_[True, sorted_[1:] != sorted_[:-1]])
        key = rank * (len(rank) + 2)
        key[:-done] += rank[done:]
        done *= 2


def occurrences(text: np.ndarray, order: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [low, high) of the suffix array that begin with each longer
    piece, found for all pieces together, a few characters a time."""
    step = 3  # code points compared at once, packed into one number
    padded = np.concatenate([text, np.zeros(model.pieces.shape[1] + step, np.int64)])
    packed = (padded[:-2] << 42) + (padded[1:-1] << 21) + padded[2:]
    n = len(model.lengths)
    low, high = np.zeros(n, np.int64), np.full(n, len(text), np.int64)

    def search(k, target, depth):
        """First place in [low, high) whose packed characters at ``depth`` are not below target."""
        lo, hi = low[k].copy(), high[k].copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            below = packed[order[mid] + depth] < target[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]

    for depth in range(0, model.pieces.shape[1], step):
        k = np.flatnonzero((model.lengths > depth) & (low < high))
        if not len(k):
            break
        part = np.zeros((len(k), step), np.int64)
        width = min(step, model.pieces.shape[1] - depth)
        part[:, :width] = model.pieces[k, depth:depth + width]
        base = (part[:, 0] << 42) + (part[:, 1] << 21) + part[:, 2]
        left = np.minimum(model.lengths[k] - depth, step)
        span = np.int64(1) << (21 * (step - left))
        new_low = search(k, base, depth)
        new_high = search(k, base + span, depth)
        low[k], high[k] = new_low, new_high
    return low, high


def edges_by_position(text: np.ndarray, model: PieceModel) -> np.ndarray:
    """Table [length][position] of the piece (index + 1) that occurs there, 0 if none."""
    order = suffix_order(text, model.pieces.shape[1])
    low, high = occurrences(text, order, model)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    piece = np.repeat(found, count)
    start = np.repeat(low[found] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    table = np.zeros((model.pieces.shape[1] + 1, len(text)), np.int32)
    table[model.lengths[piece], order[start]] = piece + 1
    return table


# ---- relaxation ------------------------------------------------------------------------------
def relax(edges: np.ndarray, first: np.ndarray, size: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols (start, length) of the pre-tokens [first, first + size), in order of position."""
    merge = np.concatenate([[NONE >> 33], model.order])
    longest = model.pieces.shape[1]
    out_start, out_length = [], []
    long = size > LONG
    for a, n in zip(first[long].tolist(), size[long].tolist()):
        s = relax_long(edges, a, n, merge)
        out_start.append(s)
        out_length.append(np.diff(np.r_[s, a + n]))
    first, size = first[~long], size[~long]
    ends = first + size
    start = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]] if len(size) else first, size) + np.arange(size.sum())
    unit = np.repeat(np.arange(len(size)), size)
    while len(start):
        last = np.r_[unit[1:] != unit[:-1], True]
        follow = np.r_[start[1:], 0]
        follow[last] = ends[unit[last]]
        after = np.r_[follow[1:], 0]             # end of the next symbol
        length = np.where(last, 0, after - start)
        usable = np.flatnonzero((length > 1) & (length <= longest))
        best = np.full(len(start), NONE)
        best[usable] = (merge[edges[length[usable], start[usable]]] << 32) + np.arange(len(start))[usable]
        begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        least = np.minimum.reduceat(best, begin)
        ready = (least >> 32) >= (NONE >> 33)    # nothing left to merge in this pre-token
        span = np.diff(np.r_[begin, len(start)])
        finished = np.repeat(ready, span)
        out_start.append(start[finished])
        out_length.append((follow - start)[finished])
        keep = ~finished
        keep[(least[~ready] & 0xFFFFFFFF) + 1] = False   # the right symbol of the merged pair is gone
        start, unit = start[keep], unit[keep]
    starts, lengths = np.concatenate(out_start or [start]), np.concatenate(out_length or [start])
    order = np.argsort(starts, kind="stable")
    return starts[order], lengths[order]


def relax_long(edges: np.ndarray, first: int, size: int, merge: np.ndarray) -> np.ndarray:
    """The same merges for one long pre-token, with a heap of candidate pairs."""
    longest = edges.shape[0] - 1
    end = list(range(1, size + 1))          # end of the symbol that starts here
    before = list(range(-1, size - 1))      # start of the symbol before
    alive = [True] * size
    heap: list[tuple[int, int, int]] = []

    def offer(a):
        if end[a] < size:
            stop = end[end[a]]
            if stop - a <= longest:
                piece = edges[stop - a, first + a]
                if piece:
                    heapq.heappush(heap, (int(merge[piece]), a, stop))

    for a in range(size):
        offer(a)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if not alive[a] or end[a] >= size or end[end[a]] != stop:
            continue
        gone = end[a]
        alive[gone] = False
        end[a] = stop
        if stop < size:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return first + np.flatnonzero(np.array(alive, bool))


def encode_units(units: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens (concatenated) and the number of ids of each."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    first = np.cumsum(size + 1) - size - 1
    codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.full(int(size.sum()) + len(units), SEPARATOR, np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(units)), size)] = codes
    edges = edges_by_position(text, model)
    start, length = relax(edges, first, size, model)
    # ids of the symbols; characters outside the vocabulary become their bytes
    ids = np.full(len(start), -1, np.int32)
    many = length > 1
    ids[many] = model.piece_ids[edges[length[many], start[many]] - 1]
    one = np.flatnonzero(~many)
    at = np.minimum(np.searchsorted(model.chars, text[start[one]]), len(model.chars) - 1)
    known = model.chars[at] == text[start[one]]
    ids[one[known]] = model.char_ids[at[known]]
    owner = np.searchsorted(first, start, side="right") - 1
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        spelled = [model.byte_ids[list(chr(c).encode())] for c in text[start[unknown]].tolist()]
        width = np.ones(len(ids), np.int64)
        width[unknown] = [len(b) for b in spelled]
        ids, owner = np.repeat(ids, width), np.repeat(owner, width)
        ids[ids < 0] = np.concatenate(spelled)
    return ids, np.bincount(owner, minlength=len(units))


class Encoder:
    """Encodes batches of texts and remembers pre-tokens up to a bound."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.pattern = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n") if model.separable else None
        self.reset()

    def reset(self):
        self.index: dict[str, int] = {}
        self.ids, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, units: list[str]):
        """Encode new pre-tokens, a bounded number of code points a time."""
        at = 0
        while at < len(units):
            n, total = 0, 0
            while at + n < len(units) and (not n or total + len(units[at + n]) <= CHUNK):
                total += len(units[at + n]) + 1
                n += 1
            ids, size = encode_units(units[at:at + n], self.model)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            at += n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (concatenated) and the number of ids of each."""
        if len(self.index) > TABLE_UNITS:
            self.reset()
        parts = []
        for text in texts:
            text = text.replace(" ", SPACE)
            if text and self.model.dummy_prefix:
                text = SPACE + text
            parts.append(self.pattern.findall(text) if self.pattern else [text] if text else [])
        units = list(chain.from_iterable(parts))
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.learn(new)
        rows = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        size = self.size[rows]
        total = np.cumsum(size)
        flat = self.ids[np.repeat(self.first[rows] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        ends = np.r_[0, total][np.cumsum([len(p) for p in parts])] if parts else np.empty(0, np.int64)
        return flat, np.diff(np.r_[0, ends])


# ---- frames ----------------------------------------------------------------------------------
def encoded(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row.  Null and empty texts have no ids;
    repeated rows give repeated results; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pa.default_memory_pool().release_unused()  # a worker may come from an earlier stage
        encoder = Encoder(shared.value)
        for batch in slices(batches, ROWS):
            flat, size = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), ids],
                                             ["doc_id", "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids array<int>")


def text_of(ids: list[int], model: PieceModel) -> str:
    out = b"".join(map(model.outputs.__getitem__, ids)).decode("utf-8", "replace")
    return out[1:] if model.dummy_prefix and out.startswith(" ") else out


def decoded(tokens: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id lists; a null list gives a null text.  Raises
    IndexError for an id outside the vocabulary."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, ROWS):
            texts = [None if ids is None else text_of(ids, shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"doc_id {dict(tokens.dtypes)[id_col]}, text string")


def round_trips(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, exact): ids of every row, and whether decoding
    them gives the text back (a U+2581 in a text comes back as a space)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pa.default_memory_pool().release_unused()  # a worker may come from an earlier stage
        encoder = Encoder(shared.value)
        for batch in slices(batches, ROWS):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            flat, size = encoder.encode(texts)
            offset = np.r_[0, np.cumsum(size)]
            exact = [text_of(flat[a:b].tolist(), shared.value) == t.replace(SPACE, " ")
                     for t, a, b in zip(texts, offset, offset[1:])]
            ids = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), ids, pa.array(exact)],
                                             ["doc_id", "n_tokens", "ids", "exact"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids array<int>, exact boolean")
