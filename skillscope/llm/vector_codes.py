"""Vector compression to short codes, with exact nearest-entry search by
slicing and intersecting bitmasks.

Vectors become integers (``floor(1024 x)``) and are cut into equal parts; each
part is replaced by the number of the nearest entry of its codebook.  Codebooks
start as the parts of the first vectors and move to the floored means of what
is assigned to them, for a fixed number of rounds.

Nearest entries are found exactly.  On every dimension the entries are sorted by
coordinate, and a prefix mask (uint64 words, one bit an entry) says which
entries come before each place.  A radius around a vector is a range of places
on every dimension; two prefix masks differ in exactly the entries of a range,
and the AND over the dimensions leaves the entries in the box around the vector.
Whatever is nearer than the radius is in the box, so the best candidate is the
nearest entry once its distance is within the radius; otherwise the radius
becomes that distance (or doubles, if the box was empty) and the vector is
looked up again.

A round is one narrow pass over the vectors and one aggregate of at most
``parts * entries`` rows; only these sums and the codebooks (whose size does not
depend on the number of vectors) pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 2048
SALTS = 16      # parts of the rows of one label where their sum joins them


def largest(width: int) -> int:
    """Largest integer component: squared distances of ``width`` components stay below 2^62."""
    return int((2.0 ** 60 / max(width, 1)) ** 0.5)


def as_integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, cut at ``largest`` and padded with zeros to a multiple of PARTS."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)
    most = largest(width)
    out = np.zeros((n, -(-width // PARTS) * PARTS), np.int64)
    out[:, :width] = np.clip(np.floor(flat * SCALE), -most, most)
    return out


class SlicedBook:
    """The codebook of one part with the sorted coordinates and prefix masks of every dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.zeros((width, n + 1, -(-n // 64)), np.uint64)
        for d in range(width):
            own = np.zeros((n, bits.shape[2]), np.uint64)
            own[np.arange(n), order[:, d] // 64] = np.uint64(1) << (order[:, d] % 64).astype(np.uint64)
            bits[d, 1:] = np.bitwise_or.accumulate(own, axis=0)
        self.prefixes = bits
        # first radius: half of the entries have another entry this near
        squares = self._squares(entries, np.arange(n)) if n and width else np.zeros((n, n), np.int64)
        squares = squares + np.where(np.eye(n, dtype=bool), squares.max(initial=0), 0).astype(squares.dtype)
        self.radius = max(1, int(np.sqrt(np.median(squares.min(axis=1))))) if n > 1 else 1

    def _squares(self, x: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Exact squared distances to some entries: floats where they hold all integers involved."""
        c = self.entries[columns]
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
        if 4 * max(x.shape[1], 1) * most * most < 1 << 53:
            x, c = x.astype(np.float64), c.astype(np.float64)
            return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        # summed dimension by dimension, so that no product of all pairs and dimensions is held
        out = np.zeros((len(x), len(c)), np.int64)
        for d in range(x.shape[1]):
            out += (x[:, d, None] - c[None, :, d]) ** 2
        return out

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows, words) of the entries within ``radius`` of each row on every dimension."""
        masks = np.broadcast_to(self.prefixes[0, -1], (len(x), self.prefixes.shape[2])).copy()
        for d in range(x.shape[1]):
            below = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            upto = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            masks &= self.prefixes[d, upto] ^ self.prefixes[d, below]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; ties go to the lower entry."""
        n, k = len(x), len(self.entries)
        entry, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not x.shape[1]:
            return entry, error
        left, radius = np.arange(n), np.full(n, self.radius, np.int64)
        while len(left):
            masks = self.candidates(x[left], radius)
            among = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :k].astype(bool)
            columns = np.flatnonzero(among.any(axis=0))
            found = among.any(axis=1)
            if len(columns):
                squares = self._squares(x[left], columns)
                far = np.iinfo(np.int64).max if squares.dtype == np.int64 else np.inf
                squares = np.where(among[:, columns], squares, far)
                best = squares.argmin(axis=1)
                least = np.where(found, squares[np.arange(len(left)), best], 0).astype(np.int64)
                settled = found & (least <= radius * radius)
                entry[left[settled]] = columns[best[settled]]
                error[left[settled]] = least[settled]
                radius = np.where(found, np.ceil(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1, 2 * radius)
                left, radius = left[~settled], radius[~settled]
            else:
                radius = 2 * radius
        return entry, error


class Codebooks:
    """One codebook a part, as integer arrays (entries, width of a part)."""

    def __init__(self, books: list[np.ndarray], width: int):
        self.books, self.width = books, width

    def sliced(self) -> list[SlicedBook]:
        return [SlicedBook(b) for b in self.books]

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def complete_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite components only."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES,
        rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vectors``, which is read once a round (give a stored table).

    The first entries are the parts of the vectors with the ``entries`` smallest
    ids (nulls last; equal ids by their vectors).  The smallest id's vector sets
    the length; vectors of another length are left out.  None without vectors."""
    rows = complete_vectors(vectors, vector_col).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    rows = rows.filter(F.size("v") == width)
    seeds = as_integers(pa.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], pa.list_(pa.float64())), width)
    books = Codebooks(np.split(seeds, PARTS, axis=1), width)
    for _ in range(rounds):
        books = _moved(rows.select("v"), books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: means of what is assigned, rounded down; unused entries stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    part_width = books.books[0].shape[1]
    names = [f"s{i}" for i in range(part_width)]

    def sums(batches):
        sliced = shared.value.sliced()
        total = [np.zeros(b.shape, np.int64) for b in shared.value.books]
        count = [np.zeros(len(b), np.int64) for b in shared.value.books]
        # 2^62 is out of reach while a task holds fewer than 2^62 / largest rows: sums of larger tasks are sent in turns
        room = (1 << 62) // largest(shared.value.width)
        held = 0

        def out():
            for p, (t, n) in enumerate(zip(total, count)):
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used]),
                     *[pa.array(t[used, i]) for i in range(part_width)]], ["part", "entry", "n", *names])
                t[:], n[:] = 0, 0

        for batch in batches:
            for piece in slices([batch], BLOCK):
                x = as_integers(piece.column(0), shared.value.width)
                if held + len(x) > room:
                    yield from out()
                    held = 0
                held += len(x)
                for p, part in enumerate(np.split(x, PARTS, axis=1)):
                    entry, _ = sliced[p].nearest(part)
                    np.add.at(total[p], entry, part)
                    count[p] += np.bincount(entry, minlength=len(count[p]))
        yield from out()

    schema = "part int, entry int, n bigint" + "".join(f", {s} bigint" for s in names)
    found = rows.mapInArrow(sums, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names]).collect()
    moved = [b.copy() for b in books.books]
    for r in found:
        moved[r["part"]][r["entry"]] = [int(r[s]) // r["n"] for s in names]
    return Codebooks(moved, books.width)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every vector of the codebooks' length:
    two hex digits a part, and the squared distances summed over the parts.
    One narrow pass; nulls in the id and the label are kept."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = complete_vectors(vectors, vector_col).filter(F.size(f"`{vector_col}`") == books.width).select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def run(batches):
        sliced = shared.value.sliced()
        for batch in slices(batches, BLOCK):
            x = as_integers(batch.column(2), shared.value.width)
            found = [s.nearest(p) for s, p in zip(sliced, np.split(x, PARTS, axis=1))]
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([bytes(c).hex() for c in codes]), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every
    vector: fitted, encoded, and the errors summed over equal labels (nulls
    together; null where the sum leaves 64 bits).

    Rows without a vector, or with a null or non-finite component, are left
    out, and so are vectors of another length than the first one's.  Components
    are cut at ``largest`` (over 90,000 times the unit for 64 dimensions);
    lengths that 4 does not divide are padded with zeros.  Repeated rows count
    and stay; an empty table gives no rows; other columns are left out."""
    books = fit(vectors, id_col, vector_col)
    empty = Codebooks([np.zeros((1, 0), np.int64)] * PARTS, -1)
    codes = encode(vectors, books or empty, id_col, vector_col, label_col)
    if books is not None:
        codes = stored(codes, "vector-codes")
    salt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int")
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(
        F.struct(F.col("label")).alias("group"), "label_error",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = codes.select("*", F.struct(F.col("label")).alias("group"), salt.alias("salt"))
    return rows.join(sums, ["group", "salt"]).select(
        "vec_id", "label", "code", "error", "label_error", F.lit((books or empty).sha256()).alias("codebooks_sha256"))
