"""Quality classifier by nearest-neighbour voting in a latent space.

Texts become hashed term counts: byte pairs (letters, case, punctuation and
their mixture, in any language) and a few repetition terms (words equal to the
one before, words and three-word windows seen before in the text).  Damped
counts times inverse document frequency are projected to ``DIMENSIONS``
latent dimensions by a truncated singular value decomposition (latent
semantic analysis).

Document frequencies are counted over all documents.  Fitting uses a bounded
sample of the labelled documents: the ``max_labelled`` with the smallest hash of
their id.  So the projection and the labelled vectors, which are broadcast, have a
fixed largest size (under 2 MB with the defaults) however large the corpus is.  Every document is then compared with *all*
labelled vectors: blocks of documents times the labelled matrix give exact
cosines, and the ``neighbours`` nearest vote with their label, weighted by
similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, words_of

BUCKETS = 2048          # hashed byte-pair terms
EXTRA = 4               # number of words, then three repetition terms
REPEAT_WEIGHT = 30      # of a repetition term that all words or lines share; byte-pair terms weigh about 1 each
DIMENSIONS = 32
NEIGHBOURS = 9
MAX_LABELLED = 4096     # documented bound of the sample that is fitted
SHARPNESS = 4           # votes weigh as similarity to this power
BLOCK = 256             # documents in a block of cosine products

#: Bucket of every byte pair (multiplicative hash of the pair).
_PAIR_BUCKET = ((np.arange(65536, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(11)) % BUCKETS).astype(np.int64)


def term_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed terms of one text (float32, length BUCKETS + EXTRA)."""
    counts = np.zeros(BUCKETS + EXTRA, np.float32)
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(b) > 1:
        counts[:BUCKETS] = np.bincount(_PAIR_BUCKET[b[:-1] * 256 + b[1:]], minlength=BUCKETS)
    words = words_of(text)
    if words:
        counts[BUCKETS] = len(words)
        counts[BUCKETS + 1] = sum(map(bytes.__eq__, words, words[1:]))
        counts[BUCKETS + 2] = len(words) - len(set(words))
        counts[BUCKETS + 3] = len(words) - 2 - len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 0
    return counts


def damped(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log-damped relative counts times idf, scaled to length one.

    Counts are taken for a thousand bytes, so long texts are not set apart by
    their length alone; repetition terms are shares of the words.  A text
    without terms keeps the zero vector."""
    pairs, extra = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weighted = np.zeros_like(counts)
    weighted[:, :BUCKETS] = np.log1p(pairs * (1000 / np.maximum(pairs.sum(1, keepdims=True), 100))) * idf[:BUCKETS]
    weighted[:, BUCKETS + 1:] = REPEAT_WEIGHT * extra[:, 1:] / np.maximum(extra[:, :1], 10)
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def counted(rows: DataFrame) -> DataFrame:
    """Term counts as sparse arrays of the rows (id, text, label)."""
    def run(batches):
        for batch in slices(batches, 256):
            found = [term_counts(t) for t in utf8(batch.column(1))]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            out = [batch.column(0), pa.array(at, pa.list_(pa.int32())),
                   pa.array([c[i] for c, i in zip(found, at)], pa.list_(pa.float32())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(out, ["id", "at", "n", "label"])

    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, at array<int>, n array<float>, label int")


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each hashed term.

    Each task sends one row for each term, so one aggregate of a fixed number of
    terms reaches the driver."""
    def run(batches):
        total, n = np.zeros(BUCKETS + EXTRA, np.int64), 0
        for batch in slices(batches, 256):
            for text in utf8(batch.column(0)):
                total += term_counts(text) > 0
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()),
                                          pa.array(np.concatenate([[n], total]))], ["term", "n"])

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + EXTRA, np.int64)
    n_docs = 0
    for r in found:
        if r["term"] < 0:
            n_docs = r["n"]
        else:
            out[r["term"]] = r["n"]
    return n_docs, out


class NoLabels(ValueError):
    """There is no labelled document to fit on."""


class NeighbourModel:
    """The fitted model: idf, projection, labelled latent vectors and labels."""

    def __init__(self, idf, basis, vectors, labels, neighbours):
        self.idf, self.basis, self.vectors, self.labels, self.neighbours = idf, basis, vectors, labels, neighbours

    def latent(self, counts: np.ndarray) -> np.ndarray:
        low = damped(counts, self.idf) @ self.basis
        return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled
        vectors.  All vectors as similar as the last neighbour vote too, so
        ties have one outcome.  Without any similar vector: the share of
        label 1 in the sample."""
        cosine = np.maximum(self.latent(counts) @ self.vectors.T, 0).round(6)
        k = min(self.neighbours, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
        weight = np.where(cosine >= least, cosine, 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        prior = float(self.labels.mean())
        return np.where(total > 0, np.minimum((weight @ self.labels) / np.where(total > 0, total, 1), 1), prior)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> NeighbourModel:
    """Fit on documents with a label (0 or 1) in ``labels`` (id, label).

    Labels without a document are left out first.  Of the rest at most
    ``max_labelled``, those with the smallest hash of their id, are looked up, so
    the sample's ids (a few bytes each) can be broadcast and no text is shuffled.
    Null ids and labels are left out; an id with two labels counts for both;
    raises :class:`NoLabels` (a ValueError) if no labelled document remains."""
    label = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    present = label.dropna().distinct().join(texts.select("id"), "id", "left_semi")
    chosen = present.orderBy(F.xxhash64("id"), "id", "label").limit(max_labelled)
    found = texts.join(F.broadcast(chosen), "id").select("id", "text", "label")
    rows = counted(found).orderBy(F.xxhash64("id"), "id", "label", "at", "n").limit(max_labelled).collect()
    if not rows:
        raise NoLabels("no labelled rows to fit")
    n_docs, frequencies = document_frequencies(docs, text_col)
    counts = np.zeros((len(rows), BUCKETS + EXTRA), np.float32)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["n"]
    labels = np.array([r["label"] for r in rows], np.float64)
    idf = (np.log((1 + n_docs) / (1 + frequencies)) + 1).astype(np.float32)
    matrix = damped(counts, idf)
    # right singular vectors from the (terms x terms) product: its size is fixed by the number of terms
    _, vectors = np.linalg.eigh(matrix.T.astype(np.float64) @ matrix)
    basis = vectors[:, ::-1][:, :dimensions].astype(np.float32)
    model = NeighbourModel(idf, basis, None, labels, neighbours)
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def scored(docs: DataFrame, model: NeighbourModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: one narrow pass with the model broadcast.

    Null and empty texts get the sample's share of label 1; repeated rows get
    equal scores; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in slices(batches, BLOCK):
            counts = np.stack([term_counts(t) for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(counts), pa.float64())],
                                             ["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, score double")


def classified(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """:func:`fit`, then :func:`scored`; without any labelled document every row scores 0.5, so empty tables have a
    result too."""
    try:
        model = fit(docs, labels, label_col, id_col, text_col, **options)
    except NoLabels:
        return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.lit(0.5).alias("score"))
    return scored(docs, model, id_col, text_col)
