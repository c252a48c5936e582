import zlib

import numpy as np
import pytest
from corpus_rows import documents

from skillscope.llm import neighbour_quality as nq
from skillscope.llm import queries


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_neighbour_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 100
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_scores_equal_a_plain_neighbour_vote(spark, small):
    counts = np.stack([nq.term_counts((t or "").encode()) for _, t in small])
    rng = np.random.default_rng(0)
    model = nq.NeighbourModel(np.ones(counts.shape[1], np.float32),
                              rng.normal(size=(counts.shape[1], 8)).astype(np.float32), None,
                              rng.integers(0, 2, 60).astype(float), 5)
    model.vectors = model.latent(counts[:60])
    got = model.scores(counts)
    low = model.latent(counts).astype(np.float64)
    assert np.allclose(np.linalg.norm(low, axis=1)[[bool(t) for _, t in small]], 1, atol=1e-4)
    for i, row in enumerate(np.maximum(model.latent(counts) @ model.vectors.T, 0).round(6).tolist()):
        near = sorted(zip(row, model.labels), reverse=True)
        voters = [x for x in near if x[0] >= near[4][0]]          # the five nearest, and whatever ties with the fifth
        share = sum(s ** nq.SHARPNESS * y for s, y in voters) / sum(s ** nq.SHARPNESS for s, _ in voters)
        assert abs(got[i] - share) < 1e-5


def test_odd_rows_bound_and_errors(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (7, 0, 0), (None, 1, 0), (8, None, 0)],
                                   "doc_id long, quality int, text int")
    model = nq.fit(odd, labels, "quality", max_labelled=3)
    assert len(model.labels) <= 3
    scores = nq.scored(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    empty = [r.score for r in scores if r.doc_id == 4]
    assert empty == [pytest.approx(model.labels.mean())]
    assert nq.scored(none, model).count() == 0
    with pytest.raises(ValueError):
        nq.fit(odd, labels.filter("quality is null"), "quality")


def test_empty_tables_score_by_the_prior(spark, none, odd):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (10 ** 9, 1)], "doc_id long, quality int")
    for docs, known in ((none, labels), (odd, labels.limit(0)), (odd, labels.filter("doc_id > 100"))):
        rows = nq.classified(docs, known, "quality").collect()
        assert len(rows) == docs.count() and {r.score for r in rows} <= {0.5}


def test_labels_without_a_document_use_up_no_sample(spark):
    docs = documents(spark, [(i, ("good words here " if i % 2 else "#$ zz #$ ") * 20, 0) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(i, 0) for i in range(1000, 3000)],
                                   "doc_id long, quality int")
    model = nq.fit(docs, labels, "quality", max_labelled=20)
    assert len(model.labels) == 20
    scores = {r.doc_id: r.score for r in nq.scored(docs, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(20, 40))


def test_document_frequencies_cover_all_documents(spark, odd):
    n, found = nq.document_frequencies(odd, "text")
    texts = [(r.text or "").encode() for r in odd.collect()]
    assert n == len(texts) and found.tolist() == sum(nq.term_counts(t) > 0 for t in texts).tolist()
