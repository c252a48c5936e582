import random

import numpy as np
import pytest
import sentencepiece
from corpus_rows import ODD, documents

from skillscope.llm import piece_matching as pm
from skillscope.llm import queries


@pytest.fixture(scope="module")
def model():
    return pm.load(queries.MODEL_PATH)


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)


def texts():
    rng = random.Random(1)
    signs = " \n\t aabcdeéñ漢字😀▁'.,;0123"
    out = ["", " ", "   ", "x", "\n", " \n ", "a" * 3000, " " * 1000 + "b", "the " * 2000, "\x00a", "hello" * 400]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    out += ["".join(rng.choice("abcdefghinorst") for _ in range(600)) for _ in range(20)]
    return out


def test_ids_equal_the_published_encoder(model, reference, small):
    rows = texts() + [t or "" for _, t in small]
    encoder, got = pm.Encoder(model), []
    for at in range(0, len(rows), 250):
        flat, size = encoder.encode(rows[at:at + 250])
        got += [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])]
    assert got == reference.encode(rows)
    assert [pm.text_of(x, model) for x in got] == [t.replace("▁", " ") for t in rows]


def test_table_bound_and_small_chunks_change_nothing(model, reference, small, monkeypatch):
    monkeypatch.setattr(pm, "CHUNK", 500)
    monkeypatch.setattr(pm, "TABLE_UNITS", 100)
    monkeypatch.setattr(pm, "LONG", 5)
    rows = [t or "" for _, t in small[:60]]
    encoder = pm.Encoder(model)
    for text in rows:
        assert encoder.encode([text])[0].tolist() == reference.encode(text)


def test_occurrences_are_all_occurrences(model):
    text = "the_▁there▁other"
    codes = np.array([ord(c) for c in text], np.int64)
    edges = pm.edges_by_position(codes, model)
    pieces = {"".join(map(chr, p[:n])) for p, n in zip(model.pieces, model.lengths)}
    want = {(n, at) for at in range(len(text)) for n in range(2, 17) if text[at:at + n] in pieces and at + n <= len(text)}
    assert {(int(n), int(at)) for n, at in zip(*np.nonzero(edges))} == want


def test_frames(spark, model, reference, odd, none):
    out = pm.round_trips(odd, model).collect()
    assert len(out) == len(ODD) and all(r.exact for r in out)
    assert sorted(map(str, ((r.doc_id, r.ids) for r in out))) == sorted(
        str((r[0], reference.encode(r[1] or ""))) for r in ODD)
    ids = pm.encoded(odd, model)
    assert [r.n_tokens == len(r.ids) for r in ids.collect()] == [True] * len(ODD)
    back = pm.decoded(ids, model).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(str((r[0], r[1] or "")) for r in ODD)
    assert pm.round_trips(none, model).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pm.decoded(nulls, model).first().text is None
