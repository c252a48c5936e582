import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from skillscope.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_brute_force_versions(spark):
    from test_decontamination import slow_align
    from test_line_chunks import slow as slow_chunks
    from test_simhash import slow_components, slow_fingerprint

    from skillscope.llm import compression, decontamination
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    press = zstandard.ZstdCompressor(level=compression.LEVEL)
    rows = {i: t for i, t in rows.items() if compression.measure(t.encode(), press)[-1]}
    rows = {i: t for i, t, _ in slow_chunks(sorted(rows.items()))}
    ids = sorted(rows)
    group = slow_components([slow_fingerprint(rows[i]) for i in ids])
    rows = {ids[g]: rows[ids[g]] for g in group}
    items = [decontamination.normal_hashes(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontamination.normal_hashes(text).tolist()
        for item in items:
            item = item.tolist()
            if len(set(item) & set(words)) >= 0.6 * len(set(item)) and slow_align(item, words)[1] >= 0.8 * len(item):
                return True
        return False

    rows = {i: t for i, t in rows.items() if not leaks(t)}
    encoder = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: encoder.encode(t) for i, t in rows.items()}
    assert len(got) == len(rows) < docs.count()


def test_stages_keep_the_columns(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [re.sub("[^a-z_0-9]", "", n) for n, _ in corpus_pipeline.STAGES] == [n for n, _ in corpus_pipeline.STAGES]


def test_odd_rows_pass_through(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        assert Counter(r.exact for r in corpus_pipeline.sentencepiece(spark, docs, SF).collect()).keys() <= {True}
