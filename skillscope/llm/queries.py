"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table.  ``ORACLE_SQL`` holds the DuckDB equivalents
of those that SQL can express (see oracle_sql)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from . import compression, decontamination, licences, line_chunks, neighbour_quality, periodic_runs, piece_matching
from . import quotations, repeated_windows, sharding, simhash, vector_codes, warc
from .common import scratch_root
from .oracle_sql import ORACLE_SQL  # noqa: F401

SHARDS = [f"shard-{i:02d}" for i in range(64)]
#: Model file of the tokenizer; the session setting of this name overrides the path.
MODEL_SETTING = "skillscope.llm.piece_model"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def piece_model(spark: SparkSession) -> piece_matching.PieceModel:
    return piece_matching.load(spark.conf.get(MODEL_SETTING, MODEL_PATH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)
    return placed.select("row.doc_id", "slot", "shard")


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels whose held-out remainder is 1 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    return neighbour_quality.classified(docs, labels, "quality").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in reply order, without quotes, with the message it answers."""
    return quotations.reply_ordered(table(spark, sf_dir, "conversations"))


def op4_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a copy, exact or edited."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "end_word")


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 50-word window of an earlier document covers, and what is left."""
    found = repeated_windows.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op6_piece_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back."""
    return piece_matching.round_trips(table(spark, sf_dir, "documents"), piece_model(spark))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and verdict of every document."""
    return compression.quality_rows(table(spark, sf_dir, "documents"))


def op8_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line or document that matches a licence template."""
    return licences.scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line chunks that repeat an earlier one."""
    return line_chunks.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    removed_col="n_removed_lines")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the errors by label and the digest of the codebooks."""
    found = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives that it was written to."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{scratch_root(spark)}/llm-warc-{uuid.uuid4().hex}"
    warc.write(pages, folder)
    id_type = dict(pages.dtypes)["page_id"]
    return warc.read(spark, folder, with_payload=False).select(
        warc.page_of(F.col("record_id")).cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).cast(id_type).alias("refers_to"), "verified")


def _looped_text():
    """The text in which a tenth of the documents repeats a stretch of its words to the end: with
    h = crc32(doc_id), g = floor(h / 10), if h % 10 = 0 each word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        numbers = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(numbers, lambda i: F.get(words, i)), " ")

    def looped(words):
        return F.when(F.size(words) > 0, loop(words)).otherwise("")

    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    return F.when(h % 10 == 0, let(words, looped)).otherwise(F.col("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodically repeated words in every document, and what is left of each run's first period."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _looped_text().alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)
    best = F.col("strongest")
    return periodic_runs.periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        digest.alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, applied to documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_neighbour_quality, op3_quotation_linking, op4_rare_seed_alignment, op5_repeated_windows,
    op6_piece_matching, op7_compression_bands, op8_simhash_gray, op9_licence_scan, op10_line_chunks,
    op11_vector_codes, op12_warc, op13_periodic_runs, pipeline)}
