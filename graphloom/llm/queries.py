"""Queries over the driver's tables, one for each corpus operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, hamming, oracles, packing, pieces, rules, runindex, simhash, spans, warc, wavelet
from .common import table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from its wavelet shards."""
    return wavelet.read_shards(wavelet.encode_shards(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER)))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without sentences in runs that occurred before."""
    got = spans.dedup(table(spark, sf_dir, "documents"), fixed=3)
    return got.select("doc_id", "n_sentences", "n_removed", F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, read back from the archives by way of the capture index."""
    return warc.read(warc.index(warc.write(table(spark, sf_dir, "pages"))))


def op4_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated strings of 400 bytes."""
    return runindex.cut(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every hundredth embedding among all."""
    rows = table(spark, sf_dir, "embeddings")
    return hamming.search(rows, rows.where("vec_id % 100 = 0"), 10)


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule features and verdicts of every document, its host's verdict included."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every document; 0.5 where the labels have too few of either class."""
    docs = table(spark, sf_dir, "documents")
    return compression.score(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


def op8_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and the class of near copies it is in."""
    got = simhash.classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its training sequence and place in it."""
    return packing.pack(packing.measured(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER)))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids, by count and checksum, and whether they decode to the text."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path(PIECES)).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_wavelet, op2_sentence_spans, op3_warc, op4_run_index, op5_multi_index, op6_host_rules, op7_compression, op8_deletion_variants, op9_best_fit, op10_pieces)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
