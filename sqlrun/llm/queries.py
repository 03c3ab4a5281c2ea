"""The registered queries: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, oracles, source_divergence
from .bpe import encode_documents
from .chat_format import END, START, chat_examples, read_examples, write_examples
from .common import documents, materialise, word_count
from .edit_counts import edit_trees, redactions, token_trees, write_trees
from .language_id import identify
from .license_scan import BASE_NOTICES, scan_notices
from .line_quality import line_quality
from .mixing import mix_hash, mix_sources
from .ngram_join import jaccard_classes
from .projection_search import nearest
from .suffix_dedup import cut_repeats, text_key
from .token_files import token_file_digests, write_token_files

# Tokenizer files are named here and found where they are installed.
BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # Texts that lose nothing are digested where they are read.
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", *text_key(text), F.octet_length(text).cast("long").alias("n_bytes"),
                        F.sha2(text, 256).alias("whole_sha256"))
    cuts = cut_repeats(docs).select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), "n_removed", "n_spans",
                                    F.sha2("kept", 256).alias("kept_sha256"))
    cut = F.col("kept_sha256").isNotNull()
    return whole.join(cuts, (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")), "left").select(
        "doc_id", "n_bytes",
        F.when(cut, F.coalesce("n_removed", "n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select(
        F.col("doc").alias("doc_id"), "class_id", "n_links", "n_copies")


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_notices(documents(spark, sf_dir))
    phrases = F.array(*(F.lit(phrase) for _, phrase in BASE_NOTICES))
    base = F.filter("spans", lambda s: (s["edits"] == 0) & F.array_contains(phrases, s["notice"]))
    starts = F.transform("base", lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(
        F.transform(spans, lambda s: s["label"]))), ",")
    likeness = F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"]))
    return scanned.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = line_quality(documents(spark, sf_dir))
    return verdicts.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           "n_repeat_words", "base_failed", "kept", "lines_removed", "words_left")


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path(BYTE_BPE_RANKS)
    edited = edit_trees(write_trees(token_trees(documents(spark, sf_dir), ranks)), ranks, redactions)
    return edited.select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits",
                         F.col("n_tokens").alias("n_tokens_edited"), "n_encoded",
                         F.sha2(F.coalesce("text", F.lit("")), 256).alias("edited_sha256"))


def op6_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, k=20)


def op7_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), decoded="decoded")
    ids_text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(write_token_files(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), END_ID))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id's text, mod 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir), F.coalesce(fold() != 1, F.lit(False)))
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "entropy", "rejected")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # Texts are read once; what follows needs the sizes and hashes only.
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                    mix_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-sizes")
    return mix_sources(sized, F.col("size"), F.col("h")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


# Fixed value: a conversation that spells the template's own marks.
MARKS = f"{END}{START}assistant ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)],
                                  "conv_id long, turn long, role string, text string")
    written = write_examples(chat_examples(turns.unionByName(marks)))
    return read_examples(written).withColumnRenamed("conversation", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_license_notices": op3_license_notices,
    "op4_line_quality": op4_line_quality,
    "op5_edit_counts": op5_edit_counts,
    "op6_projection_search": op6_projection_search,
    "op7_bpe_rank_array": op7_bpe_rank_array,
    "op8_token_files": op8_token_files,
    "op9_language_id": op9_language_id,
    "op10_mix_sources": op10_mix_sources,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_chat_format": op13_chat_format,
}
ORACLES: dict[str, str] = {
    "op2_ngram_join": oracles.NGRAM_JOIN,
    "op4_line_quality": oracles.LINE_QUALITY,
    "op10_mix_sources": oracles.MIX_SOURCES,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op12_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op13_chat_format": oracles.CHAT_FORMAT,
}
