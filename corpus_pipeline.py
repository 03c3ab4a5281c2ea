"""Training corpus pipeline: five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs:

1. ``language_id``   documents without letters, or rejected by the language
                     models, go; the models learn from the labelled documents
                     outside the held-out fold
2. ``ngram_join``    one document of each group of near copies stays
3. ``suffix_dedup``  strings of more than ``REPEAT_WORDS`` words that occur twice are cut out
4. ``mix_sources``   documents are taken as often as the mix says
5. ``bpe``           ids of each whole text, and the text that they decode to

Stages 1 to 4 return the columns of their input.  Every stage works on all
rows of its predecessor: nulls, empty and long texts, repeated rows, empty
tables and extra columns of any name are handled as the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlrun.llm.bpe import encode_documents
from sqlrun.llm.common import documents, fresh_name, materialise, quoted, sealed, word_count
from sqlrun.llm.language_id import identify
from sqlrun.llm.mixing import mix_hash, mix_sources
from sqlrun.llm.ngram_join import one_of_each
from sqlrun.llm.queries import BYTE_BPE, fold, tokenizer_path
from sqlrun.llm.suffix_dedup import without_repeats


REPEAT_WORDS = 50


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = docs.drop("text")
    rows = docs.select(sealed(others).alias("row"), "text", "lang",
                       F.coalesce(fold() != 1, F.lit(False)).alias("train"))
    found = identify(rows, F.col("train"), keep=("row", "text")).filter(~F.col("rejected"))
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = without_repeats(docs, words=REPEAT_WORDS)
    # The length column follows the text.
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else cut


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix, copy = fresh_name(docs.columns, "mix"), fresh_name([*docs.columns, "mix"], "copy")
    mixed = mix_sources(docs, word_count(F.col("text")), mix_hash(F.col("doc_id"), F.col("text")))
    copies = F.col(mix)["copies"].cast("int")
    return (mixed.filter(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
            .select(*map(quoted, docs.columns)))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_documents(docs, tokenizer_path(BYTE_BPE), keep=("doc_id", "source"), decoded="decoded")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("suffix_dedup", repeat_stage),
    ("mix_sources", mix_stage),
    ("bpe", bpe_stage),
]

# Similarity joins, language models and BPE are beyond SQL; the tests hold
# every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
