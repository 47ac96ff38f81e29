"""One registered query for each corpus operator, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    curriculum, decontaminate, infill, jaccard, language, lexical, lines, quality, simhash, sketch, tokens, toxicity, urls)
from fleetlens.llm.common import table
from fleetlens.llm.sql import ORACLE  # noqa: F401
from fleetlens.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").drop("text_key")


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages and all documents: a row has a page_id or a doc_id."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    own, other = F.col("id"), F.lit(None).cast("bigint")
    pages = language.page_languages(table(spark, sf_dir, "pages"), model).withColumns({"doc_id": other, "page_id": own})
    texts = language.document_languages(docs, model).withColumns({"doc_id": own, "page_id": other})
    return pages.unionByName(texts).drop("id")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"),
                        F.col("_good").cast("int").alias("predicted"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", F.col("_score").alias("score"), F.col("_severity").alias("severity"),
                        F.col("_grade").alias("grade"), F.col("_toxic").alias("toxic"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_tokens(spark, path, with_ids=False).drop("ids")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.size("_removed").alias("n_removed"), F.col("_removed").alias("removed"),
        F.col("_cut_words").alias("cut_words"), F.col("_kept_text").alias("text"))


@query
def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.assign(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.size("positions")).alias("taken"))


@query
def op10_curriculum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: a row for every pass over a document, range-sorted by training position."""
    return curriculum.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", F.col("_position").alias("position"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(spark, index, table(spark, sf_dir, "benchmark"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = infill.restore(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return examples.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
