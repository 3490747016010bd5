"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.decontamination import find_contaminated
from granary.llm.funnel import count_funnels
from granary.llm.html_extract import extract_pages
from granary.llm.jaccard_join import jaccard_components
from granary.llm.license_scan import scan_licenses
from granary.llm.line_dedup import dedup_lines
from granary.llm.oracles import ORACLES  # noqa: F401
from granary.llm.pipeline import run
from granary.llm.quality_rules import learn_rules, quality_verdicts
from granary.llm.secrets import scan_secrets
from granary.llm.source_mixing import mix_sources
from granary.llm.substring_dedup import dedup_substrings
from granary.llm.toxicity import held_out, score_texts, train
from granary.llm.url_filter import filter_urls, rules_table
from granary.llm.vector_codes import compress_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, the bytes covered by 200-byte strings that start anywhere else are removed; every copy goes."""
    return dedup_substrings(_table(spark, sf_dir, "documents"), length=200, keep_text=False)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles agree by 90 % or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more are dropped everywhere."""
    return dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, keep_text=False)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of sources at 97 % of the highest entropy, repeated four times at most."""
    return mix_sources(_table(spark, sf_dir, "documents"), entropy_share=0.97, max_repeats=4.0, budget_share=1.0)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: base patterns and literals of sensitive names."""
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document by a machine trained on labelled rows of the training folds."""
    docs = _table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices of licenses in every document."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rules' verdict and that of rules learned from all labels."""
    docs = _table(spark, sf_dir, "documents")
    verdicts = quality_verdicts(docs, learn_rules(docs, _table(spark, sf_dir, "labels")))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds."""
    found = find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_join("items", ",").alias("item_ids"), "n_shared_words")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row's code of 8 parts and 16 entries, its error and its label's."""
    return compress_vectors(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096).drop("exact_share")


def op12_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three funnels over all clicks, a row a funnel and client with attempts."""
    return count_funnels(_table(spark, sf_dir, "clicks"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url: of a base rule, else of a pattern, else allow."""
    judged = filter_urls(_table(spark, sf_dir, "pages"), rules_table(spark))
    of = lambda priority: F.when(F.col("priority") == priority, F.col("rule"))
    return judged.select("page_id", "host", "path", of(1).alias("rule"), "verdict", of(0).alias("pattern"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over documents, one after the other."""
    return run(spark, sf_dir)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_funnel": op12_funnel,
    "op13_url_filter": op13_url_filter,
    "pipeline": pipeline,
}
