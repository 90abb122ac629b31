"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, convtrie, decontam, htmltext, linededup, lm, merkle, pieces, quality, simhash, substring, toxicity
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over ``documents`` with the public 49k word BPE."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over ``documents``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: fitted on a bounded sample of ``labels``, scoring all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: fitted outside the held-out fold, scoring all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over ``documents``."""
    return substring.report(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over ``documents``; subwords from the public 49k word vocabulary."""
    import public_tokenizers

    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: ``documents`` against ``benchmark``."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over ``documents``."""
    return linededup.report(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: the five nearest of every fiftieth row of ``embeddings``."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over ``pages``."""
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over ``documents``."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over ``conversations``."""
    return convtrie.trie(table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over ``documents`` with the public 32k merge-type vocabulary."""
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_simhash,
        op3_toxicity,
        op4_quality,
        op5_substring_dedup,
        op6_lm,
        op7_decontamination,
        op8_line_dedup,
        op9_ann,
        op10_html,
        op11_merkle,
        op12_conversation_trie,
        op13_sentencepiece,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": substring.REPORT_SQL,
    "op7_decontamination": decontam.REPORT_SQL,
    "op8_line_dedup": linededup.REPORT_SQL,
    "op11_merkle": merkle.MANIFEST_SQL,
    "op12_conversation_trie": convtrie.TRIE_SQL,
}
