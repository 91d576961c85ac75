"""The queries of this package over the driver's tables, and their DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import ann, compression, html, jaccard, language, licences, lines, mixing, negatives, packing, quality, sentencepiece, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on each document."""
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("stratum", "step")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under four-word Jaccard links."""
    return jaccard.joined(_read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    return sentencepiece.encoded(_read(spark, sf_dir, "documents"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every query vector."""
    return ann.neighbours(_read(spark, sf_dir, "embeddings"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(_read(spark, sf_dir, "pages"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    out = lines.deduped(_read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "removed", "row.text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.labelled(_read(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names or quotes."""
    return licences.scanned(_read(spark, sf_dir, "documents"))


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of every vector, and the error that they leave."""
    return compression.compressed(_read(spark, sf_dir, "embeddings")).drop("label")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence."""
    return packing.packed(_read(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    return negatives.mined(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_html": op2_html,
    "op3_lines": op3_lines,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_jaccard": op6_jaccard,
    "op7_sentencepiece": op7_sentencepiece,
    "op9_licences": op9_licences,
    "op8_quality": op8_quality,
    "op10_mixing": op10_mixing,
    "op11_compression": op11_compression,
    "op12_packing": op12_packing,
    "op13_negatives": op13_negatives,
}
ORACLE = {"op6_jaccard": jaccard.SQL, "op10_mixing": mixing.SQL, "op11_compression": compression.SQL, "op13_negatives": negatives.SQL}
