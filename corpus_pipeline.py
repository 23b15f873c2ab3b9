"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.llm import exact_dedup, jaccard, mixing, packing, quality
from kohort.llm.common import read, stage
from kohort.llm.queries import tokenizer_path

#: shares of the expected tokens; poor texts are gone by then, so labels of quality tell clean from toxic
MIX = {"clean": 0.99, "toxic": 0.01}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.7 or more."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: shingles of five words, similarity 0.8 or more."""
    return jaccard.drop_near(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents once; of the others as many as leave at most one toxic token in a hundred. None is written twice."""
    label = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0))
    mix = mixing.fit_mix(docs, read(spark, sf_dir, "labels"), label, MIX, "clean", thin=True)
    return mixing.resample(docs, mix)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Few words are remembered, as the workers of earlier stages hold memory too."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), kept=100_000)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL states neither the fitted models nor the tokenizer; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
