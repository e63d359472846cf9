"""A corpus pipeline: each stage is one operator, and its decisions take effect for the next.

Stages get the documents that the one before has kept (columns of ``documents``) and return what
they keep; the last returns ``doc_id, ids, n_pieces, score``, a row for each time that the mix
takes a document. The classifiers judge every row; the join keeps one row of each id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastmill.llm import quality, toxicity
from contrastmill.llm.mixing import mixed_documents
from contrastmill.llm.ngram_jaccard import jaccard_components
from contrastmill.llm.quality import score_quality
from contrastmill.llm.sentencepiece_scan import encode
from contrastmill.llm.toxicity import score_toxicity
from contrastmill.runtime import materialize

MODEL = "piece_bpe_32k.model"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _judged(score, keep, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is to be kept, with their own columns; the score has a name they do not have."""
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, _labels(spark, sf_dir), name=name).where(keep(F.col(name))).drop(name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return _judged(score_quality, lambda score: score >= quality.THRESHOLD, spark, docs, sf_dir)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not flag."""
    return _judged(score_toxicity, lambda score: score < toxicity.THRESHOLD, spark, docs, sf_dir)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones, once; rows without id stay."""
    found = jaccard_components(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, in training order."""
    return mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text."""
    return encode(docs, public_tokenizers.path(MODEL)).select("doc_id", "ids", F.size("ids").alias("n_pieces"), "score")


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_texts),
]

# SQL cannot express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
