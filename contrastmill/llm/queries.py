"""One query per operator over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastmill.llm import byte_bpe
from contrastmill.llm.lexical_search import lexical_search
from contrastmill.llm.license_scan import license_matches
from contrastmill.llm.main_text import main_texts
from contrastmill.llm.mixing import mix
from contrastmill.llm.nearest_neighbours import nearest_neighbours
from contrastmill.llm.ngram_jaccard import jaccard_components
from contrastmill.llm.quality import quality_scores
from contrastmill.llm.sentencepiece_scan import decode, encode
from contrastmill.llm.spelling_variants import spelling_variants
from contrastmill.llm.token_counts import token_counts
from contrastmill.llm.top_k_search import top_k_search
from contrastmill.llm.toxicity import toxicity_scores

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages"))


def op2_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_top_k_search(spark, sf_dir):
    return top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_sentencepiece(spark, sf_dir):
    path = public_tokenizers.path(MODEL)
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "ids", F.size("ids").alias("n_pieces"), "score", F.md5("text").alias("decoded_md5"))


def op9_nearest_neighbours(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_license_scan(spark, sf_dir):
    return license_matches(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark, sf_dir):
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL), columns)


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text, op2_quality, op3_mixing, op4_top_k_search, op5_toxicity, op6_ngram_jaccard, op7_token_counts,
        op8_sentencepiece, op9_nearest_neighbours, op10_license_scan,
        op11_lexical_search, op12_byte_bpe, op13_spelling_variants,
    )
}
