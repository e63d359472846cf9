"""Words most characteristic of each group's comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.functions.stemming import stem as stemmed
from contrastmill.operators.groups import GROUP, POPULATION, col, group_by_equality
from contrastmill.runtime import materialize

# The characters stripped from words.
PUNCTUATION = ",.;:?![]{}/\\"

_BLANKS = " \t\n\x0b\f\r"
_BLANK = f"[{_BLANKS}]"


def filter_comments(df: DataFrame, comment: str, locale: str | None = None, language: str = "en") -> DataFrame:
    """Rows with a comment, in the language or without a known one."""
    return df.where(is_comment(comment, locale, language))


def is_comment(comment: str, locale: str | None = None, language: str = "en") -> Column:
    """Does a row have a comment, in the language or without a known one."""
    there = col(comment).isNotNull()
    return there if locale is None else there & (col(locale).isNull() | col(locale).startswith(language))


def tokenize(text: Column) -> Column:
    """Lower-case and split at every blank; trailing blanks make no tokens."""
    body = F.rtrim(F.lower(text), F.lit(_BLANKS))
    return F.when((body == "") & (text != ""), F.array().cast("array<string>")).otherwise(F.split(body, _BLANK))


def distinct_words_per_comment(comments: DataFrame, comment: str) -> DataFrame:
    """One row per comment and different raw word."""
    words = F.array_distinct(tokenize(col(comment)))
    return comments.select(POPULATION, GROUP, F.explode(words).alias("word"))


def concat_words_per_group(words: DataFrame) -> DataFrame:
    """The comments of a group as one document, kept as counts rather than as a list."""
    return words.groupBy(POPULATION, GROUP, "word").agg(F.count(F.lit(1)).alias("tf"))


def clean_words(counts: DataFrame, stem: bool = True) -> DataFrame:
    """Stem, then strip punctuation, then merge what became equal; empty words go.

    Works on counted words, so each group's vocabulary is stemmed once however often used.
    """
    word = stemmed(F.col("word")) if stem else F.col("word")
    stripped = F.translate(word, PUNCTUATION, "")
    return (
        counts.withColumn("word", stripped)
        .where(F.col("word") != "")
        .groupBy(POPULATION, GROUP, "word")
        .agg(F.sum("tf").alias("tf"))
    )


def stop_words(counts: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """Drop stop words; the default is the English list that comes with Spark."""
    words = StopWordsRemover.loadDefaultStopWords("english") if words is None else words
    return counts.where(~F.lower("word").isin([w.lower() for w in words]))


def term_counts(
    comments: DataFrame, comment: str, stem: bool = True, stop: Sequence[str] | None = None
) -> DataFrame:
    """``population, g, word, tf``: how often each clean word occurs in a group's comments."""
    raw = concat_words_per_group(distinct_words_per_comment(comments, comment))
    return stop_words(clean_words(raw, stem), stop)


def inverse_doc_frequency(counts: DataFrame, comments: DataFrame) -> DataFrame:
    """``population, word, df, corpus_tf, idf`` with every group that has comments a document."""
    documents = (
        comments.select(POPULATION, GROUP).distinct()
        .groupBy(POPULATION).agg(F.count(F.lit(1)).alias("documents"))
    )
    stats = counts.groupBy(POPULATION, "word").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf")
    )
    idf = F.log((F.col("documents") + 1) / (F.col("df") + 1))
    return stats.join(documents, POPULATION).withColumn("idf", idf).drop("documents")


def rank_words(counts: DataFrame, idf: DataFrame, number: int = 10) -> DataFrame:
    """The words of each group with the largest tf-idf; ties by corpus frequency, then word."""
    scored = counts.join(idf, [POPULATION, "word"]).withColumn("tfidf", F.col("tf") * F.col("idf"))
    order = Window.partitionBy(POPULATION, GROUP).orderBy(F.desc("tfidf"), F.desc("corpus_tf"), "word")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= number)
        .select(POPULATION, GROUP, "rank", "word", "tf", "tfidf")
    )


def top_words(
    records: DataFrame,
    group_column: str,
    names: Sequence[str] | DataFrame | None = None,
    *,
    comment: str = "user_comments",
    locale: str | None = "useragent_locale",
    number: int = 10,
    stem: bool = True,
    stop: Sequence[str] | None = None,
) -> DataFrame:
    """``population, g, rank, word, tf, tfidf`` for the groups asked for.

    Word frequencies over groups come from all groups. Only the asked-for groups are joined to
    them, so a word every group uses is met by few rows.
    """
    comments = group_by_equality(filter_comments(records, comment, locale), group_column)
    return rank_counted(term_counts(comments, comment, stem, stop), comments, names, number)


def rank_counted(
    counts: DataFrame, comments: DataFrame, names: Sequence[str] | DataFrame | None = None, number: int = 10
) -> DataFrame:
    """The same out of ``term_counts`` and a table with the groups that have comments."""
    counts = materialize(counts)
    idf = inverse_doc_frequency(counts, comments)
    wanted = counts
    if isinstance(names, DataFrame):
        wanted = counts.join(names.select(POPULATION, GROUP).distinct(), [POPULATION, GROUP], "left_semi")
    elif names is not None:
        wanted = counts.where(F.col(GROUP).isin(list(names)))
    return rank_words(wanted, idf, number)


def word_lists(ranked: DataFrame) -> DataFrame:
    """``population, g, top_words``: the ranked words as one short list per group."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy(POPULATION, GROUP).agg(F.transform(pairs, lambda p: p["word"]).alias("top_words"))
