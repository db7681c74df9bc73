"""Tags that depend on a phrase in a text: conditions are a table, found through their rarest word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.operators.skew import salted_join
from noticework.session import settled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Lower-cased (A to Z) words with single blanks between them; empty for null."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " ")
    return F.trim(spaced)


def _holds(text: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def met_conditions(texts: DataFrame, rules: DataFrame, identity: str, text: str, rule: str, phrase: str) -> DataFrame:
    """Distinct (identity, rule): the texts that hold a rule's phrase, word for word and whatever its case.

    Instead of trying every phrase on every text, the words of the texts are joined with one word of each phrase, the one that
    the fewest texts hold; only texts that have it are searched.  Frequent words are salted.  Null and empty
    phrases are met by nothing; a rule with several phrases is met by any of them; null identities are kept as one.
    """
    read = texts.select(F.col(identity).alias("id"), plain_words(F.col(text)).alias("plain"))
    asked = settled(rules.select(F.col(rule).alias("rule"), plain_words(F.col(phrase)).alias("phrase")).filter(F.col("phrase") != "").distinct(), "phrases")
    words = asked.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word")).distinct()
    # Words that no phrase holds go before anything is shuffled; the rest is written once and counted.
    needed = settled(words.select("word").distinct(), "words")
    postings = read.select("id", F.xxhash64("plain").alias("digest"), F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    postings = settled(postings.join(needed, "word", "left_semi"), "postings")
    counts = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rated = words.join(counts, "word", "left").groupBy("phrase").agg(
        F.min_by("word", F.struct("n", "word")).alias("word"), F.bool_and(F.col("n").isNotNull()).alias("possible"))
    anchors = rated.filter("possible").select("phrase", "word")
    met = salted_join(postings, anchors, ["word"]).select("id", "digest", "phrase")
    searched = read.withColumn("digest", F.xxhash64("plain")).withColumnRenamed("id", "own")
    same = (F.col("own").eqNullSafe(F.col("id"))) & (searched["digest"] == met["digest"])
    hits = searched.join(met, same).filter(_holds(F.col("plain"), F.col("phrase"))).select("id", "phrase").distinct()
    return hits.join(asked, "phrase").select(F.col("id").alias(identity), F.col("rule").alias(rule)).distinct()
