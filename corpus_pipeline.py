"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventledger.llm import mixing, pieces, queries, rules, simhash, substrings
from eventledger.llm.common import long_id, read_table, text_tag
from eventledger.session import prepare, shared_dir

#: Times that the expected tokens of a domain now shall be read; others stay as they are.
SCALE = {"low": 0.25, "toxic": 0.25}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go; repeated rows are judged alike."""
    return rules.measure(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without a word are one group,
    a null id sorts behind all others, and of rows with one id and text one stays."""
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; texts that were nothing else go."""
    left = substrings.remove_repeats(docs).where("n_words > n_removed")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, in whole numbers whose totals are those of the rates.

    A rate near one leaves a document as it is, so clean documents are neither lost nor
    doubled. Rows that share id and text are rounded each by itself, by a hash.
    """
    rated, domains = mixing.mix(docs, mixing.quality_domains(read_table(spark, sf_dir, "labels")), scale=SCALE)
    times = mixing.whole_copies(rated, len(domains)).groupBy("_key", "_tag").agg(
        F.count("*").alias("_alike"), F.first("rate").alias("_rate"), F.first("copies").alias("_copies")
    )
    rows = docs.select("*", long_id("doc_id").alias("_key"), text_tag().alias("_tag"), F.monotonically_increasing_id().alias("_row"))
    sure = (F.col("_alike") == 1) | mixing.as_it_is(F.col("_rate"))
    dealt = rows.join(times, ["_key", "_tag"]).withColumn("_n", F.when(sure, F.col("_copies")).otherwise(mixing.copies(F.col("_rate"), F.col("_row"))))
    return dealt.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each row; a null text has no ids."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.Model.load(queries.PIECES))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("sentencepiece", encoding),
]

#: XXH64 fingerprints and the vocabulary's pieces have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
