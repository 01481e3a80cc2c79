"""From documents to a training mix, in five stages; each is written as Parquet and read again as the next one's input.

Each stage takes documents with any further columns, whatever their names, null ids and texts, repeated rows and empty tables (which
stay empty); all but the last return the columns they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from tessera.llm._common import WORD, forget, materialize, quoted


#: What near copies share: 80 of 100 five-word shingles.
NEAR = (5, 80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go, with those of no or null text; repeated rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.learn_rules(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts, and with them documents that lose lines and are left with fewer words than the base rule of
    the stage before asks for. A near copy, by the join's measure, keeps what it repeats of its original: the next stage drops it whole.
    Rows that repeat an id and a text lose the same lines; null texts stay."""
    out = line_dedup.dedup_lines(docs, near=NEAR)
    words = F.regexp_count(F.col("text"), F.lit(WORD))
    out = out.where((F.col("n_removed") == 0) | (words >= quality_rules.LEAST_WORDS))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles one row stays, that with the smallest id; null and empty
    texts are in no group and stay."""
    return ngram_join.keep_one_each(docs, ngram_join.ngram_groups(docs, **dict(zip(("n", "num", "den"), NEAR, strict=True))))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null texts stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document how many of its words it takes, and where: places (shard, at, block, first, words), the slots of shards,
    in order of `at`, that its words go to. Null texts have no places; repeated rows are documents of their own."""
    m = mixing.mix_sources(docs)
    placed = m.documents.join(m.places().drop("doc_id"), ["source_ix", "start"], "left")
    none = F.array().cast("array<struct<shard:bigint,at:bigint,block:bigint,first:bigint,words:bigint>>")
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("places", none).alias("places"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", benchmark_leaks), ("source_mixing", mix)]
#: Learned rules, alignments and a draw of blocks are nothing that SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
    return docs
