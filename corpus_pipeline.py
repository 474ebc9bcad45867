"""A training corpus from raw documents, in five stages; each takes (spark, docs, sf_dir) and works on all that its
predecessor kept. All but the last return the columns of docs, whatever else a table has, as they are: nulls, repeats and
columns of any name pass through, and an empty table gives an empty one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrylake.llm import decontaminate, mixing, quality
from sentrylake.llm.near_join import one_of_each
from sentrylake.llm.sharding import uniform_shards
from sentrylake.work import new_path

SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores at quality.KEPT or more. Null and empty texts have the score of
    a text without features; without any label every text has that score, one half, and stays."""
    return quality.kept(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates. A text without words is alone in its group; rows
    without an id stay, and so do full repeats of a row that stays."""
    return one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item; null and empty texts cover none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat where a source's target exceeds its size, and go where it falls
    short. A null source is one of its own; a null text has no words and is taken as its hash says."""
    members = mixing.by_source(docs)
    return mixing.repeated(docs, mixing.plan_mix(docs, members, mixing.weighted_targets), members)


def shuffle_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot: a uniform shuffle into shards of equal counts. Only columns named shard or
    slot are replaced."""
    return uniform_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shuffle_to_shards),
]

#: No SQL can train the classifier or tile strings; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage{k + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
