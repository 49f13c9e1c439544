"""Training-data pipeline: quality classifier, exact and near deduplication, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the tool writes its
result as Parquet and reads it again, ``run`` writes it to the shared checkpoint folder. All stages but
the last keep the columns of ``docs``, whatever they are called, and give an empty table for an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import exact_dedup, mixing, near_dedup, packing, quality_model
from draftlake.llm.queries import table, tokenizer_file
from draftlake.session import cut_lineage

#: Every document is dealt at least once; small sources pass up to twice, as the entropy target needs.
MIXTURE = mixing.Settings(entropy=0.95, repeats=2.0)
#: Links from 0.8 on; fourteen trees of four levels miss such a link with (1 - 0.8^4)^14 = 0.0006.
NEAR = near_dedup.Settings(percent=80, trees=14)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null text is scored as empty; repeated rows and
    ties are scored alike; without labels of both kinds every document is judged by the bias alone."""
    judged = quality_model.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("quality.predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, white space aside: that of the smallest id. Null text is
    empty; a null id stays only where the group has no other; of rows that repeat one stays."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near-duplicates. Texts without words and
    rows without id stay; rows that share an id stay or go together."""
    return near_dedup.without_near_copies(docs, settings=NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture deals them, each at least once. Null sources are
    one source; texts without words count no tokens; repeated rows are dealt together."""
    return mixing.mix(docs, settings=MIXTURE).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place. Null and empty texts are the end id alone;
    rows that repeat are documents of their own; only documents longer than a sequence are cut."""
    return packing.packed(docs, tokenizer=tokenizer_file())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: No SQL: the stages fit a classifier, follow trees of minwise tokens and solve a packing programme.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
