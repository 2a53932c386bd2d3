"""A training corpus from raw documents, in five stages.

Every stage takes all rows that the one before it kept. All but the last return the columns of documents; the last
returns the mix as a manifest: the documents that it takes, how often, and their place in the queue.

Defined results, stage by stage: a null or empty text goes with the language stage, as it has no letters; where a stage is
given one all the same, it counts as the empty text (all of them are one exact group, none is a near copy or contaminated, and the
mix takes none). Null ids are kept like others and come last where ids decide. Of repeated rows one stays of exact copies; ties
go by id. Other columns pass through all but the last stage, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.llm.decontamination import drop_contaminated
from quarrion.llm.exact_dedup import drop_exact
from quarrion.llm.language_id import drop_unidentified
from quarrion.llm.mixing import mix
from quarrion.llm.near_dedup import drop_near
from quarrion.llm.shared import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, or without a language that holds a fair share of them."""
    return drop_unidentified(docs)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id stays."""
    return drop_exact(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, the one with the least id stays."""
    return drop_near(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The queue of documents in which each source has its target's share."""
    return mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: Language identification can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else written(docs), sf_dir)
    return docs
