"""The corpus pipeline: language ID, Jaccard join, decontamination, source mixing, sharding.

Each stage takes the rows its predecessor kept, with the columns of documents, and returns what it keeps or makes. The language stage
drops documents without a letter or with a language probability under LEAST_SCORE; of each component of near duplicates the document with
the least id stays; documents with a benchmark hit go; mixing draws every remaining document at least once, and those of rare sources
more often; sharding adds shard and slot. Sharding uses a Fisher-Yates shuffle, which SQL can't express, so ORACLE_SQL is None and the
tests hold the pipeline against plain versions of its stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditspan.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from auditspan.llm.common import lean, table, written

#: Just over what four languages share evenly: short texts in one language stay.
LEAST_SCORE = 0.3
#: Near duplicates share so many percent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, so null and empty texts too, and those with a language probability under LEAST_SCORE; one of exactly that stays.

    Texts of any length are scored whole; repeated rows stay or go together; an empty table, or one without a row to learn from, gives an
    empty one; columns beyond those of documents pass, whatever their names."""
    lean(spark)
    return language_id.identified(docs, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id in each component of near duplicates; of rows equal in that id and text one.

    Null and empty texts have no words, so each is its own component and stays; a null id stays only where its component has no other.
    Texts of any length are compared whole, in work that their number of shingles bounds; an empty table stays empty; other columns pass."""
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any benchmark window of ten words, or a whole shorter item.

    Null and empty texts have no words and stay, as do all where the benchmark is empty; repeated rows go together; texts of any length are
    searched whole; an empty table stays empty; other columns pass, whatever their names."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws every document at least once, and those of sources below their target share again: a row for each draw, with the columns of documents.

    A null source is a source of its own. Null and empty texts have no tokens and are drawn as the order has them; a source without any
    token is not drawn. Repeated rows are drawn as rows of their own; ties in the order are rows equal in id and text; an empty table stays
    empty; extra columns pass, but ones named mix_tokens, mix_copy or mix_block take mixing's values."""
    return mixing.mixed(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, by a seeded two-pass shuffle; extra columns of these names give way.

    Null ids and texts hash like values; equal rows, such as a document's draws, are numbered and scatter; one text of any length is one
    record; an empty table stays empty."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
