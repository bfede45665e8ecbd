"""From raw documents to packed training sequences: five operators, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasmill.llm.decontam import without_leaks
from atlasmill.llm.jaccard import one_of_each
from atlasmill.llm.langid import of_known_language
from atlasmill.llm.packing import pack
from atlasmill.llm.substring import cut_repeats
from atlasmill.session import drop_since, materialize, written_so_far


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays unclear, go.

    A null text has no letter. Repeated rows stay or go together; without any labelled row all go; an empty table gives
    no rows; other columns are carried along, whatever their names.
    """
    return of_known_language(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard similarity of 0.8, one document stays: that with the smallest id.

    Null and wordless texts are linked with nothing and stay; of rows with one id and one text one stays; a null id is
    larger than any other; an empty table gives no rows; other columns are carried along.
    """
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id has are cut out.

    Documents left with fewer than five words, but not before, go. Null texts stay null; rows of one id never cut each
    other; an empty table gives no rows; n_chars is counted again where a text changed, other columns are carried along.
    """
    return cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item, edited up to an alignment score of 0.8, go.

    Null and wordless texts stay; repeated rows stay or go together; without items all stay; an empty table gives no
    rows; other columns are carried along.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces in sequences of 4096 tokens, a row for each piece.

    A null or empty text is the end token alone; repeated rows give repeated pieces; an empty table gives no rows; other
    columns are dropped.
    """
    return pack(docs)


STAGES = [(f.__name__, f) for f in (language_id, ngram_jaccard_join, substring_dedup, benchmark_decontamination, best_fit_packing)]

#: Training and packing are beyond SQL; a test holds the rows of every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet and read again for the next. What a stage wrote on its way goes as soon as its result is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_since(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
