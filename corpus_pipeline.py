"""A training corpus from documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import decontaminate, language_id, passages, pieces, simhash, suffix_dedup
from weftwork.llm.common import discard, fold, fresh, scratch, shared_path
from weftwork.llm.queries import PIECE_MODEL
from weftwork.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the classifiers learn from three folds of four of ``docs``."""
    learn = F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False))
    return language_id.keep_identified(docs, language_id.fit(docs, learn))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Passages that those left share are cut."""
    return cut_passages(spark, simhash.keep_first(docs), sf_dir)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that also stand in another document.

    A text that holds a passage of the benchmark stays whole, so that ``drop_contaminated`` still finds it.
    """
    (spare,) = fresh(docs, "spare")
    marked, names = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return passages.remove_shared(marked.select(*docs.columns, (F.length(names["hit"]) > 0).alias(spare)), spare_col=spare)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that also stand elsewhere; every document stays."""
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, ...): encoded texts, each decoded again and compared."""
    return pieces.summary(docs, PIECE_MODEL, with_ids=True)


def _shipped(f):
    return lambda spark, docs, sf_dir: f(ship(spark), docs, sf_dir)


STAGES = [(f.__name__, _shipped(f)) for f in (identify_language, drop_near_copies, cut_repeats, drop_contaminated, tokenize)]

#: SQL can express neither the classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    What a stage stored for itself goes when it has been written, and its input when the next one has.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
