"""Corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Every stage takes a table with doc_id, text and lang (and others, whose names do not begin with "__") and keeps the columns. A null
or empty text has no words: the quality rules reject it, the other stages keep it. Rows with a null or repeated doc_id
are judged by their own text at each stage. An empty table passes through all stages. Repeated rows are near-duplicates
of each other, of which one stays.
"""

from __future__ import annotations

import contextvars
import functools
from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.llm.minhash import near_texts
from netloom.llm.packing import best_fit
from netloom.llm.quality import PerplexityQuality
from netloom.llm.queries import vocabulary
from netloom.llm.shared import noted, remove_written, written
from netloom.llm.substrings import remove_repeats
from netloom.llm.toxicity import Toxicity, held_out

#: Tables that the stage before wrote for itself; its result is stored when the next one begins. Each run has its own.
_before: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("_before", default=())


def stage(work, first: bool = False):
    """A stage that removes what the stage before needed, unless it is the first, and remembers what it wrote itself.

    Stages called one by one in one context are taken for one pipeline: each result must be stored before the next stage.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            remove_written(spark, list(_before.get()))
        mine: list[str] = []
        token = noted.set(mine)
        try:
            return work(spark, docs, sf_dir)
        finally:
            noted.reset(token)
            _before.set(tuple(mine))

    return run_stage


@functools.partial(stage, first=True)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return PerplexityQuality().fit(docs).accept(docs)


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the lexicon is learned from the labelled ones among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return Toxicity().fit(docs, labels.where(~held_out())).accept(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, the one with the least doc_id; rows are told apart by a number of their own."""
    row = next(name for k in count() if (name := f"__row{k or ''}") not in docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = near_texts(rows, row).select(row, "component_id").join(rows.select(row, "doc_id"), row)
    first = classes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("x")).select(f"x.{row}")
    return rows.join(first, row, "left_semi").select(docs.columns)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows; n_chars, if there is one, is the length of what is left."""
    own = {c: f"__own_{c}" for c in ("n_words", "n_removed") if c in docs.columns}
    cut = remove_repeats(docs.withColumnsRenamed(own)).drop("n_words", "n_removed").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin, place, tokens and text of every piece of every document: bins in the order of offsets are the training sequences."""
    return best_fit(docs, path=vocabulary("word_bpe_49k.json"), texts=True)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("MinHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("best-fit packing", packing)]

#: Perplexity, learned weights, similarity components and best-fit are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def _all_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = written(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet in the shared folder and read again by the next one. No other run, in the same
    process or not, touches the tables of this one."""
    return contextvars.copy_context().run(_all_stages, spark, sf_dir)
