"""The registered query of each operator: (spark, sf_dir) -> its whole result, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, lines, middle, sharding, spelling
from .minhash import near_texts
from .packing import best_fit
from .pieces import nbest_segmentations
from .quality import PerplexityQuality
from .shared import written
from .substrings import remove_repeats
from .tokens import count_tokens
from .toxicity import Toxicity, held_out
from .vectors import near_vectors

MAX_TOKENS = 2048
#: Bytes of a shard: a unit of shuffling in training.
SHARD = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics, base rule and perplexity verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    quality = PerplexityQuality().fit(docs)
    scored = written(quality.score(docs), "scored")
    return quality.verdict(scored, quality.bands(scored)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_texts(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.extendible(table(spark, sf_dir, "documents"), limit=SHARD)


def op5_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every turn of every conversation."""
    return nbest_segmentations(table(spark, sf_dir, "conversations"), vocabulary("piece_bpe_32k.model"), ["conv_id", "turn", "role"], 4)


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as one preference pair."""
    turns = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("is_chosen"), "turn", "role", "text")
    return chat.preference_pairs(turns, "pair_id", "is_chosen")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out rows are never read."""
    docs = table(spark, sf_dir, "documents")
    model = Toxicity().fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits", "n_words")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after the removal of repeated windows of 35 words."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and offset of every piece of every document."""
    return best_fit(table(spark, sf_dir, "documents"), path=vocabulary("word_bpe_49k.json"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, and the text rebuilt from it."""
    cut = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(middle.restored(F.col("output"), F.col("form")), 256)}
    return cut.withColumns(digests).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of all documents."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that other documents repeat."""
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_tokens, op3_minhash, op4_sharding, op5_nbest, op6_preference, op7_toxicity, op8_substrings, op9_packing, op10_vectors, op11_middle, op12_spelling, op13_lines)}

ORACLE_SQL: dict[str, str] = {"op4_sharding": sharding.oracle_sql(SHARD), "op6_preference": chat.ORACLE_SQL, "op11_middle": middle.ORACLE_SQL, "op12_spelling": spelling.ORACLE_SQL, "op13_lines": lines.ORACLE_SQL}
