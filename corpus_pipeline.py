"""A training corpus from raw documents, stage by stage.

Each stage calls one operator of ``arealens.llm`` on all rows its predecessor
kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealens.llm import jaccard_join, language_id, line_dedup, mixing, packing
from arealens.llm.common import WORD_PATTERN, row_keys, written
from arealens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: learned from the labelled rows; rejected documents go, and rows without a lang get the
    predicted one.

    Null and empty texts, texts without letters and narrow margins (ties) are rejected; texts of any length are
    classified whole; repeated rows are classified alike."""
    learned = language_id.learn(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    kept = language_id.identify(docs.select(*COLUMNS), learned).where("not rejected")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id as ``id``, and as doc_id a key of the row if doc_ids repeat."""
    own = docs.select(*COLUMNS)
    keyed = row_keys(own)
    if keyed is None:
        return own.withColumn("id", F.col("doc_id"))
    return keyed.withColumnsRenamed({"doc_id": "id", "row": "doc_id"})


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts without their repeated lines; documents of which no word is left go.

    Null and empty texts stay as they are; of equal lines the first by doc_id, row and place stays, so of repeated
    rows one keeps its text; a long text is cut into its lines like any other."""
    found = line_dedup.dedup(_by_row(docs), fold_short=True)
    lost = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(WORD_PATTERN)
    return found.where(~F.coalesce(lost, F.lit(False))).select(
        F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source",
        F.length("kept_text").cast("bigint").alias("n_chars"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each group stays, once.

    Null and empty texts are groups of their own; of rows that tie by doc_id the one with the first text stays;
    long texts take part with all their shingles."""
    own = _by_row(docs)
    stay = jaccard_join.representatives(own).withColumnRenamed("doc_id", "stay")
    kept = own.join(stay, own["doc_id"].eqNullSafe(stay["stay"]), "left_semi")
    return kept.drop("doc_id").withColumnRenamed("id", "doc_id").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the documents that the mixture takes; one epoch, so each at most once.

    Null lang and source are a value of their own; null and empty texts have no tokens and are not taken; ties in
    the seeded order go by doc_id; a long text counts with all its tokens."""
    mixed = mixing.mix(docs.select(*COLUMNS), share=0.9, weights={"lang": {"en": 3}}, max_epochs=1, seed=7)
    return mixed.where("copies > 0").select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all sequences, with their ids.

    Null and empty texts are their closing id; a long text runs over as many sequences as it needs; repeated rows
    are packed once each."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

# Compression sizes, bit-parallel distances and token ids have no SQL form;
# tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
