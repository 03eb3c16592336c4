"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, byte_bpe, chat, fingerprints, hard_negatives, jaccard_join, language_id, line_dedup, mixing, packing, secret_scan, substring_dedup

# Production parameters.
MIX = {"share": 0.8, "weights": {"lang": {"en": 3}}, "max_epochs": 2, "seed": 7}


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links",
                        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("found", lambda x: x["kind"].isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
                        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("found")).alias("spans"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    learned = language_id.learn(docs.where(~held_out), F.col("doc_id"), F.col("text"), F.col("lang"))
    found = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), learned)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = ann.nearest(vectors, "vec_id", "embedding", F.col("id") % 50 == 0, 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixing.mix(docs, **MIX).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"),
                            tokenizer_path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(vectors.withColumn("label", moved), "vec_id", "label", "embedding", F.col("id") % 100 == 0)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                        "positive_score", "negative_score")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pack": op2_pack,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_fingerprints": op7_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_nearest": op9_nearest,
    "op10_mix": op10_mix,
    "op11_align": op11_align,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}
