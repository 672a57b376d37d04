"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetrail.llm import chat_format, checks, decontamination, html_text, language_id, lm_scoring, near_dedup, packing, rotated_codes, text_fingerprint, token_alignment, token_counts, warc, whitening
from edgetrail.llm.common import ship

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the labelled documents of good quality that are not toxic."""
    wanted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), wanted)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path(TOKENIZER)
    return chat_format.digests(chat_format.read_back(chat_format.format_conversations(turns.unionByName(more), path), path))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    found = language_id.identify(docs, *model)
    return found.select("doc_id", language_id.is_held_out().alias("held_out"), "lang_pred", "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.nearest(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return token_alignment.score_links(found.withColumn("groups_sha256", digest).drop("groups"))


def op12_text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_packing, op2_lm_scoring, op3_chat_format, op4_language_id, op5_near_dedup, op6_html_text, op7_warc, op8_rotated_codes, op9_token_counts, op10_decontamination,
    op11_token_alignment, op12_text_fingerprint, op13_whitening,
)
QUERIES = {f.__name__: f for f in _ALL}
CHECKS = checks.CHECKS
