"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, hosts, lm, mixing, phrases, pii, quality, rules, simhash, tokens, topk, warc
from .common import crc_bucket, table

#: Verdict, and host and path, of the URL rules.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The key of the pseudonyms; a deployment passes its own secret to the operator.
PII_KEY = "minutes"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = topk.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("v", F.transform("v", lambda x: topk.scaled(x)))
    return topk.search(whole, F.col("vec_id") % 50 == 0, k=5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", "n_replaced", *(f"n_{k}" for k in pii.KINDS))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, bits=64, radius=2)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), budget_share=1.0, entropy_gain=0.5, max_repeat=4.0)
    return found.select("doc_id", "source", F.round("mix_weight", 6).alias("mix_weight"), "mix_epoch", "mix_block", "mix_slot")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, span=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, cut=0.3)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_bucket(F.col("doc_id"), 7) == 2).alias("held_out"))
    return lm.score(docs, docs.where(~F.col("held_out")), keep=("doc_id", "held_out"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"), "votes_against")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, percent=50, most=2000)
    return found.withColumn("rank", F.col("rank").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_topk, op3_token_counts, op4_pii, op5_simhash, op6_mixing, op7_decontamination, op8_url_filter, op9_quality, op10_lm_scores, op11_vector_codes, op12_quality_rules, op13_collocations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, seeded hashes, keyed permutations and trained models are beyond SQL: tests hold those queries
    against brute force instead."""
    return {
        "op1_warc": warc.sql("pages"),
        "op2_topk": topk.sql("embeddings", 50, 5),
        "op6_mixing": mixing.sql("documents", 1.0, 0.5, 4.0),
        "op7_decontamination": decontam.sql("documents", "benchmark", 10, 20),
        "op11_vector_codes": codes.sql("embeddings", 16, 64, 2),
        "op13_collocations": phrases.sql("documents", 10, 50, 2000),
        "op8_url_filter": hosts.sql("pages", "labels", URL_RULES),
    }
