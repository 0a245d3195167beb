"""Registered queries of the training-data operators."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanepulse.llm import (
    bpe,
    languages,
    lines,
    merkle,
    minhash,
    neighbours,
    packing,
    repetition,
    resample,
    secrets,
    simhash,
    substrings,
    urls,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Site names whose pages make up the list of unwanted URLs.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_bpe(spark, sf_dir):
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER).drop("text")


def op6_secrets(spark, sf_dir):
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"))


def op7_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op8_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urls.url_host(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_SITES)})\."))
    return urls.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "canonical")


def op1_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op2_substring_dedup(spark, sf_dir):
    """One row per span that other documents share."""
    return substrings.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark, sf_dir):
    """One row per removed line: its place, the first line of the same words, and an earlier
    matching line of other words where one settled it."""
    gone = lines.removed_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return gone.select(
        F.nullif("d", F.lit(lines.LAST_ID)).alias("doc_id"), "line",
        F.nullif("first_d", F.lit(lines.LAST_ID)).alias("first_doc_id"), "first_line",
        F.col("match_d").alias("match_doc_id"), "match_line")


def op4_repetition(spark, sf_dir):
    return repetition.repetition_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_languages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = languages.fit(docs.where(~held_out))
    return languages.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op10_simhash(spark, sf_dir):
    found = simhash.simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_resample(spark, sf_dir):
    return resample.resample(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"),
        keep=["doc_id"])


def op13_manifest(spark, sf_dir):
    """Where 3 divides the id's checksum, the text is found with its A-Z in lower case."""
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), tampered={"text": lowered}, suspect=suspect)
    found = merkle.folded(F.col("seen"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        found.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_packing": op1_packing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_repetition": op4_repetition,
        "op5_bpe": op5_bpe,
        "op6_secrets": op6_secrets,
        "op7_neighbours": op7_neighbours,
        "op8_url_filter": op8_url_filter,
        "op9_languages": op9_languages,
        "op10_simhash": op10_simhash,
        "op11_minhash": op11_minhash,
        "op12_resample": op12_resample,
        "op13_manifest": op13_manifest,
    }
