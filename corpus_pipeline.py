"""The corpus pipeline: from raw documents to packed token sequences.

Each stage works on all that the one before it kept and is stored before the next begins, so a
lost executor costs at most part of one stage. All stages but the last return the columns of
`documents`:

1. quality rules drop documents that repeat themselves or hold too few words;
2. line dedup drops lines that match an earlier line of the corpus;
3. SimHash near-dedup keeps one document of each group;
4. secret scans mask what they find;
5. packing cuts and packs token pieces into sequences.

SQL cannot express the whole, so `ORACLE_SQL` is None; tests hold it against plain Python.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanepulse.llm import lines, packing, repetition, secrets, simhash
from lanepulse.llm.stored import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(docs).where("kept").select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("secret_masks", secret_masks),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the `documents` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
