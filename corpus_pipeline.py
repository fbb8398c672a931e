"""The corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are masked, the rest is packed.

Each stage works on all that the one before has kept. Rows of the result are those of packing:
pieces of documents in sequences of at most 1024 tokens. Null and empty texts pass every stage;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import new_folder, remove_folder, stored, table
from tessera.llm.packing import pack
from tessera.llm.secrets import redact
from tessera.llm.simhash import keep_first
from tessera.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3; a labelled one is scored by the other examples."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles of Jaccard similarity 0.8 or more, found among near SimHash fingerprints, the one with the smallest id."""
    return keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_copies), ("secret_scans", mask_secrets), ("packing", pack_windows)]

#: SQL has no nearest-neighbour votes, XXH64 shingles or tokenizers; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`.

    What a stage returns is written to the shared folder for the next, and removed when that has
    written its own; the last stage's input stays, as its result is read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        docs = stored(stage(spark, docs, sf_dir), folder)
        if before:
            remove_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
