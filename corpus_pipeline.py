"""A training corpus from `documents` in five stages: quality, near copies, secrets, mixture, tokens.

All stages take null and empty texts, repeated rows and empty tables; extra columns come through as they are, whatever
their names, up to the last stage, which gives tokens only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm import bpe, mixing, quality, secrets, simhash
from loadlens.llm.common import intermediates, keep, table
from loadlens.llm.queries import MIX_SEED, domain_and_tokens, mix_weights, vocabulary

#: Share of the tokens that reach the mixture which it takes, each document once at most.
MIX_SHARE = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored as texts without words; equal texts go or stay alike."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays. Null and empty texts are copies of each other; rows without an id stay."""
    return simhash.kept_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and n_chars counts the new text; no document goes. Null and empty texts have none."""
    return secrets.redacted(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's share of the token budget stay. Null and empty texts have no tokens and stay if their place is within it."""
    domain, tokens = domain_and_tokens()
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return mixing.taken(docs, levels, mix_weights(spark), MIX_SHARE, tokens, seed=MIX_SEED).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, a row for each document; null and empty texts have no ids."""
    return bpe.encode(docs, *vocabulary())


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup), ("secret scan", secret_scan), ("source mix", source_mix), ("byte-level BPE", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. Each is written and read again; its input, and what it wrote besides, is deleted when its result is there."""
    docs, used_up = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with intermediates(spark) as written:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{i}")
            result = written.pop()
            written += used_up
            used_up = [result]
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the near copies and the tokens are beyond SQL.
ORACLE_SQL = None
