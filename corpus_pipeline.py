"""From raw documents to token ids: five stages, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perexpo.llm import bpe, language, mixing, secrets, simhash
from perexpo.llm.common import documents, stored
from perexpo.llm.queries import RANK_FILE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go. A missing label becomes the predicted one.

    None can be told in a null text, one without letters, and one none of whose n-grams any profile
    holds, as in a script that no labelled document is written in. Without labelled documents all go.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = language.predict(row, language.fit(docs), known_only=True).where(F.col("lang_pred") != language.UNKNOWN)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns}
    values["lang"] = F.coalesce(values["lang"], "lang_pred")
    return found.select(*[v.alias(c) for c, v in values.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once.

    Groups are those of op10's contract: fingerprints of three-word shingles that at most three bits
    set apart. Of several rows of the smallest id the one with the smallest checksum stays, and different
    texts under one id are kept apart. Documents without an id stay; null and empty texts are one group.
    """
    nested = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.where(F.col("doc_id").isNotNull()).select(nested, "doc_id", "text", F.xxhash64(*docs.columns).alias("checksum"))
    groups = simhash.near_duplicates(named, keep="checksum", words=simhash.WORDS, radius=simhash.RADIUS)
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", F.col("kept").alias("checksum"))).alias("first"))
    kept = named.join(first.select("first.*"), ["doc_id", "checksum"], "left_semi").dropDuplicates(["doc_id", "checksum"])
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars is counted anew; every document stays. A null text stays null."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = secrets.scan(row)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns}
    values["text"] = secrets.redact(F.col("text"), F.col("spans"))
    cleaned = found.select(*[v.alias(c) for c, v in values.items()])
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; what it does not take goes. An empty text counts nothing."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; a null text has no ids."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return bpe.decode(encoded, ranks).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"), "ids"
    )


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("byte-level BPE", tokens),
]

#: The stages are not expressible in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
