"""The registered queries of this subpackage and their SQL twins.

Each query applies its operator to the whole table; digest columns are derived here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.llm import (
    bpe, decontaminate, fingerprints, jaccard, licenses, merkle, pii, secrets, spelling, toxicity, transducer, urls, warc,
)
from bandwright.sources.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kinds(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(_table(spark, folder, "documents").select("doc_id", "text"))
    kinds = [rule.kind for rule in secrets.BASE]
    return found.select(
        "doc_id", *[F.size(_of_kinds("spans", k)).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(_of_kinds("spans", *kinds)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(_table(spark, folder, "documents"))


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_next(_table(spark, folder, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, _table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(_table(spark, folder, "pages"), path)
    return warc.page_records(spark, path)


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages").select("page_id", "url")).drop("url")


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return licenses.find(docs).select("doc_id", "n_matches", "license", "dice")


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.annotate(docs, pii.train(docs))
    return found.select(
        "doc_id", *[F.size(_of_kinds("base_spans", k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, _table(spark, folder, "labels"))
    return toxicity.score(docs, weights).select("doc_id", "held_out", "score", "predicted")


def vocabulary_path() -> str:
    """The public byte-level vocabulary of this installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with the digests of the ids and of the text decoded from them."""
    both = bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(_table(spark, folder, "documents"), vocabulary_path())


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    tampered = F.when(marked, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.prove(_table(spark, folder, "documents"), tampered).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", "verified",
    )


def rank_file_path() -> str:
    """The public rank file for many languages of this installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op12_transducer(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    both = transducer.encode(docs, rank_file_path(), decoded="decoded", packed="packed")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


REGISTRY: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_urls": op6_urls,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_merkle": op11_merkle,
    "op12_transducer": op12_transducer,
    "op13_spelling": op13_spelling,
}
