"""One query per operator on the given tables, and the same result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm import (
    chat, exact_dedup, licences, manifest, mixing, near_dedup, packing, pii, quality_model, quality_rules, secrets, sharding, spelling,
)
from draftlake.llm.common import span_text
from draftlake.llm.oracles import ORACLES

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)


@query
def op1_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules.line_frequency(docs).select("doc_id", "rules.*")


@query
def op3_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    rows = docs.select("doc_id", "text", digest.alias("text_sha256"))
    return exact_dedup.exact_groups(rows).select("doc_id", "exact.*", "text_sha256")


@query
def op8_schema_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    record = F.to_variant_object(F.struct("role", "text"))
    out = chat.format_rows(rows, "conv_id", "turn", record).select(
        "conv_id", "text", chat.parsed(F.col("text")).alias("turns"),
        chat.masked_text(F.col("text"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("bigint").alias("formatted_chars"),
    )


@query
def op10_subword_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_model.classify(docs, table(spark, folder, "labels")).select("doc_id", "quality.*")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op9_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer=tokenizer_file())


@query
def op5_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_components(table(spark, folder, "documents")).drop("h")


@query
def op7_template_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licences.scan(docs).select("doc_id", "licence.*")


@query
def op2_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"), carry=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


@query
def op4_credential_links(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in secrets.BASE], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


@query
def op6_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix.*")


@query
def op11_reduced_alphabet(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.word_counts(table(spark, folder, "documents"))
    return spelling.variants(words.where("n >= 3"))


@query
def op12_longest_first(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op13_nested_intervals(spark: SparkSession, folder: str) -> DataFrame:
    kept = ["doc_id", "source", "lang", "n_chars"]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = manifest.leaf(*[F.col(c) for c in kept], F.replace("text", F.lit("\n"), F.lit("")))
    rows = table(spark, folder, "documents").select(
        "doc_id", "source", manifest.leaf(*[F.col(c) for c in kept], F.col("text")).alias("leaf"), F.when(changed, without).alias("tampered")
    )
    again = manifest.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = manifest.manifest(rows).select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("steps")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
