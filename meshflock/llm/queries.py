"""One query per operator, over the whole of its table; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflock.llm import lang_id, mixing, near_dup, packing, pii, quality, suffix_dedup, toxicity, ts_media, url_filters
from meshflock.llm.sampling import held_out, in_training
from meshflock.runtime import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(packing.tokenize(table(spark, sf_dir, "documents"), *tokenizer_files()), "pieces")
    return packing.pack(pieces)


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filters.RULES).drop("url")


ORACLES["op2_url_filters"] = url_filters.ORACLE


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voted = materialize(quality.with_votes(quality.signals(docs).drop("text")), "quality")
    model = quality.fit(materialize(quality.patterns(voted), "patterns"))
    return quality.judged(voted, model).select("doc_id", *quality.BASE, "base_failed", "kept", "quality")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = mixing.domain_labels(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, mixing.TARGETS, mixing.BUDGET)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(in_training()).select("doc_id", "lang", "text"))
    return lang_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(in_training()).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op7_ts_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), ts_media.padded().alias("payload"))
    got = ts_media.from_stream(materialize(ts_media.to_stream(docs), "media"))
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.format_string("packets=%d", "n_packets"), F.format_string("pes=%d", "n_pes"), F.format_string("gaps=%d", "n_gaps"), F.format_string("access=%d", F.size("access_points")),
                    F.concat(F.lit("pts="), F.concat_ws(",", F.transform("access_points", lambda p: p["pts"].cast("string"))))).alias("feature"),
        "access_points",
    )


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "masked")


@query
def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group(table(spark, sf_dir, "documents").select("doc_id", "text"))
