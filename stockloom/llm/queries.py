"""Queries of this package's operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import band, decontam, fim, fingerprint, hmm, jaccard, langid, license, mixing, pii, sharding, tokenstore, toxicity
from .common import fold
from .store import ship

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "position_share"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs), read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted", "text_language"
    )


def op9_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = tokenstore.default_path(spark)
    tokenstore.write(docs, path, tokenizer or tokenstore.default_tokenizer())
    return tokenstore.read(spark, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"), fold(7) == 2)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return license.scan(docs, license.fit(docs))


def op11_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, rows = band.priced(read(spark, sf_dir, "items")), band.unit_prices(read(spark, sf_dir, "sale_lines"))
    found = band.band_join(points, rows)
    ids = [F.col(c).cast("long").alias(name) for c, name in (("sale_id", "sale_id"), ("line_no", "line_no"), ("row_key", "line_item_id"))]
    return found.select(F.col("key").alias("item_id"), "rank", "gap", "u", *ids, "n_pairs", "gap_sum", F.col("checksum").alias("lines_crc"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(read(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_fingerprint": op3_fingerprint,
    "op4_toxicity": op4_toxicity,
    "op9_token_store": op9_token_store,
    "op10_decontamination": op10_decontamination,
    "op5_pii": op5_pii,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_lm_score": op7_lm_score,
    "op8_license_scan": op8_license_scan,
    "op11_band_join": op11_band_join,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op11_band_join": band.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_sharding": sharding.SQL,
}
