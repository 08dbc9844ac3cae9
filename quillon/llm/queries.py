"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid, oracle, toxicity
from quillon.llm.decontaminate import decontaminate
from quillon.llm.matroska import store_media
from quillon.llm.neardup import near_duplicates
from quillon.llm.pack import MAX_ATTENTION, MAX_DOCS, WEIGHTS, pack
from quillon.llm.pagediff import extract
from quillon.llm.secrets import find_secrets
from quillon.llm.substring import remove_repeats
from quillon.llm.warc import PREFIX, archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] != "pair")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    refers = F.regexp_extract("refers_to", f"^<{PREFIX}(-?[0-9]+)>$", 1).cast("long")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", refers).alias("refers_to"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(table(spark, sf_dir, "documents"), with_media=False)


def _remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(_remainder("doc_id", 4) != 2))
    return langid.identify(docs, model).select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0))
    return toxicity.score_toxicity(docs, model).select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, max_docs=MAX_DOCS, max_attention=MAX_ATTENTION, rule="norm", weights=WEIGHTS)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
