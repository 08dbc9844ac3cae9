"""A training-corpus pipeline of five stages; each works on all that the one before kept.

toxicity: documents scored 0.5 or more go. near_duplicates: of every group linked at a similarity of 0.8 on five-word shingles the document
with the smallest id stays, of equal rows one. decontamination: documents with a benchmark passage go. secrets: secret values are replaced by a mark. packing: the documents
become sequences of at most 4096 tokens. Every stage but the last returns the columns of documents.

Null texts count as empty: they have no toxic window, no duplicates, no passage and no secret, and so stay. Rows with a null id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import toxicity
from quillon.llm.decontaminate import decontaminate
from quillon.llm.neardup import near_duplicates
from quillon.llm.pack import pack
from quillon.llm.secrets import find_secrets
from quillon.llm.store import Written

MARK = "[SECRET]"
BROADCAST_IDS = 2_000_000


def _packed(docs: DataFrame) -> DataFrame:
    """The text and all other columns as one, so that no name of theirs meets one of a stage's."""
    return docs.select("text", F.struct(*(c for c in docs.columns if c != "text")).alias("_row"))


def _unpacked(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(_packed(docs), model, keep=("text", "_row"))
    return _unpacked(scored.where("toxicity < 0.5"), docs.columns)


def _without(docs: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """docs whose column is not among the ids. So many ids, by their count, take 16 MB and some 64 MB as a hash table, and spare the texts a shuffle."""
    gone = Written(ids.toDF(column).distinct(), "gone").read()
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, column, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _packed(docs).withColumn("_id", F.col("_row.doc_id").cast("long"))
    again = Written(rows.where("_id is not null").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id", F.lit(True).alias("_again")), "repeated-ids").read()
    if again.isEmpty():
        gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
        return _unpacked(_without(rows, "_id", gone), docs.columns)
    # rows of one id are told apart by their text, under a hash of both; equal rows are one document
    rows = rows.join(again, "_id", "left").withColumn("_n", F.when(F.col("_again"), F.xxhash64("_id", "text")).otherwise(F.col("_id")))
    found = Written(near_duplicates(rows, doc_id="_n").where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("_n"), "component_id").distinct(), "components").read()
    names = rows.where("_again").select("_n", "_id").distinct()
    named = found.join(names, "_n", "left").select("component_id", F.struct(F.coalesce("_id", "_n").alias("id"), "_n").alias("row"))
    least = named.groupBy("component_id").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most")
    rest = _without(rows, "_n", named.join(least, "component_id").where("row > least").select("row._n"))
    copies = F.coalesce(F.col("_again") & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))  # texts without a word have no duplicates
    return _unpacked(rest.where(~copies).unionByName(rest.where(copies).dropDuplicates(["_n"])), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("text", "_row"))
    return _unpacked(found.where(F.size("hit_spans") == 0), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_secrets(_packed(docs), keep=("_row",), redact=MARK)
    size = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    return _unpacked(found if size is None else found.withColumn("_row", F.col("_row").withField("n_chars", size)), docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack_documents)]

#: SQL can't express the learned stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Written(stage(spark, docs, sf_dir), f"stage-{name}").read()
    return docs
