"""A training corpus from raw documents, in five stages; each reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.llm.decontaminate import contamination
from dataward.llm.language_id import languages
from dataward.llm.minhash_dedup import NearDuplicates, near_duplicates
from dataward.llm.packing import packed
from dataward.llm.personal_data import redacted
from dataward.llm.shared import shared_folder


#: Near copies in the corpus: five-word shingles, 0.8 or more of them in common. A link at 0.8 meets in none of 30
#: bands of four minima with a probability of (1 - 0.8^4)^30, below 1e-6.
NEAR = NearDuplicates(percent=80, bands=30, rows=4)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a ``_key`` that no two different texts share: the id where ids are whole and unique, or
    else a text made of id and content, in the order of the ids, rows without an id last."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return docs.withColumn("_key", F.concat_ws("-", F.coalesce(place, F.lit("z")), F.coalesce(F.sha2("text", 256), F.lit("none"))))


def _by_key(keyed: DataFrame) -> DataFrame:
    """What an operator gets: the key as its id."""
    return keyed.drop("doc_id").withColumnRenamed("_key", "doc_id")


def _kept(keyed: DataFrame, keep: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    return keyed.join(keep.select(F.col("doc_id").alias("_key")).distinct(), "_key", how).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: null texts and texts without a letter go, each row by its own text.
    Rows without an id, and different texts under one id, are judged one by one; an empty table stays empty."""
    keyed = _keyed(docs)
    return _kept(keyed, languages(_by_key(keyed)).where(F.col("lang_pred") != "und"), docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, once: by id, rows without an id last. Different texts
    under one id are different documents; a row that is there twice stays once."""
    keyed = _keyed(docs)
    found = _kept(keyed, near_duplicates(_by_key(keyed), NEAR).where("kept"), [*docs.columns, "_key"])
    if keyed.schema["_key"].dataType != docs.schema["doc_id"].dataType:
        found = found.dropDuplicates(["_key"])
    return found.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, each row by its own text."""
    keyed = _keyed(docs)
    found = contamination(_by_key(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    return _kept(keyed, found, docs.columns, "left_anti")


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicate", near_duplicate), ("decontamination", decontamination),
          ("personal", personal), ("packing", packing)]

#: Hashes of token ids and sequence numbers have no SQL; stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
