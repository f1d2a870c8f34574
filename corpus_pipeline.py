"""The corpus pipeline: five stages of the operators in ``binsight.llm``, each
over all rows its predecessor kept.

1. language ID: texts without a known language (``und``) and those that op5 flags
   ambiguous go;
2. quality classifier: documents that op10 predicts as 0 (score below its
   ``THRESHOLD``) go;
3. MinHash near-dedup: the row with the smallest id of each group stays;
4. benchmark decontamination: documents with a hit word go;
5. packing: what is left becomes sequences of tokens.

Stages 1 to 4 return the columns of ``documents``.  A row with a null id is a
document of its own; rows that share id and text are one document, different
texts under one id are documents of their own, of which the one with the smallest
text hash comes first.  Empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm import additive_quality, curve_packing, language_codes, minmax_dedup, phrase_index
from binsight.llm.common import cut, table, written

#: words of a shingle in near-dedup, as in op9
SHINGLE = 4
#: column names of the stages' own; none of the documents' columns is called so
_OWN, _FIRST = "__stage_value", "__stage_first"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_codes.train(docs)
    return (docs.withColumn(_OWN, language_codes.predictor(model, "text"))
            .where((F.col(f"{_OWN}.lang_pred") != language_codes.UNKNOWN) & ~F.col(f"{_OWN}.ambiguous")).select(docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = additive_quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn(_OWN, additive_quality.scorer(model, "text")).where(F.col(_OWN) >= additive_quality.THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, text_hash = phrase_index.row_key("doc_id", "text")
    # all that decides between rows of a group, smallest first
    first = F.struct(F.col("doc_id").cast("long").alias("id"), text_hash.alias("text"), F.col("text").isNotNull().alias("given"),
                     F.xxhash64(*(F.col(c).cast("string") for c in docs.columns)).alias("all"))
    rows = written(docs.where("doc_id is not null").withColumn(_FIRST, first).withColumn(_OWN, F.monotonically_increasing_id()))
    found = minmax_dedup.near_duplicates(rows, _OWN, k=SHINGLE).select(F.col("doc_id").alias(_OWN), "n_shingles", "component_id")
    # rows without words are linked with nothing: only the same id and text make one document of them
    linked = F.col("n_shingles") > 0
    stay = (rows.select(_OWN, _FIRST).join(found, _OWN)
            .groupBy(linked.alias("linked"), F.when(linked, F.col("component_id")).otherwise(F.col(f"{_FIRST}.id")).alias("of"),
                     F.when(~linked, F.col(f"{_FIRST}.text")).alias("text"))
            .agg(F.min(F.struct(_FIRST, _OWN)).alias("first")).select(F.col(f"first.{_OWN}").alias(_OWN)))
    return rows.join(stay, _OWN, "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, hits = phrase_index.phrase_matches(docs, table(spark, sf_dir, "benchmark"))
    k1, k2 = phrase_index.row_key("doc_id", "text")
    return (docs.withColumn(_OWN, F.struct(k1.alias("k1"), k2.alias("k2")))
            .join(hits.select(F.struct("k1", "k2").alias(_OWN)), _OWN, "left_anti").select(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return curve_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("quality_classifier", quality), ("minhash_near_dedup", near_dedup),
          ("benchmark_decontamination", decontaminate), ("packing", packing)]
#: SQL cannot express the stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
