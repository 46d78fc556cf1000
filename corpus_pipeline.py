"""The corpus pipeline: language, lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again
before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import language_mix, line_dedup, packing, secret_scan, tokens, weighted_minhash
from tenderlens.llm.common import digest, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language of the corpus; those without a letter, or whose trigrams an even chance explains better, go.
    Where no row names a language none can be told, and every text with a letter stays."""
    model = language_mix.learn_from(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_mix.identify(docs, model)
    return found.filter((F.col("lang_pred") != language_mix.UNKNOWN) & (F.col("likelihood") > 0)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay in the first of them only; n_chars follows the text.

    A document that has nothing left but blanks goes if another one of the same lines stays,
    whole or in part. Where all documents of the same lines were emptied, as their lines stay
    in different documents, the least of them (by doc_id, then text) keeps its whole text.
    """
    had = F.col("_had")
    marked = line_dedup.drop_common_lines(docs.withColumn("_had", F.col("text")), line_dedup.MIN_DOCS, keep_first=True)
    emptied = F.coalesce((F.btrim("text", F.lit(line_dedup.BLANKS)) == "") & (F.btrim(had, F.lit(line_dedup.BLANKS)) != ""), F.lit(False))
    lines = F.array_join(F.transform(line_dedup.split_lines(had), line_dedup.line_key), "\n")
    k1, k2 = digest(lines)
    own = F.struct(F.col("doc_id").alias("doc_id"), F.struct(*digest(had)).alias("text"))
    kept = stored(
        marked.withColumns({"_emptied": emptied, "_k1": k1, "_k2": k2, "_own": own}).withColumn("_had", F.when(F.col("_emptied"), had))
    )
    alone = kept.groupBy("_k1", "_k2").agg(F.bool_and("_emptied").alias("all_emptied"), F.min(F.when(F.col("_emptied"), F.col("_own"))).alias("_least"))
    alone = stored(alone.filter("all_emptied"))
    whole = kept.filter("_emptied").join(alone, ["_k1", "_k2"]).filter(F.col("_own").eqNullSafe(F.col("_least"))).withColumn("text", had)
    kept = kept.filter("NOT _emptied").select(*docs.columns).unionByName(whole.select(*docs.columns))
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id; texts without words stay, null ones
    too, and of repeated rows one stays. Whole texts are compared, extra columns stay, an empty table has no rows."""
    return weighted_minhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are overwritten in the text; every document and column stays, null and empty texts as they are."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all whole texts, as op1 gives them; a null or empty text is its end alone, an empty table has no piece."""
    return packing.pack_documents(docs, tokens.tokenizer_file(packing.TOKENIZER), with_ids=False)


STAGES = [
    ("language", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Trained models and tokenizers are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
