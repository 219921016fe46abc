"""A corpus from `documents`: language, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Each begins with executors giving back what the stage before left. SQL cannot express the stages (trained models,
SimHash components, tokenizers), so ORACLE_SQL is None, and tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import op1_pii, op4_simhash_gph, op6_byte_cnn, op9_cutting_stock, op10_substring_lsm
from cairn.llm.common import kept, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its language is undetermined, or less probable than this.
LEAST_SURE = 0.35
#: Fingerprints of a document, any of which makes it a candidate for a near-duplicate.
FINGERPRINTS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the network learns from this corpus's own labels. Where there is none to learn from,
    all documents with a letter stay, as no language can be told. Null and empty texts, and those without a letter, go; rows
    that are repeated, or have no doc_id, are judged each by its text; an empty table stays empty."""
    settle(spark)
    net = op6_byte_cnn.fit(docs)
    if not net.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = op6_byte_cnn.identify(docs, net, ("text", "lang", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != op6_byte_cnn.UNDETERMINED) & (F.col("score") >= LEAST_SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Rows of one doc_id stay or go together,
    and those of a null doc_id stay; texts without a word are alike; an empty table stays empty."""
    settle(spark)
    return docs.join(op4_simhash_gph.repeats(docs, FINGERPRINTS), "doc_id", "left_anti").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document has; those left without a word, by that, go. Texts that
    lose nothing stay as they are, null ones too; rows of one doc_id do not count as each other's repeats."""
    settle(spark)
    cut = op10_substring_lsm.dedup(docs.select(*COLUMNS))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("kept") != ""))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; all rows stay, repeated ones and those without a doc_id
    too. A null text becomes an empty one."""
    settle(spark)
    found = op1_pii.annotate(docs, op1_pii.fit(docs), ("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, where each lies in the sequences, and its ids (little-endian unsigned 32-bit). A null or empty text
    has the end id alone; each row is a document of its own; other columns are ignored."""
    import public_tokenizers

    settle(spark)
    return op9_cutting_stock.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
