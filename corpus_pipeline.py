"""The corpus pipeline: documents through five operators, each stage written as Parquet and read by the next.

Only the first four stages decide which documents stay; the last encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, small, spaced, table
from tidemark.llm.decontam import contaminated
from tidemark.llm.dedup import near_duplicates
from tidemark.llm.langid import fit, identify, in_language
from tidemark.llm.quality import quality
from tidemark.llm.spm import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less sure than this goes.
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence limits; null and empty texts go.

    Texts of any length are counted whole; repeated rows go or stay together, an empty table gives an empty one, columns beside those of documents are left behind.
    """
    return quality(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, learned from the stage's own labelled documents.

    A document goes if it is no more likely in one language than in the others, or if it fits its language much worse than that language's documents usually
    do. Null texts and those without a letter go; null languages count as unlabelled; without any label nothing is known and nothing stays.
    """
    out = saved(identify(docs.select(*COLUMNS), fit(docs.select("text", "lang"))), "identified", "zstd")
    return in_language(out.where(F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class; of rows that share that id, the one whose other columns sort first.

    Documents without an id or without words have no class and stay, each of them.
    """
    classes = near_duplicates(docs.select("doc_id", "text"), key="text_key")
    gone = small(saved(classes.where("doc_id <> class_id").select("doc_id", "text_key").distinct(), "gone"))
    rows = docs.select(*COLUMNS, F.unhex(F.md5(spaced(F.col("text")))).alias("text_key"))
    left = rows.join(gone, ["doc_id", "text_key"], "left_anti").select(*COLUMNS)
    twice = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return left
    left, twice = saved(left, "left", "zstd"), small(twice)
    some = left.join(twice, "doc_id", "left_semi").withColumn("bare", spaced(F.col("text")) == "")
    one = some.where(~F.col("bare")).groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return left.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS)).unionByName(some.where("bare").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none and stay, as all do where the benchmark is empty.

    Texts of any length are scanned whole; repeated rows go or stay together, an empty table gives an empty one, columns beside those of documents are left behind.
    """
    out = contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where("n_hit = 0").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_ids of every document; null and empty texts have no ids, repeated rows give repeated results.

    Texts of any length are encoded whole; an empty table gives an empty one, columns beside those named are left behind.
    """
    out = encode(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("language identification", language_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Several stages can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None
