"""A training corpus from `documents`: language ID, line dedup, near dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.decontamination import decontaminate
from lexiquarry.llm.language_id import fit, identify
from lexiquarry.llm.line_dedup import line_dedup as drop_lines
from lexiquarry.llm.near_dedup import near_dedup as drop_copies
from lexiquarry.llm.packing import pack_documents
from lexiquarry.llm.shared import Scratch


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table's labels teach: a text goes if even the likeliest of them explains its
    letters no better than an even draw does, as with random letters or other scripts.

    Null and empty texts and texts without letters go; so does all text if no row is labelled. Repeated rows and
    ties stay or go together; an empty table gives an empty one; other columns pass through, whatever their names."""
    model, names = fit(docs, _vocabulary("piece_bpe_32k.model")), [f"__lq_{k}" for k in range(len(docs.columns))]
    tagged = identify(docs.toDF(*names), model, names[docs.columns.index("text")])  # each text goes through Python once
    return tagged.filter("lang_pred <> 'und' and lift > 0").select(*names).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay in the first of them only; documents of which nothing is left go.

    Null texts become empty; empty texts stay, for they lost nothing. Repeated rows count as documents of their own, and
    the first of them by id keeps the line, with its repeated rows. An empty table gives an empty one."""
    out = drop_lines(docs, min_docs=10, keep_first=True)
    left = (F.col("__lq_dropped") == 0) | (F.length(F.regexp_replace("text", r"\s", "")) > 0)
    return out.filter(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id, null ids first.

    Null texts count as empty; texts without words match only equal ones. Of repeated rows one stays. Ties in the id
    are broken by place in the input. An empty table gives an empty one."""
    return drop_copies(docs, threshold=0.8, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay. Repeated rows stay or go together; an empty table gives an empty one."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8, width=5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of 4096 tokens.

    Null and empty texts are one token, the end id; null ids stay null. Repeated rows and ties are packed like
    others; an empty table gives an empty one."""
    return pack_documents(docs, _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Language ID, signatures and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
