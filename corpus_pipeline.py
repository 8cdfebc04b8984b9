"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of `documents`.
`run` writes what a stage returns as Parquet in the shared folder and reads it back as the next one's docs.

Defined cases, stage by stage: a null or empty text has no words, so the rules reject it; a row without doc_id is judged
by the rules and the secret scan like any other, is a near-duplicate of nothing, and neither loses nor removes a passage;
of several rows with one doc_id the near-duplicate stage keeps one; very long texts pass every stage whole; further
columns, whatever their names, go through all stages but the last; a table without n_chars keeps being one; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import jaccard, packing, quality, queries, secrets, suffixes
from callweave.llm.common import stored, table, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy `keeps`, in which length alone is no reason to go."""
    return _whole(quality.judged(_narrow(docs), "keeps").filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the smallest id. Rows without id stay."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; documents of which nothing is left go."""
    found = suffixes.suffix_dedup(_narrow(docs), with_text=True).filter("n_removed = 0 OR length(trim(kept_text)) > 0")
    return _whole(found, docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked."""
    return _whole(secrets.redact(secrets.scan(_narrow(docs))), docs, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    return packing.pack(docs, queries.vocabulary(queries.WORD_VOCABULARY))


def _narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, text, beside): what an operator reads, and all other columns where no name can clash."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias(unused(docs, "row")), *others).alias("beside"))


def _whole(found: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs from rows of `_narrow`; with a new text also its length."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("text") if text is None else text}
    if text is not None and "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col("beside")[c]).alias(c) for c in docs.columns))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: SQL cannot tokenize; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
