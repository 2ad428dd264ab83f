"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. toxicity        rejects toxic documents
2. line_dedup      deletes later copies of repeated line runs of 50 words or more from the texts
3. near_dedup      keeps one document of each class of near duplicates
4. decontaminate   drops documents that hold a benchmark window of ten words
5. bpe             encodes what is left

Every stage keeps rows it has no reason to drop, rows with null ids or texts among them.  All stages but the last
return the columns of ``documents``, and further ones if it has any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvora.llm.bpe import encode, tokenizer_file
from curvora.llm.common import fresh, materialise, number_rows, read_table
from curvora.llm.decontaminate import contamination
from curvora.llm.line_dedup import dedup_lines
from curvora.llm.minhash import near_classes
from curvora.llm.toxicity import fit_toxicity, score_toxicity

#: Documents whose score is at least this are rejected.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by their texts; the model is fitted on labelled documents of this stage's input.

    Null and empty texts have the least score of all and stay; very long texts are scored whole; equal texts (ties,
    repeated rows) have one score; an empty table, or one without labels, gives the rows of its input.
    """
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "__toxicity")
    return score_toxicity(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; n_chars is counted anew where a text has changed.

    Every row stays.  Null texts stay null; a text all of whose lines are copies becomes empty; rows with null doc_ids come
    first, rows of one doc_id by a hash of their texts; very long texts are read whole; an empty table gives no rows.
    """
    kept, lines, deleted = fresh(docs.columns, "__kept_text", "__n_lines", "__n_deleted")
    cut = dedup_lines(docs, columns=(kept, lines, deleted))
    new = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(deleted) > 0, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of least doc_id.

    Rows are decided one by one, so a row goes by its own text and not by another one's of the same doc_id.  Null doc_ids
    come last; of rows with equal doc_ids in one class, repeated rows among them, one stays (that of least hash of the
    text); null texts count as empty, and one row of those stays; an empty table gives no rows.
    """
    row, gone_row = fresh(docs.columns, "__row", "__gone")
    docs_in_order = number_rows(docs, row, nulls_last=True)
    classes = near_classes(docs_in_order.select(F.col(row).alias("row"), "text"))
    gone = materialise(classes.where("row != class_row").select(F.col("row").alias(gone_row)), "near-gone", small=True)
    return docs_in_order.join(gone.hint("merge"), F.col(row) == F.col(gone_row), "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with an occurrence of a benchmark window.

    Rows are decided one by one, whatever their doc_ids; null and empty texts have no windows and stay; very long texts
    are read whole; an empty table, or an empty benchmark, gives the rows of its input.
    """
    row, bad_row = fresh(docs.columns, "__row", "__bad")
    docs_in_order = number_rows(docs, row)
    found = contamination(docs_in_order.select(F.col(row).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    bad = materialise(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(bad_row)), "contaminated", small=True)
    return docs_in_order.join(bad.hint("merge"), F.col(row) == F.col(bad_row), "left_anti").select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document that is left."""
    return encode(docs, tokenizer_file(), keep_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]

#: SQL can express neither the toxicity model nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
