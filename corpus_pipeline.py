"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Language identification drops rows whose language it can't tell. Line deduplication cuts repeated runs out of the texts
(and brings n_chars up to date where there is such a column), but keeps every row. SimHash keeps one document of each group.
Decontamination drops documents that overlap a benchmark item. Packing returns the pieces of the sequences.

The order of the stages is given, so a run of lines that was cut from later documents goes with its first holder where a
later stage drops that one, as a near copy of another document or for its overlap with a benchmark item.

Null, empty and letterless texts have no language and go in the first stage, whatever else they hold. A text that line
deduplication empties stays as an empty text; SimHash then keeps one of all empty ones. Long texts are read whole by every
stage. Repeated rows count as one document for lines and become one with SimHash; equal ids with other texts are documents
of their own up to the last stage; rows without an id come last in every order. Ties go to the smaller id, then to the
smaller hash of the text. Further columns, whatever their names, pass through all stages but the last. An empty table gives an
empty table at every stage, and an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankfit.llm import op1_decontamination, op2_lines, op3_language, op4_packing, op5_simhash
from rankfit.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_language.with_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_lines.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_packing.packed(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

# the language model has no form in SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
