"""One query per operator over its whole table, with the reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_decontamination, op2_lines, op7_secrets, op11_lexical
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_packing import packed

    return packed(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_decontamination", op1_decontamination.ORACLE)
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_lines", op2_lines.ORACLE)
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_secrets", op7_secrets.ORACLE)
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secrets.findings(table(spark, sf_dir, "documents"))


@query("op3_language")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_language import identified

    return identified(table(spark, sf_dir, "documents"))


@query("op8_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_forest")
def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query("op10_chat")
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_chat import formatted

    return formatted(table(spark, sf_dir, "conversations"))


@query("op6_html")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_html import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query("op11_lexical", op11_lexical.ORACLE)
def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_whitening")
def _whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


@query("op13_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
