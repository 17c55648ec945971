import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
EDGES = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "x", None, "s", 1), (None, "no id at all here", "en", "s", 17),
         (5, LONG, "en", "s", len(LONG)), (6, "same row twice, with some words in it", "en", "s", 37), (6, "same row twice, with some words in it", "en", "s", 37),
         (7, "same id, first text of the two", "en", "s", 30), (7, "same id but another text entirely", "de", "s", 33), (8, "12 34 !?", "de", "s", 8),
         (9, "é\U0001f642 ñandú \x00 ​", "es", None, 5)]
CLASHING = ["row", "fp", "tokens", "n_lines", "n_removed", "cuts", "key", "score", "component_id", "d", "held_out", "n", "lines", "keep", "bad", "a.b"]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, and further columns with clashing names."""
    rows = [(*r, *[f"{c}!" for c in CLASHING]) for r in EDGES]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


@pytest.fixture
def docs_of(spark):
    def make(texts, **columns):
        rows = [(i, t, *[v[i] for v in columns.values()]) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in columns]]))

    return make
