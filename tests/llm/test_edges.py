"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, through every operator and stage."""

import pytest

import corpus_pipeline
from rankfit.llm import op1_decontamination as O1, op2_lines as O2, op3_language as O3, op4_packing as O4, op5_simhash as O5
from rankfit.llm import op6_html as O6, op7_secrets as O7, op8_quality as O8, op9_forest as O9, op10_chat as O10

from .conftest import CLASHING, EDGES, LONG


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[500:540]), "x"), (2, None, None), (None, "", "y")], "item_id long, text string, h string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, None, None), (8, 0, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")


def _operators(edges, items, labels):
    pages = edges.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    return {"op1": O1.overlaps(edges, items), "op2": O2.without_repeats(edges), "op3": O3.identified(edges), "op4": O4.packed(edges),
            "op5": O5.near_duplicates(edges), "op6": O6.main_text(pages), "op7": O7.findings(edges), "op8": O8.scored(edges, labels)}


def test_operators_on_edges(edges, items, labels):
    got = {name: df.collect() for name, df in _operators(edges, items, labels).items()}
    for name in ("op2", "op3", "op5", "op6", "op7", "op8"):
        assert len(got[name]) == len(EDGES), name
    assert {(r["doc_id"], r["item_id"]) for r in got["op1"]} == {(5, 1)}
    assert sum(r["length"] for r in got["op4"] if r["doc_id"] == 1) == 1
    assert {r["text"] for r in got["op2"] if r["doc_id"] == 1} == {None}
    assert {r["component_id"] for r in got["op5"] if r["doc_id"] in (1, 2, 3)} == {1}


def test_operators_on_empty_tables(edges, items, labels):
    for name, df in _operators(edges.limit(0), items, labels.limit(0)).items():
        assert df.count() == 0, name
    assert O1.overlaps(edges, items.limit(0)).count() == 0


def test_vectors_and_turns(spark):
    v = spark.createDataFrame([(100, [1.0, 2.0], "a"), (200, [1.0, 2.0], "b"), (3, None, "c"), (None, [1.0, 1.0], "d")], "vec_id long, embedding array<double>, leaf string")
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in O9.nearest(v).collect()) == [(100, 200, 0.0), (200, 100, 0.0)]
    assert O9.nearest(v.limit(0)).count() == 0
    t = spark.createDataFrame([(1, 0, "user", LONG, "s"), (1, 0, "user", LONG, "other"), (1, None, None, None, None)], "conv_id long, turn long, role string, text string, segment string")
    assert O10.formatted(t).count() == 2
    assert O10.formatted(t.limit(0)).count() == 0


def test_stages_on_edges(spark, edges, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edges, edges.limit(0)):
        docs = docs.cache()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
                assert all(r[c] == f"{c}!" for r in rows for c in CLASHING), name
            if name == "language":
                assert not {r["doc_id"] for r in rows} & {1, 2, 3, 8}
            if name == "lines":
                assert len(rows) == docs.count()
            if name == "near_duplicates" and rows:
                ids = [r["doc_id"] for r in rows]
                assert ids.count(6) == 1 and ids.count(1) == 1 and not {2, 3} & set(ids) and ids.count(None) == 1 and ids.count(7) == 2
            if name == "decontamination" and rows:
                assert sorted(r["doc_id"] or 0 for r in rows) == sorted(i or 0 for i, *_ in EDGES if i != 5)
