"""Ties in the one-by-one choice, within a block and across blocks."""

import pytest

from rankfit.operators import assets as OA


@pytest.mark.parametrize("block", [512, 1, 2, 3])
def test_equal_and_null_orders_use_a_url_once(spark, block):
    big = 1 << 60
    order = {"d": None, "b": None, "c": 3, "a": 3, "f": big + 1, "e": big + 2, "g": big + 2, "h": big + 2}
    rows = [(e, o, f"u{u}", 50 - u) for e, o in order.items() for u in range(7)]
    df = spark.createDataFrame(rows, "entity string, ord long, url string, score int")
    got = {r["entity"]: r["url"] for r in OA.global_exclusive_pick(df, "entity", "ord", block=block).collect()}
    assert got == {e: f"u{i}" for i, e in enumerate(["b", "d", "a", "c", "f", "e", "g"])}
