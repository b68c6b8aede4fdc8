import json

import pytest
from pyspark.sql import functions as F

from quillon.functions.values import shortest
from quillon.operators.explain import explain
from quillon.plans.find import find, get
from quillon.plans.request import Filter, FindRequest


def ids(df):
    return [r["_id"] for r in df.collect()]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(f"s{i}", float(v), "mx" if i % 2 else "us") for i, v in enumerate([30, 50, 70, 10, 90])]
    return spark.createDataFrame(rows, "_id string, score double, city string")


@pytest.fixture(scope="module")
def mixed(spark):
    """Values of every type under one field."""
    values = [30, 30.0, "30", "abc", True, None, [1, 2], {"x": 1}]
    rows = [(f"m{i}", json.dumps({"x": v})) for i, v in enumerate(values)] + [("m8", "{}")]
    return spark.createDataFrame(rows, "_id string, doc string").select("_id", F.parse_json("doc").alias("doc"))


@pytest.mark.parametrize("op, value, expected", [("gt", 50, {"s2", "s4"}), ("gte", 50, {"s1", "s2", "s4"}), ("lt", 30, {"s3"}), ("lte", 30, {"s0", "s3"}), ("between", (30, 70), {"s0", "s1", "s2"}), ("eq", 30, {"s0"}), ("eq", "30", {"s0"})])
def test_operators(scores, op, value, expected):
    assert set(ids(find(scores, FindRequest((Filter("score", op, value),))))) == expected


def test_conjunction_sort_limit_projection(scores):
    out = find(scores, FindRequest((Filter("city", "eq", "us"), Filter("score", "gt", 20)), "score", False, 2, ("score", "nowhere")))
    assert out.columns == ["_id", "score"]
    assert ids(out) == ["s4", "s2"]


def test_limit_without_sort_goes_by_id_and_zero_means_all(scores):
    assert ids(find(scores, FindRequest(limit=2))) == ["s0", "s1"]
    assert len(ids(find(scores, FindRequest(limit=0)))) == 5
    assert len(ids(find(scores, FindRequest(limit=100)))) == 5


def test_ties_go_by_id_and_text_sorts_as_zero(spark):
    df = spark.createDataFrame([("c", 1.0, "z"), ("a", 1.0, "y"), ("b", 1.0, "x")], "_id string, v double, t string")
    assert ids(find(df, FindRequest(sort_by="v", ascending=False, limit=3))) == ["a", "b", "c"]
    assert ids(find(df, FindRequest(sort_by="t"))) == ["a", "b", "c"]
    assert ids(find(df, FindRequest(sort_by="t"), native_sort=True)) == ["b", "a", "c"]


def test_top_k_and_pushdown_in_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = find(df, FindRequest((Filter("value", "gte", 10),), "value", False, 5, ("value",)), "event_id")
    plan = out._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(value,10" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


@pytest.mark.parametrize(
    "request_filter, expected",
    [
        (Filter("x", "eq", 30), {"m0", "m1", "m2"}),
        (Filter("x", "eq", "30"), {"m0", "m1", "m2"}),
        (Filter("x", "eq", "abc"), {"m3"}),
        (Filter("x", "eq", True), {"m4"}),
        (Filter("x", "eq", "true"), {"m4"}),
        (Filter("x", "eq", None), {"m5"}),
        (Filter("x", "gte", 0), {"m0", "m1", "m4"}),
        (Filter("x", "lt", 1), set()),
        (Filter("x", "exists"), {f"m{i}" for i in range(8)}),
    ],
)
def test_mixed_types(mixed, request_filter, expected):
    assert set(ids(find(mixed, FindRequest((request_filter,))))) == expected


def test_odd_names(spark):
    rows = [("a", json.dumps({"a.b": 1, "a b": 2, 'q"': 3, "a": {"b": 9}}))]
    df = spark.createDataFrame(rows, "_id string, doc string").select("_id", F.parse_json("doc").alias("doc"))
    for name, value in (("a.b", 1), ("a b", 2), ('q"', 3)):
        assert ids(find(df, FindRequest((Filter(name, "eq", value),)))) == ["a"]
    typed = spark.createDataFrame([("a", 1.0)], "_id string, `a.b` double")
    assert find(typed, FindRequest((Filter("a.b", "gte", 1),), projection=("a.b",))).columns == ["_id", "a.b"]


def test_bad_requests():
    for bad in (("x", "near", 1), ("x", "between", 1), ("x", "gt", "a"), ("", "eq", 1)):
        with pytest.raises(ValueError):
            Filter(*bad)


def test_shortest_text():
    assert [shortest(x) for x in (30.0, 1.5, 1e21, 1e-7, 0.0, 123456789.0)] == ["30", "1.5", "1e+21", "1e-07", "0", "123456789"]


def test_get_and_explain(scores):
    assert ids(get(scores, "s1")) == ["s1"] and ids(get(scores, "none")) == []
    e = explain(scores, FindRequest((Filter("city", "eq", "mx"),)), dry_run=False)
    assert (e.strategy, e.index, e.scanned, e.matched) == ("index_eq", "city", 5, 2)
    assert explain(scores, FindRequest((Filter("score", "gt", 1),))).strategy == "index_range"
    assert explain(scores, FindRequest()).strategy == "full_scan"
