from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolith.operators.predicates import Field, all_of, any_of, compare, from_expression, from_json, guaranteed, to_json, validate, where


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("Bob", "10.0.0.5", 5, datetime(2024, 1, 1), True, ["a", "B"], {"N": "7"}),
        (None, None, None, None, None, None, None),
        ("alice*", "fe80::1", 9, datetime(2024, 2, 1), False, ["b"], {"n": "x"}),
    ]
    return spark.createDataFrame(data, "who string, ip string, count int, when timestamp, flag boolean, tags array<string>, values map<string,string>")


W, C, T, N = Field("who"), Field("count"), Field("tags"), Field("n")
BOB, NONE, ALICE = "Bob", None, "alice*"


@pytest.mark.parametrize(
    ("predicate", "expected"),
    [
        (W == "bob", [BOB]), (compare("who", "Equal", "bob", ignore_case=False), []), (W != "bob", [NONE, ALICE]), (~(W == "bob"), [NONE, ALICE]),
        (W.in_("bob", None), [BOB, NONE]), (W.not_in("bob"), [NONE, ALICE]), (W.not_in("bob", None), [ALICE]), (W.is_null(), [NONE]), (W.is_not_null(), [BOB, ALICE]), (compare("who", "Equal", None), []),
        (C > 5, [ALICE]), (~(C > 5), [BOB, NONE]), (C <= 5, [BOB]), (C == 5, [BOB]), (C == "5", [BOB]), (W.contains("LIC"), [ALICE]), (W.starts_with("b"), [BOB]), (W.ends_with("*"), [ALICE]),
        (T == "b", [BOB, ALICE]), (T != "b", [BOB, NONE]), (T.contains("a"), [BOB]), (T.in_("z", "A"), [BOB]),
        (Field("ip").in_subnet("10.0.0.0/8"), [BOB]), (Field("ip").in_subnet("10.0.1.0/24"), []), (Field("ip").in_subnet("fe80::/10"), [ALICE]),
        (W.matches_wildcard("a*`*"), [ALICE]), (W.matches_wildcard("[a-b]*"), [BOB, ALICE]), (W.matches_wildcard("?ob"), [BOB]), (W.matches_wildcard("b"), []), (W.matches_regex("^.o"), [BOB]),
        (N > 5, [BOB]), (any_of(N > 5, W == "alice*"), [BOB]), (any_of(W == "alice*", N > 5), [BOB, ALICE]), (~(N > 5), [NONE]), (all_of(W == "bob", N > 5), [BOB]),
        (Field("when") >= datetime(2024, 1, 15), [ALICE]), (Field("flag") == True, [BOB]),  # noqa: E712
        (from_expression("who == 'bob' or count > 8 and not who.starts_with('z')"), [BOB, ALICE]), (from_expression("who is not None"), [BOB, ALICE]),
    ],
)
def test_two_valued_logic(rows, predicate, expected):
    assert [r["who"] for r in where(rows, predicate).select("who").collect()] == expected
    assert from_json(to_json(predicate)) == predicate


def test_limits():
    for bad in (all_of(W == "a"), compare("x", "In"), compare("", "Equal", 1), compare("x", "Nope", 1), compare("x", "MatchesRegex", "a" * 3_000), compare("x", "InSubnet", "a/b")):
        with pytest.raises(ValueError):
            validate(bad)
    deep = W == "a"
    for _ in range(40):
        deep = ~deep
    with pytest.raises(ValueError):
        validate(deep)
    with pytest.raises(ValueError):
        from_expression("__import__('os')")


def test_guaranteed_values():
    assert guaranteed((C == 4) & (W == "x"), "count") == {4}
    assert guaranteed(any_of(C == 4, C.in_(5, 6)), "COUNT") == {4, 5, 6}
    assert guaranteed(any_of(C == 4, W == "x"), "count") is None


def test_plain_conjuncts_reach_the_scan(spark, tmp_path, capsys):
    spark.range(100).select(F.col("id").cast("int").alias("event_id"), F.lit("x").alias("type")).write.parquet(f"{tmp_path}/t")
    where(spark.read.parquet(f"{tmp_path}/t"), all_of(compare("event_id", "In", 3, 4), compare("event_id", "GreaterThan", 3))).explain("formatted")
    assert "PushedFilters: [" in (plan := capsys.readouterr().out) and "GreaterThan(event_id,3)" in plan and "In(event_id, [3,4])" in plan


def test_folded_texts_reach_the_scan_and_lose_no_spelling(spark, tmp_path):
    """Every spelling that Unicode folds to a text is found; the plan shows its bounds at the scan."""
    from pyspark.sql import functions as F

    from chronolith.operators.predicates import folded_in

    texts = ["error", "ERROR", "Error", "errors", "erro", "\u017fignup", "SIGNUP", "s\u0131gnup", "V\u0131EW", "view", "stra\u00dfe", "STRASSE", "\ufb01le", "FILE", "", None, "zz", "\u212aey", "KEY"]
    spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    for value in ("error", "signup", "view", "strasse", "file", "key", "ERROR"):
        want = sorted(r["t"] for r in rows.where(F.upper("t") == value.upper()).collect())
        assert sorted(r["t"] for r in rows.where(folded_in(F.col("t"), [value])).collect()) == want and want
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t,ERROR), LessThanOrEqual(t,error)]" in rows.where(folded_in(F.col("t"), ["error"]))._jdf.queryExecution().toString()


def test_event_queries_push_filters_and_prune_columns(spark):
    import os
    import re

    from chronolith.plans import catalogue

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    for name, filters, columns in (("agg_daily_top", ["GreaterThan(value", "GreaterThanOrEqual(event_type,CLICK)"], "ts user_id event_type value"), ("pred_equal", ["LessThanOrEqual(event_type,error)"], "event_id event_type"), ("pred_in", ["GreaterThanOrEqual(c_mktsegment,BUILDING)"], "c_custkey c_mktsegment"), ("agg_store_summary", [], "ts event_type")):
        plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert all(f in plan for f in filters), plan
        assert re.search(r"ReadSchema: struct<([^>]*)>", plan)[1].replace(":", " ").split(",").__len__() == len(columns.split())
