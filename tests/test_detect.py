"""Detection against plain Python evaluators on seeded streams, and the stated edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import detect, rules, sigma
from chronolith.operators.predicates import compare
from chronolith.schema import canonical

T0 = datetime(2024, 1, 1)


def stream(spark, items):
    """items: (identity, seconds, type, group, extra payload)."""
    rows = [(i, T0 + timedelta(seconds=s), t, int(i[1:]) if i[1:].isdigit() else None, {k: v for k, v in {"g": g, "v": v}.items() if v is not None}) for i, s, t, g, v in items]
    return canonical(spark.createDataFrame(rows, "observation_identity string, time_created timestamp, type string, record_id long, values map<string,string>"))


def found(df):
    return sorted((r["rule_id"], r["group_value"], r["status"], tuple(r["evidence"])) for r in df.collect())


def one(rule, items, spark, **how):
    return [(g, e) for _, g, s, e in found(detect.evaluate(stream(spark, items), [rule], **how)) if s == "Matched"]


def threshold(n=3, window=10, **kw):
    return rules.Rule("t", kind="Threshold", selector=rules.Selector(types=("a",)), threshold=n, window_seconds=window, group_by="g", **kw)


def steps(*types):
    return tuple(rules.Selector(types=t if isinstance(t, tuple) else (t,)) for t in types)


def test_threshold_window_is_inclusive_and_firing_resets(spark):
    items = [("e1", 0, "a", "x", None), ("e2", 5, "A", "X", None), ("e3", 10, "a", "x", None), ("e4", 11, "a", "x", None), ("e5", 12, "a", "x", None), ("e6", 13, "a", "x", None), ("e7", 100, "a", "x", None)]
    assert one(threshold(), items[::-1], spark) == [("X", ("e1", "e2", "e3")), ("X", ("e4", "e5", "e6"))]
    assert one(threshold(), [("e1", 0, "a", "x", None), ("e2", 5, "a", "x", None), ("e3", 10.000001, "a", "x", None)], spark) == []


def test_missing_group_gives_one_incomplete(spark):
    got = found(detect.evaluate(stream(spark, [("e1", 0, "a", None, None), ("e2", 1, "a", None, None), ("e3", 2, "a", "x", None)]), [threshold()]).fillna("", ["group_value"]))
    assert got == [("t", "", "Incomplete", ())]


def test_distinct_ignores_case_and_keeps_the_latest(spark):
    rule = rules.Rule("d", kind="DistinctValue", selector=rules.Selector(types=("a",)), threshold=3, window_seconds=10, group_by="g", distinct_by="v")
    items = [("e1", 0, "a", "x", "p"), ("e2", 1, "a", "x", "P"), ("e3", 2, "a", "x", "q"), ("e4", 3, "a", "x", "p"), ("e5", 12, "a", "x", "r")]
    assert one(rule, items, spark) == [("X", ("e3", "e4", "e5"))]


def test_temporal_needs_independent_evidence(spark):
    rule = rules.Rule("m", kind="Temporal", steps=steps(("a", "b"), "b"), window_seconds=10, group_by="g")
    assert one(rule, [("e1", 0, "b", "x", None)], spark) == []
    assert one(rule, [("e1", 0, "b", "x", None), ("e2", 5, "b", "x", None)], spark) == [("X", ("e1", "e2"))]
    assert one(rule, [("e1", 0, "b", "x", None), ("e2", 5, "a", "x", None)], spark) == [("X", ("e1", "e2"))]


def test_ordered_keeps_the_latest_start(spark):
    rule = rules.Rule("o", kind="OrderedTemporal", steps=steps("a", "b", "c"), window_seconds=10, group_by="g")
    items = [("e1", 0, "a", "x", None), ("e2", 4, "a", "x", None), ("e3", 6, "b", "x", None), ("e4", 14, "c", "x", None)]
    assert one(rule, items, spark) == [("X", ("e2", "e3", "e4"))]
    assert one(rule, [("e1", 0, "b", "x", None), ("e2", 1, "a", "x", None), ("e3", 2, "c", "x", None)], spark) == []


def test_absence_is_strict_and_pairs_with_the_oldest(spark):
    rule = rules.Rule("n", kind="Absence", steps=steps("a", "b"), window_seconds=10, group_by="g")
    items = [("e1", 0, "a", "x", None), ("e2", 1, "a", "x", None), ("e3", 9, "b", "x", None), ("e4", 50, "z", "x", None)]
    assert one(rule, items, spark) == [("X", ("e2",))]
    assert one(rule, [("e1", 0, "a", "x", None), ("e2", 10, "b", "x", None)], spark) == [("X", ("e1",))]
    late = found(detect.evaluate(stream(spark, [("e1", 0, "a", "x", None)]), [rule]))
    assert [s for _, _, s, _ in late] == ["Incomplete"]
    assert one(rule, [("e1", 0, "a", "x", None)], spark, until=T0 + timedelta(seconds=10)) == [("X", ("e1",))]


def plain(rule, items):
    """The rules' statements, event by event, over all of a group's history."""
    out, state = [], {}
    for i, s, t, g, v in sorted(items, key=lambda x: (x[1], int(x[0][1:]))):
        hits = [k for k, sel in enumerate(rule.steps or (rule.selector,)) if t in sel.types]
        if not hits:
            continue
        held = [e for e in state.get(g, []) if e[0] >= s - rule.window_seconds]
        if rule.kind == "Threshold":
            held.append((s, i))
            if len(held) == rule.threshold:
                out.append((g.upper(), tuple(x for _, x in held)))
                held = []
        elif rule.kind == "DistinctValue":
            held = [e for e in held if e[2] != v] + [(s, i, v)]
            if len(held) == rule.threshold:
                out.append((g.upper(), tuple(e[1] for e in held)))
                held = []
        state[g] = held
    return sorted(out)


@pytest.mark.parametrize("seed", [730, 992, 441])
def test_seeded_streams_equal_the_plain_evaluator(spark, seed):
    rng = random.Random(seed)
    items = [(f"e{i}", rng.randint(0, 400), rng.choice("aab"), rng.choice("xyz"), rng.choice("PQRS")) for i in range(150)]
    for rule in (threshold(3, 12), rules.Rule("d", kind="DistinctValue", selector=rules.Selector(types=("a",)), threshold=3, window_seconds=25, group_by="g", distinct_by="v")):
        assert sorted(one(rule, items, spark)) == plain(rule, items)


def test_tuning_packs_and_hashes():
    assert sum(len(p.rules) for p in rules.BUILT_IN) == 44
    for pack in rules.BUILT_IN:
        for r in pack.rules:
            r.check()
        key = b"k" * 32
        assert rules.Pack.from_json(pack.to_json(key), key) == pack
        with pytest.raises(ValueError):
            rules.Pack.from_json(pack.to_json(key).replace(pack.rules[0].title, "Other"), key)
        with pytest.raises(ValueError):
            rules.Pack.from_json(pack.to_json(), key)
    tuned = rules.tuned([threshold()], [rules.Tuning("T", threshold=5, severity="High")])
    assert tuned[0].threshold == 5 and tuned[0].severity == "High"
    with pytest.raises(ValueError):
        rules.tuned([threshold()], [rules.Tuning("t", threshold=1)])
    a, b = rules.Pack("p", "1", (threshold(),)), rules.Pack("p", "2", (threshold(4), rules.Rule("n")))
    assert rules.compare_packs(a, b) == {"added": ["n"], "removed": [], "changed": ["t"]}
    assert rules.plan_hash([threshold(), rules.Rule("n")]) == rules.plan_hash([rules.Rule("n"), threshold()]) != rules.plan_hash([threshold(4), rules.Rule("n")])


SIGMA = """
title: NTLM
name: ntlm
logsource: {product: windows, service: security}
detection:
  sel: {EventID: 4624, LmPackageName: 'NTLM*1'}
  filter: {User|endswith: ['$', 'svc']}
  words: ['alpha', 'beta']
  condition: sel and not filter or 1 of w*
level: high
---
title: Many
correlation: {type: value_count, rules: ntlm, group-by: [User], timespan: 5m, condition: {gte: 3, field: Ip}}
---
title: Bad
logsource: {product: windows, category: process_creation}
detection: {sel: {Image|base64: x}, condition: sel}
"""


def test_sigma(spark):
    made, refused = sigma.compile_documents(sigma.load(SIGMA))
    assert [r.kind for r in made] == ["DistinctValue"] and made[0].threshold == 3 and made[0].window_seconds == 300 and [n for n, _ in refused] == ["Bad"]
    rule = sigma.compile_rule(sigma.load(SIGMA)[0])
    rows = canonical(spark.createDataFrame([(1, 4624, {"LmPackageName": "ntlm v1", "User": "bob"}, None), (2, 4624, {"LmPackageName": "NTLM V1", "User": "pc$"}, None), (3, 4625, {"LmPackageName": "NTLM V1"}, "has BETA in it"), (4, 4624, {}, None)], "record_id long, event_id int, values map<string,string>, message string")).withColumn("source_log", F.lit("security"))
    assert sorted(r["record_id"] for r in rows.where(detect.selector_column(rows, rule.selector)).collect()) == [1, 3]
    for bad in ("sel and", "sel nor x", "1 of z*", "sel | count() > 3"):
        with pytest.raises(sigma.Unsupported):
            sigma.condition(bad, {"sel": compare("a", "Equal", 1)})
    assert sigma.pattern(r"a\*b?c") == ("MatchesRegex", r"(?s)\Aa\*b.c\z") and sigma.pattern(r"a\*b") == ("Equal", "a*b")
