"""The index of candidate rules: the same matches as one projection, and plans that do not grow."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from chronolith.operators import detect, rules
from chronolith.operators.predicates import Field, all_of, compare
from chronolith.operators.rule_index import RuleIndex
from chronolith.schema import canonical

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice([*x, None])
    data = []
    for i in range(400):
        values = {k: v for k, v in {"Name": pick("alice", "BOB", "carol$", "x"), "n": pick("1", "2.5", "12", "abc"), "ip": pick("10.0.0.1", "10.1.2.3", "::1")}.items() if v is not None}
        data.append((str(i), i, T0 + timedelta(seconds=rng.randint(0, 500)), pick("logon", "Logoff", "error"), pick(1, 2, 3, 4), pick("Security", "system"), pick("p1", "P2"), pick("pc1", "pc2", "pc3"), values))
    return canonical(spark.createDataFrame(data, "observation_identity string, record_id long, time_created timestamp, type string, event_id int, source_log string, provider string, source_computer string, values map<string,string>"))


def predicates(rng):
    name, n, ip = Field("NAME"), Field("n"), Field("ip")
    leaf = [
        lambda: name == rng.choice(["Alice", "bob", "x"]), lambda: name != "x", lambda: name.in_("ALICE", rng.choice(["x", "carol$"])), lambda: name.not_in("alice", "bob"), lambda: name.in_("alice", None),
        lambda: name.contains(rng.choice(["A", "li", "$"])), lambda: name.starts_with("c"), lambda: name.ends_with(rng.choice(["$", "B"])), lambda: name.matches_wildcard(rng.choice(["*o*", "?"])), lambda: name.matches_regex(rng.choice(["^a", "l$"])),
        lambda: name.equal(rng.choice(["alice", "BOB"]), ignore_case=False), lambda: n > rng.choice([1, 2, 2.5]), lambda: n <= rng.choice([2, 12]), lambda: n == rng.choice([1, 2.5, 12]), lambda: n != rng.choice([1, "abc"]),
        lambda: n.in_(1, rng.choice([12, 99])), lambda: Field("event_id").in_(1, rng.choice([2, 3])), lambda: Field("event_id") > rng.choice([1, 2]), lambda: Field("event_id") == "3", lambda: Field("event_id") != 2,
        lambda: ip.in_subnet(rng.choice(["10.0.0.0/8", "10.1.0.0/16"])), lambda: name.is_null(), lambda: ip.is_not_null(), lambda: Field("time_created") >= T0 + timedelta(seconds=250), lambda: Field("record_id").not_in(3, 5, 250),
    ]

    def made(depth):
        if depth == 0 or rng.random() < 0.4:
            return rng.choice(leaf)()
        kind = rng.choice(["and", "or", "not"])
        return ~made(depth - 1) if kind == "not" else made(depth - 1) & made(depth - 1) if kind == "and" else made(depth - 1) | made(depth - 1)

    return [made(2) for _ in range(60)] + [x() for x in leaf]


def some_rules(rng):
    part = lambda *x: tuple(rng.sample(x, rng.choice([0, 1, 2])))
    selector = lambda p=None: rules.Selector(part(1, 2, 3), part("LOGON", "error"), part("security", "System"), part("P1", "p2"), p)
    out = []
    for i, p in enumerate(predicates(rng)):
        kind = rng.choice(rules.KINDS)
        how = {"kind": kind, "selector": selector(p), "group_by": rng.choice([None, "source_computer", "Name"])}
        if kind != "Stateless":
            how |= {"window_seconds": rng.choice([20, 60]), "threshold": 2}
        if kind == "DistinctValue":
            how["distinct_by"] = rng.choice(["n", "ip"])
        if kind in ("Temporal", "OrderedTemporal", "Absence"):
            how["steps"] = tuple(selector(rng.choice([None, p])) for _ in range(2))
        out.append(rules.Rule(f"R{i}", **how))
    return out + [rules.Rule("off", enabled=False)]


def shown(df):
    return sorted(map(str, df.collect()))


def test_index_and_projection_agree(rows, monkeypatch):
    made = some_rules(random.Random(9))
    hushed = [rules.Suppression("r3", Field("Name") == "alice"), rules.Suppression("R5", Field("event_id") > 1, T0, T0 + timedelta(seconds=100)), rules.Suppression("R5", Field("ip").is_null())]
    index = shown(RuleIndex(made).matches(rows, hushed))
    monkeypatch.setattr(detect, "INDEXED_FROM", 10**9)
    plain = []
    for at in range(0, len(made), 12):
        plain += shown(detect.matches(rows, made[at : at + 12], hushed))
    assert index == sorted(plain) and len(index) > 1000
    for r in made[:3]:  # a single rule, of whatever kind
        assert shown(RuleIndex([r]).matches(rows)) == shown(detect.matches(rows, [r]))


def test_findings_do_not_depend_on_the_way(rows, monkeypatch):
    made = [r for r in some_rules(random.Random(2)) if r.kind != "Stateless"][:9]
    monkeypatch.setattr(detect, "INDEXED_FROM", 0)
    index = shown(detect.evaluate(rows, made))
    monkeypatch.setattr(detect, "INDEXED_FROM", 10**9)
    assert index == shown(detect.evaluate(rows, made)) and index


def test_a_rule_is_posted_once_where_its_list_is_shortest():
    made = [rules.Rule(f"a{i}", selector=rules.Selector(event_ids=(i % 5,), types=("x",))) for i in range(50)]
    made += [rules.Rule("open"), rules.Rule("steps", kind="Temporal", window_seconds=1, steps=(rules.Selector(types=("y",)), rules.Selector(types=("Z",)))), rules.Rule("log", selector=rules.Selector(channels=("Security",), types=("x",)))]
    index = RuleIndex(made)
    assert index.candidates(3, "X", None, None) == [*range(3, 50, 5), 50] and index.candidates(9, "z", None, None) == [50, 51]
    assert index.candidates(None, "x", "SECURITY", None) == [50, 52] and index.candidates(None, None, None, None) == [50]


def test_plan_does_not_grow_with_rules(spark, rows):
    one = lambda i: rules.Rule(f"r{i}", selector=rules.Selector(event_ids=(i % 7,), predicate=all_of(compare("Name", "Contains", f"n{i}"), compare("n", "GreaterThan", i))))
    plans = [detect.matches(rows, [one(i) for i in range(n)])._jdf.queryExecution().optimizedPlan().toString() for n in (20, 1000)]
    nodes = [p.count("\n") for p in plans]
    assert nodes[0] == nodes[1] and len(plans[1]) < 1.5 * len(plans[0]) + 60_000
    assert len(RuleIndex([one(i) for i in range(1000)]).shapes) == 1


def test_prefilter_joins_selectors_of_different_parts(rows):
    made = [rules.Rule("a", selector=rules.Selector(event_ids=(4,))), rules.Rule("b", selector=rules.Selector(types=("ERROR",))), rules.Rule("c", selector=rules.Selector(channels=("SYSTEM",)))]
    got = rows.where(detect.prefilter(rows, made)).collect()
    assert {r["record_id"] for r in got} == {r["record_id"] for r in rows.collect() if r["event_id"] == 4 or r["type"] == "error" or r["source_log"] == "system"}
    assert rows.where(detect.prefilter(rows, [*made, rules.Rule("d")])).count() == 400 and rows.where(detect.prefilter(rows, [replace(made[0], enabled=False)])).count() == 400
