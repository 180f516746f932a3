"""Candidate rules by inverted index, for rule sets of any size.

Each of four dimensions (event id, type, channel, provider) has postings: for a value the
numbers of the rules that name it. A rule is posted once, in that of its dimensions where the
longest list of its values is shortest; rules that name nothing are open. A row looks its four values up in
broadcast postings: its candidates are those lists and the open rules, each rule once. Candidates
are rows from there on: one broadcast join brings the rule's selectors and values, and plain
expressions test them.

Predicates with the same tree of fields and operators are one *shape*, whatever their
values; a rule brings its values as arrays. So the plan has four look-ups at most, one join and one
condition a shape, and does not grow with the number of rules.

Suppressions are conditions of their own, few by nature. Rows per event are its candidates,
not all rules. The postings and the rule table hold each rule's values about once, so their
size is that of the rule set; both are written by the driver, which has the rules anyway.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.predicates import Parameter, Predicate, compile_shape, pattern_of
from chronolith.operators.rules import Rule, Selector, Suppression
from chronolith.schema import resolve

#: (name, column, how a selector names its values) of the dimensions; texts compare in capitals.
DIMENSIONS = (("ids", "event_id", "event_ids"), ("types", "type", "types"), ("channels", "source_log", "channels"), ("providers", "provider", "providers"))
_NUMBERS = ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Equal", "NotEqual")
_TEXTS = ("Contains", "StartsWith", "EndsWith", *_NUMBERS)
_VALUES = "struct<longs: array<long>, doubles: array<double>, texts: array<string>, long_lists: array<array<long>>, text_lists: array<array<string>>>"
_SELECTOR = f"struct<ids: array<int>, types: array<string>, channels: array<string>, providers: array<string>, shape: int, v: {_VALUES}>"
_RULES = f"rule_no int, rule_id string, is_stateless boolean, group_no int, group_by string, distinct_no int, distinct_by string, base {_SELECTOR}, steps array<{_SELECTOR}>"


@dataclass
class Values:
    """A predicate's values by kind, in the order in which its shape asks for them."""

    longs: list = field(default_factory=list)
    doubles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    long_lists: list = field(default_factory=list)
    text_lists: list = field(default_factory=list)

    def row(self) -> tuple:
        return (self.longs, self.doubles, self.texts, self.long_lists, self.text_lists)


def _whole(v) -> bool:
    return type(v) is int and -(1 << 63) <= v < 1 << 63


def shaped(p: Predicate, values: Values) -> dict:
    """The shape of a predicate, as a tree that two predicates of one shape share; its values go to ``values``."""
    if p.kind != "Comparison":
        return {"kind": p.kind, "children": [shaped(c, values) for c in p.children]}
    out = {"kind": p.kind, "field": p.field.lower(), "operator": p.operator, "ignore_case": p.ignore_case}
    v = p.values[0] if p.values else None
    if p.operator in ("In", "NotIn") and all(isinstance(w, str) for w in p.values):
        values.text_lists.append([w.upper() if p.ignore_case else w for w in p.values])
        return out | {"asks": "text_lists", "at": len(values.text_lists) - 1}
    if p.operator in ("In", "NotIn") and all(map(_whole, p.values)):
        values.long_lists.append(list(p.values))
        return out | {"asks": "long_lists", "at": len(values.long_lists) - 1}
    if p.operator in ("MatchesWildcard", "MatchesRegex"):
        values.texts.append(pattern_of(p))
        return out | {"operator": "MatchesRegex", "asks": "texts", "at": len(values.texts) - 1}
    if p.operator in _TEXTS and isinstance(v, str) or p.operator in _NUMBERS and (_whole(v) or type(v) is float):
        kind = "texts" if isinstance(v, str) else "longs" if _whole(v) else "doubles"
        if kind != "texts":
            getattr(values, kind).append(v)
        values.texts.append(str(v))
        return out | {"asks": kind, "at": len(getattr(values, kind)) - 1, "text": len(values.texts) - 1}
    return out | {"values": list(p.values)}  # the rest stays in the shape: nulls, truth values, times, subnets


def _bound(shape: dict, v: Column) -> Predicate:
    """The predicate that a shape and a column of values stand for."""
    if shape["kind"] != "Comparison":
        return Predicate(shape["kind"], children=tuple(_bound(c, v) for c in shape["children"]))
    asks, made = shape.get("asks"), tuple(shape.get("values", ()))
    if asks is not None:
        column = F.get(v[asks], F.lit(shape["at"]))
        kind = {"longs": int, "long_lists": int, "doubles": float}.get(asks, str)
        made = (Parameter(kind, column, F.get(v["texts"], F.lit(shape["text"])) if "text" in shape else column, asks.endswith("_lists")),)
    return Predicate("Comparison", shape["field"], shape["operator"], made, shape["ignore_case"])


def _fields(shape: dict) -> set[str]:
    return {shape["field"]} if shape["kind"] == "Comparison" else set().union(*map(_fields, shape["children"]))


class RuleIndex:
    """Postings, the rule table and the shapes of a set of rules."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [r for r in rules if r.enabled]
        self.shapes: list[dict] = []
        self._known: dict[str, int] = {}
        self.groups = sorted({r.group_by for r in self.rules if r.group_by}, key=str.lower)
        self.distincts = sorted({r.distinct_by for r in self.rules if r.distinct_by}, key=str.lower)
        named = [{name: self._named(r, part) for name, _, part in DIMENSIONS} for r in self.rules]
        load = {name: Counter(v for own in named for v in own[name]) for name, _, _ in DIMENSIONS}
        self.postings = {name: defaultdict(list) for name, _, _ in DIMENSIONS}
        self.open: list[int] = []
        self.rows = []
        for no, (r, own) in enumerate(zip(self.rules, named)):
            r.check()
            at = min((name for name in own if own[name]), key=lambda name: max(load[name][v] for v in own[name]), default=None)
            if at is None:
                self.open.append(no)
            for v in own[at] if at else ():
                self.postings[at][v].append(no)
            group, distinct = (names.index(x) if x else -1 for names, x in ((self.groups, r.group_by), (self.distincts, r.distinct_by)))
            self.rows.append((no, r.rule_id, r.kind == "Stateless", group, r.group_by, distinct, r.distinct_by, self._selector(r.selector), [self._selector(s) for s in r.steps]))

    @staticmethod
    def _values(s: Selector, part: str) -> set:
        return {v.upper() if isinstance(v, str) else v for v in getattr(s, part)}

    def _named(self, r: Rule, part: str) -> set:
        """What the rule names in a dimension: its own values, or those of its steps if each names some."""
        own = self._values(r.selector, part)
        steps = [self._values(s, part) for s in r.steps]
        return own or (set().union(*steps) if steps and all(steps) else set())

    def _selector(self, s: Selector) -> tuple:
        values, shape = Values(), -1
        if s.predicate is not None:
            tree = shaped(s.predicate, values)
            text = json.dumps(tree, sort_keys=True, default=repr)
            shape = self._known.setdefault(text, len(self.shapes))
            if shape == len(self.shapes):
                self.shapes.append(tree)
        return (list(s.event_ids), *[sorted(self._values(s, part)) for _, _, part in DIMENSIONS[1:]], shape, values.row())

    def candidates(self, event_id: int | None, *names: str | None) -> list[int]:
        """What a row's candidates are, by the rule that the plan follows."""
        found = list(self.open)
        for (name, _, _), v in zip(DIMENSIONS, (event_id, *names)):
            found += self.postings[name].get(v.upper() if isinstance(v, str) else v, [])
        return sorted(found)

    def met(self, rows: DataFrame) -> DataFrame:
        """``rows`` with rule_no, a row for each rule that may match; texts are compared as _key_ columns."""
        spark, lists = rows.sparkSession, []
        for name, _, _ in DIMENSIONS:
            if self.postings[name]:
                kind = "int" if name == "ids" else "string"
                table = spark.createDataFrame(list(self.postings[name].items()), f"_posted {kind}, _rules_{name} array<int>")
                rows = rows.join(F.broadcast(table), F.col(f"_key_{name}") == F.col("_posted"), "left").drop("_posted")  # the size of the rule set
                lists.append(F.coalesce(f"_rules_{name}", F.array().cast("array<int>")))
        if self.open:
            lists.append(F.from_json(F.lit(json.dumps(self.open)), "array<int>"))
        every = F.concat(*lists) if lists else F.array().cast("array<int>")
        return rows.withColumn("rule_no", F.explode(every)).drop(*[f"_rules_{name}" for name, _, _ in DIMENSIONS])

    def _takes(self, s: Column, rows: DataFrame) -> Column:
        """Whether a selector that a column holds takes the row."""
        parts = [F.lit(True)]
        for name, _, part in DIMENSIONS:
            if any(getattr(x, part) for r in self.rules for x in (r.selector, *r.steps)):
                parts.append((F.size(s[name]) == 0) | F.coalesce(F.array_contains(s[name], F.col(f"_key_{name}")), F.lit(False)))
        shape = F.lit(True)
        if self.shapes:
            cases = F.when(s["shape"] < 0, F.lit(True))
            for no, tree in enumerate(self.shapes):
                cases = cases.when(s["shape"] == no, compile_shape(_bound(tree, s["v"]), rows))
            shape = cases
        return reduce(lambda a, b: a & b, parts) & shape

    def matches(self, rows: DataFrame, suppressions: Sequence[Suppression] = ()) -> DataFrame:
        """The same rows as ``detect.matches``, by way of the candidates."""
        from chronolith.operators.detect import suppressed

        fields = sorted(set().union(*map(_fields, self.shapes))) if self.shapes else []
        for s in suppressions:
            from_shape = shaped(s.predicate, Values())
            fields = sorted({*fields, *_fields(from_shape)})
        own = ["event_id", "type", "source_log", "provider", "time_created", "record_id", "observation_identity"]
        extra = [f for f in fields if f not in own]
        groups = F.array(*[resolve(rows, g).cast("string") for g in self.groups]).cast("array<string>")
        distincts = F.array(*[resolve(rows, d).cast("string") for d in self.distincts]).cast("array<string>")
        slim = rows.select(*own, *[resolve(rows, f).alias(f) for f in extra], groups.alias("_groups"), distincts.alias("_distincts"))
        keyed = slim.select("*", *[(F.col(c) if name == "ids" else F.upper(c)).alias(f"_key_{name}") for name, c, _ in DIMENSIONS])
        met = self.met(keyed)
        table = rows.sparkSession.createDataFrame(self.rows, _RULES)
        pairs = met.join(F.broadcast(table), "rule_no")  # a row a rule
        hit = self._takes(F.col("base"), slim)
        if suppressions:
            by = defaultdict(list)
            for s in suppressions:
                by[s.rule_id.lower()].append(s)
            held = reduce(lambda a, b: a | b, [(F.lower("rule_id") == i) & suppressed(slim, i, own_) for i, own_ in sorted(by.items())])
            hit = hit & ~held
        steps = F.lit(0)
        if any(r.steps for r in self.rules):
            steps = F.filter(F.transform("steps", lambda s, i: F.when(self._takes(s, slim), i)), lambda x: x.isNotNull())
            steps = F.when(F.size("steps") > 0, steps).otherwise(F.array(F.lit(0)))
        else:
            steps = F.array(F.lit(0))
        taken = pairs.where(hit).withColumn("steps", steps).where(F.size("steps") > 0)
        group = F.when(F.col("group_no") < 0, F.lit("*")).otherwise(F.get("_groups", F.col("group_no")))
        distinct = F.when(F.col("distinct_no") >= 0, F.get("_distincts", F.col("distinct_no")))
        lacks = F.when(group.isNull(), F.col("group_by")).when(distinct.isNull(), F.col("distinct_by"))
        return taken.select(
            "rule_id", "steps", F.upper(group).alias("group_value"), F.upper(distinct).alias("distinct_value"), F.when(~F.col("is_stateless"), lacks).alias("missing"), F.col("observation_identity").alias("identity"), "record_id", "time_created"
        )
