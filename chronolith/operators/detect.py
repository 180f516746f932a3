"""Batch detection: one projection finds what each rule matches, ordered state machines do the rest.

The selectors of a few rules compile into one array column, those of many are met by an index
(``rule_index``), so the rows are read and tested once for all rules; their common safe prefilter
reaches the scan. Stateless findings come straight from it. For stateful rules the matches are
written once, narrow, and dealt by (rule, group, run), a run being a stretch
without a gap longer than the rule's window: state never outlives a gap, so a hot group is
many short runs. Runs are found over slots as long as the window, of which a group has few,
not over its events, and slots that cannot be part of a finding by their counts are left out
before any row is sorted. Each run is sorted by (time, record id with null first, identity) and
streamed through a small state machine; no run is held in memory as a whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolith.operators.predicates import compile_predicate, compile_with_error, folded_in, guaranteed
from chronolith.operators.rule_index import RuleIndex
from chronolith.operators.rules import Pack, Rule, Selector, Suppression
from chronolith.operators.timeline import pivots
from chronolith.schema import observed, resolve
from chronolith.scratch import written

FINDINGS = "rule_id string, group_value string, status string, event_us long, evidence array<string>"


#: Selectors of enabled rules beyond which candidates come from an index.
INDEXED_FROM = 16


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def selector_column(rows: DataFrame, s: Selector) -> Column:
    """Whether a row is one that the selector takes; texts compare without case."""
    parts = [F.lit(True)]
    if s.event_ids:
        parts.append(_false(F.col("event_id").isin(list(s.event_ids))))
    for column, names in (("type", s.types), ("source_log", s.channels), ("provider", s.providers)):
        if names:
            parts.append(_false(folded_in(F.col(column), names)))
    if s.predicate is not None:
        parts.append(compile_predicate(s.predicate, rows))
    return reduce(lambda a, b: a & b, parts)


def suppressed(rows: DataFrame, rule_id: str, suppressions: Sequence[Suppression]) -> Column:
    out = F.lit(False)
    for s in suppressions:
        if s.rule_id.lower() == rule_id.lower():
            hit = compile_predicate(s.predicate, rows)
            if s.start is not None:
                hit = hit & (F.col("time_created") >= F.lit(s.start))
            if s.end is not None:
                hit = hit & (F.col("time_created") <= F.lit(s.end))
            out = out | _false(hit)
    return out


def prefilter(rows: DataFrame, rules: Sequence[Rule]) -> Column:
    """A cheap condition that every row of interest meets: for each selector its event ids, or else its types, channels or providers, joined by or."""
    selectors = [s for r in rules if r.enabled for s in (r.steps or (r.selector,))]
    ids: set[int] = set()
    names: dict[str, set[str]] = {"type": set(), "source_log": set(), "provider": set()}
    for s in selectors:
        own = frozenset(s.event_ids) or (guaranteed(s.predicate, "event_id") if s.predicate else None)
        if own and all(type(v) is int for v in own):
            ids |= own
            continue
        column, values = next(((c, v) for c, v in (("type", s.types), ("source_log", s.channels), ("provider", s.providers)) if v), (None, ()))
        if column is None:
            return F.lit(True)
        names[column] |= {v.upper() for v in values}
    parts = [F.col("event_id").isin(sorted(ids))] if ids else []
    parts += [folded_in(F.col(c), sorted(v)) for c, v in names.items() if v]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(not selectors)


def matches(rows: DataFrame, rules: Sequence[Rule], suppressions: Sequence[Suppression] = ()) -> DataFrame:
    """(rule_id, steps, group_value, distinct_value, missing, identity, record_id, time_created), a row for each rule that takes an event.

    A few rules are tested on every row in one projection. More would make that projection
    too large to compile, so they go through an index of candidates; the rows are the same.
    """
    enabled = [r for r in rules if r.enabled]
    if sum(1 + len(r.steps) for r in enabled) > INDEXED_FROM:
        return RuleIndex(enabled).matches(rows.where(prefilter(rows, enabled)), suppressions)
    found = []
    for r in (r for r in rules if r.enabled):
        r.check()
        base = ~suppressed(rows, r.rule_id, suppressions)
        if r.steps:
            base = base & selector_column(rows, r.selector)
            steps = F.array_compact(F.array(*[F.when(selector_column(rows, s), F.lit(i)) for i, s in enumerate(r.steps)]))
            hit = base & (F.size(steps) > 0)
        else:
            steps, hit = F.array(F.lit(0)), base & selector_column(rows, r.selector)
        group = resolve(rows, r.group_by).cast("string") if r.group_by else F.lit("*")
        distinct = resolve(rows, r.distinct_by).cast("string") if r.distinct_by else F.lit(None).cast("string")
        missing = F.when(group.isNull(), F.lit(r.group_by)).when(distinct.isNull(), F.lit(r.distinct_by)) if r.kind != "Stateless" else F.lit(None).cast("string")
        found.append(F.when(hit, F.struct(F.lit(r.rule_id).alias("rule_id"), steps.alias("steps"), F.upper(group).alias("group_value"), F.upper(distinct).alias("distinct_value"), missing.alias("missing"))))
    hits = rows.where(prefilter(rows, rules)).select("observation_identity", "record_id", "time_created", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return hits.select("m.*", F.col("observation_identity").alias("identity"), "record_id", "time_created")


class Threshold:
    """Fires when the window (inclusive) holds enough events, then starts anew."""

    def __init__(self, rule: Rule):
        self.n, self.window, self.held = rule.threshold, int(rule.window_seconds * 1e6), deque()

    def expire(self, us: int) -> None:
        while self.held and self.held[0][0] < us - self.window:
            self.held.popleft()

    def size(self) -> int:
        return len(self.held)

    def feed(self, us: int, identity: str, steps, value) -> list[str] | None:
        self.expire(us)
        self.held.append((us, identity))
        if len(self.held) < self.n:
            return None
        out = [x for _, x in self.held]
        self.held.clear()
        return out


class Distinct:
    """Fires when the window holds enough distinct values; of a value the latest event counts."""

    def __init__(self, rule: Rule):
        self.n, self.window, self.held = rule.threshold, int(rule.window_seconds * 1e6), {}

    def expire(self, us: int) -> None:
        while self.held and next(iter(self.held.values()))[0] < us - self.window:
            self.held.pop(next(iter(self.held)))

    def size(self) -> int:
        return len(self.held)

    def feed(self, us: int, identity: str, steps, value) -> list[str] | None:
        self.held.pop(value, None)  # a value's latest event goes to the end
        self.held[value] = (us, identity)
        self.expire(us)
        if len(self.held) < self.n:
            return None
        out = [x for _, x in self.held.values()]
        self.held.clear()
        return out


class Temporal:
    """Fires when each step has an event of its own within the window, in any order.

    For each step the latest as many events as there are steps are enough to give every
    step its own.
    """

    def __init__(self, rule: Rule):
        self.steps, self.window = len(rule.steps), int(rule.window_seconds * 1e6)
        self.held: list[deque] = [deque(maxlen=self.steps) for _ in rule.steps]

    def expire(self, us: int) -> None:
        for own in self.held:
            while own and own[0][0] < us - self.window:
                own.popleft()

    def size(self) -> int:
        return sum(map(len, self.held))

    def feed(self, us: int, identity: str, steps, value) -> list[str] | None:
        self.expire(us)
        for s in steps:
            self.held[s].append((us, identity))
        if not all(self.held):
            return None
        taken: dict[tuple, int] = {}

        def assign(step: int, tried: set) -> bool:
            for event in self.held[step]:
                if event not in tried:
                    tried.add(event)
                    if event not in taken or assign(taken[event], tried):
                        taken[event] = step
                        return True
            return False

        if not all(assign(s, set()) for s in range(self.steps)):
            return None
        for own in self.held:
            own.clear()
        return [x for _, x in sorted(taken)]


class Ordered:
    """Fires when the steps come in order, first to last within the window; of prefixes of one length the latest start stays."""

    def __init__(self, rule: Rule):
        self.steps, self.window = len(rule.steps), int(rule.window_seconds * 1e6)
        self.prefix: list[list | None] = [None] * (self.steps - 1)

    def expire(self, us: int) -> None:
        for i, p in enumerate(self.prefix):
            if p is not None and p[0][0] < us - self.window:
                self.prefix[i] = None

    def size(self) -> int:
        return sum(len(p) for p in self.prefix if p)

    def feed(self, us: int, identity: str, steps, value) -> list[str] | None:
        self.expire(us)
        for done in range(self.steps - 1, 0, -1):
            source = self.prefix[done - 1]
            if source is None or done not in steps:
                continue
            longer = [*source, (us, identity)]
            if done + 1 == self.steps:
                self.prefix = [None] * (self.steps - 1)
                return [x for _, x in longer]
            now = self.prefix[done]
            if now is None or now[0][0] < source[0][0]:
                self.prefix[done] = longer
        if 0 in steps:
            self.prefix[0] = [(us, identity)]
        return None


MACHINES: dict[str, Callable] = {"Threshold": Threshold, "DistinctValue": Distinct, "Temporal": Temporal, "OrderedTemporal": Ordered}


class Absence:
    """Triggers (step 0) that no completion (step 1) answers in less than the window; a completion answers the oldest."""

    def __init__(self, rule: Rule):
        self.window, self.open = int(rule.window_seconds * 1e6), deque()

    def due(self, us: int | None) -> list[tuple[int, str]]:
        out = []
        while self.open and (us is None or self.open[0][0] + self.window <= us):
            at, identity = self.open.popleft()
            out.append((at + self.window, identity))
        return out

    def size(self) -> int:
        return len(self.open)

    def feed(self, us: int, identity: str, steps) -> list[tuple[int, str]]:
        out = self.due(us)
        if 1 in steps and self.open:
            self.open.popleft()
        elif 0 in steps:
            self.open.append((us, identity))
        return out


class Machine:
    """A rule's state for one group, holding at most ``most`` observations.

    ``feed`` gives (time, evidence, status) for what fires. Where the state is full and nothing in it
    has left the window, an event is not evaluated, and the first such event gives one Incomplete.
    """

    def __init__(self, rule: Rule, most: int):
        self.absence = rule.kind == "Absence"
        self.inner, self.most, self.full, self.last = Absence(rule) if self.absence else MACHINES[rule.kind](rule), most, False, 0

    def feed(self, us: int, identity: str, steps, value) -> list[tuple[int, list[str], str]]:
        self.last = us
        out = []
        if self.inner.size() >= self.most:
            if self.absence:
                out = [(at, [i], "Matched") for at, i in self.inner.due(us)]
            else:
                self.inner.expire(us)
            if self.inner.size() >= self.most and not (self.absence and 1 in steps):
                told, self.full = self.full, True
                return out if told else [*out, (us, [], "Full")]
        if self.absence:
            return out + [(at, [i], "Matched") for at, i in self.inner.feed(us, identity, steps)]
        evidence = self.inner.feed(us, identity, steps, value)
        return [] if evidence is None else [(us, evidence, "Matched")]

    def due(self, us: int | None, status: Callable[[int], str] = lambda at: "Matched") -> list[tuple[int, list[str], str]]:
        """What an absence rule finds without more events, up to a time or at the end."""
        return [(at, [i], status(at)) for at, i in self.inner.due(us)] if self.absence else []


def _streamed(rules: dict[str, Rule], until_us: int | None, most: int):
    ended = lambda at: "Matched" if until_us is not None and at <= until_us else "Incomplete"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for pdf in batches:
            out = []
            for rule_id, group, stretch, us, identity, steps, value in zip(*(pdf[c].tolist() for c in ("rule_id", "group_value", "run", "us", "identity", "steps", "distinct_value"))):
                if (rule_id, group, stretch) != key:
                    if machine is not None:
                        out += [(key[0], key[1], status, at, found) for at, found, status in machine.due(None, ended)]
                    key, machine = (rule_id, group, stretch), Machine(rules[rule_id], most)
                out += [(rule_id, group, status, at, found) for at, found, status in machine.feed(us, identity, steps, value)]
            if out:
                yield pd.DataFrame(out, columns=["rule_id", "group_value", "status", "event_us", "evidence"])
        if machine is not None and (last := machine.due(None, ended)):
            yield pd.DataFrame([(key[0], key[1], status, at, found) for at, found, status in last], columns=["rule_id", "group_value", "status", "event_us", "evidence"])

    return run


def _can_fire(order: Window) -> Column:
    """Whether a slot, with the one before or behind it, has the events that a finding takes.

    A finding's window reaches over two neighbouring slots at most, so events of other slots
    are in no finding's window, and leaving them out changes none. Absence rules need all.
    """
    out = F.lit(False)
    for shift, step in ((F.lag, -1), (F.lead, 1)):
        beside = shift("slot").over(order) == F.col("slot") + step
        n = F.col("_n") + F.when(beside, shift("_n").over(order)).otherwise(0)
        mask = F.col("_mask").bitwiseOR(F.when(beside, shift("_mask").over(order)).otherwise(0))
        out = out | F.coalesce((n >= F.col("need")) & (mask.bitwiseAND(F.col("full")) == F.col("full")), F.lit(False))
    return out


#: Observations that a rule's state for one group holds at most.
MAX_HELD = 250_000


def evaluate(rows: DataFrame, rules: Sequence[Rule], suppressions: Sequence[Suppression] = (), until: datetime | None = None, max_held: int = MAX_HELD) -> DataFrame:
    """Findings: rule_id, group_value, status, event_time, evidence (identities in order of time).

    Status is Matched, or Incomplete where a stateful rule met an event without its group or
    distinct field (one finding a rule and field), or where an absence's deadline lies
    behind ``until``, the time up to which input is complete (by default that of the last row).
    A group whose state would hold more than ``max_held`` observations goes on without those
    that find no room, and its rule gets one Incomplete finding without evidence.
    """
    by_id = {r.rule_id: r for r in rules if r.enabled}
    hits = matches(rows, rules, suppressions)
    plain = [r.rule_id for r in by_id.values() if r.kind == "Stateless"]
    states = [r.rule_id for r in by_id.values() if r.kind != "Stateless"]
    columns = ("rule_id", "group_value", "status", "event_time", "evidence")
    out = hits.where(F.col("rule_id").isin(plain)).select("rule_id", "group_value", F.lit("Matched").alias("status"), F.col("time_created").alias("event_time"), F.array("identity").alias("evidence"))
    if not states:
        return out
    hits = written(hits, "detect-matches")  # the rows are read and tested once; what follows reads the matches
    out = hits.where(F.col("rule_id").isin(plain)).select("rule_id", "group_value", F.lit("Matched").alias("status"), F.col("time_created").alias("event_time"), F.array("identity").alias("evidence")) if plain else None
    held = hits.where(F.col("rule_id").isin(states)) if plain else hits
    lacking = held.where(F.col("missing").isNotNull()).groupBy("rule_id", "missing").agg(F.min("time_created").alias("event_time")).select("rule_id", F.lit(None).cast("string").alias("group_value"), F.lit("Incomplete").alias("status"), "event_time", F.array().cast("array<string>").alias("evidence"))
    needs = []
    for i in states:
        r = by_id[i]
        every = r.kind == "Absence"
        needs.append((i, int(r.window_seconds * 1e6), 0 if every else len(r.steps) or r.threshold, 0 if every or not r.steps else (1 << len(r.steps)) - 1))
    table = rows.sparkSession.createDataFrame(needs, "rule_id string, width long, need long, full long")
    ready = held.where(F.col("missing").isNull()).withColumn("us", F.unix_micros("time_created")).join(F.broadcast(table), "rule_id").withColumn("slot", F.floor(F.col("us") / F.col("width")))  # a row a rule
    mask = F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(F.pow(F.lit(2), s).cast("long")))
    once = [F.first(c).alias(c) for c in ("width", "need", "full")]
    slots = ready.groupBy("rule_id", "group_value", "slot").agg(F.min("us").alias("_low"), F.max("us").alias("_high"), F.count(F.lit(1)).alias("_n"), F.bit_or(mask).alias("_mask"), *once)
    order = Window.partitionBy("rule_id", "group_value").orderBy("slot")
    slots = slots.withColumn("_alive", _can_fire(order)).where("_alive")
    fresh = F.when(F.col("_low") - F.lag("_high").over(order) > F.col("width"), 1).otherwise(0)
    numbered = slots.withColumn("_new", fresh).select("rule_id", "group_value", "slot", F.sum("_new").over(order).alias("run"))
    runs = ready.join(numbered, ["rule_id", "group_value", "slot"])
    sorted_runs = runs.repartition("rule_id", "group_value", "run").sortWithinPartitions("rule_id", "group_value", "run", "us", F.col("record_id").asc_nulls_first(), "identity")
    if until is not None:
        until_us = int(pd.Timestamp(until).value // 1000)
    elif any(r.kind == "Absence" for r in by_id.values()):
        until_us = rows.agg(F.max(F.unix_micros("time_created"))).first()[0]
    else:
        until_us = None
    fed = sorted_runs.select("rule_id", "group_value", "run", "us", "identity", "steps", "distinct_value").mapInPandas(_streamed(by_id, until_us, max_held), FINDINGS)
    if any(by_id[i].kind not in ("Temporal", "OrderedTemporal") for i in states):  # the state of the others is bounded by their steps
        fed = written(fed, "detect-fired")
        full = fed.where("status = 'Full'").groupBy("rule_id").agg(F.min("event_us").alias("event_us")).select("rule_id", F.lit(None).cast("string").alias("group_value"), F.lit("Incomplete").alias("status"), "event_us", F.array().cast("array<string>").alias("evidence"))
        fed = fed.where("status <> 'Full'").unionByName(full)
    fired = fed.select("rule_id", "group_value", "status", F.timestamp_micros("event_us").alias("event_time"), "evidence")
    parts = [p for p in (out, fired, lacking) if p is not None]
    return reduce(DataFrame.unionByName, parts).select(*columns)


def described(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings with what their rule says: title, severity (after tuning), confidence and tags; null for findings of no rule."""
    shown = [(r.rule_id, r.title, r.severity, r.confidence, list(r.tags)) for r in rules]
    table = findings.sparkSession.createDataFrame(shown, "rule_id string, title string, severity string, confidence int, tags array<string>")
    return findings.join(F.broadcast(table), "rule_id", "left")  # a row a rule


def entities(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings with start_time and end_time of their evidence, and entities: its distinct (kind, value) pivots and the group."""
    seen = observed(rows.withColumn("_id", F.col("observation_identity"))).select(F.col("_id").alias("identity"), "time_created", pivots(F.col("fields")).alias("p"))
    keyed = findings.withColumn("_finding", F.sha2(F.to_json(F.struct("rule_id", "group_value", "status", "event_time", "evidence")), 256))
    found = keyed.select("_finding", F.explode("evidence").alias("identity")).distinct().join(seen, "identity")
    per = found.select("_finding", "time_created", F.explode_outer("p").alias("e")).groupBy("_finding").agg(F.min("time_created").alias("start_time"), F.max("time_created").alias("end_time"), F.array_sort(F.collect_set("e")).alias("entities"))
    return keyed.join(per, "_finding", "left").drop("_finding")


def _failure_times(rows: DataFrame, rules: Sequence[Rule]) -> dict[str, tuple[datetime, str]]:
    """For each rule whose predicates fail on a row: (time, identity) of the first such row. One aggregate over the rows."""
    failing = {}
    for r in (r for r in rules if r.enabled):
        errors = [compile_with_error(s.predicate, rows)[1] for s in (r.selector, *r.steps) if s.predicate is not None]
        if errors:
            applies = reduce(lambda a, b: a | b, [selector_column(rows, replace(s, predicate=None)) for s in (r.steps or (r.selector,))])
            failing[r.rule_id] = applies & _false(reduce(lambda a, b: a | b, errors))
    if not failing:
        return {}
    order = F.struct("time_created", F.col("observation_identity").alias("identity"))
    first = rows.agg(*[F.min(F.when(c, order)).alias(f"r{i}") for i, c in enumerate(failing.values())]).first()
    return {rule_id: tuple(first[i]) for i, rule_id in enumerate(failing) if first[i] is not None}


def evaluate_isolated(rows: DataFrame, rules: Sequence[Rule], suppressions: Sequence[Suppression] = (), until: datetime | None = None) -> DataFrame:
    """``evaluate``, but a rule whose predicate cannot be evaluated on a row is off from that time on, with one Error finding; others go on."""
    broken = _failure_times(rows, rules)
    sound = [r for r in rules if r.rule_id not in broken]
    parts = [evaluate(rows, sound, suppressions, until)] if sound else []
    for r in rules:
        if r.rule_id in broken:
            at, identity = broken[r.rule_id]
            parts.append(evaluate(rows.where(F.col("time_created") < F.lit(at)), [r], suppressions, min(at, until) if until else at))
            error = [(r.rule_id, None, "Error", at, [identity])]
            parts.append(rows.sparkSession.createDataFrame(error, "rule_id string, group_value string, status string, event_time timestamp, evidence array<string>"))
    return reduce(DataFrame.unionByName, parts)


#: The rule id of the finding that says that a run passed its bounds.
BOUNDS_RULE = "ENGINE-BOUNDS"


def bounds(rows: DataFrame, rules: Sequence[Rule], suppressions: Sequence[Suppression] = (), max_groups: int = 25_000, max_observations: int = 1_000_000, max_candidates: int = 10_000) -> DataFrame:
    """(bound, value, allowed): what a run would hold beyond a stated bound; empty if it keeps all. Nothing is cut.

    Groups count over stateful rules, observations over rows, and candidates are the most
    rules that one row matches.
    """
    hits = matches(rows, rules, suppressions)
    stateful = [r.rule_id for r in rules if r.enabled and r.kind != "Stateless"]
    groups = hits.where(F.col("rule_id").isin(stateful) & F.col("missing").isNull()).select("rule_id", "group_value").distinct().agg(F.lit("groups").alias("bound"), F.count(F.lit(1)).alias("value"), F.lit(max_groups).cast("long").alias("allowed"))
    seen = rows.agg(F.lit("observations").alias("bound"), F.count(F.lit(1)).alias("value"), F.lit(max_observations).cast("long").alias("allowed"))
    most = hits.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).agg(F.lit("candidates").alias("bound"), F.coalesce(F.max("n"), F.lit(0)).alias("value"), F.lit(max_candidates).cast("long").alias("allowed"))
    return groups.unionByName(seen).unionByName(most).where("value > allowed")


def evaluate_bounded(rows: DataFrame, rules: Sequence[Rule], suppressions: Sequence[Suppression] = (), until: datetime | None = None, **limits: int) -> DataFrame:
    """``evaluate`` where a run keeps its bounds; else a single Incomplete finding of ENGINE-BOUNDS, never a part of the findings."""
    passed = [r["bound"] for r in bounds(rows, rules, suppressions, **limits).collect()]  # three rows at most
    if not passed:
        return evaluate(rows, rules, suppressions, until)
    return rows.sparkSession.createDataFrame([(BOUNDS_RULE, None, "Incomplete", None, sorted(passed))], "rule_id string, group_value string, status string, event_time timestamp, evidence array<string>")


def explain(rows: DataFrame, rule: Rule, suppressions: Sequence[Suppression] = ()) -> DataFrame:
    """For each row which conditions of a rule hold."""
    s = rule.selector
    part = lambda **kw: selector_column(rows, Selector(**kw))
    conditions = F.struct(
        F.lit(rule.enabled).alias("enabled"), part(event_ids=s.event_ids).alias("event_id"), part(types=s.types).alias("type"), part(channels=s.channels).alias("channel"), part(providers=s.providers).alias("provider"),
        (compile_predicate(s.predicate, rows) if s.predicate is not None else F.lit(True)).alias("predicate"), (~suppressed(rows, rule.rule_id, suppressions)).alias("not_suppressed"),
    )
    return rows.select("observation_identity", conditions.alias("conditions"))


def impact(rows: DataFrame, old: Sequence[Rule], new: Sequence[Rule]) -> DataFrame:
    """Findings that a change of rules adds or removes."""
    a, b = evaluate(rows, old), evaluate(rows, new)
    key = ["rule_id", "group_value", "status", "event_time", "evidence"]
    lost = a.exceptAll(b).withColumn("change", F.lit("removed"))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(lost).select("change", *key)


def coverage(packs: Sequence[Pack], observed_types: DataFrame) -> DataFrame:
    """(rule_id, type, observed) for the types that rules need."""
    pairs = sorted({(r.rule_id, t) for p in packs for r in p.rules for s in (r.steps or (r.selector,)) for t in s.types})
    need = observed_types.sparkSession.createDataFrame(pairs, "rule_id string, need string")
    seen = observed_types.select(F.upper("type").alias("_t")).distinct()
    joined = need.join(seen, F.upper("need") == F.col("_t"), "left")
    return joined.select("rule_id", F.col("need").alias("type"), F.col("_t").isNotNull().alias("observed"))
