"""Sigma documents compiled to detection rules.

What cannot be expressed exactly is refused with a reason; a rule is never weakened.
"""

from __future__ import annotations

import re
from typing import Any

from chronolith.operators.predicates import Predicate, all_of, any_of, compare, guaranteed
from chronolith.operators.rules import Rule, Selector

_SYSMON = ("Microsoft-Windows-Sysmon/Operational", "Microsoft-Windows-Sysmon")
_POWERSHELL = ("Microsoft-Windows-PowerShell/Operational", "Microsoft-Windows-PowerShell")
#: Fixed values: (channel, provider) and event ids of log-source categories.
CATEGORIES = {
    "process_creation": (_SYSMON, (1,)),
    "network_connection": (_SYSMON, (3,)),
    "sysmon_status": (_SYSMON, (4, 16)),
    "driver_load": (_SYSMON, (6,)),
    "image_load": (_SYSMON, (7,)),
    "create_remote_thread": (_SYSMON, (8,)),
    "raw_access_thread": (_SYSMON, (9,)),
    "process_access": (_SYSMON, (10,)),
    "file_event": (_SYSMON, (11,)),
    "registry_add": (_SYSMON, (12,)),
    "registry_delete": (_SYSMON, (12,)),
    "registry_event": (_SYSMON, (12, 13, 14)),
    "registry_set": (_SYSMON, (13,)),
    "create_stream_hash": (_SYSMON, (15,)),
    "pipe_created": (_SYSMON, (17,)),
    "wmi_event": (_SYSMON, (19, 20, 21)),
    "dns_query": (_SYSMON, (22,)),
    "file_delete": (_SYSMON, (23, 26)),
    "process_tampering": (_SYSMON, (25,)),
    "file_executable_detected": (_SYSMON, (29,)),
    "sysmon_error": (_SYSMON, (255,)),
    "ps_module": (_POWERSHELL, (4103,)),
    "ps_script": (_POWERSHELL, (4104,)),
}
SERVICES = {"security": "Security", "system": "System", "application": "Application", "sysmon": _SYSMON[0], "powershell": _POWERSHELL[0]}
LEVELS = {"informational": "Informational", "low": "Low", "medium": "Medium", "high": "High", "critical": "Critical"}


class Unsupported(ValueError):
    """A document that cannot be compiled exactly."""


def load(text: str) -> list[dict]:
    """The documents of a YAML text."""
    import yaml

    return [d for d in yaml.safe_load_all(text) if d]


def pattern(text: str) -> tuple[str, str]:
    """(operator, value) of a text with ``*`` and ``?`` wildcards and backslash escapes."""
    parts, i, plain = [], 0, True
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in "*?\\":
            i += 1
            parts.append(re.escape(text[i]))
        elif c in "*?":
            plain = False
            parts.append(".*" if c == "*" else ".")
        else:
            parts.append(re.escape(c))
        i += 1
    literal = re.sub(r"\\([*?\\])", r"\1", text)
    return ("Equal", literal) if plain else ("MatchesRegex", rf"(?s)\A{''.join(parts)}\z")


def _value(field: str, modifiers: list[str], value: Any) -> Predicate:
    cased = "cased" in modifiers
    kinds = [m for m in modifiers if m not in ("all", "cased")]
    if len(kinds) > 1 or kinds and kinds[0] not in ("contains", "startswith", "endswith", "re", "cidr", "exists"):
        raise Unsupported(f"modifier {'|'.join(modifiers)} of {field}")
    kind = kinds[0] if kinds else ""
    if kind == "exists":
        if not isinstance(value, bool):
            raise Unsupported(f"exists of {field} takes true or false")
        return compare(field, "IsNotNull" if value else "IsNull")
    if value is None:
        return compare(field, "IsNull")
    if kind == "cidr":
        return compare(field, "InSubnet", str(value))
    if kind == "re":
        return compare(field, "MatchesRegex", str(value), ignore_case=False)
    if isinstance(value, (bool, int, float)) and not kind:
        return compare(field, "Equal", value)
    text = str(value)
    if not kind:
        operator, made = pattern(text)
        return compare(field, operator, made, ignore_case=not cased)
    if re.search(r"(?<!\\)[*?]", text):
        around = {"contains": f"*{text}*", "startswith": f"{text}*", "endswith": f"*{text}"}[kind]
        return compare(field, "MatchesRegex", pattern(around)[1], ignore_case=not cased)
    return compare(field, {"contains": "Contains", "startswith": "StartsWith", "endswith": "EndsWith"}[kind], pattern(text)[1], ignore_case=not cased)


def _many(parts: list[Predicate], join) -> Predicate:
    return parts[0] if len(parts) == 1 else join(*parts)


def _field(name: str, value: Any) -> Predicate:
    field, *modifiers = name.split("|")
    field = {"EventID": "event_id"}.get(field, field)
    if isinstance(value, list):
        if not value:
            raise Unsupported(f"{name} has no values")
        return _many([_value(field, modifiers, v) for v in value], all_of if "all" in modifiers else any_of)
    return _value(field, modifiers, value)


def selection(found: Any) -> Predicate:
    """A map is all of its fields, a list any of its items, a bare text what the message contains."""
    if isinstance(found, dict):
        if not found:
            raise Unsupported("an empty selection")
        return _many([_field(k, v) for k, v in found.items()], all_of)
    if isinstance(found, list):
        return _many([selection(x) for x in found], any_of)
    return compare("message", "Contains", str(found))


def condition(text: str, selections: dict[str, Predicate]) -> Predicate:
    """and, or, not, parentheses, ``1 of`` and ``all of`` over names, prefixes and them."""
    tokens = re.findall(r"\(|\)|[\w*]+", text)
    if re.sub(r"[\s()]|[\w*]", "", text):
        raise Unsupported(f"condition {text!r}")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(tokens):
            raise Unsupported(f"condition {text!r} ends early")
        return tokens[at - 1]

    def some(word: str) -> Predicate:
        if take() != "of":
            raise Unsupported(f"condition {text!r}")
        name = take()
        hits = [p for k, p in selections.items() if name == "them" and not k.startswith("_") or k == name or name.endswith("*") and k.startswith(name[:-1])]
        if not hits:
            raise Unsupported(f"{name!r} names no selection")
        return _many(hits, all_of if word == "all" else any_of)

    def unit() -> Predicate:
        word = take()
        if word == "not":
            return ~unit()
        if word == "(":
            inner = either()
            if take() != ")":
                raise Unsupported(f"condition {text!r}")
            return inner
        if word in ("1", "all") and peek() == "of":
            return some(word)
        if word not in selections:
            raise Unsupported(f"{word!r} names no selection")
        return selections[word]

    def both() -> Predicate:
        parts = [unit()]
        while peek() == "and":
            take()
            parts.append(unit())
        return _many(parts, all_of)

    def either() -> Predicate:
        parts = [both()]
        while peek() == "or":
            take()
            parts.append(both())
        return _many(parts, any_of)

    made = either()
    if peek() is not None:
        raise Unsupported(f"condition {text!r} goes on after its end")
    return made


def compile_rule(doc: dict) -> Rule:
    """A single-event rule."""
    source, detection = doc.get("logsource") or {}, dict(doc.get("detection") or {})
    if source.get("product", "windows") != "windows":
        raise Unsupported(f"product {source['product']!r}")
    channels: tuple[str, ...] = ()
    providers: tuple[str, ...] = ()
    ids: tuple[int, ...] = ()
    if source.get("category"):
        if source["category"] not in CATEGORIES:
            raise Unsupported(f"category {source['category']!r}")
        (channel, provider), ids = CATEGORIES[source["category"]]
        channels, providers = (channel,), (provider,)
    elif source.get("service"):
        if source["service"] not in SERVICES:
            raise Unsupported(f"service {source['service']!r}")
        channels = (SERVICES[source["service"]],)
    text = detection.pop("condition", None)
    if not isinstance(text, str) or detection.pop("timeframe", None):
        raise Unsupported("one condition and no timeframe")
    made = condition(text, {k: selection(v) for k, v in detection.items()})
    implied = guaranteed(made, "event_id")
    if implied is not None and all(isinstance(v, int) for v in implied):
        ids = tuple(sorted(implied & set(ids) if ids else implied)) or ids
    return Rule(str(doc.get("id") or doc["title"]), doc.get("title", ""), "Stateless", LEVELS[doc.get("level", "medium")], Selector(ids, (), channels, providers, made), tags=tuple(doc.get("tags", ())))


_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def compile_correlation(doc: dict, base: dict[str, Rule]) -> Rule:
    """event_count, value_count, temporal and temporal_ordered over compiled rules."""
    c = doc["correlation"]
    if c.get("aliases"):
        raise Unsupported("aliases")
    groups = c.get("group-by") or []
    groups = [groups] if isinstance(groups, str) else groups
    if len(groups) > 1:
        raise Unsupported("more than one group-by field")
    span = re.fullmatch(r"(\d+)([smhd])", str(c.get("timespan", "")))
    names = [c["rules"]] if isinstance(c["rules"], str) else c["rules"]
    if not span or any(n not in base for n in names):
        raise Unsupported("a timespan and known rules are needed")
    parts = tuple(base[n].selector for n in names)
    common = dict(rule_id=str(doc.get("id") or doc["title"]), title=doc.get("title", ""), severity=LEVELS[doc.get("level", "medium")], window_seconds=int(span[1]) * _SECONDS[span[2]], group_by=groups[0] if groups else None, tags=tuple(doc.get("tags", ())))
    if c["type"] in ("temporal", "temporal_ordered"):
        return Rule(kind="Temporal" if c["type"] == "temporal" else "OrderedTemporal", steps=parts, **common)
    if c["type"] not in ("event_count", "value_count") or len(parts) != 1:
        raise Unsupported(f"correlation {c['type']!r} of {len(parts)} rules")
    limits = {k: v for k, v in (c.get("condition") or {}).items() if k != "field"}
    if len(limits) != 1 or next(iter(limits)) not in ("gte", "gt"):
        raise Unsupported("a condition of gte or gt")
    threshold = limits.get("gte", limits.get("gt", 0) + 1)
    if c["type"] == "event_count":
        return Rule(kind="Threshold", selector=parts[0], threshold=threshold, **common)
    return Rule(kind="DistinctValue", selector=parts[0], threshold=threshold, distinct_by=c["condition"]["field"], **common)


def compile_documents(docs: list[dict]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """(rules, refused documents with reasons); rules that a correlation refers to are hidden unless it says generate."""
    base: dict[str, Rule] = {}
    out: dict[str, Rule] = {}
    refused, hidden = [], set()
    for d in (d for d in docs if "correlation" not in d):
        try:
            rule = compile_rule(d)
            out[rule.rule_id] = rule
            base.update({n: rule for n in (d.get("name"), d.get("id"), d.get("title")) if n})
        except (Unsupported, ValueError, KeyError) as e:
            refused.append((str(d.get("id") or d.get("title")), str(e)))
    for d in (d for d in docs if "correlation" in d):
        try:
            rule = compile_correlation(d, base)
            out[rule.rule_id] = rule
            names = d["correlation"]["rules"]
            if not d["correlation"].get("generate"):
                hidden |= {base[n].rule_id for n in ([names] if isinstance(names, str) else names)}
        except (Unsupported, ValueError, KeyError) as e:
            refused.append((str(d.get("id") or d.get("title")), str(e)))
    return [r for k, r in out.items() if k not in hidden], refused
