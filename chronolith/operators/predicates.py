"""A serializable, two-valued predicate language that compiles to one column.

Leaves compare a field with values; ``All``, ``Any`` and ``Not`` combine. There is no third
truth value: a comparison with a null field is false (``NotEqual`` and ``NotIn`` are true
unless null itself is listed), and ``Not`` is plain negation. A value that cannot be read
as the type compared with makes the whole predicate false, if evaluation, left to right,
gets to that leaf.

Text compares without case unless ``ignore_case`` is off. For an array field ``Equal`` and
``Contains`` ask for any equal element, ``NotEqual`` for any that differs. Regular
expressions are Java's and have no time limit.
"""

from __future__ import annotations

import ast
import ipaddress
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.decode import ipv4_number, ipv6_halves
from chronolith.functions.text import wildcard_regex
from chronolith.schema import resolve

OPERATORS = ("Equal", "NotEqual", "In", "NotIn", "Contains", "StartsWith", "EndsWith", "MatchesWildcard", "MatchesRegex", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "IsNull", "IsNotNull", "InSubnet")
MAX_DEPTH, MAX_NODES, MAX_VALUES, MAX_TEXT, MAX_PATTERN = 32, 512, 1_024, 4_096, 2_048


@dataclass(frozen=True)
class Predicate:
    """A node: a comparison has field, operator and values; the others have children."""

    kind: str
    field: str = ""
    operator: str = ""
    values: tuple = ()
    ignore_case: bool = True
    children: tuple["Predicate", ...] = ()

    def __and__(self, other: "Predicate") -> "Predicate":
        return all_of(self, other)

    def __or__(self, other: "Predicate") -> "Predicate":
        return any_of(self, other)

    def __invert__(self) -> "Predicate":
        return Predicate("Not", children=(self,))


def compare(field: str, operator: str, *values, ignore_case: bool = True) -> Predicate:
    return Predicate("Comparison", field, operator, tuple(values), ignore_case)


def all_of(*children: Predicate) -> Predicate:
    return Predicate("All", children=children)


def any_of(*children: Predicate) -> Predicate:
    return Predicate("Any", children=children)


class Field:
    """Builds comparisons with Python operators: ``Field("value") > 3``."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, value):  # noqa: D105
        return compare(self.name, "Equal", value)

    def __ne__(self, value):
        return compare(self.name, "NotEqual", value)

    def __gt__(self, value):
        return compare(self.name, "GreaterThan", value)

    def __ge__(self, value):
        return compare(self.name, "GreaterThanOrEqual", value)

    def __lt__(self, value):
        return compare(self.name, "LessThan", value)

    def __le__(self, value):
        return compare(self.name, "LessThanOrEqual", value)

    __hash__ = None

    def __getattr__(self, name: str):
        operator = "".join(w.capitalize() for w in name.rstrip("_").split("_"))
        if operator not in OPERATORS:
            raise AttributeError(name)
        return lambda *values, **how: compare(self.name, operator, *values, **how)


def validate(p: Predicate) -> None:
    """Raises ValueError where a predicate breaks a limit or its form."""
    nodes = 0

    def walk(n: Predicate, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise ValueError("the predicate is too deep or too large")
        if n.kind == "Comparison":
            if n.operator not in OPERATORS or not n.field:
                raise ValueError(f"no comparison {n.operator!r} on {n.field!r}")
            few = {"IsNull": (0, 0), "IsNotNull": (0, 0), "In": (1, MAX_VALUES), "NotIn": (1, MAX_VALUES)}.get(n.operator, (1, 1))
            if not few[0] <= len(n.values) <= few[1]:
                raise ValueError(f"{n.operator} takes {few[0]} to {few[1]} values")
            most = MAX_PATTERN if n.operator.startswith("Matches") else MAX_TEXT
            if any(isinstance(v, str) and len(v) > most for v in n.values):
                raise ValueError(f"a value of {n.operator} is longer than {most}")
            if n.operator == "InSubnet":
                ipaddress.ip_network(n.values[0], strict=False)
        elif n.kind in ("All", "Any") and len(n.children) < 2 or n.kind == "Not" and len(n.children) != 1 or n.kind not in ("All", "Any", "Not"):
            raise ValueError(f"{n.kind} has {len(n.children)} children")
        for child in n.children:
            walk(child, depth + 1)

    walk(p, 1)


def to_json(p: Predicate) -> str:
    def plain(n: Predicate) -> dict:
        if n.kind == "Comparison":
            values = [{"$time": v.isoformat()} if isinstance(v, datetime) else v for v in n.values]
            return {"kind": n.kind, "field": n.field, "operator": n.operator, "values": values, "ignoreCase": n.ignore_case}
        return {"kind": n.kind, "children": [plain(c) for c in n.children]}

    return json.dumps(plain(p), sort_keys=True)


def from_json(text: str) -> Predicate:
    def made(d: dict) -> Predicate:
        values = tuple(datetime.fromisoformat(v["$time"]) if isinstance(v, dict) else v for v in d.get("values", ()))
        return Predicate(d["kind"], d.get("field", ""), d.get("operator", ""), values, d.get("ignoreCase", True), tuple(made(c) for c in d.get("children", ())))

    p = made(json.loads(text))
    validate(p)
    return p


def from_expression(text: str) -> Predicate:
    """A predicate from a restricted Python expression: comparisons of names with literals, and, or, not, in."""
    operators = {ast.Eq: "Equal", ast.NotEq: "NotEqual", ast.Gt: "GreaterThan", ast.GtE: "GreaterThanOrEqual", ast.Lt: "LessThan", ast.LtE: "LessThanOrEqual", ast.In: "In", ast.NotIn: "NotIn"}

    def walk(n: ast.AST) -> Predicate:
        if isinstance(n, ast.BoolOp):
            return (all_of if isinstance(n.op, ast.And) else any_of)(*map(walk, n.values))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return ~walk(n.operand)
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and isinstance(n.left, ast.Name):
            value = ast.literal_eval(n.comparators[0])
            if isinstance(n.ops[0], (ast.Is, ast.IsNot)) and value is None:
                return compare(n.left.id, "IsNull" if isinstance(n.ops[0], ast.Is) else "IsNotNull")
            if type(n.ops[0]) in operators:
                return compare(n.left.id, operators[type(n.ops[0])], *(value if isinstance(n.ops[0], (ast.In, ast.NotIn)) else [value]))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and not n.keywords:
            operator = "".join(w.capitalize() for w in n.func.attr.split("_"))
            if operator in OPERATORS:
                return compare(n.func.value.id, operator, *map(ast.literal_eval, n.args))
        raise ValueError(f"{ast.unparse(n)!r} is not allowed in a predicate")

    p = walk(ast.parse(text, mode="eval").body)
    validate(p)
    return p


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Parameter:
    """A value that each row brings in a column: its kind, the column, and its text as Python writes it.

    ``many`` columns hold an array of values, for In and NotIn.
    """

    kind: type
    column: Column
    text: Column
    many: bool = False


def _is(value, kinds) -> bool:
    return issubclass(value.kind, kinds) if isinstance(value, Parameter) else isinstance(value, kinds)


def _shown(value) -> Column:
    return value.text if isinstance(value, Parameter) else F.lit(str(value))


def _literal(value) -> Column:
    if isinstance(value, Parameter):
        return value.column
    if isinstance(value, datetime):
        value = value.replace(tzinfo=value.tzinfo or timezone.utc)
    return F.lit(value)


def _text(c: Column, ignore_case: bool) -> Column:
    return F.upper(c) if ignore_case else c


@lru_cache(1)
def _widened_letters() -> frozenset:
    """ASCII capitals with which the capitals of some other letter begin (the dotless i, the long s, ligatures)."""
    return frozenset(chr(c).upper()[0] for c in range(0x80, 0x20000) if chr(c).upper()[0].isascii())


def folded_in(column: Column, values: Sequence[str]) -> Column:
    """Whether a text column is one of ``values`` without case.

    Every spelling of an ASCII text lies between its capitals and its small letters. These
    bounds are plain comparisons, so a scan can skip what they exclude.
    """
    hit = F.upper(column).isin([v.upper() for v in values])
    if not values or not all(v.isascii() for v in values):
        return hit

    def high(v: str) -> str:
        at = next((i for i, c in enumerate(v.upper()) if c in _widened_letters()), None)
        return v.lower() if at is None else v[:at].lower() + "\U0010ffff"

    return (column >= F.lit(min(v.upper() for v in values))) & (column <= F.lit(max(map(high, values)))) & hit


class _Leaf:
    """A field as compared with a value: whether its value can be read as the value's type, and how."""

    def __init__(self, column: Column, kind: T.DataType, ignore_case: bool):
        self.column, self.kind, self.ignore_case = column, kind, ignore_case

    def both(self, value) -> tuple[Column, Column, Column | None]:
        """(field, value, whether one of them cannot be read; None if that cannot be)."""
        text = isinstance(self.kind, T.StringType)
        if isinstance(value, bool) or isinstance(self.kind, T.BooleanType):
            got = self.column.try_cast("boolean") if text else self.column.cast("boolean")
            want = F.lit(value) if isinstance(value, bool) else F.lower(_shown(value)) == "true"
            return got, want, (self.column.isNotNull() & got.isNull()) if text else None
        if isinstance(value, datetime) or isinstance(self.kind, T.TimestampType):
            got = F.try_to_timestamp(self.column) if text else self.column
            want = _literal(value) if isinstance(value, datetime) else F.try_to_timestamp(_shown(value))
            return got, want, (self.column.isNotNull() & got.isNull()) if text else None
        if _is(value, (int, float)):
            got = self.column.try_cast("double") if text else self.column
            return got, _literal(value), (self.column.isNotNull() & got.isNull()) if text else None
        if isinstance(self.kind, T.NumericType):
            want = _shown(value).try_cast("double")
            return self.column, want, want.isNull()
        return _text(self.column.cast("string"), self.ignore_case), _text(_shown(value), self.ignore_case), None

    def equal(self, value) -> Column:
        got, want, unread = self.both(value)
        if unread is None:
            return got == want
        plain = _text(self.column.cast("string"), self.ignore_case) == _text(_shown(value), self.ignore_case)
        return F.when(unread, plain).otherwise(got == want)

    def among(self, values: Parameter) -> Column:
        """Whether the field equals one of many values of a column."""
        if isinstance(self.kind, T.StringType) and values.kind is str:
            return F.array_contains(values.column, _text(self.column, self.ignore_case))  # the values have this case
        if not isinstance(self.kind, (T.StringType, T.BooleanType, T.TimestampType)) and values.kind is not str:
            return F.array_contains(values.column, self.column.cast("long")) & (self.column.cast("long") == self.column)
        return F.exists(values.column, lambda w: _false(self.equal(Parameter(values.kind, w, w.cast("string")))))


def _subnet(column: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4:
        low, number = int(net.network_address), ipv4_number(F.trim(column))
        return number.between(low, low + net.num_addresses - 1)

    high, low = ipv6_halves(F.trim(column.cast("string")))
    halves = lambda n: ((int(n) >> 64) - (1 << 63), (int(n) & (1 << 64) - 1) - (1 << 63))  # noqa: E731  signed order
    (first_high, first_low), (last_high, last_low) = halves(net.network_address), halves(net.broadcast_address)
    if net.prefixlen <= 64:
        return high.between(first_high, last_high)
    return (high == first_high) & low.between(first_low, last_low)


def _leaf(p: Predicate, df: DataFrame) -> tuple[Column, Column | None]:
    """(condition, where null means false; error, None where there can be none) of a comparison."""
    column = resolve(df, p.field)
    kind = df.select(column.alias("x")).schema["x"].dataType
    v = p.values[0] if p.values else None
    if p.operator in ("IsNull", "IsNotNull"):
        return column.isNull() if p.operator == "IsNull" else column.isNotNull(), None
    if isinstance(kind, T.ArrayType):
        item = lambda x: _false(_Leaf(x, kind.elementType, p.ignore_case).equal(v))
        if p.operator in ("Equal", "Contains"):
            return F.exists(column, item), None
        if p.operator == "NotEqual":
            return F.when(column.isNull(), F.lit(v is not None)).otherwise(F.exists(column, lambda x: ~item(x))), None
        if p.operator in ("In", "NotIn") and isinstance(v, Parameter):
            hit = _false(F.exists(column, lambda x: _false(_Leaf(x, kind.elementType, p.ignore_case).among(v))))
            return hit if p.operator == "In" else ~hit, None
        if p.operator in ("In", "NotIn"):
            hit = _false(F.exists(column, lambda x: reduce(lambda a, b: a | b, [_false(_Leaf(x, kind.elementType, p.ignore_case).equal(w)) for w in p.values])))
            return hit if p.operator == "In" else ~hit, None
        raise ValueError(f"{p.operator} does not take the array {p.field}")
    leaf = _Leaf(column, kind, p.ignore_case)
    if p.operator == "Equal":
        return (F.lit(False) if v is None else leaf.equal(v)), None
    if p.operator == "NotEqual":
        return (column.isNotNull() if v is None else F.when(column.isNull(), True).otherwise(~_false(leaf.equal(v)))), None
    if p.operator in ("In", "NotIn") and isinstance(v, Parameter):
        hit = leaf.among(v)
        return hit if p.operator == "In" else ~_false(hit), None
    if p.operator in ("In", "NotIn"):
        some = [w for w in p.values if w is not None]
        if isinstance(kind, T.StringType) and all(isinstance(w, str) for w in some):
            hit = _text(column, p.ignore_case).isin([w.upper() if p.ignore_case else w for w in some])
        elif not isinstance(kind, T.StringType) and all(type(w) in (int, float) for w in some):
            hit = column.isin(some)
        else:
            hit = reduce(lambda a, b: a | b, [leaf.equal(w) for w in some], F.lit(False))
        if None in p.values:
            hit = hit | column.isNull()
        return hit if p.operator == "In" else ~_false(hit), None
    text = column.cast("string")
    if p.operator in ("Contains", "StartsWith", "EndsWith"):
        test = {"Contains": "contains", "StartsWith": "startswith", "EndsWith": "endswith"}[p.operator]
        return getattr(_text(text, p.ignore_case), test)(_text(_shown(v), p.ignore_case)), None
    if p.operator in ("MatchesWildcard", "MatchesRegex"):
        if isinstance(v, Parameter):
            return F.rlike(text, v.column), None
        pattern = wildcard_regex(v) if p.operator == "MatchesWildcard" else v
        return text.rlike(("(?i)" if p.ignore_case else "") + pattern), None
    if p.operator == "InSubnet":
        return _subnet(column, v), None
    got, want, unread = leaf.both(v)
    return {"GreaterThan": got > want, "GreaterThanOrEqual": got >= want, "LessThan": got < want, "LessThanOrEqual": got <= want}[p.operator], unread


def _or(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a | b


def _built(p: Predicate, df: DataFrame) -> tuple[Column, Column | None]:
    """(condition, error) of a tree, both two-valued; an error counts if evaluation, left to right, gets to it."""
    if p.kind == "Comparison":
        condition, error = _leaf(p, df)
        return _false(condition), None if error is None else _false(error)
    parts = [_built(c, df) for c in p.children]
    if p.kind == "Not":
        return ~parts[0][0], parts[0][1]
    condition, error = parts[0]
    for c, e in parts[1:]:
        if e is not None:
            error = _or(error, (condition if p.kind == "All" else ~condition) & e)
        condition = condition & c if p.kind == "All" else condition | c
    return condition, error


def _filter(p: Predicate, df: DataFrame) -> Column:
    """The condition for a filter, where null and false are one: conjuncts stay plain, so that they reach the scan."""
    if p.kind == "Comparison":
        texts = [v for v in p.values if isinstance(v, str)]
        if p.operator in ("Equal", "In") and p.ignore_case and len(texts) == len(p.values):
            column = resolve(df, p.field)
            if p.field.lower() == "type" and "type_key" in df.columns:  # a store keeps the type in capitals
                return F.col("type_key").isin([v.upper() for v in texts])
            if isinstance(df.select(column.alias("x")).schema["x"].dataType, T.StringType):
                return folded_in(column, texts)
        return _leaf(p, df)[0]
    if p.kind == "Not":
        return ~_built(p.children[0], df)[0]
    return reduce(lambda a, b: a & b if p.kind == "All" else a | b, [_filter(c, df) for c in p.children])


def compile_predicate(p: Predicate, df: DataFrame) -> Column:
    """One two-valued column for ``df``."""
    validate(p)
    condition, error = _built(p, df)
    return condition if error is None else condition & ~error


def pattern_of(p: Predicate) -> str:
    """The regular expression of a MatchesWildcard or MatchesRegex leaf, as a parameter brings it."""
    return ("(?i)" if p.ignore_case else "") + (wildcard_regex(p.values[0]) if p.operator == "MatchesWildcard" else p.values[0])


def compile_shape(p: Predicate, df: DataFrame) -> Column:
    """``compile_predicate`` of a tree whose values may be parameters; the trees that they stand for were validated."""
    condition, error = _built(p, df)
    return condition if error is None else condition & ~error


def compile_with_error(p: Predicate, df: DataFrame) -> tuple[Column, Column]:
    """(condition, error) for callers that report errors instead of dropping rows."""
    validate(p)
    condition, error = _built(p, df)
    return condition, F.lit(False) if error is None else error


def where(df: DataFrame, p: Predicate) -> DataFrame:
    """The rows that match."""
    validate(p)
    error = _built(p, df)[1]
    return df.where(_filter(p, df)) if error is None else df.where(compile_predicate(p, df))


def guaranteed(p: Predicate, field: str) -> frozenset | None:
    """The values of ``field`` that the predicate allows at most; None if any may pass."""
    if p.kind == "Comparison" and p.field.lower() == field.lower() and p.operator in ("Equal", "In"):
        return frozenset(p.values)
    if p.kind == "All":
        sets = [s for c in p.children if (s := guaranteed(c, field)) is not None]
        return frozenset.intersection(*sets) if sets else None
    if p.kind == "Any":
        sets = [guaranteed(c, field) for c in p.children]
        return None if None in sets else frozenset.union(*sets)
    return None
