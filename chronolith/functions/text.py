"""Text functions over columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard_regex(pattern: str) -> str:
    """A Java regex for a shell-style wildcard: ``*``, ``?``, ``[a-z]`` sets and backtick escapes, over the whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "`" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out.append(f"[{inside}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def blank_to_empty(text: Column) -> Column:
    """Trimmed text; null and the placeholder ``-`` become empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "-", "").otherwise(t)


def account_domain(text: Column) -> Column:
    """``DOMAIN`` of ``DOMAIN\\user``; null unless the separator is inside."""
    at = F.instr(text, "\\")
    return F.when((at > 1) & (at < F.length(text)), F.substring_index(text, "\\", 1))


def account_user(text: Column) -> Column:
    """``user`` of ``DOMAIN\\user``; the whole text if the separator is not inside."""
    at = F.instr(text, "\\")
    return F.when((at > 1) & (at < F.length(text)), F.substring(text, at + 1, F.length(text))).otherwise(text)


def compose_account(domain: Column, user: Column) -> Column:
    """``domain\\user``, or what there is of it; null if neither."""
    d, u = (F.when(blank_to_empty(c) != "", blank_to_empty(c)) for c in (domain, user))
    return F.nullif(F.concat_ws("\\", d, u), F.lit(""))


def message_subject(text: Column) -> Column:
    """The first paragraph."""
    return F.trim(F.get(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n"), F.lit(0)))


def message_line(text: Column, number: int) -> Column:
    """A line, counted from 0; null beyond the end."""
    return F.get(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), F.lit(number))


def key_value_lines(text: Column, between: str = ":") -> Column:
    """A map of the ``key: value`` lines; keys and values trimmed, the first of equal keys stays."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.instr(x, between) > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, between, 1)).alias("key"), F.trim(F.substring(x, F.instr(x, between) + len(between), F.length(x))).alias("value")))
    first = F.aggregate(pairs, F.filter(pairs, lambda _: F.lit(False)), lambda seen, p: F.when(F.exists(seen, lambda s: s["key"] == p["key"]), seen).otherwise(F.concat(seen, F.array(p))))
    return F.map_from_entries(first)


def snake_case(name: str) -> str:
    """``SubjectUserName`` and ``IPAddress`` as ``subject_user_name`` and ``ip_address``."""
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()


def split_words(text: Column) -> Column:
    """An identifier with spaces between its words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-\s]+", " "))


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis if something went."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def longest(*texts: Column) -> Column:
    """The longest text, the first of equals."""
    best = F.array_sort(F.transform(F.array(*[F.struct((-F.length(F.coalesce(t, F.lit("")))).alias("n"), F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate(texts)]), lambda x: x))
    return F.get(best, F.lit(0))["t"]


def distinct_values(text: Column) -> Column:
    """A multi-valued text, split at newlines or ``;``: trimmed, distinct ignoring case, sorted."""
    parts = F.filter(F.transform(F.split(text, r"[\n;]"), lambda x: F.trim(x)), lambda x: x != "")
    keyed = F.map_from_entries(F.transform(F.array_distinct(F.transform(parts, F.upper)), lambda u: F.struct(u.alias("key"), F.get(F.filter(parts, lambda p: F.upper(p) == u), F.lit(0)).alias("value"))))
    return F.transform(F.array_sort(F.map_keys(keyed)), lambda u: F.element_at(keyed, u))


def normalize_ip(text: Column) -> Column:
    """``::1`` and IPv4-mapped addresses in plain form."""
    return F.when(text == "::1", "127.0.0.1").otherwise(F.regexp_replace(text, r"^(?i)::ffff:(?=\d+\.\d+\.\d+\.\d+$)", ""))


def correlation_id(*parts: Column) -> Column:
    """16 hex digits that identify a tuple of texts."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 16)


def joined_values(first: Column, second: Column, between: str = "\\", swapped: bool = False) -> Column:
    """Two payload values with a separator, in either order; the one that is there if the other is null; empty if both are."""
    both = F.concat(second, F.lit(between), first) if swapped else F.concat(first, F.lit(between), second)
    return F.coalesce(both, first, second, F.lit(""))


def contains_all(text: Column, *parts: str) -> Column:
    """Whether a text holds every part, without case; a null text holds none."""
    folded = F.upper(text)
    out = F.lit(True)
    for p in parts:
        out = out & folded.contains(p.upper())
    return F.coalesce(out, F.lit(False))


def snake_keys(payload: Column) -> Column:
    """A payload map with its keys in snake case; of keys that become equal the first stays."""
    words = lambda k: F.regexp_replace(F.regexp_replace(k, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    entries = F.transform(F.map_entries(payload), lambda e: F.struct(F.lower(F.trim(F.regexp_replace(words(e["key"]), r"[^A-Za-z0-9]+", "_"), F.lit("_"))).alias("key"), e["value"].alias("value")))
    first = F.aggregate(entries, F.filter(entries, lambda _: F.lit(False)), lambda seen, e: F.when(F.exists(seen, lambda x: x["key"] == e["key"]), seen).otherwise(F.concat(seen, F.array(e))))
    return F.map_from_entries(first)


@lru_cache(1)
def latin_pairs() -> dict[str, str]:
    """Letter and mark to the letter that composes them, by Unicode's own data, for Latin letters."""
    out = {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
            out["".join(chr(int(x, 16)) for x in parts)] = c
    return out


#: Marks that compose with Latin letters lie here; a text without characters from here on is composed as it is.
_MARKS = "[\u0300-\u036f]"


def composed(column: Column) -> Column:
    """A text with Latin letters and the marks behind them composed, up to two marks a letter; no other text changes."""
    pairs = F.create_map(*[F.lit(x) for pair in sorted(latin_pairs().items()) for x in pair])

    def once(text: Column) -> Column:
        met = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(\\p{{IsLatin}}{_MARKS})"), F.lit(1)))
        return F.aggregate(met, text, lambda made, pair: F.replace(made, pair, F.coalesce(F.element_at(pairs, pair), pair)))

    return F.when(column.rlike(_MARKS), once(once(column))).otherwise(column)


def nfc(column: Column) -> Column:
    """Unicode's composed form of any text; only texts with characters from U+0300 on go to Python with a value."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    beyond = column.rlike("[^\u0000-\u02ff]")
    return F.when(beyond, made(F.when(beyond, column))).otherwise(column)


def _indent(script: str) -> str:
    """Depth is the running sum of braces, raised by its own lowest point: it never falls below 0."""
    lines = [x.strip() for x in script.replace("\r", "").split("\n")]
    opened = np.array([0] + [x.endswith("{") for x in lines[:-1]], dtype=np.int64)
    depth = np.cumsum(opened - np.array([x.startswith("}") for x in lines], dtype=np.int64))
    depth -= np.minimum(np.minimum.accumulate(depth), 0)
    return "".join(f"{'    ' * n}{x}\n" for n, x in zip(depth.tolist(), lines))


def indented(column: Column) -> Column:
    """A script with each line trimmed, four spaces for each brace that is open before it, and a newline behind it; null stays null."""

    @F.pandas_udf("string")
    def run(scripts: pd.Series) -> pd.Series:
        return scripts.map(_indent, na_action="ignore")

    return run(column)
